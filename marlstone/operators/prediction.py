"""Grades by written criteria and by earlier cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import cosines, directed, first_of, matrix, meet

# Criteria looked at, what is said of a grade and of the change of one.
CRITERIA = 6
#: Queries whose scores against a block are held at once, so blocks of many queries are bounded and what they meet is sent few times.
ASKED = 64
#: Criteria, cases and queries of a block; words whose places in a block are kept.
ROWS, CASES, QUERIES, WORDS = 16_384, 8192, 8192, 2048
RATIONALE = "인정 상이처 '%s'에 대하여 제출된 진단서, 해당 진료과목 전문의의 신체검사 소견을 종합하여 살펴보건대, 이는 「국가유공자 등 예우 및 지원에 관한 법률 시행령」 [별표3] 상이등급구분표 %s호 \"%s\"에 부합하는 것으로 판단되어 상이등급 '%s %s호'에 해당함."
BELOW, RAISED, UP, DOWN, KEEP = "등급기준미달", "승급(기준미달→등급)", "승급", "하향", "직전등급 유지"
NO_GRADE = 99


def updown(before: Column, proposed: Column) -> Column:
    """What a proposed severity means after the one before (1 the worst, 99 none): null if neither is a grade."""
    return F.when(proposed == NO_GRADE, F.when(before < NO_GRADE, BELOW)).when(before == NO_GRADE, RAISED).when(proposed < before, UP).when(proposed > before, DOWN).otherwise(KEEP)


def score_criteria(queries: DataFrame, criteria: DataFrame, most: int = CRITERIA) -> DataFrame:
    """The best criteria of each query: letters of its different words that stand in the text, plus the cosine.

    queries: id, disease, body_part (null: any), embedding; criteria: class_no, grade, body_part, description, embedding. A query meets
    all criteria of its body part; one without meets each part's. Returns id, r, class_no, grade, description, similarity.
    Criteria of one part, vector and text have the same score for any query, so only their first `most` by number and grade are met, and a
    block scores them once. Cosines are matrix products of blocks (nearest.meet), and a word is looked for in the different texts of a
    block; a vector without a direction finds nothing and isn't found.
    """
    parts = criteria.where("body_part IS NOT NULL").agg(F.collect_set("body_part").alias("every"))  # one row
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("disease", F.lit("")), F.lit("[가-힣A-Za-z0-9]{2,}"), 0)).alias("words")
    of = F.explode(F.when(F.col("body_part").isNull(), F.col("every")).otherwise(F.array("body_part"))).alias("body_part")
    asked = queries.where(directed("embedding")).join(F.broadcast(parts)).select(F.col("id").cast("long"), words, "embedding", of)
    known = criteria.where(directed("embedding")).select(F.col("class_no").cast("long"), "grade", "body_part", "description", "embedding")
    alike = Window.partitionBy(F.xxhash64("embedding"), "body_part", "description", "embedding").orderBy("class_no", "grade")  # a number sorts faster than vectors
    known = known.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= most).drop("n")

    def run(r: pa.Table, q: pa.Table) -> pa.Table:
        vectors, spoken = matrix(r["embedding"]), [tuple(x or ()) for x in q["words"].to_pylist()]
        class_no, grade, text = (np.array(r[c].to_pylist(), kind) for c, kind in (("class_no", np.int64), ("grade", object), ("description", object)))
        ties = [class_no, *(np.unique([v or "" for v in c], return_inverse=True)[1] if len(c) else np.zeros(0, int) for c in (grade, text))]
        different, said_at = np.unique([t or "" for t in text], return_inverse=True)
        different = different.tolist()
        kinds: dict[tuple[int, bytes], list[int]] = {}  # rows of one text and vector, in order
        for i in np.lexsort(ties[::-1]):
            kinds.setdefault((said_at[i], vectors[i].tobytes()), []).append(i)
        members = [np.array(x) for x in kinds.values()]
        lead = np.array([x[0] for x in members], int)
        against, said_at, order = vectors[lead], said_at[lead], [t[lead] for t in ties]
        held: dict[str, np.ndarray] = {}

        def letters(words: tuple[str, ...]) -> np.ndarray:
            total = np.zeros(len(different))
            for w in words:
                if w not in held:
                    if len(held) >= WORDS:
                        held.clear()
                    held[w] = np.fromiter((w in t for t in different), bool, len(different))
                total += len(w) * held[w]
            return total[said_at]

        best, scores = [], []
        for a in range(0, len(spoken), ASKED):  # the scores of a few queries are held at once
            few = spoken[a : a + ASKED]
            counted = {x: letters(x) for x in set(few)}
            for x, near in zip(few, cosines(matrix(q["embedding"].slice(a, len(few))), against), strict=True):
                s = np.round(counted[x] + near, 4)
                first = first_of([-s, *order], most)  # a row among the first is of a kind among the first
                rows = np.concatenate([members[k] for k in first])
                of = np.repeat(s[first], [len(members[k]) for k in first])
                pick = first_of([-of, *(t[rows] for t in ties)], most)
                best.append(rows[pick])
                scores.append(of[pick])
        at = np.concatenate(best) if best else np.zeros(0, int)
        by = np.repeat(np.arange(len(best)), [len(x) for x in best])
        return pa.table({"id": pa.array(q["id"].to_numpy()[by]), "class_no": pa.array(class_no[at]), "grade": pa.array(grade[at], pa.string()), "description": pa.array(text[at], pa.string()), "similarity": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    rows = meet(known, F.struct("embedding", "description"), asked, F.col("id"), run, "id long, class_no long, grade string, description string, similarity double", keys=["body_part"], rows_each=ROWS, queries_each=QUERIES)
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "class_no", "grade", "description")
    return rows.withColumn("r", F.row_number().over(order).cast("long")).where(F.col("r") <= most).select("id", "r", "class_no", "grade", "description", "similarity")


def similar_cases(queries: DataFrame, cases: DataFrame, most: int = 5) -> DataFrame:
    """The nearest cases of each query, those of its body part first: id, r, case_id, grade, similarity.

    queries: id, body_part, embedding; cases: case_id, body_part, grade, embedding. As in the order of booleans with nulls first,
    a case without body part comes before all others. Only cases that may come among the first `most` are met: where enough have no body part, those;
    where a query's own part has enough with them, these two; else all. Cosines are matrix products of blocks, each of which keeps its best
    `most` of a query; a vector without a direction finds nothing and isn't found. The frames are counted when this one is built.
    """
    schema = "id long, first long, case_id long, grade string, similarity double"

    def met(known: DataFrame, asked: DataFrame, tier: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
        """The best of each block; tier: what comes first is the same for all its cases and queries."""

        def run(r: pa.Table, q: pa.Table) -> pa.Table:
            against, own = matrix(r["embedding"]), q["part"].to_pylist()
            part, grade = np.array(r["part"].to_pylist(), object), np.array(r["grade"].to_pylist(), object)
            ids, none = r["case_id"].to_numpy(), np.equal(part, None)
            out = []
            for a in range(0, len(own), ASKED):  # the scores of a few queries are held at once
                few = own[a : a + ASKED]
                for s, part_of in zip(np.round(cosines(matrix(q["embedding"].slice(a, len(few))), against), 4), few, strict=True):
                    first = np.where(none, 2, np.equal(part, part_of).astype(int)) if tier is None else None
                    best = first_of([-s, ids] if tier is not None else [-first, -s, ids], most)
                    out.append((first[best] if tier is None else np.full(len(best), tier), ids[best], best, s[best]))
            size = [len(x[0]) for x in out]
            flat = lambda i, kind: np.concatenate([x[i] for x in out]) if out else np.zeros(0, kind)
            return pa.table({"id": pa.array(np.repeat(q["id"].to_numpy(), size)), "first": pa.array(flat(0, np.int64)), "case_id": pa.array(flat(1, np.int64)), "grade": pa.array(grade[flat(2, np.int64)], pa.string()), "similarity": pa.array(flat(3, np.float64))})

        return meet(known, F.col("case_id"), asked, F.col("id"), run, schema, keys=keys, rows_each=CASES, queries_each=QUERIES)

    asked = queries.where(directed("embedding")).select(F.col("id").cast("long"), F.coalesce("body_part", F.lit("")).alias("part"), "embedding")
    known = cases.where(directed("embedding")).select(F.col("case_id").cast("long"), F.col("body_part").alias("part"), "grade", "embedding")
    bare, named = known.where("part IS NULL"), known.where("part IS NOT NULL")
    lacking = most - bare.count()
    if lacking <= 0:
        rows = met(bare, asked, 2)
    else:
        full = named.groupBy("part").count().where(F.col("count") >= lacking).select("part")
        own, rest = asked.join(full, "part", "left_semi"), asked.join(full, "part", "left_anti")
        rows = met(bare, own, 2).unionByName(met(named, own, 1, ("part",))).unionByName(met(known, rest))
    order = Window.partitionBy("id").orderBy(F.desc("first"), F.desc("similarity"), "case_id")
    return rows.withColumn("r", F.row_number().over(order).cast("long")).where(F.col("r") <= most).select("id", "r", "case_id", "grade", "similarity")


def picked_cases(near: DataFrame, cases: DataFrame, picks: DataFrame, left_out: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """near (id, r, case_id, grade, similarity) as a person's picks (id, case_id, kind, weight) want it: excluded cases go, pinned ones come
    first by weight, then by similarity; a pinned case that isn't near comes with no similarity. r counts anew.

    left_out: sets of cases that a question excludes (id, case_set), and the cases of each set (case_id, case_set). Only near cases are
    looked up in them, so a set that many questions exclude isn't a row for each question and case."""
    kept = near.join(picks.where("kind = 'exclude'").select("id", "case_id"), ["id", "case_id"], "left_anti")
    if left_out is not None:
        asked, held = left_out
        listed = lambda df, key, name: df.groupBy(key).agg(F.collect_set("case_set").alias(name))
        kept = kept.join(listed(held, "case_id", "held"), "case_id", "left").join(listed(asked, "id", "out"), "id", "left")
        kept = kept.where(~F.coalesce(F.arrays_overlap("held", "out"), F.lit(False))).drop("held", "out")
    pins = picks.where("kind = 'pin'").groupBy("id", "case_id").agg(F.max("weight").alias("weight"))
    pins = pins.join(cases.select(F.col("case_id").cast("long").alias("case_id"), F.col("grade").alias("own")), "case_id").join(near.select("id").distinct(), "id", "left_semi")
    rows = kept.join(pins, ["id", "case_id"], "full")
    order = [F.col("own").isNull(), F.desc_nulls_last("weight"), F.desc_nulls_last("similarity"), F.asc_nulls_last("r"), "case_id"]
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order)).cast("long")
    return rows.withColumn("place", place).select("id", F.col("place").alias("r"), "case_id", F.coalesce("grade", "own").alias("grade"), "similarity")


def predict(queries: DataFrame, criteria: DataFrame, cases: DataFrame, picks: DataFrame | None = None, left_out: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, grade1, grade2, rationale: the best criterion's grade and that of the next with another grade or number; where there are no
    criteria for a body part, the grades with the largest sums of similarity among near cases (of equals the nearer), without
    rationale. picks (id, case_id, kind, weight), and with them left_out, are applied to the near cases first (see picked_cases); a case
    without similarity adds nothing to a sum.

    Which queries the cases decide follows from the body parts alone, so each score is worked out once.
    """
    parts = criteria.where(directed("embedding") & F.col("body_part").isNotNull()).select("body_part").distinct()
    scored = queries.where(directed("embedding")).select("id", F.col("body_part").alias("asked"))
    met = scored.join(parts, F.col("asked").isNull() | (F.col("asked") == F.col("body_part")), "left_semi")
    item = F.struct("r", "grade", "class_no", "description")
    best = score_criteria(queries, criteria).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    top = F.get("c", F.lit(0))
    other = F.get(F.filter("c", lambda x: (x["grade"] != top["grade"]) | (x["class_no"] != top["class_no"])), F.lit(0))
    named = lambda c: F.concat(c["grade"], F.lit(" "), c["class_no"].cast("string"), F.lit("호"))
    number = top["class_no"].cast("string")
    text = F.format_string(RATIONALE, "disease", number, top["description"], top["grade"], number)
    by_criteria = queries.select("id", "disease").join(best, "id").select("id", named(top).alias("grade1"), named(other).alias("grade2"), text.alias("rationale"))
    rest = queries.join(met, "id", "left_anti").select("id", "body_part", "embedding")
    near = similar_cases(rest, cases)
    if picks is not None:
        near = picked_cases(near, cases, picks, left_out)
    sums = near.groupBy("id", "grade").agg(F.sum(F.coalesce("similarity", F.lit(0.0))).alias("s"), F.min("r").alias("r"))
    votes = sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "r", "grade"))).alias("g"))
    voted = rest.select("id").join(votes, "id", "left").select("id", F.get("g", F.lit(0))["grade"].alias("grade1"), F.get("g", F.lit(1))["grade"].alias("grade2"), F.lit(None).cast("string").alias("rationale"))
    return by_criteria.unionByName(voted)


def audiometry(a: Column, b: Column, c: Column, d: Column, threshold: int = 26) -> Column:
    """struct(loss, impaired): the six-part mean of four tones, and whether it reaches the threshold."""
    loss = (a + 2 * b + 2 * c + d) / 6
    return F.struct(loss.alias("loss"), (loss >= threshold).alias("impaired"))
