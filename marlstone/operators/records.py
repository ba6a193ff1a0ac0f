"""Boards, chat sessions, the file register of a case, field accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import new_only


def threads(posts: DataFrame) -> DataFrame:
    """Posts (id, parent_id, ...) that answer none, each with its replies (array of structs of the other columns, by id); sorted by id
    downwards they are the board. A reply to a reply, or to nothing that is held, is left out."""
    rest = ["id", *(c for c in posts.columns if c not in ("id", "parent_id"))]
    roots = posts.where("parent_id IS NULL").drop("parent_id")
    replies = posts.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("replies"))
    none = F.array().cast(dict(replies.dtypes)["replies"])
    return roots.join(replies, "id", "left").withColumn("replies", F.coalesce("replies", none))


# What is kept of a source, letters of a title.
SOURCE = ("doc_id", "source_path", "page_no", "content", "block_type")
TITLE = 60


def exchanges(messages: DataFrame, batch: DataFrame) -> DataFrame:
    """New messages (session, seq, role, content, sources) of question and answer pairs (session, at, question, answer, sources).

    A session's numbers go on behind its largest; pairs of one batch follow each other by at. Of a source the fields of SOURCE
    stay, missing ones as null.
    """
    last = messages.groupBy("session").agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("at"))
    rows = batch.withColumn("place", place).join(last, "session", "left")
    at = (F.coalesce("last", F.lit(0)) + 2 * F.col("place") - 1).cast("long")
    held = set(batch.schema["sources"].dataType.elementType.names)
    project = lambda s: F.struct(*[(s[c].cast("string") if c in held else F.lit(None).cast("string")).alias(c) for c in SOURCE])
    kept = F.transform("sources", project)
    said = lambda seq, role, text, sources: F.struct(seq.alias("seq"), F.lit(role).alias("role"), text.alias("content"), sources.alias("sources"))
    none = F.lit(None).cast("array<struct<" + ",".join(f"{c}:string" for c in SOURCE) + ">>")
    return rows.select("session", F.inline(F.array(said(at, "user", F.col("question"), none), said(at + 1, "ai", F.col("answer"), kept))))


def new_sessions(held: DataFrame, batch: DataFrame) -> DataFrame:
    """(session, title) of sessions that aren't held: their first question, cut."""
    first = batch.groupBy("session").agg(F.substring(F.min_by("question", "at"), 1, TITLE).alias("title"))
    return new_only(first, held, ["session"])


# The register's kinds and titles, records that are final at once, lengths.
APPLICATION, SERVICE, FACTS, MEDICAL, OFFICIAL, SCAN = "신청서", "병적", "요건사실확인서", "의무기록", "공적서류", "스캔 원문"
APPLICATION_TITLE, SERVICE_TITLE, FACTS_TITLE = "1-1 신청서·요건발급요청서", "1-4 병적증명서·인사자력표", "1-4 요건사실확인서 — "
FINAL_RECORDS, NO_DAY, TITLE_CHARS, NOTE_CHARS = ("영상", "수술"), "일자미상", 200, 150


def register(cases: DataFrame, items: DataFrame, records: DataFrame, officials: DataFrame, scans: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The files of cases: app_id, dis_id, kind, title, note, file_name, file_path, is_final; what is held stays as it is.

    cases: app_id; items: app_id, dis_id, name; records: dis_id, hospital, rec_type, rec_date, diagnosis, finding; officials: app_id,
    dis_id, doc_kind, doc_date, issuer, content; scans: app_id, doc_kind, file_name, orig_path. One row a case, item (none
    equals 0), kind and title; of several the least note and file name.
    """
    none, text = F.lit(None).cast("string"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = lambda df, kind, title, dis=None, note=none, name=none, path=none, final=F.lit(False): df.select(
        F.col("app_id").cast("long").alias("app_id"), (F.col(dis) if dis else F.lit(None)).cast("long").alias("dis_id"), F.lit(kind).alias("kind"), F.substring(title, 1, TITLE_CHARS).alias("title"),
        F.substring(note, 1, NOTE_CHARS).alias("note"), name.alias("file_name"), path.alias("file_path"), final.alias("is_final"),
    )
    of_items = records.join(items.select("app_id", "dis_id"), "dis_id")
    yes = F.lit(True)
    parts = [
        named(cases, APPLICATION, F.lit(APPLICATION_TITLE), final=yes), named(cases, SERVICE, F.lit(SERVICE_TITLE), final=yes),
        named(items, FACTS, F.concat(F.lit(FACTS_TITLE), text("name")), "dis_id", final=yes),
        named(of_items, MEDICAL, F.concat(text("hospital"), F.lit(" "), text("rec_type"), F.lit(" ("), F.coalesce(F.col("rec_date").cast("string"), F.lit(NO_DAY)), F.lit(")")), "dis_id", F.coalesce(F.nullif("diagnosis", F.lit("")), F.col("finding"), F.lit("")), final=F.coalesce(F.col("rec_type").isin(*FINAL_RECORDS), F.lit(False))),
        named(officials, OFFICIAL, F.trim(F.concat(text("doc_kind"), F.lit(" ("), text("doc_date"), F.lit(" "), text("issuer"), F.lit(")"))), "dis_id", text("content")),
        named(scans, SCAN, F.concat(text("doc_kind"), F.lit(" — "), text("file_name")), name=F.col("file_name"), path=F.col("orig_path")),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    key = ["app_id", "item", "kind", "title"]
    rest = F.struct("note", "file_name", "file_path", "is_final", "dis_id")
    rows = both.select("app_id", F.coalesce("dis_id", F.lit(0)).alias("item"), "kind", "title", rest.alias("r"))
    if held is not None:
        old = held.select(F.col("app_id").cast("long").alias("app_id"), F.coalesce("dis_id", F.lit(0)).cast("long").alias("item"), "kind", "title", F.lit(None).cast(rows.schema["r"].dataType).alias("r"))
        rows = rows.unionByName(old)
    # Rows go to their case once: whatever is held of a key stands beside what is new.
    new = rows.repartition("app_id").groupBy(*key).agg(F.min("r").alias("r"), F.bool_or(F.col("r").isNull()).alias("held")).where("NOT held")
    return new.select("app_id", "r.dis_id", "kind", "title", "r.note", "r.file_name", "r.file_path", "r.is_final")


def files_in_order(files: DataFrame) -> DataFrame:
    """A case's files: final ones first, by kind, then by title."""
    return files.orderBy("app_id", F.desc("is_final"), "kind", "title")


def field_hits(found: DataFrame, expected: DataFrame, whole: tuple[str, ...] = ("grade",)) -> DataFrame:
    """hit for each expected field (block, field, needles) of what was found (block, field, value): a field of `whole` has to hold all needles,
    any other one of them; a value that is missing is empty."""
    value = F.coalesce("value", F.lit(""))
    has = lambda x: F.contains(value, x)
    hit = F.when(F.col("field").isin(*whole), F.forall("needles", has)).otherwise(F.exists("needles", has))
    return expected.join(found.select("block", "field", "value"), ["block", "field"], "left").select("block", "field", hit.alias("hit"))


def agenda_sources(agendas: DataFrame, contents: DataFrame, types: DataFrame) -> DataFrame:
    """Edges to agendas (agenda, content, type): from their content, else from their type, else from themselves; contents and types have key."""
    rows = agendas.join(contents.select(F.col("key").alias("content"), F.lit(True).alias("c")).distinct(), "content", "left").join(types.select(F.col("key").alias("type"), F.lit(True).alias("t")).distinct(), "type", "left")
    at = lambda a, b, c: F.when(F.col("c"), a).when(F.col("t"), b).otherwise(c)
    kind: Column = at(F.lit("review_content"), F.lit("review_type"), F.lit("agenda"))
    return rows.select(kind.alias("stype"), at(F.col("content"), F.col("type"), F.col("agenda")).alias("skey"), F.lit("HAS_AGENDA").alias("etype"), F.lit("agenda").alias("dtype"), F.col("agenda").alias("dkey"))


def with_profile(rows: DataFrame, key: str, profiles: DataFrame, otherwise: str) -> DataFrame:
    """rows with the columns of the profile (key: text, ...) that their key, as text, names; those of `otherwise` where it is null or nobody's.

    profiles has one row a key. The key is settled first, so the profile is met by one equality.
    """
    known = profiles.select(F.col("key").alias("_known")).distinct()
    asked = rows.withColumn("_asked", F.col(key).cast("string")).join(known, F.col("_asked") == F.col("_known"), "left")
    settled = asked.withColumn("_key", F.coalesce("_known", F.lit(otherwise))).drop("_asked", "_known")
    return settled.join(profiles.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def listed_items(cases: DataFrame, items: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """cases with an array for each of the items' columns, in the items' order, nulls kept in their places; a case without items has one null
    in each, as a left join grouped by case gives it. Items are listed before they are joined."""
    row = F.struct(F.col(order).alias("_order"), *columns)
    listed = items.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_items"))
    none = lambda c: F.array(F.lit(None).cast(items.schema[c].dataType))
    field = lambda c: F.transform("_items", lambda x: x[c])
    found = [F.coalesce(field(c), none(c)).alias(c) for c in columns]
    return cases.join(listed, key, "left").select(*cases.columns, *found)


def nested_size(items: Column) -> Column:
    """How many elements an array of arrays has in all; null arrays have none."""
    return F.aggregate(F.coalesce(items, F.array()), F.lit(0).cast("long"), lambda total, x: total + F.coalesce(F.size(x), F.lit(0)))


def matching_list(rows: DataFrame, said: str | None = None, within: tuple[str, ...] = (), equal: dict | None = None, unanswered: tuple[DataFrame, str] | None = None) -> DataFrame:
    """A list as its filters show it: a word, in any case, in one of some columns; columns that equal a value; rows whose key (answers, key) has
    no answer yet. A filter that isn't given, is empty or None shows all."""
    if said and said.strip():
        word = F.lit(said.strip().lower())
        some = F.lit(False)
        for c in within:
            some = some | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), word), F.lit(False))
        rows = rows.where(some)
    for c, value in (equal or {}).items():
        if value is not None and value != "":
            rows = rows.where(F.col(c) == value)
    if unanswered:
        answers, key = unanswered
        rows = rows.join(answers.select(key).distinct(), key, "left_anti")
    return rows
