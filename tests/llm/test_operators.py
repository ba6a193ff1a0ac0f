"""Every operator against a plain version, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import os
import random
import sys
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, classifier, components, jaccard, licenses, lines, lm, media, mixing, rules, suffixes

SCHEMA = "doc_id long, text string, source string, size long, a long, place string, spans string, n_tokens int, kind int"


def rows():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 8))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = text(90), "Shared line that stands in many of the documents."
    out = []
    for i in range(60):
        t = text(r.randrange(3, 160))
        if i % 4 == 0:
            t = t + " " + passage + " " + text(5)
        if i % 5 == 0:
            t = f"{t}\n  {line.upper() if i % 2 else line}\t\n{text(9)}\n"
        if i % 9 == 0:
            t += "\nLicensed under the MIT License. Also Apache License, Version 2.0 and CC BY-NC 4.0"
        out.append((i, t, f"s{i % 4}" if i % 7 else None))
    base = text(120).split()
    for i in range(60, 84):  # near copies, more than a short list holds
        w = list(base)
        w[(i * 3) % 120] = f"own{i}"
        out.append((i, " ".join(w), "s1"))
    for i in range(84, 96):
        out.append((i, out[0][1] if i % 2 else "De " * 300 + "da " * 200, "s0"))
    out += [(96, None, "s1"), (97, "", None), (98, " \n\t ", "s2"), (99, "ab", "s2"), (100, "x" * 1200 + " end", "s3"), (101, "Über ÄÖ K K \n\n" * 60, "s3"), (102, text(6000), "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, 5, 6, "p", "q", 7, 8) for x in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, and an id with two texts."""
    t = "Some line that is long enough to count here\n" + "word other more text here " * 40
    data = [(None, t, None), (None, None, None), (1, t, "s"), (1, t, "s"), (1, "another text of the same id", "s"), (2, None, "s"), (3, "", None)]
    return spark.createDataFrame([(*x, 5, 6, "p", "q", 7, 8) for x in data], SCHEMA)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


PAIRS = [(d, t) for d, t, _ in rows()]


def test_licenses(docs):
    found = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for d, t in PAIRS:
        r = found[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_notice_with_a_word_put_in(spark):
    text = "x y permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction z"
    r = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.labels) == (0, "mit") and r.score > 0.8


def test_suffixes(docs):
    assert got(suffixes.dedup_spans(docs, keep="none", digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffixes(PAIRS))


def test_suffixes_keep_first(docs):
    found = got(suffixes.dedup_spans(docs, size=60), "doc_id", "kept")
    assert [(d, bytes(k)) for d, k in found] == brute.suffixes_first(PAIRS, 60)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffixes_with_windows_of_large_anchors(docs, keep):
    columns = ["doc_id", "n_removed", "n_spans", "n_shared"]
    plain = got(suffixes.dedup_spans(docs, size=80, keep=keep, passage=50), *columns)
    assert got(suffixes.dedup_spans(docs, size=80, keep=keep, passage=50, bin_bytes=300), *columns) == plain
    assert [(d, n) for d, *_, n in plain] == sorted(brute.shared_bytes(PAIRS, 50))
    without = suffixes.dedup_spans(docs, size=80, keep=keep)
    assert "n_shared" not in without.columns and got(without, *columns[:3]) == [r[:3] for r in plain]


def test_suffixes_over_files(spark, tmp_path):
    """Copies, near copies and short and long passages over many files and partitions, against every window."""
    r = random.Random(8)
    words_ = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(n))
    passages, base = [words_(n) for n in (30, 52, 56, 70, 90, 300)], words_(200)
    data = []
    for i in range(120):
        t = words_(r.randrange(1, 120))
        if i % 3 == 0:
            t += " " + passages[i // 3 % 6] + " " + words_(3)
        if i % 10 == 1:
            w = base.split()
            w[r.randrange(200)] = f"own{i}"
            t = " ".join(w)
        if i % 10 == 2:
            t = data[r.randrange(i - 1)][1]
        data.append((i, t))
    spark.createDataFrame(data, "doc_id long, text string").repartition(37).write.parquet(str(tmp_path / "d"))
    found = suffixes.dedup_spans(spark.read.parquet(str(tmp_path / "d")), keep="none", passage=256, digest=True)
    shared = dict(brute.shared_bytes(data, 256))
    assert sorted(map(tuple, found.collect())) == sorted((*x, shared[x[0]]) for x in brute.suffixes(data))
    long_ = {i for i in range(120) if i % 3 == 0 and i // 3 % 6 > 0 and i % 10 not in (1, 2)}
    assert all(shared[i] for i in long_)


def test_rules(docs):
    found = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    for d, t in PAIRS:
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(t)
        assert r.kept == (not r.base_failed)


def test_rules_reject_depleted(spark):
    data = [(i, "The same long line of every page is here " * 3 + f"\nx{i}", "h") for i in range(40)] + [(99, " ".join(f"w{i}" for i in range(50)), "h")]
    found = rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string"), least=10).collect()
    assert all(r.kept == (r.doc_id == 99) for r in found)
    assert {r.n_left for r in found if r.doc_id < 99} == {1}


def test_rules_reject_depleted_in_hosts_of_any_size(spark):
    """Depleted documents (a shared line is most of the text, some of them copies) among clean ones, with the default limits."""
    r = random.Random(6)
    line = "This shared line of the host stands above the text of every depleted page here."
    own = lambda i, n: " ".join(f"w{i}-{r.randrange(10**9)}" for _ in range(n))
    data, depleted = [], set()
    for host, clean, bad in (("small", 4, 12), ("large", 900, 12), ("hot", 6000, 20), (None, 30, 10)):
        for k in range(clean + bad):
            i = len(data)
            if k < bad:
                depleted.add(i)
                data.append((i, f"{line}\n{line.upper()}  \n" + (own(i, 9) if k % 3 else "the same rest"), host))
            else:  # one clean document in two has the line too
                data.append((i, (f"{line}\n" if k % 2 else "") + own(i, 40), host))
    found = {x.doc_id: x for x in rules.quality_rules(spark.createDataFrame(data, SCHEMA[: SCHEMA.index(", size")]).repartition(4)).collect()}
    assert len(found) == len(data) and {d for d, x in found.items() if not x.kept} == depleted
    assert all(x.n_left == x.n_words - sum(len(y.split()) for y in t.split("\n") if y.strip().lower() == line.lower()) for (d, t, _), x in zip(data, (found[d] for d, _, _ in data), strict=True))


def test_rules_limit_is_the_same_in_every_host(spark):
    """A line in nine documents stays and one in ten goes, whether the host has ten documents or a thousand; rows of one id count once."""
    one = lambda host, i: f"{host} heading line\n" + " ".join(f"w{i}-{k}" for k in range(30))
    data = []
    for host, have, more in (("nine", 9, 0), ("ten", 10, 0), ("nine of many", 9, 1000), ("ten of many", 10, 1000)):
        data += [(len(data) + k, one(host, len(data) + k), host) for k in range(have)]
        data += [(len(data) + k, " ".join(f"w{len(data)}-{k}-{j}" for j in range(30)), host) for k in range(more)]
    data += [(-1, one("repeated", k), "repeated") for k in range(20)] + [(None, one("unnamed", k), "unnamed") for k in range(10)]
    found = rules.boilerplate(spark.createDataFrame(data, SCHEMA[: SCHEMA.index(", size")])).collect()
    assert sorted((x.host, x.n_docs) for x in found) == [("ten", 10), ("ten of many", 10), ("unnamed", 10)]


def test_lines(docs):
    assert got(lines.dedup_lines(docs, digest=True), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.lines(PAIRS))


def test_line_index_is_reversible(docs):
    one, two = docs.where("doc_id < 50"), docs.where("doc_id >= 50")
    index = lines.LineIndex.build(one, shards=3)
    more = index.insert(two)
    assert got(more.droppable(), "a", "b", "keep") == got(lines.LineIndex.build(docs).droppable(), "a", "b", "keep")
    assert got(lines.dedup_lines(docs, more, digest=True), "doc_id", "kept_sha256") == [(d, s) for d, _, _, s in sorted(brute.lines(PAIRS))]
    back = more.delete(two.select("doc_id"))
    assert got(back.refs, "a", "b", "doc_id") == got(index.refs, "a", "b", "doc_id")
    assert got(lines.dedup_lines(one, back, digest=True), "doc_id", "kept_sha256") == got(lines.dedup_lines(one, index, digest=True), "doc_id", "kept_sha256")


def test_line_filters_work_beyond_the_size_sent(docs, monkeypatch):
    """Dealt by shard, the filters let the same rows pass as when they are sent, far fewer than all, and the result is exact."""
    index = lines.LineIndex.build(docs, shards=3)
    sent = got(index.candidates(docs), "a", "b", "doc_id")
    monkeypatch.setattr(lines, "SEND_BYTES", 0)
    monkeypatch.setattr(lines, "GROUP_ROWS", 20)
    assert got(index.candidates(docs), "a", "b", "doc_id") == sent and 0 < len(sent) < lines.references(docs).count() / 2
    assert got(lines.dedup_lines(docs, index, digest=True), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.lines(PAIRS))


def test_cuckoo():
    import numpy as np

    from marlstone.llm.cuckoo import CuckooFilter

    r = random.Random(1)
    keys = [r.getrandbits(64) for _ in range(5000)]
    f = CuckooFilter.from_bytes(CuckooFilter.of(keys).to_bytes())
    assert f.contains(np.array(keys, np.uint64)).all()
    assert f.contains(np.array([r.getrandbits(64) for _ in range(20_000)], np.uint64)).mean() < 0.002
    assert all(f.delete(k) for k in keys) and not f.table.any()


def test_jaccard(docs):
    assert got(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(PAIRS))


def test_jaccard_lists_are_met_by_numbers(spark, monkeypatch):
    """What rows of long lists carry through the join is an array of small numbers, not of hashes; all links of different components are found."""
    common = " ".join(f"c{j}" for j in range(60))
    data = [(10 * g + k, f"{common} " + " ".join(f"g{g}x{j}" for j in range(3 + g % 4 + k))) for g in range(12) for k in range(2)] + [(500 + g, f"{common} " + " ".join(f"u{g}v{j}" for j in range(40))) for g in range(12)]
    kept, put = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: kept.append(put(df)) or kept[-1])
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(data))
    listed = [x for x in kept if "grams" in x.columns]
    assert len(listed) == 1 and listed[0].schema["grams"].dataType.simpleString() == "array<int>" and not listed[0].isEmpty()


def test_jaccard_long_lists(spark):
    """Groups around a base whose members link with it but not always with each other, and chains."""
    r = random.Random(3)
    base, data = [f"w{r.randrange(400)}" for _ in range(200)], []
    for i in range(50):
        w = list(base)
        for k in r.sample(range(200), r.randrange(0, 6)):
            w[k] = f"z{i}-{k}"
        data.append((i, " ".join(w)))
    for i in range(50, 80):  # a common passage makes most of the text
        data.append((i, " ".join(base[:100] + [f"q{i}-{k}" for k in range(r.randrange(0, 40))])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert got(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(data))


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 330)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    linked = {x for e in edges if e[0] != e[1] for x in e}
    found = components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y")
    assert got(found, "node", "component") == sorted((x, c) for x, c in root.items() if x in linked)


def test_lm(docs):
    found = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    for d, held, n, known, total, base in brute.base_scores(PAIRS):
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in found.values()) > sum(r.base_score for r in found.values())


@pytest.mark.parametrize("n", [1, 2, 3])
def test_lm_scores_equal_plain_interpolation(docs, n):
    """Orders, buckets and weights; cells stand for tokens with nearly the same estimates, hence the tolerance."""
    found = {r.doc_id: r.score for r in lm.lm_scores(docs, n=n).collect()}
    for (d, _), score in zip(PAIRS, brute.lm_scores(PAIRS, n), strict=True):
        assert found[d] == pytest.approx(score, rel=2e-3 if n < 3 else 2e-2, abs=1e-3)


def test_lm_exchange_of_several_levels(docs):
    """Small chunks and ranges: counts and scores are the same through one exchange or several."""
    plain = got(lm.lm_scores(docs), "doc_id", "n_known", "train_tokens")
    score = {r.doc_id: (r.base_score, r.score) for r in lm.lm_scores(docs).collect()}
    for width in (2, 3):
        found = lm.lm_scores(docs, chunk=700, fragment=2500, width=width)
        assert got(found, "doc_id", "n_known", "train_tokens") == plain
        assert all((r.base_score, r.score) == pytest.approx(score[r.doc_id]) for r in found.collect())


def test_lm_mixture_sums_to_one():
    import numpy as np

    p = np.array([[1e-3, 0.2], [1e-2, 0.0]])
    w = lm.mixture(np.array([27, 27]), np.array([70.0, 30.0]), p, 1000)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and (w[1 : lm.LOGS, 1] == 0).all()


def test_mixing(docs):
    found = mixing.mix_sources(docs).collect()
    total = sum(r.size for r in found)
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.copies <= 3
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert abs(sum(r.size * r.copies for r in v) - v[0].target) <= max(r.size for r in v)
    assert sorted(mixing.mix_sources(docs).collect()) == sorted(found)


def test_mixing_takes_nothing_beyond_the_limit(spark):
    """A source at its limit, with many empty texts: whatever their hashes, none is taken a fourth time."""
    data = [(i, "" if i % 3 else "one two", "small") for i in range(60)] + [(100 + i, "w " * 400, "large") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    found = mixing.mix_sources(df).collect()
    small = [r for r in found if r.source == "small"]
    assert {r.copies for r in small} == {3} and small[0].target == 3 * small[0].source_size
    assert {r.doc_id: r.copies for r in found} == brute.copies(data)


def test_mixing_caps(spark):
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 5), (None, 10)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.source_targets(df, (1, 2, 3), 3).collect()}
    assert t["a"] == 3 and t["c"] == 15 and t[None] == 30 and t["b"] == pytest.approx(68)


def test_bpe(docs):
    import public_tokenizers as public

    enc = bpe.encoding(bpe.rank_bytes(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    full = {r.doc_id: r for r in bpe.bpe_encode(docs).collect()}
    digest = {r.doc_id: r for r in bpe.bpe_encode(docs, digest=True).collect()}
    for d, t in PAIRS:
        ids = enc.encode_ordinary(t or "")
        assert list(full[d].ids) == ids and bytes(full[d].decoded) == (t or "").encode()
        assert digest[d].n_tokens == len(ids) and digest[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bpe.encode_text(enc, t or "", piece=40) == ids


def test_bpe_pieces_of_odd_texts():
    import public_tokenizers as public

    enc = bpe.encoding(bpe.rank_bytes(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(" \n\t'strlab12²é! \x1c") for _ in range(120))
        assert bpe.encode_text(enc, t, piece=7) == enc.encode_ordinary(t)


def test_media(spark, docs, tmp_path):
    path = str(tmp_path / "m")
    media.write_media(docs, path)
    stored = media.read_media(spark, path, step=3000)
    found = {r.doc_id: r for r in media.media_features(stored).collect()}
    assert len(found) == len(PAIRS)
    for d, t in PAIRS:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = found[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_media_appends_and_overwrites(spark, docs, tmp_path):
    path = str(tmp_path / "m")
    one, two, three = docs.where("doc_id < 20"), docs.where("doc_id >= 90"), docs.where("doc_id = 50")
    ids = lambda: got(media.read_media(spark, path), "doc_id")
    media.write_media(one, path)
    media.write_media(two, path)
    assert ids() == got(one.union(two), "doc_id")
    media.write_media(three, path, "overwrite")
    assert ids() == [(50,)] and len(list((tmp_path / "m").glob("*.zip"))) == 1
    media.write_media(one, path)
    assert ids() == got(one.union(three), "doc_id")


def test_png_by_another_reading():
    """Stored images by the chunks of the format, and images of any row filter made by the definition."""
    import struct

    import numpy as np

    r = np.random.default_rng(3)
    for rows in (1, 5, 40):
        payload = r.integers(0, 256, rows * 192, dtype=np.uint8).tobytes()
        stored = media.to_png(payload)
        assert stored[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">IIBB", stored[16:26]) == (64, rows, 8, 2)
        n = struct.unpack(">I", stored[33:37])[0]
        raw = zlib.decompress(stored[41 : 41 + n])
        assert b"".join(raw[i * 193 + 1 : (i + 1) * 193] for i in range(rows)) == payload and set(raw[::193]) == {0}
        assert media.from_png(stored) == payload
    for colour, step in ((0, 1), (2, 3), (4, 2), (6, 4)):
        x = r.integers(0, 256, (10, 7 * step), dtype=np.uint8)
        lines = []
        for y in range(10):
            line = [y % 5]
            for i in range(7 * step):
                a = int(x[y, i - step]) if i >= step else 0
                b = int(x[y - 1, i]) if y else 0
                c = int(x[y - 1, i - step]) if y and i >= step else 0
                q = a + b - c
                near = a if abs(q - a) <= abs(q - b) and abs(q - a) <= abs(q - c) else b if abs(q - b) <= abs(q - c) else c
                line.append((int(x[y, i]) - [0, a, b, (a + b) // 2, near][y % 5]) % 256)
            lines.append(bytes(line))
        body = lambda kind, v: struct.pack(">I", len(v)) + kind + v + struct.pack(">I", zlib.crc32(kind + v))
        head = struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0)
        packed = zlib.compress(b"".join(lines))
        image = b"\x89PNG\r\n\x1a\n" + body(b"IHDR", head) + body(b"IDAT", packed[:20]) + body(b"IDAT", packed[20:]) + body(b"IEND", b"")
        assert media.from_png(image) == x.tobytes()


def test_media_tells_of_damage(spark, docs, tmp_path):
    path = tmp_path / "m"
    media.write_media(docs.coalesce(1), str(path))
    part = next(path.glob("*.zip"))
    raw = bytearray(part.read_bytes())
    raw[200] ^= 1
    part.write_bytes(raw)
    with pytest.raises(Exception, match="damaged|offset"):
        media.read_media(spark, str(path), retries=1).count()


def test_classifier(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    data, labels = [], []
    for i in range(400):
        w = [word() for _ in range(r.randrange(30, 200))]
        good = i % 3 > 0
        data.append((i, (" ".join(w) if good else " ".join(x.upper() + "!!" for x in w[:5] * 20)) + "."))
        labels.append((i, int(good)))
    found = classifier.classify(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in found if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)


def test_classifier_equals_plain_discriminant(spark, docs):
    labels = {d: int(len((t or "").split()) >= 60) for d, t in PAIRS if d % 9}
    found = classifier.classify(docs, spark.createDataFrame(sorted(labels.items()), "doc_id long, quality int")).collect()
    want = brute.quality(PAIRS, labels)
    assert len(found) == len(want) and all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.5) for r in found)


def test_words_are_hashed_alike_in_blocks_of_any_size(monkeypatch):
    import numpy as np

    from marlstone.llm import common

    r = random.Random(9)
    texts = ["".join(r.choice("ab \n") for _ in range(r.randrange(0, 400))) for _ in range(30)] + ["x" * 3000 + " ab", "", "AB ab"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, first = common.words(data, at)
    by = {}
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert b - a == len(t.split())
        for w, x in zip(t.lower().split(), h[a:b].tolist(), strict=True):
            assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    monkeypatch.setattr(common, "_BLOCK", 64)
    assert (common.words(data, at)[0] == h).all()


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts of some MB, one without any white space and one with a long line in each of three documents."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghé1'") for _ in range(r.randrange(1, 9))) for _ in range(500)]
    big = "\n".join(" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(12_000))
    line = " ".join(r.choice(vocabulary) for _ in range(60_000))
    data = [(1, big), (2, "ab" * 700_000), (3, f"{line}\nend"), (4, f"x\n{line}"), (5, f" {line} "), (6, "short text"), (7, big[: len(big) // 2] + " other words at the end")]
    return data, spark.createDataFrame([(d, t, "s") for d, t in data], "doc_id long, text string, source string").repartition(2)


def test_long_texts(long_texts, spark, tmp_path):
    """Texts beyond a piece, a slice or a chunk."""
    import public_tokenizers as public

    data, df = long_texts
    assert max(len(t) for _, t in data) > bpe.PIECE
    enc = bpe.encoding(bpe.rank_bytes(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    ids = {r.doc_id: r for r in bpe.bpe_encode(df.where("doc_id <> 2"), digest=True).collect()}
    for d, t in data:
        if d != 2:  # the library itself is quadratic on a single match of that length
            want = enc.encode_ordinary(t)
            assert ids[d].n_tokens == len(want) and ids[d].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert got(lines.dedup_lines(df, digest=True), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.lines(data))
    found = {r.doc_id: r for r in lm.lm_scores(df, chunk=100_000, fragment=50_000, width=4).collect()}
    for d, held, n, known, total, base in brute.base_scores(data):
        assert (found[d].held_out, found[d].n_tokens, found[d].n_known, found[d].train_tokens) == (held, n, known, total) and found[d].base_score == pytest.approx(base)
    assert got(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(data))
    media.write_media(df, str(tmp_path / "m"))
    stored = {r.doc_id: r.payload_sha256 for r in media.media_features(media.read_media(spark, str(tmp_path / "m"), step=1 << 20)).collect()}
    assert stored == {d: hashlib.sha256(media.payload_of(t.encode())).hexdigest() for d, t in data}


@pytest.mark.parametrize("name", ["op1_mixing", "op2_licenses", "op5_rules", "op6_lines", "op8_jaccard"])
def test_equals_sql(spark, name):
    from marlstone.llm.queries import ORACLES, QUERIES

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import oracle

    assert oracle.differences(spark, "/root/testdata/sf0.001", name, QUERIES, ORACLES) is None


def every(spark, df):
    none = spark.createDataFrame([], "doc_id long, quality int")
    yield mixing.mix_sources(df)
    yield licenses.license_scan(df)
    yield bpe.bpe_encode(df, digest=True)
    yield suffixes.dedup_spans(df, keep="none", digest=True)
    yield suffixes.dedup_spans(df)
    yield rules.quality_rules(df)
    yield lines.dedup_lines(df)
    yield classifier.classify(df, none)
    yield jaccard.jaccard_components(df)
    yield lm.lm_scores(df)


def test_empty_tables(spark, empty, tmp_path):
    assert all(df.count() == 0 for df in every(spark, empty))
    media.write_media(empty, str(tmp_path / "e"))
    assert media.read_media(spark, str(tmp_path / "e")).count() == 0


def test_null_ids_and_repeated_rows(spark, odd, tmp_path):
    for df in every(spark, odd):
        assert df.count() == 7
    media.write_media(odd, str(tmp_path / "o"))
    assert media.media_features(media.read_media(spark, str(tmp_path / "o"))).count() == 7


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    labels = [(d, int(d % 9 > 0)) for d, _ in PAIRS]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs.withColumn("n_chars", F.length("text").cast("long"))
    now.write.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_equals_plain_stages(spark, docs, tmp_path):
    """Each stage's rows, and those of run(), against the plain versions one after the other."""
    import public_tokenizers as public

    import corpus_pipeline

    labels = {d: int(len((t or "").split()) >= 60) for d, t in PAIRS if d % 9}
    spark.createDataFrame(sorted(labels.items()), "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs.withColumn("n_chars", F.length("text").cast("long"))
    now.write.parquet(str(tmp_path / "documents.parquet"))

    good = brute.good(PAIRS, labels)
    one = [x for x in rows() if x[0] in good]
    text = dict(brute.lines_kept([(d, t) for d, t, _ in one]))
    two = [(d, text[d], s) for d, _, s in one]
    alone = {d for d, _, c in brute.jaccard([(d, t) for d, t, _ in two]) if d == c}
    three = [x for x in two if x[0] in alone]
    times = brute.copies(three)
    four = [x for x in three for _ in range(times[x[0]])]
    assert len(PAIRS) > len(one) > len(three) and two != one and {0, 1} < set(times.values())

    key = lambda x: (x[0], x[1] or "")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (one, two, three, four), strict=True):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        found = sorted((tuple(r) for r in now.select("doc_id", "text", "source", "n_chars").collect()), key=key)
        assert found == sorted(((d, t, s, None if t is None else len(t)) for d, t, s in want), key=key), name
    enc = bpe.encoding(bpe.rank_bytes(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    found = sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == sorted((d, enc.encode_ordinary(t), t.encode()) for d, t, _ in four)


def test_very_long_texts_of_the_others(spark):
    """Three megabytes in a row, for the operators that test_long_texts leaves out."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 10))) for _ in range(40_000)]
    words_ = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = words_(150)
    long = f"{words_(240_000)} under the mit license {words_(240_000)} <{passage}> end\n# x\n"
    assert len(long) > 3_000_000
    data = [(1, long), (2, f"[{passage}]"), (3, "short")]
    df = spark.createDataFrame([(*x, "s") for x in data], "doc_id long, text string, source string")
    assert {x.doc_id: x.size for x in mixing.mix_sources(df).collect()} == {d: len(t.split()) for d, t in data}
    found = {x.doc_id: x for x in licenses.license_scan(df).collect()}
    assert all((found[d].n_words, found[d].n_base, found[d].first_word, found[d].last_word, found[d].base_labels) == brute.licenses(t) for d, t in data)
    removed = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.dedup_spans(df, keep="none", digest=True).collect()}
    assert removed == {1: (len(long), len(passage), 1), 2: (len(passage) + 2, len(passage), 1), 3: (5, 0, 0)}
    judged = {x.doc_id: x for x in rules.quality_rules(df).collect()}
    assert (judged[1].n_words, judged[1].n_symbols, judged[1].n_dup_lines) == (len(long.split()), 3, 0) and not judged[1].base_failed and judged[3].base_failed
    scored = classifier.classify(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).collect()
    assert len(scored) == 3 and all(0 <= x.score <= 1 for x in scored)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_on_odd_input(spark, empty, odd, tmp_path, kind):
    """No rows; null ids, null and empty texts, repeated rows, an id with two texts, and columns with names that stages use."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = (empty if kind == "empty" else odd).withColumn("n_chars", F.length("text").cast("long")).withColumn("copies", F.lit(9)).withColumn("good", F.lit("g"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {t for (t,) in now.select("text").collect()} | {""}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and {(r.copies, r.good) for r in after.collect()} <= {(9, "g")}
        assert kind == "odd" or after.count() == 0
        if name == "lines":
            assert after.count() == now.count() and all(r.text is not None and r.n_chars == len(r.text) for r in after.collect())
        else:
            assert {r.text for r in after.collect()} <= texts | {r.text for r in now.collect()}
        now = after
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == now.count() and all(bytes(r.decoded).decode() in {t.text for t in now.collect()} for r in run.collect())
