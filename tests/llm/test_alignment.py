"""Alignment of two tokenizers against whole texts, token by token."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest

from marlstone.llm import alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def plain(texts):
    """(result per text, documents per pair): both tokenizers run on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    first = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain_bytes)}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a" and table["Ġ"] == 32
    aligned, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            a = [(i, bytes(table[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
                cuts, found = np.array(sorted(set(ends[0]) & set(ends[1]))), defaultdict(lambda: ([], []))
                for k, side in enumerate((a, b)):
                    for (i, _), end in zip(side, ends[k], strict=True):
                        found[np.searchsorted(cuts, end)][k].append(i)
                groups = [found[g] for g in sorted(found)]
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        aligned.append((groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups, links in aligned:
        joined = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        counts = [held[p] for p in links]
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(counts), joined))
    return out, held


TEXTS = [
    None, "", " ", "a", "Hello, world! It's 12,345.67 and don't   stop\n\n  here\t\tnow <|endoftext|> </s> <s> <0x0A>", "naïve café — “quotes” … 東京に 行く。 привет мир", "\n\nlead\r\nend \n", "x▁y ▁ z", "é   nb sp  　 id ",
    "foo_bar(baz)[0] = {'k': \"v\"}; // c++ <tag/> a>b </x>", "a\x00b\x1c \x85 c", "🙂🙃 👩‍👩‍👧 ok", "x" * 3000 + " " + "ab" * 500, "x" + "a" * 999 + "b" + "a" * 1001, "the cat sat. The cat's hat, THE CAT", "Ünïcödé ÀÉ ×÷ ÿ! ǅ, ßs", "don't we'll I'd 'tis x's,y'sz", "Hello, world! Hello, world!",
]


def rows_of(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, chunk int, unit int").repartition(3)
    return alignment.align_tokens(docs, **more)


def test_odd_texts(spark):
    want, held = plain(TEXTS)
    for chunk in (alignment.CHUNK, 60):
        found, pairs = rows_of(spark, TEXTS, chunk=chunk)
        assert [tuple(r)[1:] for r in sorted(found.collect())] == want
        got = {(r.a, r.b): r.n_docs for r in pairs.collect()}
        assert got == dict(held)
        best = defaultdict(int)
        for (a, _), n in held.items():
            best[a] = max(best[a], n)
        assert all(r.best == (r.n_docs == best[r.a]) for r in pairs.collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, _ = plain(list(texts.values()))
    want = {d: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for d, w in zip(texts, want, strict=True)}
    found = alignment.op13_alignment(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want


def test_no_rows_and_repeated_rows(spark):
    empty, pairs = rows_of(spark, ["a"])
    docs = spark.createDataFrame([], "doc_id long, text string")
    found, none = alignment.align_tokens(docs)
    assert found.count() == 0 == none.count()
    found, none = alignment.align_tokens(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")] and none.count() == 0
    docs = spark.createDataFrame([(None, "one word"), (None, "one word"), (1, None), (1, "one word"), (1, "▁")], "doc_id long, text string")
    found, pairs = alignment.align_tokens(docs)
    got = sorted(tuple(r)[1:] for r in found.collect())
    assert [r[-1] for r in got] == ["", ""] + [got[-1][-1]] * 3 and {r.n_docs for r in pairs.collect()} == {3}


def test_long_text(spark):
    text = "word, other word; und noch\nein Wort " * 60_000 + "x" * 3_000
    found, _ = rows_of(spark, [text])
    assert tuple(found.first())[1:] == plain([text])[0][0]


def test_short_numbers():
    n = np.array([0, 127, 128, 5, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 1])
    data, ends = alignment.short_numbers(n)
    assert alignment.long_numbers(data)[0].tolist() == n.tolist() and alignment.long_numbers(data)[1].tolist() == ends.tolist()
    assert len(data) == 1 + 1 + 2 + 1 + 2 + 3 + 3 + 4 + 4 + 1 and all(len(x) == 0 for x in alignment.long_numbers(data[:0]))


@pytest.mark.parametrize("marks", [b"", b",.", b",.;!?\n'\"()<>"])
def test_units_join_to_the_texts(marks):
    raw = [(" " + t).encode() for t in TEXTS if t]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = alignment.unit_starts(data, at[:-1], marks)
    assert set(at[:-1]) <= set(start.tolist()) and len(set(start.tolist())) == len(start)
    index, which = alignment.distinct_units(data, start)
    end = np.append(start[1:], len(data))
    units = [bytes(data[start[i] : end[i]]) for i in index]
    assert b"".join(units[i] for i in which) == data.tobytes() and len(set(units)) == len(units)
