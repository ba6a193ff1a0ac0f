"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, slices, trim

# The first and last code points of scripts' blocks.
SCRIPT_RANGES = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0xFF21, 0xFF5A), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F),
    ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Ethiopic", 0x1200, 0x137F),
    ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x2FA1F),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]

#: Buckets of hashed n-grams of 1 to ORDERS characters; a language of which a script has this share of the letters is a candidate in it.
BUCKETS, ORDERS, SHARE = 1 << 15, 4, 0.01
#: Scores are whole numbers, so many to a natural logarithm's unit; the price of a change of language; at most so many languages.
UNIT, PENALTY, LANGUAGES = 256, 12, 400
_NEVER = -(1 << 24)
_EDGE, _CODES = 0x10FFFF, 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Letters:
    """Which code points are letters, their lower case and script; looked up once for each that turns up."""

    def __init__(self):
        self.known, self.letter = np.zeros(_CODES, bool), np.zeros(_CODES, bool)
        self.lower, self.script = np.arange(_CODES, dtype=np.uint32), np.zeros(_CODES, np.uint8)
        for name, first, last in SCRIPT_RANGES:
            self.script[first : last + 1] = SCRIPTS.index(name)

    def learn(self, codes: np.ndarray) -> None:
        new = codes[~self.known[codes]]
        for c in np.unique(new).tolist():
            x = chr(c)
            self.known[c], self.letter[c] = True, x.isalpha()
            if len(low := x.lower()) == 1:
                self.lower[c] = ord(low)


@dataclass
class Words:
    """The words (runs of letters of one script) of a run of texts: the text of each, its letters, and which of the distinct ones it is."""

    text: np.ndarray
    letters: np.ndarray
    which: np.ndarray
    chars: np.ndarray
    bounds: np.ndarray
    script: np.ndarray


def split(data: np.ndarray, at: np.ndarray, letters: Letters) -> Words:
    """Words of all texts; chars and bounds hold the distinct ones, lower-cased."""
    lead = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum(lead)])[at]
    letters.learn(codes)
    script = np.where(letters.letter[codes], letters.script[codes] + 1, 0).astype(np.int16)
    change = np.ones(len(codes) + 1, bool)
    change[1:-1] = script[1:] != script[:-1]
    change[first] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    inside = script[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[inside], end[inside]
    low = letters.lower[codes]
    # A word's hash: the sum of its letters' values times powers of a base, from its first letter on.
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int((end - start).max(initial=1)), _ODD, np.uint64)]))
    size = end - start
    place = _ranges(size)
    flat = np.repeat(start, size) + place
    h = np.add.reduceat(mix(low[flat].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
    _, index, which = np.unique(mix(h + size.astype(np.uint64)), return_index=True, return_inverse=True)
    own = size[index]
    chars = low[np.repeat(start[index], own) + _ranges(own)]
    return Words(np.searchsorted(first, start, "right") - 1, size, which, chars, np.concatenate([[0], np.cumsum(own)]), script[start[index]] - 1)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def grams(chars: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each n-gram of 1 to `orders` characters of the words, an edge before and after each."""
    size = np.diff(bounds)
    n = len(size)
    padded = np.full(len(chars) + 2 * n, _EDGE, np.uint64)
    word = np.repeat(np.arange(n), size + 2)
    at = _ranges(size + 2)
    padded[(at > 0) & (at <= np.repeat(size, size + 2))] = chars
    left = np.repeat(size + 2, size + 2) - at
    found, of, h = [], [], np.zeros(len(padded), np.uint64)
    for k in range(orders):
        rolled = np.zeros(len(padded), np.uint64)
        rolled[: len(padded) - k] = padded[k:]
        h = mix(h * _ODD + rolled + np.uint64(k + 1))
        whole = left > k
        if k == 0:
            whole &= padded != _EDGE
        found.append((h[whole] % np.uint64(buckets)).astype(np.int32))
        of.append(word[whole])
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Languages:
    """What was learned: names by code point, scores of buckets, candidates of each script, and the commonest language's place."""

    names: list[str]
    scores: np.ndarray
    candidates: np.ndarray
    commonest: int

    def of(self, words: Words) -> np.ndarray:
        """The score of each distinct word in each language: sums over its n-grams, never for one that its script rules out.

        Where the script rules out all, nothing is known of the word: zeros.
        """
        bucket, word = grams(words.chars, words.bounds, self.scores.shape[1], ORDERS)
        n = len(words.script)
        out = np.stack([np.bincount(word, row[bucket], n) for row in self.scores], 1).astype(np.int64) if n else np.zeros((0, len(self.names)), np.int64)
        fits = self.candidates[words.script]
        return np.where(fits.any(1)[:, None], np.where(fits, out, _NEVER), 0)


def viterbi(score: np.ndarray, free: np.ndarray, penalty: int, step: int = 256) -> np.ndarray:
    """The best state of each place: the sum of scores less `penalty` for each change of state, except into a place that is free.

    Places are cut into blocks that are followed side by side: first from every state a block may be entered in,
    then, with the entries known, once more with back pointers. Whole numbers, so blocks change nothing. Staying
    wins ties, else the smaller state.
    """
    n, k = score.shape
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    step = max(step, k * k // 4)
    blocks = -(-n // step)
    e = np.zeros((blocks * step, k), np.int64)
    e[:n] = score
    price = np.zeros(blocks * step, np.int64)
    price[:n] = np.where(free, 0, penalty)
    e, price = e.reshape(blocks, step, k), price.reshape(blocks, step)
    reach = np.where(np.eye(k, dtype=bool), 0, -price[:, :1, None]) + e[:, 0, None, :]
    for t in range(1, step):
        reach = np.maximum(reach, reach.max(2, keepdims=True) - price[:, t, None, None]) + e[:, t, None, :]
    entry = np.zeros((blocks, k), np.int64)
    for b in range(1, blocks):
        entry[b] = (entry[b - 1][:, None] + reach[b - 1]).max(0)
    v, back, states = entry, np.zeros((step, blocks, k), np.int16), np.arange(k)
    for t in range(step):
        top = v.argmax(1)
        changed = np.take_along_axis(v, top[:, None], 1) - price[:, t, None]
        stay = v >= changed
        back[t] = np.where(stay, states, top[:, None])
        v = np.where(stay, v, changed) + e[:, t]
    came = np.broadcast_to(states, (blocks, k)).astype(np.int64)
    for t in range(step - 1, -1, -1):
        came = np.take_along_axis(back[t], came, 1).astype(np.int64)
    leave = np.zeros(blocks, np.int64)
    leave[-1] = v[-1].argmax()
    for b in range(blocks - 1, 0, -1):
        leave[b - 1] = came[b, leave[b]]
    out, rows = np.zeros((blocks, step), np.int64), np.arange(blocks)
    for t in range(step - 1, -1, -1):
        out[:, t] = leave
        leave = back[t][rows, leave].astype(np.int64)
    return out.ravel()[:n]


def learn(labelled: DataFrame) -> Languages:
    """Languages from all rows of labelled (text, lang): n-grams of words by language, letters by script and language.

    Each task sums its rows, Spark the sums of the tasks; what reaches the driver is bounded by BUCKETS + the scripts
    for each of at most LANGUAGES languages. Rows with a null language are left out. The names are in the order of
    their code points.
    """
    width = BUCKETS + len(SCRIPTS) + 1

    def run(batches):
        letters, total = Letters(), {}
        for batch, data, at in slices(batches):
            names, code = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            w = split(data, at, letters)
            bucket, word = grams(w.chars, w.bounds)
            times = np.bincount(code[w.text] * len(w.script) + w.which, minlength=len(names) * len(w.script)).reshape(len(names), -1)
            size = np.diff(w.bounds)
            for i, name in enumerate(names):
                own = total.setdefault(name, np.zeros(width, np.int64))
                own[:BUCKETS] += np.bincount(bucket, times[i][word], BUCKETS).astype(np.int64)
                own[BUCKETS:-1] += np.bincount(w.script, times[i] * size, len(SCRIPTS)).astype(np.int64)
                own[-1] += int((code == i).sum())
        for name, own in total.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], ["lang", "i", "n"])

    rows = labelled.where(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = rows.mapInArrow(run, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = sums.toArrow()
    count = np.zeros((len(names), width))
    if names:
        code = {n: i for i, n in enumerate(names)}
        count[[code[x] for x in found["lang"].to_pylist()], found["i"].to_numpy()] = found["n"].to_numpy()
    # Half a count is added to each bucket.
    share = (count[:, :BUCKETS] + 0.5) / (count[:, :BUCKETS].sum(1, keepdims=True) + 0.5 * BUCKETS)
    of_script = count[:, BUCKETS:-1]
    return Languages(names, np.rint(np.log(share) * UNIT), (of_script >= np.maximum(SHARE * of_script.sum(1, keepdims=True), 1)).T, int(count[:, -1].argmax()) if names else 0)


def language_spans(docs: DataFrame, model: Languages, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, first_word, last_word, letters) of every whole text.

    Words are runs of letters of one script. A word's score in a language sums its n-grams' logarithms of probability; languages
    that hardly use its script are out. Viterbi labels the words so that scores less `penalty` (natural logarithms)
    for each change are largest; equal neighbours make a span, words counted from 0. lang_pred has most letters (ties: the first
    name); score is its share of the letters times its probability against the other languages over those words.

    Null texts and texts without a letter are `und` with score 0 and no spans, as is everything where no language was
    learned. A text of unknown scripts only gets the commonest language. Null and repeated ids pass through; only
    doc_id and text are read; no rows give no rows. Texts are read where they lie; a task holds about 2 MB of them, or one longer text.
    """
    names, price = np.array(model.names, object), round(penalty * UNIT)

    def run(batches: Iterator[pa.RecordBatch]):
        letters = Letters()
        for batch, data, at in slices(batches):
            n, k = batch.num_rows, len(names)
            w = split(data, at, letters) if k else None
            if w is None or not len(w.text):
                yield _result(batch, pa.array(["und"] * n), np.zeros(n), np.zeros(n + 1, np.int32), np.zeros(0, np.int64), names, np.zeros(0), np.zeros(0), np.zeros(0))
                continue
            own = model.of(w)
            begins = np.concatenate([[True], w.text[1:] != w.text[:-1]])
            score = own[w.which]
            blank = ~own.any(1)[w.which]
            if blank.all():
                state = np.full(len(w.text), model.commonest)
            else:
                score[blank.nonzero()[0], model.commonest] += 1  # decides only where nothing else does
                state = viterbi(score, begins, price)
            size = np.bincount(w.text * k + state, w.letters, n * k).reshape(n, k)
            best = size.argmax(1)
            mine = state == best[w.text]
            sums = np.stack([np.bincount(w.text[mine], np.maximum(score[mine, j], _NEVER), n) for j in range(k)], 1) / UNIT
            gap = np.clip(sums - sums[np.arange(n), best][:, None], -700, 700)
            all_letters = size.sum(1)
            sure = np.where(all_letters > 0, size.max(1) / np.maximum(all_letters, 1) / np.exp(gap).sum(1), 0.0).clip(0, 1)
            edge = np.flatnonzero(begins | np.concatenate([[True], state[1:] != state[:-1]]))
            last = np.append(edge[1:], len(state))
            word = np.arange(len(state)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            offsets = np.searchsorted(w.text[edge], np.arange(n + 1)).astype(np.int32)
            pred = pa.array(np.where(all_letters > 0, names[best], "und"), pa.string())
            yield _result(batch, pred, sure, offsets, state[edge], names, word[edge], word[last - 1], np.add.reduceat(w.letters, edge))
        trim()

    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first_word: long, last_word: long, letters: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _result(batch, pred, score, offsets, state, names, first, last, size) -> pa.RecordBatch:
    whole = lambda x: pa.array(np.asarray(x, np.int64))
    spans = pa.StructArray.from_arrays([pa.array(names[state] if len(state) else [], pa.string()), whole(first), whole(last), whole(size)], ["lang", "first_word", "last_word", "letters"])
    return pa.RecordBatch.from_arrays([batch.column(0), pred.cast(pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["doc_id", "lang_pred", "score", "spans"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return language_spans(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
