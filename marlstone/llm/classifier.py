"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, mix, slices, table, words

FEATURES = ["words", "word_length", "distinct_share", "top_share", "pair_share", "upper_share", "digit_share", "symbol_share", "mark_share", "space_share", "line_words", "dup_line_share", "end_share"]
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>~^=+_{}[]\\@", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_ODD = np.uint64(0x9FB21C651E98DF25)


def _logit(x: float, n: float) -> float:
    """The log odds of a share x / n, one half added to either side."""
    return float(np.log((x + 0.5) / (max(n - x, 0) + 0.5)))


def statistics(raw: bytes, w: np.ndarray) -> list[float]:
    """The transformed statistics of one text (UTF-8) and the hashes of its words (A-Z lower-cased): logs of sizes, log odds of shares."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(w)
    _, times = np.unique(w, return_counts=True)
    top = int(times.max(initial=0))
    pairs = len(np.unique(mix(w[:-1] * _ODD + w[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines)
    return [
        float(np.log1p(k)), float(np.log1p((n - count[_SPACES].sum()) / max(k, 1))), _logit(len(times), k), _logit(top, k), _logit(pairs, max(k - 1, 0)),
        _logit(count[_UPPER].sum(), n), _logit(count[_DIGIT].sum(), n), _logit(count[_SYMBOLS].sum(), n), _logit(count[_MARKS].sum(), n), _logit(count[_SPACES].sum(), n),
        float(np.log1p(k / max(len(lines), 1))), _logit(len(lines) - len(set(lines)), len(lines)), _logit(ended, len(lines)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text; a null text is empty."""

    def run(batches):
        for batch, data, at in slices(batches):
            raw, (h, first) = data.tobytes(), words(data, at)
            bounds = zip(at[:-1].tolist(), at[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)
            x = np.array([statistics(raw[a:b], h[c:d]) for a, b, c, d in bounds])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Discriminant:
    """Means, cached inverse Cholesky factors and log determinants of both classes."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    known: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.offsets[0])
        z = (x - self.center) / self.scale
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            u = factor @ (z - mean).T  # L u = z - mean: the squared length of u is the Mahalanobis distance
            density.append(offset - 0.5 * (u * u).sum(0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products for each label, from one row a task: rows has label and x."""
    d = len(FEATURES)

    def run(frames):
        total = {}
        for f in frames:
            for label, part in f.groupby("label"):
                x = np.stack(part["x"].to_numpy())
                old = total.get(label, (0.0, np.zeros(d), np.zeros((d, d))))
                total[label] = (old[0] + len(x), old[1] + x.sum(0), old[2] + x.T @ x)
        for label, (n, s, p) in total.items():
            yield pd.DataFrame({"label": label, "i": np.arange(1 + d + d * d), "v": np.concatenate([[n], s, p.ravel()])})

    sums = rows.select("label", "x").mapInPandas(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).toPandas()
    found = {}
    for label, part in sums.groupby("label"):
        v = part.sort_values("i")["v"].to_numpy()
        found[int(label)] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return found


def fit(rows: DataFrame, pooled: float = 0.2, diagonal: float = 0.1) -> Discriminant:
    """Fit on all rows (label 0 or 1, x). A class covariance is its own, shrunk by `pooled` to that of
    both classes and by `diagonal` to a multiple of the identity; features are first scaled to unit variance.

    Without rows of both labels the score is the share of label 1 (0.5 without any row).
    """
    found = moments(rows)
    total = sum(v[0] for v in found.values())
    if set(found) != {0, 1}:
        return Discriminant(np.zeros(0), np.ones(0), [], [], [found[1][0] / total if 1 in found else 0.0 if total else 0.5], known=False)
    center = (found[0][1] + found[1][1]) / total
    scale = np.sqrt(np.maximum(np.diag(found[0][2] + found[1][2]) / total - center**2, 1e-12))
    means, spread = [], []
    for label in (0, 1):
        n, s, p = found[label]
        mean = s / n
        means.append((mean - center) / scale)
        spread.append((p / n - np.outer(mean, mean)) / np.outer(scale, scale))
    both = (found[0][0] * spread[0] + found[1][0] * spread[1]) / total
    factors, offsets = [], []
    for label in (0, 1):
        c = (1 - pooled) * spread[label] + pooled * both
        c = (1 - diagonal) * c + diagonal * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(factor))
        offsets.append(float(np.log(found[label][0] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(center, scale, means, factors, offsets)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; the model is fitted on labels' rows that aren't held out.

    Scores use the text alone. A null or empty text gets the score of its
    (extreme) statistics; rows that repeat an id are scored one by one; a null
    id counts as the empty text in the choice of held-out documents, so it isn't one, and matches no label; labels without a quality are left
    out. Only doc_id and text, doc_id and quality are read.
    """
    x = cut(features(docs))
    of = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).distinct()
    model = fit(x.where(~held_out(F.col("doc_id"))).join(of, "doc_id"))

    def run(batches):
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            s = model.scores(v) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
