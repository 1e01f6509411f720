"""Operator 6 - quality classifier: regularised quadratic discriminant.

Each text becomes a vector of transformed document statistics (rates of letters
cases, digits, marks, repeated words and lines, lengths). For both classes the
mean and the covariance come from sums over all labelled training rows; the
covariance is shrunk towards its diagonal and the pooled one, its Cholesky
factor is cached, and a text's score is the logistic of the difference of the
two Gaussian log densities. Only the text is an input of the score.

Edge cases: null or empty texts have the statistics of no words and get a score
like any other; rates are smoothed, so very short texts stay near the average;
labels that are null, not 0 or 1, or of unknown ids are not used, an id
labelled more than once counts once (as the mean, 1 if 0.5 or more); with no
training rows of a class every score is 0.5; repeated ids give one row each; a
null id is never held out; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import id_text, stored, table
from rolloutlab.llm.vectext import LOWER, chunks, ngram_hashes, span_hashes, text_bytes, word_spans

THRESHOLD = 0.7
SHRINK = 0.05       # weight of the diagonal in each covariance
POOL = 0.02         # weight of the covariance of both classes together
SMOOTH = 8.0        # words' worth of the typical rate added to each rate

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_SPACE = ~_SPACE
_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "stop": np.isin(np.arange(256), [ord(c) for c in ".,;:?"]),
    "loud": np.isin(np.arange(256), [ord("!")]),
    "bar": np.isin(np.arange(256), [ord(c) for c in "|<>{}[]\\/_=+"]),
    "symbol": np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~`"]),
}
FEATURES = ("log_words", "word_length", "upper", "digit", "stop", "loud", "bar", "symbol", "distinct", "repeat", "bigram_distinct",
            "line_words", "line_distinct", "length_spread")
# typical rates that short texts are smoothed towards (fixed values)
_TYPICAL = {"upper": 0.02, "digit": 0.005, "stop": 0.03, "loud": 0.002, "bar": 0.002, "symbol": 0.002}


def _sum_by(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def _distinct_by(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    if len(hashes) == 0:
        return np.zeros(n)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics of each text: one row of len(FEATURES) values."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, rows = word_spans(data, offsets, _NOT_SPACE)
    words = np.bincount(rows, minlength=n).astype(float)
    length = (ends - starts).astype(float)
    mean = (_sum_by(length, rows, n) + SMOOTH * 6) / (words + SMOOTH)
    spread = np.sqrt((_sum_by((length - mean[rows]) ** 2, rows, n) + SMOOTH * 10) / (words + SMOOTH))
    out = {"log_words": np.log1p(words), "word_length": np.log(mean), "length_spread": np.log(spread)}
    at = np.repeat(np.arange(n), np.diff(offsets))
    for name, rate in _TYPICAL.items():
        hits = np.bincount(at[_CLASSES[name][data]], minlength=n)
        out[name] = np.log((hits + rate * 6 * SMOOTH) / (size + 6 * SMOOTH) + 1e-3)
    h = span_hashes(LOWER[data], starts, ends)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    out["repeat"] = np.log((_sum_by(again, rows, n) + 0.01 * SMOOTH) / (words + SMOOTH) + 1e-3)
    out["distinct"] = np.log((_distinct_by(h, rows, n) + SMOOTH) / (np.minimum(words, 1e9) ** 0.8 + SMOOTH))
    pair = ngram_hashes(h, 2) if len(h) > 1 else np.empty(0, np.uint64)
    same = rows[1:] == rows[:-1] if len(h) > 1 else np.empty(0, bool)
    out["bigram_distinct"] = np.log((_distinct_by(pair[same], rows[1:][same] if len(h) > 1 else rows, n) + SMOOTH) / (words + SMOOTH))
    not_break = np.ones(256, bool)
    not_break[[10, 13]] = False
    ls, le, lr = word_spans(data, offsets, not_break)
    lines = np.bincount(lr, minlength=n).astype(float)
    out["line_words"] = np.log((words + SMOOTH) / (lines + 1))
    out["line_distinct"] = np.log((_distinct_by(span_hashes(data, ls, le), lr, n) + 2) / (lines + 2))
    return np.column_stack([out[f] for f in FEATURES])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics vector of every whole text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                x = statistics(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                flat = pa.array(x.ravel())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo),
                                       pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), flat)],
                                      names=["doc_id", "x"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the classes, and log prior odds."""
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [-0.5 * ((z - m) @ f.T).__pow__(2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.odds, -500, 500)))


def _sums(train: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class the count, sum and sum of outer products: partial sums per task, added up by position."""

    def run(batches):
        total = {c: np.zeros(1 + width + width * width) for c in (0, 1)}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy().reshape(-1, width) if batch.num_rows else np.empty((0, width))
            for c in total:
                rows = x[y == c]
                total[c] += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([total[0].tolist(), total[1].tolist()], pa.list_(pa.float64()))],
                              names=["label", "sums"])

    rows = (train.select("x", "y").mapInArrow(run, "label int, sums array<double>")
            .select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect())
    out = {c: np.zeros(1 + width + width * width) for c in (0, 1)}
    for r in rows:                                    # 2 * (1 + width + width^2) rows
        out[r["label"]][r["at"]] = r["v"]
    return {c: (v[0], v[1:1 + width], v[1 + width:].reshape(width, width)) for c, v in out.items()}


def fit(train: DataFrame, width: int = len(FEATURES), shrink: float = SHRINK, pool: float = POOL) -> Discriminant | None:
    """Fit on every row (x, y) of ``train``; None if a class has no rows."""
    sums = _sums(train, width)
    if min(sums[0][0], sums[1][0]) < 1:
        return None
    n = sums[0][0] + sums[1][0]
    centre = (sums[0][1] + sums[1][1]) / n
    total = (sums[0][2] + sums[1][2]) / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(total), 1e-6))
    pooled = total / np.outer(scale, scale)
    means, factors, logdets = [], [], []
    for c in (0, 1):
        m, s, q = sums[c]
        mean = s / m
        cov = (q / m - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrink - pool) * cov + shrink * np.diag(np.diag(cov)) + pool * pooled
        cov[np.diag_indices(width)] += 1e-4
        chol = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(chol))
        logdets.append(2 * float(np.log(np.diag(chol)).sum()))
    return Discriminant(centre, scale, means, factors, logdets, float(np.log(sums[1][0] / sums[0][0])))


def score(stats: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of statistics."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            s = np.full(batch.num_rows, 0.5) if model is None else model.score(x)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                  names=["doc_id", "score", "predicted"])

    return (stats.mapInArrow(run, "doc_id bigint, score double, predicted int")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | None:
    """Fit on the statistics of the labelled documents outside the held-out fold."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
             .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).where(~held_out(F.col("doc_id"))))
    return fit(stats.join(known, "doc_id"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """Learn from the labelled rows outside the held-out fold and score every row of ``docs``."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    return score(stats, learn(stats, labels, id_col, label_col), threshold)


def accepted(docs: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``threshold`` or more (all if nothing was learned)."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            keep = [model.score(statistics(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])) >= threshold
                    for lo, hi in chunks(offsets)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
