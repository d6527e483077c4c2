"""Regularised quadratic discriminant over transformed document statistics.

Statistics are made once per text in vectorised kernels.  Each class has a Gaussian with its own shrunken covariance
(Friedman, 1989): a mix of the class covariance, the pooled one and a multiple of the identity.  The fit needs only
sums, sums of products and counts per class, which Spark aggregates over all labelled rows; the Cholesky factors of a
dozen dimensions are computed once and sent to the tasks.  The score is the logistic of the difference of the
log-densities, from Mahalanobis distances, plus the log prior ratio.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import cut
from marlstone.llm.textkernel import U64, chunks

FEATURES = (
    "log_words", "mean_word", "word_spread", "symbols", "upper", "digits", "punctuation", "distinct_words", "distinct_pairs", "short_words", "line_words", "wide_bytes",
)
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c in b"#*$%&|<>":
    _CLASS[_c] = 4
for _c in b"!?.,;:'\"()-[]{}/\\@^_~`+=":
    _CLASS[_c] = 5
_CLASS[10] = 6
_CLASS[128:] = 7


def statistics(chunk) -> np.ndarray:
    """Rows by FEATURES; ratios by square root, counts by logarithm, so that their classes are nearer to Gaussian."""
    n = len(chunk)
    size = np.diff(chunk.offs)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 8 + _CLASS[chunk.data], minlength=8 * n).reshape(n, 8).astype(np.float64)
    words = chunk.counts.astype(np.float64)
    some = np.maximum(words, 1)
    length = (chunk.end - chunk.start).astype(np.float64)
    owner = chunk.row_of_word()
    total = np.bincount(owner, length, n)
    square = np.bincount(owner, length * length, n)
    short = np.bincount(owner, length <= 3, n)
    mean = total / some
    hashes = chunk.word_hashes()
    pairs = hashes[:-1] * U64(0x9E3779B97F4A7C15) + hashes[1:] if len(hashes) > 1 else hashes[:0]
    distinct, twos = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(chunk.words[:-1].tolist(), chunk.words[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(hashes[a:b])
            distinct[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
        if b > a + 1:
            s = np.sort(pairs[a : b - 1])
            twos[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
    seen = np.maximum(total, 1)
    return np.stack(
        [
            np.log1p(words), np.log1p(mean), np.sqrt(np.maximum(square / some - mean**2, 0)) / np.maximum(mean, 1), np.sqrt(kinds[:, 4] / seen), np.sqrt(kinds[:, 2] / seen), np.sqrt(kinds[:, 3] / seen),
            np.sqrt(kinds[:, 5] / seen), distinct / some, twos / np.maximum(words - 1, 1), short / some, np.log1p(words / (kinds[:, 6] + 1)), np.sqrt(kinds[:, 7] / seen),
        ],
        1,
    )


def _measure(batches):
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            x = statistics(chunk)
            f = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), f], names=["doc_id", "f"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


@dataclass
class Discriminant:
    mean: np.ndarray  # class by feature, in standardised units
    factor: np.ndarray  # inverse lower Cholesky factors
    log_det: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        far = [(((z - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) for c in (0, 1)]
        log_ratio = 0.5 * (far[0] - far[1] + self.log_det[0] - self.log_det[1]) + self.bias
        return 1 / (1 + np.exp(-np.clip(log_ratio, -30, 30)))


def fit(measured: DataFrame, labels: DataFrame, own: float = 0.6, ridge: float = 0.05) -> Discriminant:
    """Class Gaussians from all labelled rows that aren't held out.

    measured: doc_id, f; labels: doc_id, quality (0 or 1; null and other values are left out).  own: weight of a class's
    covariance against the pooled one; ridge: weight of the mean variance times the identity.  With no row of a class,
    the mean and covariance of all rows stand for it; with no labelled row at all every score is one half.
    """
    d = len(FEATURES)
    rows = measured.where(~held_out()).join(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").alias("y")), "doc_id")
    f = [F.get("f", F.lit(i)) for i in range(d)]
    sums = [F.sum(x) for x in f] + [F.sum(f[i] * f[j]) for i in range(d) for j in range(i + 1)]
    got = {r[0]: r for r in rows.groupBy("y").agg(F.count("*"), *sums).collect()}  # two rows
    n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c, r in got.items():
        n[c], s[c] = r[1], r[2 : 2 + d]
        q[c][np.tril_indices(d)] = r[2 + d :]
        q[c] = np.tril(q[c]) + np.tril(q[c], -1).T
    total = max(n.sum(), 1)
    centre = s.sum(0) / total
    scale = np.sqrt(np.maximum(np.diag(q.sum(0)) / total - centre**2, 1e-6))
    seen = np.maximum(n, 1)[:, None]
    raw = np.where(n[:, None] > 0, s / seen, centre)
    spread = np.stack([q[c] / max(n[c], 1) - np.outer(raw[c], raw[c]) if n[c] else np.diag(scale**2) for c in (0, 1)]) / np.outer(scale, scale)
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / total if n.sum() else np.eye(d)
    factor, log_det = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        cov = own * spread[c] + (1 - own) * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factor[c], log_det[c] = np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()
    bias = float(np.log((n[1] + 1) / (n[0] + 1))) if n.sum() else 0.0
    return Discriminant((raw - centre) / scale, factor, log_det, bias, centre, scale)


def _apply(model: Discriminant):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), repeated ids included.

    Null and empty texts have all statistics zero and are scored like any other.  Repeated labels count as often as they
    occur.  A null id is never learned from; its held_out is null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = cut(docs.mapInArrow(_measure, "doc_id long, f array<double>"))
    model = fit(measured, labels)
    out = measured.mapInArrow(_apply(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
