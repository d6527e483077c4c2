"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

Features are counts of hashed byte trigrams of the text with A-Z lowered, divided by their number, over whole texts.  A
linear machine's value is then the mean of its weights over the trigrams, so scoring needs no feature vectors.

The machines are fitted on at most ``per_language`` rows of each language, those with the least hash of their ids and
texts, and on ``SAMPLE_ROWS`` rows in all; only their fixed-size vectors reach the driver (16 kB each, 320 MB at most).
There is one machine for each pair of families and of languages within a family, so the machines are fitted on the rows of
the ``languages`` labels that most rows bear (``MAX_LANGUAGES`` unless told otherwise); a noisy column of labels adds none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.quality_classifier import held_out
from marlstone.llm.textkernel import _LOWER, chunks

DIM = 4096
SAMPLE_ROWS, MAX_LANGUAGES = 20_000, 40
UNKNOWN = "und"
#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
}


def trigrams(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a chunk's rows, and their bounds by row; a row's ends count as blanks."""
    d = _LOWER[chunk.data].astype(np.int64)
    size = np.diff(chunk.offs)
    padded = np.full(len(d) + 2 * len(chunk), 32, np.int64)
    at = np.arange(len(d)) + 2 * np.repeat(np.arange(len(chunk)), size) + 1
    padded[at] = d
    padded[np.isin(padded, (9, 10, 11, 12, 13))] = 32
    h = (padded[:-2] * 0x2F0B4C47 + padded[1:-1] * 0x1B873593 + padded[2:] * 0x85EBCA6B) if len(padded) > 2 else padded[:0]
    h = ((h ^ (h >> 15)) * 0x2C1B3C6D >> 12) & (DIM - 1)
    first = chunk.offs[:-1] + 2 * np.arange(len(chunk))
    keep = np.ones(len(h), bool)  # no trigram crosses two rows
    for k in (1, 2):
        keep[first[1:] - k] = False
    bound = np.concatenate(([0], np.cumsum(keep)))
    return h[keep], bound[np.minimum(np.append(first, len(h)), len(h))]


def _has_letter(chunk) -> np.ndarray:
    """Whether each row holds a letter of any script."""
    low = _LOWER[chunk.data]
    plain = (low >= 97) & (low <= 122)
    any_plain = np.diff(np.concatenate(([0], np.cumsum(plain)))[chunk.offs]) > 0
    for i in np.flatnonzero(~any_plain & (np.diff(chunk.offs) > 0)):
        any_plain[i] = any(c.isalpha() for c in chunk.text(int(i)).decode())
    return any_plain


def _vectors(batches):
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            h, bound = trigrams(chunk)
            n = len(chunk)
            counts = np.bincount(np.repeat(np.arange(n), np.diff(bound)) * DIM + h, minlength=n * DIM).reshape(n, DIM)
            counts = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(chunk.first, n), pa.array([r.tobytes() for r in counts], pa.binary())], names=["lang", "v"])


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights with the bias last, by dual coordinate descent on the squared hinge loss; y is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    weight = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    diag = (x * x).sum(1) + 0.5 / weight
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + a[i] * 0.5 / weight[i]
            new = max(a[i] - g / diag[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


class Tree:
    """Pairwise machines between families, and between the languages of each family."""

    def __init__(self, langs: list[str], x: np.ndarray, families: dict[str, str]):
        self.centre = x.mean(0) if len(x) else np.zeros(DIM)
        self.scale = 1 / (np.sqrt(x.var(0)) + 2e-4) if len(x) else np.ones(DIM)
        norm = np.sqrt(((x - self.centre) ** 2 * self.scale**2).sum(1).mean()) if len(x) else 1.0
        self.scale = self.scale / max(norm, 1e-9)
        z = (x - self.centre) * self.scale
        lang = np.array(langs, object)
        family = np.array([families.get(v, f"only {v}") for v in langs], object)
        self.families = sorted(set(family))
        self.within = {f: sorted(set(lang[family == f])) for f in self.families}
        machines, self.place = [], {}
        for key, names, of, rows in [("", self.families, family, np.ones(len(x), bool)), *((f, self.within[f], lang, family == f) for f in self.families)]:
            for p, q in combinations(names, 2):
                use = rows & ((of == p) | (of == q))
                self.place[key, p, q] = len(machines)
                machines.append(svm(z[use], np.where(of[use] == p, 1.0, -1.0)))
        w = np.array(machines).reshape(-1, DIM + 1)
        self.weights = np.ascontiguousarray((w[:, :-1] * self.scale).T)  # on plain frequencies
        self.bias = w[:, -1] - (w[:, :-1] * self.scale * self.centre).sum(1)

    def _choose(self, key: str, names: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The name with most won duels, ties by summed margins then order, and how sure its closest duel is."""
        n = len(values)
        if len(names) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        votes, sure = np.zeros((n, len(names))), np.ones((n, len(names)))
        for i, j in combinations(range(len(names)), 2):
            p = 1 / (1 + np.exp(-np.clip(4 * values[:, self.place[key, names[i], names[j]]], -30, 30)))
            votes[:, i] += (p >= 0.5) + p * 1e-3
            votes[:, j] += (p < 0.5) + (1 - p) * 1e-3
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = votes.argmax(1)
        return best, sure[np.arange(n), best]

    def predict(self, chunk) -> tuple[list[str], np.ndarray]:
        h, bound = trigrams(chunk)
        n, k = len(chunk), len(self.bias)
        known = _has_letter(chunk)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        values = np.empty((n, k))
        count = np.maximum(np.diff(bound), 1)
        for m in range(k):
            acc = np.concatenate(([0.0], np.cumsum(self.weights[:, m][h])))
            values[:, m] = np.diff(acc[bound]) / count + self.bias[m]
        family, sure = self._choose("", self.families, values)
        out, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for i, f in enumerate(self.families):
            mine = family == i
            if mine.any():
                best, s = self._choose(f, self.within[f], values[mine])
                out[mine], score[mine] = np.array(self.within[f], object)[best], sure[mine] * s
        out[~known], score[~known] = UNKNOWN, 0.0
        return out.tolist(), score


def _predict(tree):
    def run(batches):
        model = tree.value
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                lang, score = model.predict(chunk)
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(score), *part.columns[1:]], names=["lang_pred", "score", *part.schema.names[1:]])

    return run


def fit(docs: DataFrame, per_language: int = 400, families: dict[str, str] = FAMILIES, languages: int = MAX_LANGUAGES) -> Tree:
    """docs: doc_id, text, lang.  Rows held out, without a language or without text take no part.

    languages: of more labels, those of most rows are learned; ties go by name.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)).select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    known = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    names, rows = len(known), rows.where(F.col("lang").isin(known))
    # tasks rank their own rows first and pass on per_language of each language at most
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = rows.withColumn("rank", rank).where(F.col("rank") <= min(per_language, SAMPLE_ROWS // max(1, names))).select("text", "lang")
    got = sample.mapInArrow(_vectors, "lang string, v binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))  # the fit doesn't depend on the order of partitions
    x = np.frombuffer(b"".join(bytes(r[1]) for r in got), "<f4").reshape(-1, DIM)
    return Tree([r[0] for r in got], x, families)


def identify(docs: DataFrame, per_language: int = 400, families: dict[str, str] = FAMILIES, languages: int = MAX_LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang), repeated ids included.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if there is nothing to learn from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    tree = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, families, languages))
    out = docs.select("text", "doc_id").mapInArrow(_predict(tree), "lang_pred string, score double, doc_id long")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
