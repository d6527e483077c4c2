"""The best match and the hits of each set in an evaluation set, without a row for every pair that shares an element.

Evaluation sets are an inverted index in which each posting list is ordered by the size of its sets.  A query opens its
lists from rare elements to frequent ones.  What was counted so far is a lower bound that raises the thresholds, and what
is left of the query bounds every set that was not met yet; from such a set nothing can come unless its size is below a
limit, so only the head of a list is opened, and in the end none (after MaxScore, Turtle and Flood 1995, and WAND, Broder
et al. 2003).  Sets that were met and can still win are counted exactly.  The result is exact in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An index has about so many elements, 24 bytes each; a larger evaluation set is searched in several.
BLOCK_GRAMS = 2_000_000
#: Postings that are opened before the thresholds are raised for the first time; twice as many each time after that.
FIRST = 512


class SetIndex:
    """keys: in order; sets: distinct 64-bit elements of each."""

    def __init__(self, keys: list, sets: list[np.ndarray]):
        self.keys = keys
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
        self.elements, number = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.numbers = number  # of each set's elements, in its own order
        order = np.lexsort((self.size[owner], number))
        self.lists, self.sizes = owner[order].astype(np.int32), self.size[owner[order]]
        self.start = np.searchsorted(number[order], np.arange(len(self.elements) + 1))

    def search(self, ids: np.ndarray, percent: int, inclusive: bool, best: bool) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Largest Jaccard similarity and containment (if best), the sets that reach percent, and their similarities."""
        n = len(ids)
        at = np.minimum(np.searchsorted(self.elements, ids), max(0, len(self.elements) - 1))
        q = np.unique(at[self.elements[at] == ids]) if len(self.elements) else at[:0]
        if not len(q):
            return 0.0, 0.0, np.zeros(0, np.int64), np.zeros(0)
        length = self.start[q + 1] - self.start[q]
        q = q[np.argsort(length, kind="stable")]
        met, shared, cut_off = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        t, top_j, top_c = percent / 100, 0.0, 0.0
        limit, i, budget = np.inf, 0, FIRST
        while i < len(q) and limit > 0:
            opened, held = [], 0
            while i < len(q) and held < budget:
                a, b = self.start[q[i]], self.start[q[i] + 1]
                end = b if limit == np.inf else a + np.searchsorted(self.sizes[a:b], limit, "right")
                opened.append(self.lists[a:end])
                cut_off += end < b
                held += end - a
                i += 1
            budget *= 2
            met, back = np.unique(np.concatenate((np.repeat(met, shared), *opened)), return_counts=True)
            shared, left = back, len(q) - i
            if not len(met) or not left:
                continue
            if best:
                top_j, top_c = max(top_j, (shared / (n + self.size[met] - shared)).max()), max(top_c, (shared / self.size[met]).max())
            floor = min(t, top_j) if best else t
            limit = left / floor - n + left + 1 if floor and left >= floor * n - 1 else np.inf if not floor else 0.0
            if best and top_c < 1:
                limit = max(limit, left / top_c + 1 if top_c else np.inf)
        missed = cut_off + len(q) - i
        if missed:
            most = np.minimum(shared + missed, np.minimum(self.size[met], n))
            reach = most / (n + self.size[met] - most)
            open_ = reach >= (min(t, top_j) if best else t) - 1e-9
            if best:
                open_ |= most / self.size[met] >= top_c
            met = met[open_]
            asked = np.sort(q)
            shared = np.array([np.isin(self.numbers[self.first[m] : self.first[m + 1]], asked, assume_unique=True).sum() for m in met.tolist()], np.int64)
        union = n + self.size[met] - shared
        over = 100 * shared >= percent * union if inclusive else 100 * shared > percent * union
        j = shared / union
        if best and len(met):
            top_j, top_c = j.max(), (shared / self.size[met]).max()
        return float(top_j), float(top_c), met[over], j[over]


def _indexes(sets: DataFrame):
    """sets: key, ids.  Broadcast indexes of about BLOCK_GRAMS elements."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum(F.size("ids") + 8), F.lit(0))).first()[0]
    blocks = total // BLOCK_GRAMS + 1
    for b in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # of about BLOCK_GRAMS elements
        rows.sort(key=lambda r: r["key"])
        yield spark.sparkContext.broadcast(SetIndex([r["key"] for r in rows], [np.array(r["ids"], np.int64) for r in rows]))


def _scan(index, percent: int, inclusive: bool, pairs: bool, kinds: list[pa.DataType]):
    def run(batches):
        own = index.value
        for batch in batches:
            ids = batch.column(1)
            flat, bound = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            found = [own.search(flat[a:b], percent, inclusive, not pairs) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            if pairs:
                row = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
                hits = [own.keys[k] for f in found for k in f[2].tolist()]
                cols = [batch.column(0).take(pa.array(row)), pa.array(hits, kinds[0]), pa.array(np.concatenate([np.zeros(0), *(f[3] for f in found)]))]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "jaccard"])
            else:
                first = [own.keys[int(f[2].min())] if len(f[2]) else None for f in found]
                cols = [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array(first, kinds[0])]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "max_jaccard", "max_containment", "first_hit"])

    return run


def _run(queries: DataFrame, evaluation: DataFrame, percent: int, inclusive: bool, pairs: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    a, b = queries.schema["key"].dataType, evaluation.schema["key"].dataType
    names = f"a {a.simpleString()}, b {b.simpleString()}, jaccard double" if pairs else f"key {a.simpleString()}, max_jaccard double, max_containment double, first_hit {b.simpleString()}"
    out = None
    for index in _indexes(evaluation):
        one = queries.mapInArrow(_scan(index, percent, inclusive, pairs, [to_arrow_type(b)]), names)
        several, out = out is not None, one if out is None else out.union(one)
    if not pairs and several:
        out = out.groupBy("key").agg(F.max("max_jaccard").alias("max_jaccard"), F.max("max_containment").alias("max_containment"), F.min("first_hit").alias("first_hit"))
    return out


def best_matches(queries: DataFrame, evaluation: DataFrame, percent: int, inclusive: bool = True) -> DataFrame:
    """queries, evaluation: (key, ids), distinct 64-bit elements.  A row for each query: max_jaccard, max_containment (of an
    evaluation set in the query), and first_hit, the least evaluation key that reaches percent, or null.

    Queries are searched where they are and not shuffled; keys of queries are distinct.  Empty sets share nothing (0).
    """
    return _run(queries.select("key", "ids"), evaluation.select("key", "ids"), percent, inclusive, False)


def matches(queries: DataFrame, evaluation: DataFrame, percent: int, inclusive: bool = True) -> DataFrame:
    """All pairs (a, b, jaccard) that reach percent, which is over 0; others are not formed."""
    return _run(queries.select("key", "ids"), evaluation.select("key", "ids"), percent, inclusive, True)
