"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item of g shingles is contained in a document if it shares at least ``threshold_pct`` per cent of them.  Items are
partitioned by size; an item's sketch is its k least shingle hashes (a bottom-k MinHash), with k chosen by its partition
so that a containing document misses fewer than k of any item's shingles there.  So each containing document shares
``SPARE`` of the sketch's hashes at least: the search has no false negatives, however long the document, and never
compares an item with a document that shares fewer.  Candidates are verified with the full sets of shingles, compared as
bytes.

Items of up to ``BLOCK_BYTES`` together are broadcast to one pass over the documents, whose texts are not shuffled.  For
a larger benchmark the documents' shingle hashes are joined with the sketches' in one pass, and only the texts of
candidate pairs are fetched; results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import fresh, with_row_ids
from marlstone.llm.textkernel import _LOWER, U64, chunks, gram_hashes

BLOCK_BYTES = 16 << 20
SPARE = 2
_FOUND = "doc_id long, item_id long, n_shingles long, n_shared long"


def _lowered(chunk) -> bytes:
    return _LOWER[chunk.data].tobytes()


def _shingle(chunk, low: bytes, at: int, n: int) -> bytes:
    """The n words from word at on, joined by one space."""
    return b" ".join(low[chunk.start[i] : chunk.end[i]] for i in range(at, at + n))


def _sketch(s: np.ndarray, threshold_pct: int) -> tuple[np.ndarray, int]:
    """An item's sketch, and how many of its hashes a containing document shares at least.

    The top of a size partition is a power of two; its sketches outnumber what its largest item may miss.
    """
    top = 1 << (len(s) - 1).bit_length()
    sketch = s[: top * (100 - threshold_pct) // 100 + SPARE]
    return sketch, max(1, len(sketch) - len(s) * (100 - threshold_pct) // 100)


class ItemIndex:
    """Sketches and shingle sets of a bounded block of items; items of fewer than n words have one whole-text shingle."""

    def __init__(self, ids: list[int], texts: list[str], n: int, threshold_pct: int):
        self.sets, self.ids, self.grams, self.shingles = [], [], [], []
        for chunk in chunks(pa.array(texts, pa.string())):
            words, low = chunk.word_hashes(lower=True), _lowered(chunk)
            for i, k in enumerate(chunk.counts.tolist()):
                if k:
                    a, g = int(chunk.words[i]), min(n, k)
                    self.sets.append(np.unique(gram_hashes(words[a : a + k], g)))
                    self.grams.append(g)
                    self.ids.append(ids[chunk.first + i])
                    self.shingles.append({_shingle(chunk, low, j, g) for j in range(a, a + k - g + 1)})
        sketches, need = zip(*(_sketch(s, threshold_pct) for s in self.sets), strict=True) if self.sets else ((), ())
        self.need = np.array(need, np.int64)
        self.tables = {}
        for g in set(self.grams):
            own = [i for i, x in enumerate(self.grams) if x == g]
            hashes = np.concatenate([sketches[i] for i in own])
            items = np.repeat(own, [len(sketches[i]) for i in own])
            order = np.argsort(hashes, kind="stable")
            table, first = np.unique(hashes[order], return_index=True)
            coarse = np.zeros(1 << 20, bool)
            coarse[(table >> U64(44)).astype(np.int64)] = True
            self.tables[g] = table, np.append(first, len(order)), items[order], coarse

    def search(self, chunk) -> list[tuple[int, int, int, int]]:
        """(row, item id, shingles of the item, shared) for each row that contains an item."""
        found = []
        words = chunk.word_hashes(lower=True)
        row_of = chunk.row_of_word()
        for g, (table, first, items, coarse) in self.tables.items():
            grams = gram_hashes(words, g)
            at = np.flatnonzero(coarse[(grams >> U64(44)).astype(np.int64)])
            where = np.searchsorted(table, grams[at])
            hit = table[np.minimum(where, len(table) - 1)] == grams[at]
            at, where = at[hit], where[hit]
            inside = row_of[at] == row_of[at + g - 1]
            pairs = np.unique(row_of[at[inside]] * len(table) + where[inside])  # a hash counts once for each row
            row, where = pairs // len(table), pairs % len(table)
            n = first[where + 1] - first[where]
            item = items[np.repeat(first[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            keys, hits = np.unique(np.repeat(row, n) * len(self.ids) + item, return_counts=True)
            good = hits >= self.need[keys % len(self.ids)]
            low = _lowered(chunk) if good.any() else b""
            for key in keys[good].tolist():
                r, i = divmod(key, len(self.ids))
                a, b = int(chunk.words[r]), int(chunk.words[r + 1])
                s, own = self.sets[i], grams[a : b - g + 1]
                hits = np.flatnonzero(s[np.minimum(np.searchsorted(s, own), len(s) - 1)] == own)
                shared = {_shingle(chunk, low, a + j, g) for j in hits.tolist()} & self.shingles[i]
                found.append((r, self.ids[i], len(self.shingles[i]), len(shared)))
        return found


def _scan(index, threshold_pct: int):
    def run(batches):
        items = index.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                rows = [x for x in items.search(chunk) if 100 * x[3] >= threshold_pct * x[2]]
                doc = [int(ids[chunk.first + r[0]]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def _item_sketches(n: int, threshold_pct: int):
    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for chunk in chunks(batch.column(1)):
                words = chunk.word_hashes(lower=True)
                for i, k in enumerate(chunk.counts.tolist()):
                    if k:
                        a, g = int(chunk.words[i]), min(n, k)
                        sketch, need = _sketch(np.unique(gram_hashes(words[a : a + k], g)), threshold_pct)
                        out.extend((ids[chunk.first + i], g, h, need) for h in sketch.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["item_id", "g", "hash", "need"])

    return run


def _doc_hashes(n: int):
    """Each document's distinct shingle hashes, of 1 to n words, since an item of fewer than n words is one shingle."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                words, row_of = chunk.word_hashes(lower=True), chunk.row_of_word()
                for g in range(1, n + 1):
                    grams = gram_hashes(words, g)
                    inside = row_of[: len(grams)] == row_of[g - 1 :]
                    row, h = row_of[: len(grams)][inside], grams[inside]
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                    doc = ids[chunk.first + row[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.full(len(doc), g, np.int32)), pa.array(h[new].view(np.int64))], names=["doc_id", "g", "hash"])

    return run


def _verify(n: int, threshold_pct: int):
    """(doc_id, text, item_id, item) to the items that are contained."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, item, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = next(chunks(pa.array([text], pa.string())))
                out.extend((doc, *r[1:]) for r in ItemIndex([item], [words], n, threshold_pct).search(chunk) if 100 * r[3] >= threshold_pct * r[2])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold_pct: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: each document with each item that it contains.

    docs: doc_id, text; items: item_id, text; other columns are ignored, rows with a null id are left out.  A-Z count as
    lower case.  Null or blank texts contain nothing and are contained in nothing; an item of fewer than n words is
    found where its whole word sequence stands.  Rows that occur twice give equal rows, which are returned once; texts of
    one id are searched one by one.  An empty table of either gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if total <= block_bytes:
        rows = items.collect()  # of block_bytes at most
        index = ItemIndex([r[0] for r in rows], [r[1] for r in rows], n, threshold_pct)
        if not index.ids:
            return spark.createDataFrame([], _FOUND + ", containment double")
        out = docs.mapInArrow(_scan(spark.sparkContext.broadcast(index), threshold_pct), _FOUND)
    else:
        sketches = items.mapInArrow(_item_sketches(n, threshold_pct), "item_id long, g int, hash long, need long")
        met = docs.mapInArrow(_doc_hashes(n), "doc_id long, g int, hash long").join(sketches, ["g", "hash"])
        # texts of one id may add up here; the texts themselves decide
        pairs = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.min("need").alias("need")).where("hits >= need").select("doc_id", "item_id")
        both = docs.join(pairs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "text", "item_id", "item")
        out = both.mapInArrow(_verify(n, threshold_pct), _FOUND)
    return out.distinct().withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def remove_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold_pct: int = 80) -> DataFrame:
    """The rows of docs that contain no item, with their columns, whatever their names.

    A row is judged by its own text: of an id with several texts only those go that contain an item, and rows without an
    id are judged too.  Rows that repeat stay or go together; null and empty texts stay; no items, or none with a word,
    remove nothing.
    """
    rows, row = with_row_ids(docs)
    name = fresh(rows, "bad")
    bad = contained_items(rows.select(F.col(row).alias("doc_id"), "text"), items, n, threshold_pct).select(F.col("doc_id").alias(name)).distinct()
    return rows.join(bad, F.col(row) == F.col(name), "left_anti").drop(row)
