"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

Exact: every pair with ``100 * |A & B| >= threshold_pct * |A | B|`` is a link.  ``jaccard_join`` gives each document's
component and counts its links; ``jaccard_pairs`` gives the links between distinct texts.

1. Rows with equal texts are one row of the matrix; their least id stands for them.
2. Row blocks.  The full product would meet every pair that shares any n-gram, so a filter without false negatives
   chooses rows first.  Sets of sizes x <= y that reach the threshold differ in at most ``(x + y)(1 - t)/(1 + t)``
   elements.  A set is cut by hash range into m buckets, m larger than that bound, so a linked pair agrees on whole
   buckets; a bucket's content hash is a signature (the PartEnum scheme of Arasu, Ganti and Kaushik, 2006).  m depends
   on the size class; a set signs for its class and for the one below, since sizes of a linked pair differ by 1/t at
   most.  Pairs that agree on fewer signatures than a linked pair must are dropped.  A signature stands for several
   shingles at once, so a passage that many documents share makes few candidates.  Equal signatures within one batch are
   collapsed before the shuffle, which carries packed arrays.
3. Components of what is left are blocks of rows.  One of over ``block_rows`` rows or ``cell_shingles`` shingles is dealt
   into groups, and each pair of groups, and each group with itself, is a cell of its own, so that any two rows of a
   component meet once.
4. A cell's product is summed over blocks of columns into a matrix of overlap counts so far: ranges of hashes one after the
   other, and in a range from rare n-grams to frequent ones.  After each block a pair can still gain what the shorter of its rows has left; rows of which no pair can
   reach the bound that its sizes give leave the product.  Rare columns add their pairs, frequent ones are multiplied as
   dense blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.cluster import bucket_of, buckets_for, components, cut, parts
from marlstone.llm.textkernel import Chunk, U64, chunks, gram_hashes, mix, release

FLUSH = 400_000
LARGE = 8
PAIR, SIZE, MEMBER = 1, 2, 4
#: A column that over this share of a cell's rows has is multiplied as a part of a dense block of BLOCK_CELLS numbers.
DENSE, BLOCK_CELLS, SLAB = 0.08, 1 << 21, 256
#: Elements of a cell that are multiplied at a time, and shingles of all texts of a cell (8 bytes each), about.
RANGE, CELL_SHINGLES = 1 << 21, 1 << 24
SURE = 1 << 40  # the count of a pair whose sets were compared already
_OUT = "kind int, a long, b long, c long, bucket int, ids binary, sigs binary"
_MET = "kind int, a long, b long, c long"


def shingle_sets(chunk: Chunk, n: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct n-word shingle hashes; with fewer words the whole sequence; without words none."""
    words = chunk.word_hashes(lower=True)
    grams = gram_hashes(words, n)
    first, counts = chunk.words, chunk.counts
    for i, k in enumerate(counts.tolist()):
        a = int(first[i])
        if k == 0:
            yield np.zeros(0, U64)
        elif k < n:
            yield gram_hashes(words[a : a + k], k)
        else:
            s = np.sort(grams[a : a + k - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def size_classes(threshold_pct: int, top: int = 1 << 26) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper sizes of the classes; for pairs whose smaller set is in a class: most differing elements, and buckets."""
    tops, t = [1], threshold_pct
    while tops[-1] < top:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // t))
    u = np.array(tops, np.int64)
    differ = (u + u * 100 // t) * (100 - t) // (100 + t)
    return u, differ, differ + np.maximum(3, differ * 15 // 100)


class Signer:
    def __init__(self, threshold_pct: int):
        self.tops, self.differ, self.buckets = size_classes(threshold_pct)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The signatures of a sorted set, for its class and the one below, and how many a linked set must share."""
        own = int(np.searchsorted(self.tops, len(s)))
        high, mixed, out, need = s >> U64(32), mix(s ^ U64(0xA5A5A5A5A5A5A5A5)), [], 1 << 30
        for c in (own, own - 1) if own else (own,):
            m = int(self.buckets[c])
            where = (high * U64(m)) >> U64(32)
            cuts = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1))
            tag = (where[cuts] + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(c)
            out.append(mix(np.add.reduceat(mixed, cuts) ^ mix(tag)))
            need = min(need, len(cuts) - int(self.differ[c]))
            if len(cuts) <= self.differ[c]:  # so many empty buckets that a pair could agree on these alone
                void = np.setdiff1d(np.arange(m, dtype=U64), where[cuts])
                out.append(mix(mix((void + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(c)) ^ U64(0x0E0E0E0E)))
        return np.concatenate(out), max(1, need)


def _record(kind, a, b, c, bucket=None, ids=None, sigs=None) -> pa.RecordBatch:
    n = len(a)
    more = [] if bucket is None else [pa.array(bucket, pa.int32()), pa.array(ids if ids is not None else [None] * n, pa.binary()), pa.array(sigs if sigs is not None else [None] * n, pa.binary())]
    cols = [pa.array(np.broadcast_to(np.asarray(x, np.int64), n)) for x in (a, b, c)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cols, *more], names=["kind", "a", "b", "c", "bucket", "ids", "sigs"][: 4 + len(more)])


def _groups(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and size of each run of equal signatures."""
    if not len(sigs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(sigs[1:] != sigs[:-1]) + 1))
    return first, np.diff(np.append(first, len(sigs)))


def _sign(n: int, threshold_pct: int, buckets: int):
    def run(batches):
        signer = Signer(threshold_pct)
        sigs, owners, docs, sizes, needs, same, held = [], [], [], [], [], {}, 0

        def flush():
            ids = np.array(docs, np.int64)
            yield _record(PAIR, [d for d, r in copies if d != r], [r for d, r in copies if d != r], SURE, [docs[0] % buckets] * sum(d != r for d, r in copies))
            s = np.concatenate(sigs) if sigs else np.zeros(0, U64)
            d = np.repeat(np.array([r for r, _ in owners], np.int64), [k for _, k in owners])
            order = np.argsort(s, kind="stable")
            s, d = s[order], d[order]
            first, size = _groups(s)
            late = np.arange(len(s)) - np.repeat(first, size) > LARGE
            where = bucket_of(s, buckets)
            yield _record(MEMBER, d[late], _name(s[late], where[late]), 0, where[late])
            s, d, where = s[~late], d[~late], where[~late]
            cuts = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(s)])) if len(s) else np.array([0])
            table, at = np.unique(d, return_inverse=True)
            six = s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]  # a bucket stands for much of the rest
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield _record(0, np.zeros(len(spans), np.int64), 0, 0, where[cuts[:-1]], [_ids(table, at[x:y]) for x, y in spans], [six[x:y].tobytes() for x, y in spans])
            yield _record(SIZE, [0], 0, 0, [docs[0] % buckets], [ids.tobytes()], [np.array([sizes, needs], np.int64).tobytes()])

        copies = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                for i, s in enumerate(shingle_sets(chunk, n)):
                    doc = int(ids[chunk.first + i])
                    got, need = signer(s) if len(s) else (s, 1)
                    docs.append(doc)
                    sizes.append(len(s))
                    needs.append(need)
                    if len(s):
                        key = (len(s), int(got.sum()), int(got[0]))
                        twin = same.setdefault(key, len(owners))
                        if twin < len(owners) and np.array_equal(sigs[twin], got):
                            copies.append((doc, owners[twin][0]))  # an equal set, of which one is enough here
                            continue
                        sigs.append(got)
                        owners.append((doc, len(got)))
                        held += len(got)
                if held >= FLUSH or len(docs) >= 65_000:
                    yield from flush()
                    sigs, owners, docs, sizes, needs, same, copies, held = [], [], [], [], [], {}, [], 0
        if docs:
            yield from flush()
        del sigs, owners, docs, sizes, needs, same, copies
        release()

    return run


def _name(sigs: np.ndarray, where: np.ndarray) -> np.ndarray:
    """A long for a signature, made of what the packed rows keep of it."""
    return ((where & 0x7FFF) << 48) | (sigs & U64((1 << 48) - 1)).astype(np.int64)


def _ids(table: np.ndarray, at: np.ndarray) -> bytes:
    """The documents of one packed row: those it names, then an index into them for each signature."""
    used, at = np.unique(at, return_inverse=True)
    wide = np.dtype("<u2") if len(used) <= 65_536 else np.dtype("<u4")
    return np.array([len(used), wide.itemsize], "<i8").tobytes() + table[used].astype("<i8").tobytes() + at.astype(wide).tobytes()


def _read_ids(b: bytes) -> np.ndarray:
    k, wide = np.frombuffer(b, "<i8", 2).tolist()
    return np.frombuffer(b, "<i8", k, 16)[np.frombuffer(b, f"<u{wide}", -1, 16 + 8 * k)]


def count_pairs(first: np.ndarray, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (larger, smaller id) of members of one group, and in how many of the groups, of LARGE at most, they meet."""
    table, at = np.unique(docs, return_inverse=True)
    found = [np.zeros(0, np.int64)]
    for k in range(2, LARGE + 1):
        rows = first[size == k]
        if len(rows):
            x, y = np.triu_indices(k, 1)
            x, y = at[rows[:, None] + x], at[rows[:, None] + y]
            found.append((np.maximum(x, y) * len(table) + np.minimum(x, y))[x != y])
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return table[keys // max(1, len(table))], table[keys % max(1, len(table))], n


def _meet(batches):
    """Packed signatures, bucket by bucket, to counted pairs and members of large groups; other rows pass through."""

    def close(sigs: list[np.ndarray], docs: list[np.ndarray]):
        sigs, docs = np.concatenate(sigs), np.concatenate(docs)
        order = np.argsort(sigs, kind="stable")
        sigs, docs = sigs[order], docs[order]
        del order
        first, size = _groups(sigs)
        yield _record(PAIR, *count_pairs(first, size, docs))
        large = np.repeat(size > LARGE, size)
        yield _record(MEMBER, docs[large], sigs[large], 0)

    sigs, docs, last = [], [], None
    for batch in batches:
        kind = batch.column(0).to_numpy(zero_copy_only=False)
        ids, packed, bucket = batch.column(5), batch.column(6), batch.column(4).to_numpy(zero_copy_only=False)
        through = np.flatnonzero((kind == PAIR) | (kind == MEMBER))
        if len(through):
            yield pa.RecordBatch.from_arrays([x.take(pa.array(through)) for x in batch.columns[:4]], names=["kind", "a", "b", "c"])
        for i in np.flatnonzero(kind == SIZE):
            d, (n, need) = np.frombuffer(ids[i].as_py(), np.int64), np.frombuffer(packed[i].as_py(), np.int64).reshape(2, -1)
            yield _record(SIZE, d, n, need)
        for i in np.flatnonzero(kind == 0):
            if bucket[i] != last and sigs:
                yield from close(sigs, docs)
                sigs, docs = [], []
            last = bucket[i]
            six = np.frombuffer(packed[i].as_py(), np.uint8).reshape(-1, 6)
            full = np.zeros((len(six), 8), np.uint8)
            full[:, :6] = six
            sigs.append(_name(full.view("<u8").ravel(), np.full(len(six), last, np.int64)))
            docs.append(_read_ids(ids[i].as_py()))
    if sigs:
        yield from close(sigs, docs)
    del sigs, docs
    release()


def _forest(batches):
    """Rows (doc_id, sig) of a part of the documents to each document's root in it, and each signature's roots."""
    doc, sig = [], []
    for batch in batches:
        doc.append(batch.column(0).to_numpy(zero_copy_only=False))
        sig.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not doc:
        return
    docs, row = np.unique(np.concatenate(doc), return_inverse=True)
    sigs, col = np.unique(np.concatenate(sig), return_inverse=True)
    root, last = np.arange(len(docs)), None
    while last is None or (root != last).any():
        last, least = root, np.full(len(sigs), len(docs))
        np.minimum.at(least, col, root[row])
        root = root.copy()
        np.minimum.at(root, row, least[col])
        root = root[root]
    pairs = np.unique(col * len(docs) + root[row])
    out = [np.concatenate(x) for x in ((docs, np.zeros(len(pairs), np.int64)), (np.zeros(len(docs), np.int64), sigs[pairs // len(docs)]), (docs[root], docs[pairs % len(docs)]))]
    tree = np.arange(len(docs) + len(pairs)) >= len(docs)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], mask=tree), pa.array(out[1], mask=~tree), pa.array(out[2])], names=["doc", "sig", "root"])


def candidates(docs: DataFrame, n: int, threshold_pct: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of which the components hold all linked pairs, and (doc_id, n_shingles)."""
    buckets = buckets_for(docs)
    met = docs.mapInArrow(_sign(n, threshold_pct, buckets), _OUT).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _MET)
    met = cut(met)
    sizes = met.where(F.col("kind") == SIZE).groupBy(F.col("a").alias("doc_id")).agg(F.max("b").alias("n_shingles"), F.min("c").alias("need"))
    member = met.where(F.col("kind") == MEMBER).select(F.col("a").alias("doc_id"), F.col("b").alias("sig"))
    in_large = member.groupBy("doc_id").agg(F.count("*").alias("lost"))
    need = cut(sizes.join(in_large, "doc_id", "left").select("doc_id", (F.col("need") - F.coalesce("lost", F.lit(0))).alias("need")))
    pairs = met.where(F.col("kind") == PAIR)
    sure = pairs.where(F.col("c") >= SURE).select("a", "b")  # a text with very many copies is met here only
    pairs = pairs.where(F.col("c") < SURE).repartition(buckets, "a").groupBy("a", "b").agg(F.sum("c").alias("c"))
    for side in ("a", "b"):
        pairs = pairs.join(need.select(F.col("doc_id").alias(side), "need"), side).where("c >= need").drop("need")
    # each part of the documents becomes a forest over what its large groups join; then the parts' trees meet by group
    star = member.join(need.where("need < 1"), "doc_id", "left_semi").repartition(buckets, "doc_id").mapInArrow(_forest, "doc long, sig long, root long")
    star = cut(star)
    trees = star.where("sig is not null").withColumn("near", F.min("root").over(Window.partitionBy("sig"))).select(F.col("root").alias("doc"), F.col("near").alias("root"))
    star = star.where("sig is null").select("doc", "root").union(trees).where("doc > root").distinct().select(F.col("doc").alias("a"), F.col("root").alias("b"))
    return pairs.select("a", "b").union(sure).union(star), sizes.select("doc_id", "n_shingles")


def _sparse(counts: np.ndarray, holders: np.ndarray, start: np.ndarray, spread: np.ndarray, n0: int) -> None:
    """Adds the pairs of rows that share a column to counts; a column's rows are holders[start:start + spread], in order.

    n0: rows below it are the first side's, and only pairs of both sides count; 0 for pairs within one side.
    """
    k0, k1 = counts.shape
    for d in np.unique(spread).tolist():
        cols = start[spread == d]
        x, y = np.triu_indices(d, 1)
        step = max(1, 2_000_000 // len(x))
        for i in range(0, len(cols), step):
            rows = holders[cols[i : i + step, None] + np.arange(d)]
            a, b = rows[:, x].ravel(), rows[:, y].ravel()
            if n0:
                across = (a < n0) & (b >= n0)
                a, b = a[across], b[across] - n0
            at = a * k1 + b
            if k0 * k1 <= 4 * len(at):
                counts += np.bincount(at, minlength=k0 * k1).reshape(k0, k1)
            else:
                np.add.at(counts.reshape(-1), at, 1)


def overlap_counts(parts: Iterator[tuple[np.ndarray, np.ndarray]], size: np.ndarray, n0: int, threshold_pct: int) -> np.ndarray:
    """Overlaps of rows (of both sides if n0, else of pairs a < b) as a matrix; 0 or too little for pairs without a link.

    parts: ranges of columns as (row, column) of each element of the incidence matrix; size: the rows' whole sizes.
    """
    k, t = len(size), threshold_pct
    counts = np.zeros((n0, k - n0) if n0 else (k, k), np.float32)
    left = size.astype(np.float32)
    live = np.arange(k)
    for owner, cols in parts:
        left -= np.bincount(owner, minlength=k)
        on = np.zeros(k, bool)
        on[live] = True
        cols, owner = cols[on[owner]], owner[on[owner]]
        _, cols, spread = np.unique(cols, return_inverse=True, return_counts=True)
        met = spread > 1  # what a single row has is in no overlap
        owner, cols = owner[met[cols]], (np.cumsum(met) - 1)[cols[met[cols]]]
        left += np.bincount(owner, minlength=k)
        live = _add_columns(counts, left, live, owner, cols, size, n0, t)
        if not len(live):
            break
    return counts


def _add_columns(counts: np.ndarray, left: np.ndarray, live: np.ndarray, owner: np.ndarray, cols: np.ndarray, size: np.ndarray, n0: int, t: int) -> np.ndarray:
    """Adds blocks of columns to counts, from rare to frequent ones, and takes them from left; the rows that stay live."""
    if not len(cols):
        return live
    k = len(size)
    spread = np.bincount(cols)
    rare = np.argsort(spread, kind="stable")  # columns from rare to frequent
    place = np.empty_like(rare)
    place[rare] = np.arange(len(rare))
    order = np.argsort(place[cols] * k + owner)
    holders, spread = owner[order], spread[rare]
    start = np.cumsum(spread) - spread
    dense = int(np.searchsorted(spread, max(2, k * DENSE), "right"))  # from there on a dense product is cheaper
    width = max(64, BLOCK_CELLS // max(k, 1))
    blocks = [(0, dense), *((c, min(c + width, len(spread))) for c in range(dense, len(spread), width))]
    for c, d in blocks:
        if c == d:
            continue
        own = holders[start[c] : start[d - 1] + spread[d - 1]]
        left -= np.bincount(own, minlength=k)
        if d <= dense:
            _sparse(counts, holders, start[c:d], spread[c:d], n0)
        else:
            x = np.zeros((k, d - c), np.float32)
            x[own, np.repeat(np.arange(d - c), spread[c:d])] = 1
            if n0:
                one, two = live[live < n0], live[live >= n0]
                counts[np.ix_(one, two - n0)] += x[one] @ x[two].T
            else:
                counts[np.ix_(live, live)] += x[live] @ x[live].T
        live = _still_live(counts, left, size, live, n0, t)
        if not len(live):
            break
    return live


def _still_live(counts: np.ndarray, left: np.ndarray, size: np.ndarray, live: np.ndarray, n0: int, t: int) -> np.ndarray:
    """The rows of which some pair can still reach its bound, from the rows that could before."""
    one, two = (live[live < n0], live[live >= n0]) if n0 else (live, live)
    good = np.zeros(len(size), bool)
    for i in range(0, len(one), SLAB):
        p = one[i : i + SLAB]
        most = counts[np.ix_(p, two - n0)] + np.minimum(left[p][:, None], left[two])
        can = (100 + t) * most >= t * (size[p][:, None] + size[two])
        if not n0:
            can &= p[:, None] < two
        good[p[can.any(1)]] = True
        good[two[can.any(0)]] = True
    return np.flatnonzero(good)


def _ranges(sets: list[np.ndarray], total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The elements of sorted sets by ranges of hashes, about RANGE at a time: (row, element) of each."""
    n = total // RANGE + 1
    cuts = [np.searchsorted(s, np.array([(i << 64) // n for i in range(1, n)], U64)) for s in sets] if n > 1 else [np.zeros(0, np.int64)] * len(sets)
    bounds = np.concatenate((np.zeros((len(sets), 1), np.int64), np.array(cuts, np.int64).reshape(len(sets), n - 1), np.array([[len(s)] for s in sets], np.int64)), axis=1)
    for i in range(n):
        a, b = bounds[:, i].tolist(), bounds[:, i + 1].tolist()
        yield np.repeat(np.arange(len(sets)), bounds[:, i + 1] - bounds[:, i]), np.concatenate([s[x:y] for s, x, y in zip(sets, a, b, strict=True)])


def near_pairs(sets: list[np.ndarray], threshold_pct: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All linked pairs, each once: a row, the rows linked with it that were not its pivots, and the overlaps.

    side: 0 or 1 for each row; then only pairs of rows of both sides are tested.  A set without elements has no links.
    """
    t = threshold_pct
    size = np.array([len(s) for s in sets], np.int64)
    rows = np.flatnonzero(size)
    side = np.zeros(len(size), np.int64) if (one := side is None) else side.astype(np.int64)
    rows = rows[np.argsort(side[rows], kind="stable")]
    k, size, side = len(rows), size[rows], side[rows]
    n0 = 0 if one else int((side == 0).sum())
    if k < 2 or not one and n0 in (0, k):
        return
    counts = overlap_counts(_ranges([sets[i] for i in rows.tolist()], int(size.sum())), size, n0, t)
    for i in range(0, len(counts), SLAB):
        part = counts[i : i + SLAB].astype(np.int64)
        hits = (100 + t) * part >= t * (size[i : i + SLAB][: len(part), None] + size[n0:])
        if one:
            hits &= np.arange(i, i + len(part))[:, None] < np.arange(k)
        for p in np.flatnonzero(hits.any(1)).tolist():
            hit = np.flatnonzero(hits[p])
            yield int(rows[i + p]), rows[n0 + hit], part[p, hit]


def _by_cell(n: int, block):
    """Calls block with each cell's rows (doc_id, flag, label, shingles); the small batches it makes leave together."""

    def cells(batches):
        key, rows = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[1:]]
            sets = [s for chunk in chunks(batch.column(0)) for s in shingle_sets(chunk, n)]
            for comp, cell, doc, flag, label, grams in zip(*cols, sets, strict=True):
                if (comp, cell) != key and rows:
                    yield from block(rows)
                    rows = []
                key = (comp, cell)
                rows.append((doc, bool(flag), label, grams))
        if rows:
            yield from block(rows)

    def run(batches):
        held, k = [], 0
        for batch in cells(batches):
            held.append(batch)
            k += batch.num_rows
            if k >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, k = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _near(rows: list[tuple], threshold_pct: int):
    """A cell's ids in order, their copies, and its linked pairs; label: copies of the text, negative on the second side."""
    rows = list({r[0]: r for r in rows}.values())  # a repeated row counts once
    rows.sort(key=lambda r: r[0])
    ids, label = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    return ids, np.abs(label), near_pairs([r[3] for r in rows], threshold_pct, label < 0 if rows[0][1] else None)


def _count(n: int, threshold_pct: int):
    """Rows of cells to (row, least row its links lead to in the cell, its links there with every copy counted)."""

    def block(rows: list[tuple]):
        ids, copies, near = _near(rows, threshold_pct)
        root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for p, hit, _ in near:
            links[p] += copies[hit].sum()
            links[hit] += copies[p]
            if (root[hit] != root[p]).any():
                group = np.unique(np.append(root[hit], root[p]))
                root[np.isin(root, group)] = group[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(links)], names=["a", "b", "links"])

    return _by_cell(n, block)


def _list(n: int, threshold_pct: int):
    """Rows of cells to linked pairs (a, b, overlap), a the lesser id."""

    def batch(out):
        a, b, o = map(np.concatenate, zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(o.astype(np.int64))], names=["a", "b", "n_shared"])

    def block(rows: list[tuple]):
        ids, _, near = _near(rows, threshold_pct)
        out, held = [], 0
        for p, hit, overlap in near:
            out.append((np.full(len(hit), ids[p]), ids[hit], overlap))
            held += len(hit)
            if held >= 100_000:
                yield batch(out)
                out, held = [], 0
        if out:
            yield batch(out)

    return _by_cell(n, block)


def _in_cells(cells: DataFrame, docs: DataFrame, run, schema: str) -> DataFrame:
    rows = cells.join(docs, "doc_id").select("text", "comp", "cell", "doc_id", "flag", "label")
    rows = rows.repartition(parts(docs.sparkSession), "comp", "cell").sortWithinPartitions("comp", "cell")
    return rows.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def _all_cells(comp: DataFrame, block_rows: int, cell_shingles: int) -> DataFrame:
    """comp: node, component, copies, n_shingles.  Cells in which any two rows of a component meet exactly once.

    A component of over block_rows rows or cell_shingles shingles is dealt into groups of about half as many; a cell holds
    two groups, or one.
    """
    wide = comp.groupBy("component").agg((2 * F.greatest(F.count("*") / block_rows, F.sum("n_shingles") / cell_shingles)).alias("halves"))
    wide = wide.where("halves > 2").select(F.col("component").alias("c"), F.ceil("halves").cast("int").alias("k"))
    rows = comp.join(wide, F.col("component") == F.col("c"), "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cell = F.least("g", "x") * F.col("k") + F.greatest("g", "x")
    label = F.when(F.col("g") > F.col("x"), -F.col("copies")).otherwise(F.col("copies"))
    return rows.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"), cell.alias("cell"), (F.col("g") != F.col("x")).alias("flag"), label.alias("label"))


def _blocks(docs: DataFrame, n: int, threshold_pct: int, block_rows: int, cell_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows to take part, (doc_id, key), the texts' (key, doc_id, copies), (doc_id, n_shingles), cells of texts with candidates."""
    keyed = cut(docs.groupBy("doc_id").agg(F.min(F.md5("text")).alias("key"), F.max(F.md5("text")).alias("last")))
    if keyed.where("key <> last").take(1):
        own = keyed.select(F.col("doc_id").alias("id"), "key")
        docs = docs.join(own, (F.col("doc_id") == F.col("id")) & (F.md5("text") == F.col("key")), "left_semi")
    keyed = keyed.drop("last")
    first = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    edges, sizes = candidates(docs, n, threshold_pct)
    comp = components(edges).join(first.select(F.col("doc_id").alias("node"), "copies"), "node").join(sizes.withColumnRenamed("doc_id", "node"), "node")
    return docs, keyed, first, sizes, _all_cells(cut(comp), block_rows, cell_shingles)


def jaccard_join(docs: DataFrame, n: int = 5, threshold_pct: int = 80, block_rows: int = 4096, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Components and counts of links of documents by Jaccard similarity of n-word shingle sets.

    docs: doc_id and text; other columns are ignored, rows with a null id are left out.  Returns doc_id, n_shingles
    (long), component_id (the least doc_id reachable by links), text_id (the least doc_id of an equal text, which stands
    for it in jaccard_pairs) and n_links (long: the other documents linked with it, exact copies included).  A-Z count as
    lower case.  A null, empty or blank text has no shingles and is linked with nothing; an empty table gives no rows.
    Rows with one id are one document and give one row: repeated rows count once, and of different texts the one with the
    least MD5 is meant.
    """
    docs, keyed, first, sizes, cells = _blocks(_texts(docs), n, threshold_pct, block_rows, cell_shingles)
    part = cut(_in_cells(cells, docs, _count(n, threshold_pct), "a long, b long, links long"))
    links = part.groupBy(F.col("a").alias("doc_id")).agg(F.sum("links").alias("links"))
    whole = components(part.select("a", "b")).select(F.col("node").alias("doc_id"), "component")
    known = first.join(sizes, "doc_id").join(links, "doc_id", "left").join(whole, "doc_id", "left")
    some = F.col("n_shingles") > 0
    known = known.select(
        "key", F.col("doc_id").alias("text_id"), "n_shingles", F.when(some, F.coalesce("component", "doc_id")).alias("c"),
        F.when(some, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
    )
    return keyed.join(known, "key").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), "text_id", "n_links")


def jaccard_pairs(docs: DataFrame, n: int = 5, threshold_pct: int = 80, block_rows: int = 4096, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Every link between two different texts: a < b (each text's least doc_id) and n_shared shingles.

    With text_id of jaccard_join they give all links of documents.  Their number grows with the square of a group's size.
    """
    docs, _, _, _, cells = _blocks(_texts(docs), n, threshold_pct, block_rows, cell_shingles)
    return _in_cells(cells, docs, _list(n, threshold_pct), "a long, b long, n_shared long")
