"""n-gram sets, set similarity, MinHash, and similarity joins by inverted index and by prefix filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import bucket_of, buckets_for
from marlstone.llm.textkernel import U64, Chunk, chunks, gram_hashes, mix, release, span_hash


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, also where body uses it inside of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ngrams(tokens: Column, n: Column | int) -> Column:
    """Joined n-token runs; empty if there are fewer tokens than n.  tokens must be bound already."""
    n = F.lit(n) if isinstance(n, int) else n
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - n + 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def adaptive_grams(text: Column) -> Column:
    """Lower-cased letter and digit tokens as a set: single ones below three, runs of 3 for three or four, else of 4."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return let(tokens, lambda t: let(F.when(F.size(t) < 3, 1).when(F.size(t) < 5, 3).otherwise(4), lambda n: _ngrams(t, n)))


def word_grams(text: Column, n: int = 4, lower: bool = True, short: str = "empty") -> Column:
    """n-grams of white-space tokens; a text with fewer tokens gives the empty set, or as a whole one gram."""
    def made(t: Column) -> Column:
        out = _ngrams(t, n)
        return F.when((F.size(t) < n) & (F.coalesce(text, F.lit("")) != ""), F.array(text)).otherwise(out) if short == "whole" else out

    return let(words(F.lower(text) if lower else text), made)


def char_grams(text: Column, n: int) -> Column:
    """Runs of n characters; a shorter text gives itself."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: F.substring(t, i, F.lit(n)))
    return F.array_distinct(let(F.coalesce(text, F.lit("")), cut))


def mixed_grams(text: Column, n: int = 4) -> Column:
    """Word n-grams; with fewer words character n-grams; with fewer characters the set of characters."""
    t = F.lower(F.coalesce(text, F.lit("")))
    chars = F.when(F.length(t) >= n, char_grams(t, n)).otherwise(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")))
    return let(words(t), lambda w: F.when(F.size(w) >= n, _ngrams(w, n)).otherwise(chars))


def char_shingles(text: Column, n: int = 5) -> Column:
    """Character shingles of the lower-cased text with its white space collapsed."""
    return char_grams(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), n)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """|A & B| / |A | B|; what two empty sets have is a convention."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def one_permutation(rows: list[np.ndarray], k: int) -> np.ndarray:
    """Signatures of sets of 64-bit hashes, from one pass over their elements; a row of zeros for the empty set.

    A hash falls into one of k bins and the least of a bin is its slot (Li, Owen and Zhang, 2012).  An empty bin takes the
    slot of a full one that a sequence of hashes of the bin alone picks, the same for every set (Shrivastava, 2017), so
    slots of two sets still agree with the probability of their Jaccard similarity.
    """
    size = np.array([len(r) for r in rows], np.int64)
    h = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    none = np.iinfo(np.uint64).max
    own = np.full((len(rows), k), none, np.uint64)
    np.minimum.at(own, (np.repeat(np.arange(len(rows)), size), ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)), h & np.uint64(none >> 1))
    out, full = own.copy(), own != none
    row, slot = np.nonzero(~full & (size > 0)[:, None])
    turn = 0
    while len(row):
        turn += 1
        pick = (slot.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(turn * 0xFF51AFD7ED558CCD & (1 << 64) - 1)
        pick = (pick ^ (pick >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        pick = ((pick >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        found = full[row, pick]
        out[row[found], slot[found]] = own[row[found], pick[found]]
        row, slot = row[~found], slot[~found]
    out[size == 0] = 0
    return out.astype(np.int64)


def minhash(rows: DataFrame, k: int = 128) -> DataFrame:
    """rows: (key, grams or ids).  (key, signature) with k slots; null for the empty set.  Grams are hashed once, not for each slot."""
    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            flat, bound = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            made = one_permutation([flat[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)], k)
            made = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), k).cast(pa.list_(pa.int64()))
            full = pa.array(np.where(np.diff(bound) > 0, np.arange(len(made)), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), made.take(pc.if_else(pc.less(full, 0), pa.scalar(None, pa.int64()), full))], names=["key", "signature"])

    kind = rows.schema["key"].dataType.simpleString()
    return with_ids(rows).mapInArrow(run, f"key {kind}, signature array<bigint>")


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal slots, which estimates the Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def lsh_bands(threshold: float, k: int = 128) -> tuple[int, int]:
    """Bands and rows whose collision curve (1/b)^(1/r) is nearest to the threshold."""
    return min(((k // r, r) for r in range(1, k + 1)), key=lambda x: abs((1 / x[0]) ** (1 / x[1]) - threshold))


def bands(signature: str, threshold: float, k: int = 128) -> Column:
    """One hash for each band, of its number and its slots."""
    b, r = lsh_bands(threshold, k)
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.xxhash64(i, F.slice(F.col(signature), i * r + 1, r)))


def lsh_candidates(index: DataFrame, queries: DataFrame, threshold: float, key: str = "key", signature: str = "signature", k: int = 128) -> DataFrame:
    """Pairs (query, hit) of different keys that agree on a whole band, with the estimated similarity.

    Both sides are shuffled; where one is asked more than once, see lsh_index.
    """
    def banded(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(signature).isNotNull()).select(F.col(key).alias(name), F.explode(bands(signature, threshold, k)).alias("band"))

    pairs = banded(queries, "query").join(banded(index, "hit"), "band").where(F.col("query") != F.col("hit")).select("query", "hit").distinct()
    pairs = pairs.join(queries.select(F.col(key).alias("query"), F.col(signature).alias("a")), "query").join(index.select(F.col(key).alias("hit"), F.col(signature).alias("b")), "hit")
    return pairs.select("query", "hit", signature_similarity(F.col("a"), F.col("b")).alias("estimate"))


def gram_ids(grams: str) -> Column:
    """A set's grams as distinct 64-bit hashes."""
    return F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))


def with_ids(rows: DataFrame) -> DataFrame:
    """rows: (key, grams) or (key, ids), as (key, ids)."""
    return rows.select("key", "ids" if "ids" in rows.columns else gram_ids("grams").alias("ids"))


#: Text of which the white-space words are the tokens, and tokens of a gram (None: by their number, see adaptive_grams).
TOKENS = {
    "lower": (F.lower, 4), "cased": (lambda t: t, 4),
    "adaptive": (lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]+", " "), None),
}


def _row_grams(chunk: Chunk, n: int | None, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each row of a chunk: the grams row by row, and how many each row has."""
    words, counts, first = chunk.word_hashes(), chunk.counts, chunk.words[:-1]
    size = np.full(len(counts), n) if n else np.where(counts < 3, 1, np.where(counts < 5, 3, 4))
    grams, owner = [], []
    for k in np.unique(size).tolist():
        many = np.where(size == k, np.maximum(0, counts - k + 1), 0)
        row = np.repeat(np.arange(len(counts)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
        grams.append(gram_hashes(words, k)[at])
        owner.append(row)
    if whole:  # a text with fewer words is one gram
        short = np.flatnonzero((counts < n) & (np.diff(chunk.offs) > 0))
        grams.append(mix(span_hash(chunk.data, chunk.offs[short], chunk.offs[short + 1]) + U64(1)))
        owner.append(short)
    g, r = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new].view(np.int64), np.bincount(r[new], minlength=len(counts))


def gram_sets(rows: DataFrame, text: Column, kind: str = "lower", short: str = "empty") -> DataFrame:
    """rows: (key, ...).  (key, ids) with the sets of word_grams (lower or cased) or adaptive_grams as 64-bit hashes.

    The sets are those of these functions, told by hashes of tokens, without a string for each gram.
    """
    made, n = TOKENS[kind]

    def run(batches):
        for batch in batches:
            parts = [_row_grams(c, n, short == "whole") for c in chunks(batch.column(1))]
            flat, size = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
            ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return rows.select("key", made(F.coalesce(text, F.lit("")))).mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<bigint>")


#: Elements that a task sorts at a time, and sets that they are of; a place of that many is told by two bytes.
HELD, LOT, NOBODY = 1_000_000, 65_000, 65_535
_DEALT = "bucket int, lot long, place int, key long, met long, n long, owners binary, sigs binary"
_TOLD = "lot long, place int, key long, met long, n long"


def _bounds(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of arrays, and where each row's begin."""
    return ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))


def _dealt(buckets: int, lot_sets: int):
    """Rows (key, ids) to one row for each, and to packed rows of elements by lot and bucket.

    Elements that are met within one lot are counted here, and one goes on that tells others but is nobody's; so an
    element is dealt as often as there are lots at most.
    """
    def pack(lot: int, keys: list[int], sets: list[np.ndarray]):
        k, size = len(keys), np.array([len(s) for s in sets])
        g, row = np.concatenate(sets).view(U64), np.repeat(np.arange(k), size)
        order = np.argsort(g, kind="stable")
        g, row = g[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        many = np.diff(np.append(first, len(g)))
        met = np.bincount(row[np.repeat(many > 1, many)], minlength=k)
        own = [pa.array(np.arange(k) % buckets, pa.int32()), pa.array(np.full(k, lot)), pa.array(np.arange(k), pa.int32()), pa.array(keys, pa.int64()), pa.array(met), pa.array(size)]
        names = [c.split()[0] for c in _DEALT.split(", ")]
        yield pa.RecordBatch.from_arrays([*own, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
        g, owner = g[first], np.where(many > 1, NOBODY, row[first]).astype("<u2")
        bucket = bucket_of(g, buckets)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        sig = (g & U64(0xFFFFFFFF)).astype("<u4")
        packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (owner, sig)]
        k = len(spans)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(np.full(k, lot)), pa.nulls(k, pa.int32()), *(pa.nulls(k, pa.int64()) for _ in range(3)), *packed], names=names)

    def run(batches):
        lot, keys, sets, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            flat, bound = _bounds(batch.column(1))
            for key, a, b in zip(batch.column(0).to_pylist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                if b > a:
                    keys.append(key)
                    sets.append(flat[a:b])
                    held += b - a
                if held >= HELD or len(keys) >= lot_sets:
                    yield from pack(lot, keys, sets)
                    lot, keys, sets, held = lot + 1, [], [], 0
        if keys:
            yield from pack(lot, keys, sets)
        del keys, sets
        release()

    return run


def _told(batches):
    """Packed elements, bucket by bucket, to how many of a row's elements another lot has; rows of sets pass through."""
    names = [c.split()[0] for c in _TOLD.split(", ")]

    def close(lots: list[int], sigs: list[np.ndarray], owners: list[np.ndarray]):
        s, o = np.concatenate(sigs), np.concatenate(owners).astype(np.int64)
        o += np.repeat(np.arange(len(lots)), [len(x) for x in sigs]) << 16
        order = np.argsort(s, kind="stable")
        s = s[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        many = np.diff(np.append(first, len(s)))
        hit = o[order[np.repeat(many > 1, many)]]
        at, met = np.unique(hit[hit & 0xFFFF != NOBODY], return_counts=True)
        k = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(lots, np.int64)[at >> 16]), pa.array(at & 0xFFFF, pa.int32()), pa.nulls(k, pa.int64()), pa.array(met, pa.int64()), pa.array(np.zeros(k, np.int64))], names=names)

    lots, sigs, owners, last = [], [], [], None
    for batch in batches:
        yield pa.RecordBatch.from_arrays(batch.filter(batch.column(7).is_null()).columns[1:6], names=names)
        packed = batch.filter(batch.column(7).is_valid())
        for bucket, lot, own, sig in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), packed.column(6), packed.column(7), strict=True):
            if bucket != last and sigs:
                yield from close(lots, sigs, owners)
                lots, sigs, owners = [], [], []
            last = bucket
            lots.append(lot)
            owners.append(np.frombuffer(own.as_py(), "<u2"))
            sigs.append(np.frombuffer(sig.as_py(), "<u4"))
    if sigs:
        yield from close(lots, sigs, owners)
    del lots, sigs, owners
    release()


def sharing(sets: DataFrame, percent: int) -> DataFrame:
    """sets: (key, ids), keys whole numbers.  The keys of sets of which percent or more of the elements are in other sets too.

    Every set that is similar to another one by that Jaccard similarity is among them.  An element is shuffled once, as
    four bytes beside what its bucket tells and two for its owner; elements that are taken for equal let more sets through.
    """
    buckets = buckets_for(sets)
    dealt = sets.mapInArrow(_dealt(buckets, LOT), _DEALT)
    told = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_told, _TOLD)
    whole = told.groupBy("lot", "place").agg(F.max("key").alias("key"), F.sum("met").alias("met"), F.sum("n").alias("n"))
    return whole.where(f"100 * met >= {percent} * n").select("key")


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sets: (key, ids).  Rows (key, n, g): the rare grams by which sets over the threshold meet.

    Prefix filter (Chaudhuri et al., 2006; Vernica et al., 2010): grams are ordered from rare to frequent, and two
    similar sets share one of their first ``n - ceil(t n) + 1`` grams.  So frequent boilerplate is no key unless a set
    has little else.  Grams of one set only are left out.
    """
    grams = sets.select("key", F.size("ids").alias("n"), F.explode("ids").alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    rare = F.expr(f"n - CAST(ceil(n * {percent} / 100.0D - 1e-9) AS INT) + 1")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "g")))
    ranked = grams.join(df, "g", "left").groupBy("key", "n").agg(order.alias("o"))
    return ranked.select("key", "n", F.explode(F.slice("o", 1, rare)).alias("o")).where("o.df > 1").select("key", "n", "o.g")


def sized(n_a: str, n_b: str, percent: int) -> Column:
    """Whether sets of such sizes can reach the threshold."""
    return F.expr(f"100 * {n_a} >= {percent} * {n_b} AND 100 * {n_b} >= {percent} * {n_a}")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, inclusive: bool = False) -> DataFrame:
    """Pairs (a, b) of which the sets (key, ids) are over (or at) the threshold, with jaccard."""
    got = [sets.select(F.col("key").alias(x), F.col("ids").alias(f"g_{x}")) for x in "ab"]
    shared = F.size(F.array_intersect("g_a", "g_b"))
    both = pairs.join(got[0], "a").join(got[1], "b").select("a", "b", shared.alias("shared"), (F.size("g_a") + F.size("g_b") - shared).alias("union"))
    return both.where(F.expr(f"100 * shared {'>=' if inclusive else '>'} {percent} * union")).select("a", "b", (F.col("shared") / F.col("union")).alias("jaccard"))
