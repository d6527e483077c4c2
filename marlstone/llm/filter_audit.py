"""Filter interaction audit: what each filter of a chain removes in every order, from counts of failure masks.

1. Failure conditions that a text decides alone are bits of a mask, measured where the documents are read.
2. Copies are found by refining a partition.  Rows are split by code-point length; then the classes that are left are
   split by the hash of their texts' first block, of the next block, and so on, each block ``GROWTH`` times as long as the
   one before.  After each step rows that are alone in their class go.  Only fixed-width rows take part.
3. The texts of surviving classes, known to the tasks by a bitmap of fixed size, are compared in full: equal texts of a
   class are combined before the shuffle and after it, so a group of copies of any size is one row of each task.
4. Rows that hold a text which a smaller id holds get their bit, and masks are counted per part.  All orders of the
   filters follow from these counts, 2^filters of a part at most.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import cut, dealt
from marlstone.llm.textkernel import chunks, mix, release

FILTERS = "ABCDE"
COPY = 16  # the bit of E
BLOCK_BYTES, GROWTH = 1024, 8
#: Bits of the bitmap of surviving classes: 8 MB, whatever the corpus; beyond what it can tell apart more texts are compared.
MAP_BITS, BUCKET_BITS = 1 << 26, 1 << 15
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*|"]] = True


def text_masks(chunk, min_words: int = 50, distinct_pct: int = 65, upper_pct: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the conditions A to D for each row of a chunk, and its code points."""
    d, offs, n = chunk.data, chunk.offs, chunk.counts.astype(np.int64)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offs])

    points, upper, marks = per_row((d & 0xC0) != 0x80), per_row((d >= 65) & (d <= 90)), per_row(_MARKS[d])
    row, words = chunk.row_of_word(), chunk.word_hashes()
    order = np.lexsort((words, row))
    row, words = row[order], words[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (words[1:] != words[:-1])
    distinct = np.bincount(row[new], minlength=len(n))
    return (n < min_words) + 2 * (100 * distinct < distinct_pct * n) + 4 * (100 * upper > upper_pct * points) + 8 * (marks > 0), points


def block_hashes(text: bytes, bits: int = 64) -> list[int]:
    """Hashes of a text's blocks in order, of BLOCK_BYTES, GROWTH times as many, and so on; of fewer bits for tests."""
    out, a, size = [], 0, BLOCK_BYTES
    while a < len(text):
        h = int.from_bytes(hashlib.blake2b(text[a : a + size], digest_size=8).digest(), "little")
        out.append((h & (1 << bits) - 1) - (1 << 63))
        a, size = a + size, size * GROWTH
    return out


def _class(points: int, hashes: list[int]) -> int:
    """The class in which a text ends: its length, refined by each block."""
    c = np.array([points], np.uint64)
    with np.errstate(over="ignore"):
        for h in hashes:
            c = mix(c * np.uint64(0x9E3779B97F4A7C15) ^ np.array([h + (1 << 63)], np.uint64))
    return int(c.view(np.int64)[0])


_SKETCH = "doc_id long, part string, mask int, points long, hashes array<long>, class long"


def _sketch(bits: int, limits: tuple[int, int, int], with_text: bool = False):
    """(doc_id, part, text) to rows of _SKETCH, and the text."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                mask, points = text_masks(chunk, *limits)
                hashes = [block_hashes(chunk.text(i), bits) for i in range(len(chunk))]
                ends = [_class(p, h) for p, h in zip(points.tolist(), hashes, strict=True)]
                own = batch.slice(chunk.first, len(chunk))
                cols = [own.column(0), own.column(1), pa.array(mask.astype(np.int32)), pa.array(points), pa.array(hashes, pa.list_(pa.int64())), pa.array(ends, pa.int64()), own.column(2)]
                names = ["doc_id", "part", "mask", "points", "hashes", "class", "text"]
                yield pa.RecordBatch.from_arrays(cols if with_text else cols[:6], names=names if with_text else names[:6])
        release()

    return run


def _survivors(bits: int, bitmap):
    """(doc_id, text) to (class, doc_id, text), of classes in the bitmap."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                starts = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))[chunk.offs]
                ends = np.array([_class(n, block_hashes(chunk.text(i), bits)) for i, n in enumerate(np.diff(starts).tolist())], np.int64)
                at = ends % MAP_BITS
                kept = pa.array(np.flatnonzero(bitmap.value[at >> 3] >> (at & 7) & 1))
                own = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([pa.array(ends).take(kept), own.column(0).take(kept), own.column(1).take(kept)], names=["class", "doc_id", "text"])
        release()

    return run


def refine(rows: DataFrame) -> DataFrame:
    """rows: points, hashes, class.  The classes that two rows or more end in, with n_rows (about; exact but for equal hashes).

    Each step keeps the rows of classes of two rows or more: first by length, then by one block after the other.
    """
    live, step = rows.select(F.col("points").alias("c"), "hashes", "class"), 0
    while True:
        shared = live.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("shared"))
        live = cut(live.join(shared, F.col("c") == F.col("shared"), "left_semi"))
        if not live.where(F.size("hashes") > step).take(1):
            return live.groupBy("class").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
        live = live.withColumn("c", F.when(F.size("hashes") > step, F.xxhash64("c", F.get("hashes", F.lit(step)))).otherwise(F.col("c")))
        step += 1


def _bitmap(classes: DataFrame) -> np.ndarray:
    """The classes' places modulo MAP_BITS as bytes; built by tasks, gathered in pieces of 4 kB."""
    place = F.pmod("class", F.lit(MAP_BITS))
    pieces = classes.groupBy(F.floor(place / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(place % BUCKET_BITS).alias("bits")).collect()  # MAP_BITS at most
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in pieces:
        out[r["bucket"] * (BUCKET_BITS // 8) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def mark_copies(docs: DataFrame, part: Column | None = None, bits: int = 64, min_words: int = 50, distinct_pct: int = 65, upper_pct: int = 5) -> DataFrame:
    """doc_id, part, mask for each row of docs: bits A 1, B 2, C 4, D 8 of its text, and 16 if a smaller id has its text.

    docs: doc_id, text; other columns are ignored but in the expression part, which is a string (null: empty).  Null text
    is empty, and a copy of any other empty one.  Rows that repeat an id and a text are copies of smaller ids only, not of
    each other; a row without an id is no copy, and no text is a copy of its.  A text of any length is hashed and compared
    whole.  An empty table gives no rows.
    """
    part, limits = F.lit("") if part is None else F.coalesce(part.cast("string"), F.lit("")), (min_words, distinct_pct, upper_pct)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = cut(docs.mapInArrow(_sketch(bits, limits), _SKETCH))
    classes = cut(refine(rows))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(classes))
    texts = docs.select("doc_id", "text").mapInArrow(_survivors(bits, bitmap), "class long, doc_id long, text string")
    whole = texts.groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    whole = cut(whole.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first")))
    own, sizes = dealt(rows.select("doc_id", "part", "mask", "class"), classes.join(whole, "class"), "class", ["doc_id"])
    own = own.join(sizes, ["class", "salt"], "left")
    out = own.where("coalesce(texts, 1) = 1").select("doc_id", "part", "mask", "first")
    mixed = whole.where("texts > 1").select("class")
    if mixed.take(1):  # different texts of equal hashes: their rows are told apart by the texts themselves
        again = docs.mapInArrow(_sketch(bits, limits, True), f"{_SKETCH}, text string").join(mixed, "class", "left_semi")
        least = again.groupBy("text").agg(F.min("doc_id").alias("first"))
        out = out.union(again.join(least, "text").select("doc_id", "part", "mask", "first"))
    copy = F.when(F.col("doc_id") > F.col("first"), COPY).otherwise(0)
    return out.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def audit_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masks: part, mask (bit i: the filter of letter i fails), good, toxic.  One row for each part, order of the letters, and step.

    Counts of the part's documents: kept after the step, removed in it, redundant (failing its filter, removed before),
    unique_fails (failing its filter alone), good_lost and toxic_lost (removed in it), and shapley: what its filter removes,
    summed over all orders, since of the filters that a document fails each is the first in an equal share of the orders.
    """
    orders = ["".join(p) for p in itertools.permutations(filters)]
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # one for each mask at most
    rows = cells.select("part", "cells", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter <> ''")
    bit = f"shiftleft(1, instr('{filters}', {{}}) - 1)"
    before = f"aggregate(filter(split(filter_order, ''), (x, i) -> i < at AND x <> ''), 0, (t, x) -> t + {bit.format('x')})"
    rows = rows.withColumns({"bit": F.expr(bit.format("letter")), "before": F.expr(before), "step": (F.col("at") + 1).cast("int")})

    def total(held: str, what: str = "x.n") -> Column:
        return F.expr(f"aggregate(filter(cells, x -> {held}), 0L, (t, x) -> t + {what})")

    removed = "x.mask & bit > 0 AND x.mask & before = 0"
    return rows.select(
        "part", "filter_order", "step", total("x.mask & (before | bit) = 0").alias("kept"), total(removed).alias("removed"), total("x.mask & bit > 0 AND x.mask & before > 0").alias("redundant"),
        total("x.mask = bit").alias("unique_fails"), total(removed, "x.good").alias("good_lost"), total(removed, "x.toxic").alias("toxic_lost"), total("x.mask & bit > 0", f"x.n * {len(orders)} div bit_count(x.mask)").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters remove from each source in each of their orders; see mark_copies and audit_orders.

    docs: doc_id, text, source (null: empty); labels: doc_id, quality, toxic.  A document counts as good (toxic) if any
    label row of its id says so; without a label it is neither.  Documents are rows: those that repeat count again.
    """
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    masks = mark_copies(docs, F.col("source")).join(one, "doc_id", "left")
    return audit_orders(masks)
