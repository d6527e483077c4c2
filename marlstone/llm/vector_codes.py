"""Vector code compression: product codes from integer codebooks, exact to the last bit.

Components become whole numbers ``floor(scale * x)`` and a vector is cut into equal parts with a codebook each.  The
codebooks are broadcast, entries times width numbers whatever the table; Arrow batches compute the distances of all parts to
all entries as ``|x|^2 - 2 x.c + |c|^2`` with int64 matrix products and take the first least.  In each round a task sums
its parts by entry, a grouped shuffle adds the tasks' sums, and an entry becomes the floor of its mean.  Nothing is
rounded, so the result does not depend on how rows are dealt to tasks, nor on tasks that ran twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import cut, dealt
from marlstone.llm.textkernel import release


def _whole(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of a list column of doubles as whole numbers, one vector a row."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest row of book, and its squared distance."""
    distance = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best]


def _sums(books, width: int, scale: int):
    """Vectors to (part, entry, place, total, n): sums of the parts of each entry over a task's rows."""

    def run(batches):
        book = books.value
        total, n = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            x = _whole(batch.column(0), width, scale).reshape(-1, len(book), book.shape[2])
            for p, entries in enumerate(book):
                best, _ = nearest(x[:, p], entries)
                order = np.argsort(best, kind="stable")
                heads = np.flatnonzero(np.diff(best[order], prepend=-1))
                if len(heads):
                    total[p, best[order][heads]] += np.add.reduceat(x[order, p], heads)
                n[p] += np.bincount(best, minlength=len(entries))
        part, entry = np.nonzero(n)
        k = book.shape[2]
        cols = [np.repeat(part, k), np.repeat(entry, k), np.tile(np.arange(k), len(part)), total[part, entry].ravel(), np.repeat(n[part, entry], k)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int32, np.int64, np.int64), strict=True)], names=["part", "entry", "place", "total", "n"])
        release()

    return run


def _assign(books, width: int, scale: int):
    """(vec_id, label key, vector or null) to (vec_id, label key, code, error)."""

    def run(batches):
        book = books.value
        for batch in batches:
            vectors = batch.column(2)
            some = vectors.is_valid()
            x = _whole(vectors.filter(some), width, scale).reshape(-1, len(book), book.shape[2])
            codes, error = np.zeros((len(x), len(book)), np.uint8), np.zeros(len(x), np.int64)
            for p, entries in enumerate(book if len(x) else ()):
                codes[:, p], distance = nearest(x[:, p], entries)
                error += distance
            at = np.cumsum(some.to_numpy(zero_copy_only=False)) - 1
            at = pa.array(at, mask=~some.to_numpy(zero_copy_only=False))
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code.take(at), pa.array(error).take(at)], names=["vec_id", "key", "code", "error"])
        release()

    return run


def learn_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int, width: int) -> np.ndarray:
    """vectors: vec_id, v (doubles, width of them).  Codebooks as whole numbers: part, entry, place.

    They start as the vectors of the least ids (ties: the least vectors), which with parts * entries sums is all that the
    driver sees.  Fewer vectors than entries give smaller codebooks.
    """
    spark = vectors.sparkSession
    first = vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect()
    books = np.floor(np.array([r["v"] for r in first], np.float64).reshape(-1, width) * scale).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(-1, parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast(books)
        sums = vectors.select("v").mapInArrow(_sums(shared, width, scale), "part int, entry int, place int, total long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # width * entries rows
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label, label_error, codebooks_sha256 of each vector of table.

    table: vec_id, embedding (an array of numbers), label of any type; other columns are ignored.  Rows are dropped whose
    vector is null or holds a null or non-finite component.  A code is the hex digits of the indexes in part order; error
    the squared distances summed over parts; label_error the errors summed over rows of an equal label, nulls together;
    codebooks_sha256 the digest of the final codebooks' numbers by part, entry and place.  Ties go to the lower index.
    Rows that repeat count again; rows without an id are coded but start no codebook.  The width is that of most vectors
    (ties: the largest), and must be a multiple of parts.  A vector of another width, or with components so large that
    its squared distances could pass 64 bits (2^27 for 64 components), has null code and error.  An empty table gives no
    rows; one without a codable vector null codes and the digest of nothing.
    """
    v = F.col("embedding").cast("array<double>").alias("v")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.to_json(F.struct("label")).alias("key"), v)
    rows = rows.where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    width = rows.where("vec_id is not null and size(v) > 0").groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    width = width[0]["w"] if width else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    most = int((2**61 / width) ** 0.5) // scale  # (2 * scale * most)^2 * width stays below 2^63
    can = (F.size("v") == width) & F.forall("v", lambda x: F.abs(x) < most)
    books = learn_codebooks(rows.where(can).select("vec_id", "v"), parts, entries, rounds, scale, width)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = table.sparkSession.sparkContext.broadcast(books)
    vector = F.when(can, F.col("v")) if books.size else F.lit(None).cast("array<double>")
    coded = cut(rows.select("vec_id", "key", vector.alias("v")).mapInArrow(_assign(shared, width, scale), "vec_id long, key string, code string, error long"))
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows"))
    own, sums = dealt(coded, sums, "key", ["vec_id", "code"])
    return own.join(sums, ["key", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
