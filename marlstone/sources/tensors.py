"""Model weights as tables: shards of named tensors, read and written in pieces, and blended by name.

A shard is a file of a length, a JSON header with each tensor's type, shape and place, and the bytes (the safetensors
layout).  A scan makes one partition of a file and one row of a piece of ``PIECE`` bytes, so no task holds a tensor.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 8 << 20
COLUMNS = "shard string, name string, dtype string, shape array<bigint>, part int, data binary"
#: Bytes of a number of each type that can be blended.
WIDTH = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2}


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.piece = options["path"], int(options.get("piece", PIECE))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _files(self.root)
        found = files.get_file_info(fs.FileSelector(root))
        return [_File(f) for f in sorted(f.path for f in found if f.is_file and f.base_name.endswith(".safetensors") and not f.base_name.startswith(("_", ".")))] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _files(self.root)
        shard = partition.path.rpartition("/")[2]
        with files.open_input_stream(partition.path) as f:
            (size,) = struct.unpack("<Q", f.read(8))
            header = json.loads(f.read(size))
            at = 0
            for name, t in sorted(((n, t) for n, t in header.items() if n != "__metadata__"), key=lambda x: x[1]["data_offsets"]):
                begin, end = t["data_offsets"]
                if begin < at:
                    raise ValueError(f"{shard}: tensors overlap at {name}")
                f.read(begin - at)
                for part in range(max(1, -(-(end - begin) // self.piece))):
                    want = min(self.piece, end - begin - part * self.piece)
                    data = f.read(want)
                    if len(data) < want:
                        raise ValueError(f"{shard} ends early at {name}")
                    cols = [pa.array([x], k) for x, k in ((shard, pa.string()), (name, pa.string()), (t["dtype"], pa.string()), (t["shape"], pa.list_(pa.int64())), (part, pa.int32()), (data, pa.binary()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["shard", "name", "dtype", "shape", "part", "data"])
                at = end


class TensorShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor_shards"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tensors(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """Rows of COLUMNS of all shards in a folder."""
    spark.dataSource.register(TensorShards)
    return spark.read.format("tensor_shards").option("piece", piece).load(path)


def _write(path: str):
    """Rows sorted by shard, name and part to files; a task holds a piece and the headers of one shard."""

    def run(batches):
        files, root = _files(path)
        files.create_dir(root, recursive=True)
        shard, header, at, data, hidden = None, {}, 0, None, ""

        def close() -> pa.RecordBatch:
            data.close()
            head = json.dumps(header).encode()
            head += b" " * (-len(head) % 8)
            made = f"{root}/_{uuid.uuid4().hex}"
            with files.open_output_stream(made) as out, files.open_input_stream(hidden) as body:
                out.write(struct.pack("<Q", len(head)) + head)
                for block in iter(lambda: body.read(PIECE), b""):
                    out.write(block)
            files.delete_file(hidden)
            files.move(made, f"{root}/{shard}")  # whole, or not there
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(header)], pa.int64()), pa.array([at], pa.int64())], names=["shard", "tensors", "bytes"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if data is not None:
                        yield close()
                    shard, header, at, hidden = r["shard"], {}, 0, f"{root}/_{uuid.uuid4().hex}"
                    data = files.open_output_stream(hidden)
                own = header.setdefault(r["name"], {"dtype": r["dtype"], "shape": r["shape"], "data_offsets": [at, at]})
                data.write(r["data"])
                at += len(r["data"])
                own["data_offsets"][1] = at
                if r["dtype"] in WIDTH and own["data_offsets"][1] - own["data_offsets"][0] > WIDTH[r["dtype"]] * math.prod(r["shape"]):
                    raise ValueError(f"{r['name']} has more data than its shape")
        if data is not None:
            yield close()

    return run


def write_tensors(rows: DataFrame, path: str) -> DataFrame:
    """rows: COLUMNS.  Writes each shard by the task that has all its pieces; shard, tensors and bytes of what was written."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("shard", "name", "dtype", "shape", "part", "data").repartition(parts, "shard").sortWithinPartitions("shard", "name", "part")
    done = dealt.mapInArrow(_write(path), "shard string, tensors bigint, bytes bigint").collect()  # a row for each file
    return rows.sparkSession.createDataFrame(done, "shard string, tensors bigint, bytes bigint")


def _numbers(data: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(data, {"F64": "<f8", "F32": "<f4", "F16": "<f2"}[dtype])


def _bytes(x: np.ndarray, dtype: str) -> bytes:
    """Rounded to the nearest number of the type, ties to even."""
    if dtype != "BF16":
        return x.astype({"F64": "<f8", "F32": "<f4", "F16": "<f2"}[dtype]).tobytes()
    b = x.astype(np.float32).view(np.uint32)
    up = ((b >> 16) & 1) + 0x7FFF
    return np.where(np.isnan(x), 0x7FC0, (b + up) >> 16).astype("<u2").tobytes()


def _blend(alpha: float):
    def run(batches):
        for batch in batches:
            a, b, kinds = (batch.column(i).to_pylist() for i in (5, 6, 2))
            made = [_bytes((1 - alpha) * _numbers(x, k).astype(np.float64) + alpha * _numbers(y, k).astype(np.float64), k) for x, y, k in zip(a, b, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary())], names=["shard", "name", "dtype", "shape", "part", "data"])

    return run


def blend(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) a + alpha b of each tensor, in the shards of a; rows of COLUMNS, cut into pieces alike.

    A name that one of them lacks, or another type or shape, is an error that names it.
    """
    other = b.select("name", "part", F.col("dtype").alias("dtype_b"), F.col("shape").alias("shape_b"), F.col("data").alias("data_b"))
    both = a.join(other, ["name", "part"], "full")
    wrong = F.when(F.col("data").isNull() | F.col("data_b").isNull(), F.raise_error(F.concat(F.lit("only one side has "), "name")))
    wrong = wrong.when((F.col("dtype") != F.col("dtype_b")) | (F.col("shape") != F.col("shape_b")) | (F.length("data") != F.length("data_b")), F.raise_error(F.concat(F.lit("type or shape differs: "), "name")))
    wrong = wrong.when(~F.col("dtype").isin(*WIDTH), F.raise_error(F.concat(F.lit("no numbers: "), "name")))
    checked = both.select("shard", "name", wrong.otherwise(F.col("dtype")).alias("dtype"), "shape", "part", "data", "data_b")
    return checked.mapInArrow(_blend(alpha), COLUMNS)


def from_arrays(rows: DataFrame) -> DataFrame:
    """rows: shard, name, v (doubles).  Tensors of one dimension, a piece each."""
    def run(batches):
        for batch in batches:
            v = [np.asarray(x, "<f8") for x in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(["F64"] * len(v), pa.string()), pa.array([[len(x)] for x in v], pa.list_(pa.int64())), pa.array([0] * len(v), pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "name", "dtype", "shape", "part", "data"])

    return rows.select("shard", "name", "v").mapInArrow(run, COLUMNS)


def to_arrays(rows: DataFrame) -> DataFrame:
    """shard, name, part and v (doubles) of each piece."""
    def run(batches):
        for batch in batches:
            made = [_numbers(x, k).astype(np.float64) for x, k in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.float64()))], names=["shard", "name", "part", "v"])

    return rows.select("shard", "name", "part", "data", "dtype").mapInArrow(run, "shard string, name string, part int, v array<double>")
