"""Event files of training runs as a data source: framed, checksummed records that hold scalars by tag.

    spark.dataSource.register(EventFiles)
    spark.read.format("event_files").load(folder)                  # run, tag, step, wall_time, value, file
    rows.write.format("event_files").mode("append").save(folder)   # run, tag, step, wall_time, value

A file is one partition of a scan and is read as a stream, a batch of rows at a time.  run is the folder of a file under
the one that is read.  A file that is still being written ends in a part of a record, which is left out; so is a record
whose data fail their checksum.  Where a length fails, nothing behind it can be told, and the rest of the file is left
out, or is an error with option ``broken`` = ``error``.  Other payloads than single numbers are skipped.

Written files appear under their names when the job commits; a task writes one file for each run that it meets.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "run string, tag string, step bigint, wall_time double, value double, file string"
#: Fixed values of the format: the checksum's polynomial and mask, the numbers of fields, and the wire types.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
WALL_TIME, STEP, SUMMARY, VALUE, TAG, SIMPLE_VALUE, TENSOR = 1, 2, 5, 1, 1, 2, 8
DTYPE, CONTENT, FLOATS, DOUBLES = 1, 4, 5, 6
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
ROWS = 10_000


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def checksum(data: bytes) -> int:
    """Masked CRC-32C."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n, shift = 0, 0
    while True:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return n, at


def fields(message: bytes) -> Iterator[tuple[int, int, object]]:
    """Number, wire type and value of each field of a message; floating values are left as bytes."""
    at = 0
    while at < len(message):
        head, at = _varint(message, at)
        number, kind = head >> 3, head & 7
        if kind == VARINT:
            value, at = _varint(message, at)
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            value, at = message[at : at + size], at + size
        elif kind == BYTES:
            size, at = _varint(message, at)
            value, at = message[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield number, kind, value


def _tensor(message: bytes) -> float | None:
    """The number in a tensor of one single or double."""
    kind, found = 0, []
    for number, _, v in fields(message):
        if number == DTYPE:
            kind = v
        elif number in (FLOATS, DOUBLES) or number == CONTENT and kind in (1, 2):
            wide = number == DOUBLES or number == CONTENT and kind == 2
            found += struct.unpack(f"<{len(v) // (8 if wide else 4)}{'d' if wide else 'f'}", v)
    return found[0] if len(found) == 1 else None


def scalars_of(event: bytes) -> Iterator[tuple[str, int, float, float]]:
    """(tag, step, wall_time, value) of an event's numbers."""
    time, step, values = 0.0, 0, []
    for number, kind, v in fields(event):
        if number == WALL_TIME:
            time = struct.unpack("<d", v)[0]
        elif number == STEP:
            step = v - (1 << 64) if v >> 63 else v
        elif number == SUMMARY and kind == BYTES:
            values += [x for n, _, x in fields(v) if n == VALUE]
    for message in values:
        tag, value = "", None
        for number, _, v in fields(message):
            if number == TAG:
                tag = v.decode(errors="replace")
            elif number == SIMPLE_VALUE:
                value = struct.unpack("<f", v)[0]
            elif number == TENSOR:
                value = _tensor(v)
        if value is not None:
            yield tag, step, time, value


def records(stream, strict: bool = False) -> Iterator[bytes]:
    """The data of each whole record of a stream."""
    while True:
        head = stream.read(12)
        if len(head) < 12:
            return
        size, check = struct.unpack("<QI", head)
        if checksum(head[:8]) != check:
            if strict:
                raise ValueError("a record's length fails its checksum")
            return
        data, check = stream.read(size), stream.read(4)
        if len(data) < size or len(check) < 4:
            return
        if checksum(data) == struct.unpack("<I", check)[0]:
            yield data


def framed(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", checksum(head)) + data + struct.pack("<I", checksum(data))


def _number(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _nested(number: int, data: bytes) -> bytes:
    return _number(number << 3 | BYTES) + _number(len(data)) + data


def scalar_event(tag: str, step: int, time: float, value: float) -> bytes:
    """An event with one number, as a tensor of one double, since a plain value is a single."""
    tensor = _number(DTYPE << 3) + _number(2) + _nested(DOUBLES, struct.pack("<d", value))
    body = _nested(VALUE, _nested(TAG, tag.encode()) + _nested(TENSOR, tensor))
    return _number(WALL_TIME << 3 | FIXED64) + struct.pack("<d", time) + _number(STEP << 3) + _number(step) + _nested(SUMMARY, body)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))


@dataclass
class _File(InputPartition):
    path: str
    run: str

    def __init__(self, path: str, run: str):
        super().__init__(path)
        self.path, self.run = path, run


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.strict, self.name = options["path"], options.get("broken") == "error", options.get("name", "tfevents")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _files(self.root)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted(f.path for f in found if f.is_file and self.name in f.base_name and not f.base_name.startswith(("_", ".")))
        return [_File(f, f.rpartition("/")[0][len(root.rstrip("/")) + 1 :]) for f in found] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names, kinds = ["run", "tag", "step", "wall_time", "value", "file"], [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [[partition.run] * len(rows), *zip(*rows, strict=True), [partition.path.rpartition("/")[2]] * len(rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        files, _ = _files(self.root)
        held: list[tuple] = []
        with files.open_input_stream(partition.path) as stream:
            for data in records(stream, self.strict):
                held += scalars_of(data)
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class _Writer(DataSourceWriter):
    """A task's files have hidden names until the job is committed."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, rows: Iterator) -> _Written:
        files, root = _files(self.root)
        open_: dict[str, tuple] = {}
        for r in rows:
            run = r["run"] or ""
            if run not in open_:
                at = f"{root}/{run}".rstrip("/")
                files.create_dir(at, recursive=True)
                name = f"events.out.tfevents.{uuid.uuid4().hex}"
                open_[run] = files.open_output_stream(f"{at}/_{name}"), (f"{at}/_{name}", f"{at}/{name}")
            open_[run][0].write(framed(scalar_event(r["tag"] or "", r["step"] or 0, r["wall_time"] or 0.0, r["value"])))
        for stream, _ in open_.values():
            stream.close()
        return _Written([names for _, names in open_.values()])

    def commit(self, messages: list) -> None:
        files, _ = _files(self.root)
        for hidden, name in (x for m in messages if m for x in m.files):
            files.move(hidden, name)

    def abort(self, messages: list) -> None:
        files, _ = _files(self.root)
        for hidden, _name in (x for m in messages if m for x in m.files):
            files.delete_file(hidden)


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("event files are only added to")
        return _Writer(dict(self.options))


def read_events(spark: SparkSession, path: str, tag: str | None = None, **options: str) -> DataFrame:
    """Scalars of all event files under path; a tag that none has gives no rows, and so does a folder without files."""
    spark.dataSource.register(EventFiles)
    rows = spark.read.format("event_files").options(**options).load(path)
    return rows if tag is None else rows.where(rows["tag"] == tag)


def write_events(rows: DataFrame, path: str) -> None:
    """rows: run (a folder under path), tag, step, value and, if there is one, wall_time; rows without a value are left out."""
    from pyspark.sql import functions as F

    rows.sparkSession.dataSource.register(EventFiles)
    time = F.col("wall_time").cast("double") if "wall_time" in rows.columns else F.lit(0.0)
    rows = rows.where("value IS NOT NULL").select(F.col("run").cast("string").alias("run"), F.col("tag").cast("string").alias("tag"), F.col("step").cast("long").alias("step"), time.alias("wall_time"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("file"))
    rows.write.format("event_files").mode("append").save(path)
