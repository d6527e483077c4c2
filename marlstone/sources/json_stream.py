"""JSON files that are one value each, read element by element.

    spark.dataSource.register(JsonElements)
    spark.read.format("json_elements").load(path)                   # file, path, i, value
    rows.write.format("json_elements").mode("append").save(folder)  # value: a file for each task, one array each

The elements of every outermost array of a file are rows, with the keys that lead to the array as ``path``, their number
and their text.  A file is one partition of the scan and is read as a stream: a task holds one element and a block of the
file, never the file or an array.  What is no JSON, or ends early, is an error.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK = 1 << 20
ROWS = 2_000
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
_SPACE = re.compile(r"\s*")


def _tokens(blocks: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Tokens with the white space before each; what is between them is an error."""
    rest = ""
    grown = 0
    blocks = iter(blocks)
    while True:
        block = next(blocks, None)
        if block is not None and grown and len(rest) + len(block) < grown:  # a long string: look again at twice its length
            rest += block
            continue
        rest += block or ""
        at = 0
        while True:
            start = _SPACE.match(rest, at).end()
            found = _TOKEN.match(rest, start)
            if found is None or block is not None and found.end() == len(rest) and found[0] not in "{}[]:,":
                break
            yield rest[at:start], found[0]
            at = found.end()
        grown = 2 * (len(rest) - at) if at == 0 else 0
        rest = rest[at:]
        if block is None:
            if rest.strip():
                raise ValueError(f"not JSON: {rest[:40]!r}")
            return


def elements(blocks: Iterable[str]) -> Iterator[tuple[list[str], int, str]]:
    """(path, number, text) of the elements of all outermost arrays of one JSON value."""
    path: list = []  # keys of the open objects, None before a key; the number of elements of an open array
    text: list[str] = []
    depth, seen, key = 0, False, True
    for space, t in _tokens(blocks):
        if depth:  # inside of an element
            text += (space, t)
            depth += (t in "{[") - (t in "}]")
            if not depth:
                yield [p for p in path[:-1]], path[-1] - 1, "".join(text)
                text.clear()
        elif path and isinstance(path[-1], int):
            if t == "]":
                path.pop()
            elif t in ("{", "["):
                path[-1] += 1
                depth = 1
                text.append(t)
            elif t in ("}", ":"):
                raise ValueError(f"{t!r} in an array")
            elif t != ",":
                path[-1] += 1
                yield [p for p in path[:-1]], path[-1] - 1, t
        elif t == "[":
            path.append(0)
        elif t == "{":
            path.append(None)
            key = True
        elif t == "}":
            if not path:
                raise ValueError("'}' without '{'")
            path.pop()
        elif path and key and t[0] == '"':
            path[-1], key = json.loads(t), False
        elif t == ",":
            key = True
        elif t == "]":
            raise ValueError("']' without '['")
        seen = True
    if depth or path or not seen:
        raise ValueError("the file ends early")


def open_path(path: str):
    """The file system of a path, and the path in it, as driver and tasks open it."""
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
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = open_path(self.root)
        top = files.get_file_info(root)
        found = [top] if top.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f) for f in sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = open_path(self.root)
        name, held, size = partition.path.rpartition("/")[2], [], 0

        def batch() -> pa.RecordBatch:
            path, i, value = zip(*held, strict=True)
            cols = [pa.array([name] * len(held)), pa.array(path, pa.list_(pa.string())), pa.array(i, pa.int64()), pa.array(value, pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["file", "path", "i", "value"])

        with files.open_input_stream(partition.path) as stream:
            decode = codecs.getincrementaldecoder("utf-8-sig")()
            blocks = (decode.decode(b) for b in iter(lambda: stream.read(BLOCK), b""))
            for e in elements(blocks):
                held.append(e)
                size += len(e[2])
                if len(held) >= ROWS or size >= 8 * BLOCK:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class _Writer(DataSourceWriter):
    """A task's array is written row by row, under a hidden name until the job is committed."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, rows: Iterator) -> _Written:
        files, root = open_path(self.root)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{root}/_{name}") as out:
            out.write(b"[")
            for i, r in enumerate(rows):
                out.write((",\n" if i else "\n").encode() + r["value"].encode())
            out.write(b"\n]\n")
        return _Written([(f"{root}/_{name}", f"{root}/{name}")])

    def commit(self, messages: list) -> None:
        files, _ = open_path(self.root)
        for hidden, name in (x for m in messages if m for x in m.files):
            files.move(hidden, name)

    def abort(self, messages: list) -> None:
        files, _ = open_path(self.root)
        for hidden, _name in (x for m in messages if m for x in m.files):
            files.delete_file(hidden)


class JsonElements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "file string, path array<string>, i bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("arrays are only added")
        return _Writer(dict(self.options))
