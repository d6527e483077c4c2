"""Shards of tensors: round trip in pieces, blends of all types, names that don't match."""

import json
import struct

import numpy as np
import pytest

from marlstone.sources import tensors


def rows_of(made):
    return [(s, n, k, list(x.shape), 0, tensors._bytes(x, k)) for s, n, k, x in made]


def table(spark, made):
    return spark.createDataFrame(rows_of(made), tensors.COLUMNS)


@pytest.fixture
def two():
    rng = np.random.default_rng(1)
    shapes = {"a": ("F32", (40, 50)), "b": ("F16", (7,)), "c": ("BF16", (3, 4)), "d": ("F64", ()), "e": ("F32", (0, 3))}
    return [[(f"model-{i % 2}.safetensors", n, k, rng.normal(size=s)) for i, (n, (k, s)) in enumerate(shapes.items())] for _ in range(2)]


def test_round_trip_in_pieces(spark, two, tmp_path):
    done = tensors.write_tensors(table(spark, two[0]), f"{tmp_path}/w").collect()
    assert {r.shard: r.tensors for r in done} == {"model-0.safetensors": 3, "model-1.safetensors": 2}
    raw = (tmp_path / "w/model-0.safetensors").read_bytes()
    header = json.loads(raw[8 : 8 + struct.unpack("<Q", raw[:8])[0]])
    assert set(header) == {"a", "c", "e"} and header["a"]["shape"] == [40, 50]
    got = tensors.read_tensors(spark, f"{tmp_path}/w", piece=1024)
    data = {}
    for r in sorted(got.collect(), key=lambda r: (r.name, r.part)):
        assert len(r.data) <= 1024
        data[r.name] = data.get(r.name, b"") + bytes(r.data)
    assert data == {n: tensors._bytes(x, k) for _, n, k, x in two[0]} and got.where("name = 'a'").count() == 8
    again = tensors.write_tensors(got, f"{tmp_path}/w2")
    assert again.count() == 2 and (tmp_path / "w2/model-0.safetensors").read_bytes() == raw


def test_blend_and_names(spark, two, tmp_path):
    for name, t in zip("ab", two, strict=True):
        tensors.write_tensors(table(spark, t), f"{tmp_path}/{name}")
    a, b = (tensors.read_tensors(spark, f"{tmp_path}/{n}", piece=512) for n in "ab")
    tensors.write_tensors(tensors.blend(a, b, 0.25), f"{tmp_path}/out")
    got = {r.name: tensors._numbers(bytes(r.data), r.dtype) for r in tensors.read_tensors(spark, f"{tmp_path}/out").collect()}
    for (_, n, k, x), (*_, y) in zip(*two, strict=True):
        x, y = (tensors._numbers(tensors._bytes(v, k), k).astype(np.float64) for v in (x, y))
        assert got[n].tolist() == tensors._numbers(tensors._bytes(0.75 * x + 0.25 * y, k), k).tolist()
    short = table(spark, two[1][:-1])
    with pytest.raises(Exception, match="only one side has e"):
        tensors.blend(table(spark, two[0]), short, 0.5).collect()
    with pytest.raises(Exception, match="only one side has e"):
        tensors.blend(short, table(spark, two[0]), 0.5).collect()
    other = [(s, n, k, x.reshape(-1) if n == "a" else x) for s, n, k, x in two[1]]
    with pytest.raises(Exception, match="type or shape differs: a"):
        tensors.blend(table(spark, two[0]), table(spark, other), 0.5).collect()


def test_half_precision_rounds_to_even():
    x = np.array([1.0, 1.00390625, 1.01171875, np.nan, np.inf, -2.5], np.float64)
    back = tensors._numbers(tensors._bytes(x, "BF16"), "BF16")
    assert back[:3].tolist() == [1.0, 1.0, 1.015625] and np.isnan(back[3]) and back[4:].tolist() == [np.inf, -2.5]


def test_a_file_that_ends_early_is_an_error(spark, two, tmp_path):
    tensors.write_tensors(table(spark, two[0]), f"{tmp_path}/w")
    f = tmp_path / "w/model-0.safetensors"
    f.write_bytes(f.read_bytes()[:-5])
    with pytest.raises(Exception, match="ends early"):
        tensors.read_tensors(spark, f"{tmp_path}/w").collect()
