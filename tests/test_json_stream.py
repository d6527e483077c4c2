"""JSON read element by element against the library's parser."""

import json
import random

import pytest

from marlstone.sources import json_stream, readers, sinks


def blocks(text, n):
    return [text[i : i + n] for i in range(0, len(text), n)]


def arrays(v, path=()):
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield list(path), i, x
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from arrays(x, (*path, k))


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice(["a", "b\"", "c]", "d\\", "é"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [None, True, rng.random() * 10 - 5, rng.randrange(-9, 9), "".join(rng.choice('ab"\\{}[],: \n\u2028é日') for _ in range(rng.randrange(12)))][kind]


def test_equals_the_parser():
    rng = random.Random(1)
    for k in range(300):
        v = value(rng)
        text = json.dumps(v, ensure_ascii=k % 2 == 0, indent=None if k % 3 else 1)
        for n in (1, 2, 7, 1000):
            assert [(p, i, json.loads(x)) for p, i, x in json_stream.elements(blocks(text, n))] == list(arrays(v))


@pytest.mark.parametrize("bad", ["", "[1, 2", '{"a": [1}', "[1]]", '{"a": "', "}", '["a'])
def test_what_is_no_json_is_an_error(bad):
    with pytest.raises(ValueError):
        list(json_stream.elements(blocks(bad, 3)))


def test_long_strings_are_not_scanned_again_and_again():
    text = json.dumps(["x" * 3_000_000, 1])
    assert [len(x) for _, _, x in json_stream.elements(blocks(text, 1000))] == [3_000_002, 1]


def test_files_are_never_held_whole(spark, tmp_path, monkeypatch):
    """What is kept of a large array at a time is an element and a block."""
    monkeypatch.setattr(json_stream, "BLOCK", 4096)
    made = (b"[" if i == 0 else b"," if i <= 200_000 else b"]" for i in range(200_002))
    path = tmp_path / "big.json"
    with path.open("wb") as f:
        for i, sep in enumerate(made):
            f.write(sep + (b'{"i": %d, "t": "some text of the row"}' % i if i <= 200_000 else b""))
    import tracemalloc

    tracemalloc.start()
    reader = json_stream._Reader({"path": str(path)})
    n = sum(b.num_rows for b in reader.read(reader.partitions()[0]))
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_001 and top < 4_000_000 < path.stat().st_size


def test_round_trip_and_other_forms(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f'text "{i}"\n é') for i in range(50)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(3)
    sinks.json_arrays(df, f"{tmp_path}/a")
    assert sorted(map(tuple, readers.json_array(spark, f"{tmp_path}/a", "i long, t string").collect())) == rows
    assert readers.json_array(spark, f"{tmp_path}/a", "i long, t string").rdd.getNumPartitions() == 3
    (tmp_path / "b.json").write_text('\ufeff{"results": {"p": [{"i": 1}], "q": []}, "n": 2}', encoding="utf-8")
    assert [tuple(r) for r in readers.results(spark, f"{tmp_path}/b.json", "i long").collect()] == [("p", 1)]
    with pytest.raises(Exception, match="no array"):
        readers.json_array(spark, f"{tmp_path}/b.json", "i long").collect()


def test_matches_over_blocks_equal_those_of_the_whole_text(spark, tmp_path):
    import re

    rng = random.Random(2)
    text = "".join(rng.choice(["step: ", "12", " |", "\n", "x" * 7, "é", "step: 5\n6 |"]) for _ in range(3000))
    pattern = r"(?s)step: (.{0,40}?) \|"
    want = [m[1] for m in re.finditer(pattern, text)]
    for n in (1, 10, 64, 5000):
        assert list(readers.matches_of(blocks(text, n), pattern, 50)) == want
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("no match")
    got = readers.log_matches(spark, f"{tmp_path}/*.log", pattern, 50).collect()
    assert [r.match for r in sorted(got, key=lambda r: r.i)] == want and {r.file.rpartition("/")[2] for r in got} == {"a.log"}
