"""Event files: what is written is read back; broken tails, bad checksums, single floats, missing tags and folders."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from marlstone.sources import event_files as ev


def test_known_checksum():
    crc = ev.checksum(b"123456789")  # CRC-32C of this is e3069283
    assert crc == ((0xE3069283 >> 15 | 0xE3069283 << 17) + ev.MASK) & 0xFFFFFFFF


def test_round_trip(spark, tmp_path):
    rows = [(f"run{i % 3}/train", "ab"[i % 2], i - 50, 1.5 * i, i / 7) for i in range(200)] + [("run0/train", "é", 2**62, 0.0, math.inf), ("run0/train", "a", 3, 0.0, None)]
    df = spark.createDataFrame(rows, "run string, tag string, step long, wall_time double, value double").repartition(3)
    ev.write_events(df, f"{tmp_path}/logs")
    got = ev.read_events(spark, f"{tmp_path}/logs")
    assert sorted(map(tuple, got.drop("file").collect())) == sorted(r for r in rows if r[4] is not None)
    assert got.rdd.getNumPartitions() == got.select("file").distinct().count()
    ev.write_events(df.limit(5), f"{tmp_path}/logs")
    assert ev.read_events(spark, f"{tmp_path}/logs", "é").count() >= 1 and ev.read_events(spark, f"{tmp_path}/logs", "none").collect() == []


def test_other_writers_and_broken_files(spark, tmp_path):
    single = lambda tag, step, v: ev._number(2 << 3) + ev._number(step) + ev._nested(5, ev._nested(1, ev._nested(1, tag) + ev._number(2 << 3 | 5) + struct.pack("<f", v)))
    good = [ev.framed(single(b"kl", i, i / 2)) for i in range(5)]
    version = ev.framed(ev._nested(3, b"brain.Event:2"))
    bad = bytearray(good[2])
    bad[20] ^= 1  # in the data
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.tfevents.1").write_bytes(version + b"".join(good) + good[0][:-3])
    (tmp_path / "a/x.tfevents.2").write_bytes(good[0] + bytes(bad) + good[1])
    (tmp_path / "a/x.tfevents.3").write_bytes(good[0] + b"\x05" * 40 + good[1])
    (tmp_path / "a/x.tfevents.4").write_bytes(b"")
    (tmp_path / "a/_x.tfevents.5").write_bytes(good[0])
    got = ev.read_events(spark, str(tmp_path))
    by = {r.file[-1]: r.s for r in got.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("s")).collect()}
    assert {k: [tuple(x) for x in v] for k, v in by.items()} == {"1": [(i, i / 2) for i in range(5)], "2": [(0, 0.0), (1, 0.5)], "3": [(0, 0.0)]}
    assert {r.run for r in got.collect()} == {"a"}
    with pytest.raises(Exception, match="checksum"):
        ev.read_events(spark, str(tmp_path), broken="error").collect()
    assert ev.read_events(spark, f"{tmp_path}/none").collect() == []
