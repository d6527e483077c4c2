"""Answers that are kept while they come: killed jobs, attempts, failures, other settings."""

import os
import subprocess
import sys
import uuid

from pyspark.sql import functions as F

from marlstone.operators import model_calls, responses


class Counting:
    """Notes each call in a folder; the call after the first ``dies`` ends its worker, unless the folder notes that already."""

    def __init__(self, folder, dies=None, text="a"):
        self.folder, self.dies, self.text = str(folder), dies, text

    def chat(self, messages, **parameters):
        calls = [f for f in os.listdir(self.folder) if f.startswith("call")]
        if self.dies is not None and len(calls) >= self.dies and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        open(f"{self.folder}/call-{uuid.uuid4().hex}", "w").close()
        n = parameters.get("n", 1)
        return {"content": self.text, "choices": [{"content": f"{self.text}{k}"} for k in range(n)]} if n > 1 else {"content": self.text}


def calls(folder):
    return sum(f.startswith("call") for f in os.listdir(folder))


def asked(spark, n):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))


def test_a_killed_job_asks_only_for_the_rest(spark, tmp_path):
    rows, table = asked(spark, 40), f"{tmp_path}/table"
    (tmp_path / "log").mkdir()
    client = responses.StoredClient(Counting(tmp_path / "log", 25), table, commit_rows=1)
    try:
        model_calls.call(rows, client, in_flight=1)
        raise AssertionError("the job must fail")
    except Exception as e:
        assert "must fail" not in str(e)
    before, kept = calls(tmp_path / "log"), responses.answered(spark, table).count()
    assert 20 <= kept <= before < 40
    out = model_calls.call(rows, client, in_flight=1)
    assert calls(tmp_path / "log") == before + 40 - kept
    assert sorted(r.key for r in out.collect()) == sorted(f"k{i}" for i in range(40)) and out.count() == 40
    model_calls.call(rows, client).count()
    assert calls(tmp_path / "log") == before + 40 - kept  # nothing is asked again


_RETRIED = """
import os, sys
sys.path[:0] = {paths!r}
os.environ["PYTHONPATH"] = os.pathsep.join({paths!r})
from pyspark.sql import SparkSession
from test_responses import Counting, asked
from marlstone.operators import model_calls, responses
spark = SparkSession.builder.master("local[1, 3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r} + "/cp").getOrCreate()
client = responses.StoredClient(Counting({folder!r} + "/log", 12), {folder!r} + "/table", commit_rows=1)
print("ROWS", model_calls.call(asked(spark, 30), client, in_flight=1).count())
"""


def test_a_task_that_is_run_again_finds_its_answers(tmp_path):
    (tmp_path / "log").mkdir()
    here = os.path.dirname(os.path.abspath(__file__))
    done = subprocess.run([sys.executable, "-c", _RETRIED.format(paths=[here, os.path.dirname(here)], folder=str(tmp_path))], capture_output=True, text=True, timeout=300)
    assert "ROWS 30" in done.stdout, done.stderr[-2000:]
    assert os.path.exists(tmp_path / "log/died") and calls(tmp_path / "log") == 30  # the call that died was not counted


def test_other_settings_failures_and_samples(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows, table = asked(spark, 5), f"{tmp_path}/table"
    one = responses.StoredClient(Counting(tmp_path / "log"), table)
    model_calls.call(rows, one, {"t": 0})
    model_calls.call(rows, one, {"t": 1})
    assert calls(tmp_path / "log") == 10
    got = model_calls.call(rows, one, {"t": 0}, samples=3).groupBy("key").agg(F.sort_array(F.collect_list("sample_idx")).alias("s")).collect()
    assert all(r.s == [0, 1, 2] for r in got) and calls(tmp_path / "log") == 20  # the first samples were there
    got = model_calls.call(rows, one, {"t": 2}, samples=4, together=True).collect()
    assert len(got) == 20 and {r.content for r in got} == {"a0", "a1", "a2", "a3"} and calls(tmp_path / "log") == 25
    bad = model_calls.call(rows, responses.StoredClient(model_calls.StubClient(answer=_fail), table), {"t": 3}, tries=1).collect()
    assert len(bad) == 5 and all(r.content is None and "broken" in r.error for r in bad)
    assert [r.error for r in model_calls.call(rows, one, {"t": 3}).collect()] == [None] * 5
    n = responses.answered(spark, table).count()
    want = sorted(map(tuple, responses.answered(spark, table).collect()))
    responses.compact(spark, table, 2)
    assert sorted(map(tuple, responses.answered(spark, table).collect())) == want and len(want) == n
    assert sum(f.endswith(".parquet") and not f.startswith((".", "_")) for f in os.listdir(table)) <= 4


def _fail(h, messages, parameters):
    raise RuntimeError("broken")


def test_operators_read_their_answers_from_the_table(spark, tmp_path):
    (tmp_path / "log").mkdir()
    client = responses.StoredClient(Counting(tmp_path / "log", text='{"category": "x"}'), f"{tmp_path}/table")
    rows = spark.range(6).select("id", F.concat(F.lit("text "), "id").alias("t"))
    out = model_calls.diagnose(rows, client, "id", F.col("t"), ("x", "y"))
    assert out.count() == 6 and out.where("outcome = 'ok'").count() == 6 and calls(tmp_path / "log") == 6


def test_only_whole_files_of_the_partition_count(tmp_path):
    os.mkdir(tmp_path / "t")
    first = responses.Commits(str(tmp_path / "t"), "job", 3, 0)
    first.add([("r1", 0, "a", 1, 1, "stop", None), ("r2", 0, None, 0, 0, None, "failed")])
    (tmp_path / "t/_job-000003-0-000001.parquet").write_bytes(b"half")
    assert responses.Commits(f"file:{tmp_path}/t", "job", 3, 1).earlier() == {("r1", 0)} and first.earlier() == set()
    assert responses.Commits(str(tmp_path / "t"), "job", 4, 1).earlier() == set()
