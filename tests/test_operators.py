import random
import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import aggregates, dedup, greedy, model_calls, sampling, similarity
from marlstone.sources import readers, sinks


def test_jaccard_of_known_texts(spark):
    df = spark.createDataFrame([("the quick brown fox", "the quick brown dog")], "a string, b string")
    j = similarity.jaccard(similarity.adaptive_grams(F.col("a")), similarity.adaptive_grams(F.col("b")))
    assert df.select(j).first()[0] == pytest.approx(1 / 3)  # four tokens: runs of three
    three = similarity.jaccard(similarity.word_grams(F.col("a"), 3), similarity.word_grams(F.col("b"), 3))
    assert df.select(three).first()[0] == pytest.approx(1 / 3)


def test_short_and_empty_texts_have_defined_grams(spark):
    df = spark.createDataFrame([("",), (None,), ("a b",), ("  x  ",)], "t string")
    assert [r[0] for r in df.select(similarity.word_grams(F.col("t"))).collect()] == [[], [], [], []]
    assert [r[0] for r in df.select(similarity.word_grams(F.col("t"), short="whole")).collect()] == [[], [], ["a b"], ["  x  "]]
    assert [r[0] for r in df.select(F.array_sort(similarity.mixed_grams(F.col("t")))).collect()] == [[], [], [" ", "a", "b"], ["  x ", " x  "]]


def test_minhash_estimates(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words), " ".join(words[:150] + [f"v{i}" for i in range(50)])
    df = spark.createDataFrame([(0, a), (1, b), (2, "something else entirely here")], "key long, t string")
    df = similarity.minhash(df.select("key", similarity.word_grams(F.col("t")).alias("grams")))
    got = {(r.query, r.hit): r.estimate for r in similarity.lsh_candidates(df, df, 0.5).collect()}
    assert set(got) == {(0, 1), (1, 0)} and abs(got[0, 1] - 147 / 247) < 0.15


sets = st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=8, unique=True), min_size=1, max_size=9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sets)
def test_near_duplicates_follow_the_greedy_pass(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "key long, grams array<string>")
    kept, want = [], {}
    for i, g in enumerate(map(set, rows)):
        near = [k for k in kept if g and rows[k] and len(g & set(rows[k])) * 100 > 70 * len(g | set(rows[k]))]
        want[i] = bool(near)
        if not near:
            kept.append(i)
    got = {r.key: r.near is not None for r in dedup.near_duplicates(df, 70).collect()}
    assert got == want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_settled_like_a_pass_in_order(spark, one_task):
    """Random graphs, some of whose rows lack edges to earlier rows; then what does not hang on these is decided."""
    rng = random.Random(4)
    for n, p in ((40, 0.05), (40, 0.2)):
        edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < p]
        df = spark.createDataFrame(edges, "late long, early long")
        for some in (set(range(n)), {i for i in range(n) if rng.random() < 0.8}):
            stays = {}
            for a in range(n):  # a row that lacks edges may stay or not
                near = [stays[b] for x, b in edges if x == a]
                stays[a] = False if True in near else None if None in near or a not in some else True
            nodes = spark.createDataFrame([(i, i in some) for i in range(n)], "key long, complete boolean")
            got = {r.key: r.stays for r in greedy.settle(nodes, df, one_task).collect()}
            assert {k: v for k, v in got.items() if stays[k] is not None} == {k: v for k, v in stays.items() if v is not None}
            assert len(some) < n or len(got) == n


def test_chain_is_settled_in_logarithmic_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(greedy, "cut", lambda df, f=greedy.cut: cuts.append(1) or f(df))
    n = 10_000
    nodes = spark.range(n).select(F.col("id").alias("key"), F.lit(True).alias("complete"))
    edges = spark.range(1, n).select(F.col("id").alias("late"), (F.col("id") - 1).alias("early"))
    got = {r.key: r.stays for r in greedy.settle(nodes, edges, 0).collect()}
    assert got == {i: i % 2 == 0 for i in range(n)} and len(cuts) / 2 < 20


def test_near_duplicates_of_a_chain_of_sets(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(dedup, "cut", lambda df, f=dedup.cut: cuts.append(1) or f(df))
    rows = spark.range(3000).select(F.col("id").alias("key"), F.transform(F.sequence(F.col("id"), F.col("id") + 9), lambda x: x.cast("string")).alias("grams"))
    got = {r.key: r.near for r in dedup.near_duplicates(rows, 70).collect()}
    assert got == {i: None if i % 2 == 0 else i - 1 for i in range(3000)} and len(cuts) <= 4 + 3 * 6


def test_two_key_dedup_is_sequential(spark):
    base = spark.createDataFrame([(0, "a", "T")], "ord long, k string, t string")
    new = spark.createDataFrame([(1, "b", "T"), (2, "b", "U"), (3, "c", "U"), (4, "d", "U")], "ord long, k string, t string")
    got = dedup.two_key(base, new, "k", F.col("t"), "ord").collect()
    assert [r.ord for r in got] == [3]  # 1 goes by text but holds key b; 2 goes by key; 4 goes by text


@pytest.mark.parametrize("sizes,n,want", [
    ({"a": 90, "b": 9, "c": 1}, 20, {"a": 18, "b": 2, "c": 1}),  # the highest rate is that of a stratum of one, which stays
    ({"a": 60, "b": 60, "c": 60}, 100, {"a": 33, "b": 34, "c": 33}), ({"a": 1, "b": 1, "c": 1}, 2, {"a": 1, "b": 1, "c": 1}), ({"a": 3, "b": 3}, 5, {"a": 3, "b": 2}), ({"a": 50, "b": 50}, 7, {"a": 4, "b": 3}),
])
def test_quotas(sizes, n, want):
    got = sampling.quotas(sizes, n)
    assert sum(got.values()) == sum(want.values()) and sorted(got.values()) == sorted(want.values()) and all(1 <= got[k] <= sizes[k] for k in sizes)


def test_permutation_keeps_the_gold_text(spark):
    rows = [(f"q{i}", [f"o{i}{j}" for j in range(2 + i % 4)], "AB"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, options array<string>, gold string")
    want = {i: o["AB".index(g)] for i, o, g in rows}
    got = sampling.permute_options(df, "id").collect()
    assert {r.id: r.options["ABCDE".index(r.gold)] for r in got} == want
    assert any(r.options != rows[k][1] for k, r in enumerate(got))
    odd = spark.createDataFrame([("x", ["1", "2"], "Z"), ("y", [], "A")], "id string, options array<string>, gold string")
    assert [(r.options, r.gold) for r in sampling.permute_options(odd, "id").collect()] == [(["1", "2"], "Z"), ([], "A")]


def test_replication_counts(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0.7).otherwise(1.3).alias("m"))
    n = {r.id: r["count"] for r in sampling.replicate(df, F.col("m"), "id").groupBy("id").count().collect()}
    assert set(n.values()) <= {1, 2} and 600 < sum(1 for i in n if i % 2 == 0) < 800 and all(n[i] >= 1 for i in range(1, 2000, 2))


@pytest.mark.parametrize("rule", ["min", "n-1"])
def test_nearest_rank(spark, rule):
    values = [5, 1, 1, 9, 7, 3, 3, 3, 2, 8, 4]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    s, n = sorted(values), len(values)
    at = {"min": lambda q: s[min(n - 1, int(q / 100 * n))], "n-1": lambda q: s[int(q / 100 * (n - 1))]}[rule]
    r = aggregates.nearest_rank(df, ["g"], "v", [50, 95, 99], rule).first()
    assert [r.p50, r.p95, r.p99] == [at(q) for q in (50, 95, 99)]


class Flaky:
    def __init__(self, fails, error=RuntimeError):
        self.left, self.error = fails, error

    def chat(self, messages, **p):
        self.left -= 1
        if self.left >= 0:
            raise self.error("no")
        return {"content": "ok"}


def test_retry():
    waits = []
    c = Flaky(2)
    assert model_calls.with_retry(lambda: c.chat([]), 3, sleep=waits.append)["content"] == "ok" and waits == [1.0, 1.5]
    waits.clear()
    c = Flaky(1, model_calls.RateLimited)
    model_calls.with_retry(lambda: c.chat([]), 3, sleep=waits.append)
    assert waits == [30.0]
    with pytest.raises(RuntimeError):
        model_calls.with_retry(lambda: Flaky(9).chat([]), 2, sleep=waits.append)


def test_streamed_answer():
    lines = ['data: {"choices": [{"delta": {"content": "a"}}]}', "", 'data: {"choices": [{"delta": {"content": "b"}}]}', 'data: {"choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}', "data: [DONE]"]
    assert model_calls.accumulate(lines) == {"content": "ab", "finish_reason": None, "prompt_tokens": 3, "completion_tokens": 2}


def _fail(h, messages, parameters):
    raise ValueError("broken")


def test_failed_calls_stay_as_rows(spark):
    rows = spark.createDataFrame([("k", [("user", "x")])], "key string, messages array<struct<role: string, content: string>>")
    got = model_calls.call(rows, model_calls.StubClient(answer=_fail), tries=1, samples=2).collect()
    assert len(got) == 2 and all(r.content is None and "broken" in r.error for r in got)


def test_parameter_hash_names_settings():
    hashes = {model_calls.parameter_hash(p) for p in ({"t": 0}, {"t": 1}, {"t": 0, "n": 8})}
    assert len(hashes) == 3 and model_calls.parameter_hash({"a": 1, "b": 2}) == model_calls.parameter_hash({"b": 2, "a": 1})


@pytest.fixture
def endpoint():
    """A local server of chat completions: it refuses the first request for a text that holds "busy"."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][-1]["content"]
            first = not any(b["messages"][-1]["content"] == text for b, _, _ in seen)
            seen.append((body, self.path, self.headers.get("Authorization")))
            status = 429 if "busy" in text and first else 500 if "broken" in text else 200
            if body.get("stream"):
                parts = [{"choices": [{"delta": {"reasoning_content": "hidden"}}]}, {"choices": [{"delta": {"content": text}, "finish_reason": "stop"}]}, {"choices": [], "usage": {"prompt_tokens": 4, "completion_tokens": 2}}]
                out = "".join(f"data: {json.dumps(p)}\n\n" for p in parts) + "data: [DONE]\n\n"
            else:
                choice = lambda k: {"message": {"content": f"{text} {k}"}, "finish_reason": "length" if "long" in text else "stop"}
                out = json.dumps({"choices": [choice(k) for k in range(body.get("n", 1))], "usage": {"prompt_tokens": 4, "completion_tokens": 3}})
            self.send_response(status)
            self.end_headers()
            self.wfile.write(out.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_chat_client(endpoint, monkeypatch):
    url, seen = endpoint
    monkeypatch.setenv("TEST_KEY", "k1")
    client = model_calls.ChatClient(model_calls.BackendSpec("x", "m", (f"{url}/a", f"{url}/b"), "TEST_KEY"))
    ask = lambda t, **p: client.chat([{"role": "user", "content": t}], **p)
    got = ask("hi", n=2, temperature=0.5)
    assert got["content"] == "hi 0" and [c["content"] for c in got["choices"]] == ["hi 0", "hi 1"] and (got["finish_reason"], got["completion_tokens"]) == ("stop", 3)
    assert seen[0][0]["model"] == "m" and seen[0][0]["temperature"] == 0.5 and seen[0][2] == "Bearer k1"
    assert ask("more", thinking=True) == {"content": "more", "finish_reason": "stop", "prompt_tokens": 4, "completion_tokens": 2}
    assert [path for _, path, _ in seen] == ["/a/chat/completions", "/b/chat/completions"]
    waits = []
    assert model_calls.with_retry(lambda: ask("busy"), 2, sleep=waits.append)["content"] == "busy 0" and waits == [30.0]
    with pytest.raises(RuntimeError, match="HTTP 500"):
        ask("broken")


def test_evaluation_tells_truncated_answers(spark, endpoint):
    client = model_calls.ChatClient(model_calls.BackendSpec("x", "m", (endpoint[0],)))
    rows = [("q1", "", "long", ["a", "b"], "A", "en", "t"), ("q2", "", "short", ["a", "b"], "A", "en", "t")]
    df = spark.createDataFrame(rows, "question_id string, story string, question string, options array<string>, gold string, language string, task string")
    got = {r.question_id: (r.finish_reason, r.truncated) for r in model_calls.evaluate(df, client, "direct").collect()}
    assert got == {"q1": ("length", True), "q2": ("stop", False)}
    scored = model_calls.score_difficulty(df, client, 8).collect()
    assert {r.n_total for r in scored} == {8} and sum(b.get("n") == 8 for b, _, _ in endpoint[1]) == 2


def test_distill_returns_the_story_that_was_solved(spark, endpoint, tmp_path):
    """A paraphraser that never answers the same twice is asked once for each row."""
    df = spark.createDataFrame([(f"q{i}", f"s{i}", "?", ["a", "b"], "A", "en", f"t{i % 2}") for i in range(6)], "question_id string, story string, question string, options array<string>, gold string, language string, task string")
    log = str(tmp_path / "log")

    def tell(h, messages, parameters):
        with open(log, "a") as f:
            f.write("x\n")
        return f"{messages[-1]['content']} {uuid.uuid4()}"

    def solve(h, messages, parameters):
        with open(log + ".solved", "a") as f:
            f.write(messages[-1]["content"] + "\n")
        return "\\boxed{A}"

    out = model_calls.distill(df, model_calls.StubClient(answer=solve), votes=2, needed=2, paraphrase=F.col("task") == "t0", paraphraser=model_calls.StubClient(answer=tell), source="made").collect()
    assert len(out) == 6 and len(open(log).readlines()) == 3
    solved = open(log + ".solved").read()
    assert all(r.story in solved for r in out) and {(r.task, r.source) for r in out} == {("t0", "made_paraphrased"), ("t1", "made_original")}


def test_first_of_each_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 2), (None, 3), (None, 4)], "k string, o long")
    got = sorted((str(r.k), r.o) for r in dedup.first_by_key(df, F.col("k"), F.col("o")).collect())
    assert got == [("None", 3), ("a", 1), ("b", 2)]


def test_null_groups_have_cells_of_their_own(spark):
    rows = [("m", "p", None, "t", True), ("m", "p", "en", None, False), (None, "p", "en", "t", True)]
    df = spark.createDataFrame(rows, "model string, protocol string, language string, task string, correct boolean")
    got = {r.model: (r.n, r.by_language, r.by_task) for r in aggregates.accuracy_cube(df).collect()}
    assert got == {"m": (2, {"?": 1.0, "en": 0.0}, {"?": 0.0, "t": 1.0}), None: (1, {"en": 1.0}, {"t": 1.0})}
    shares = {(r.language, r.task, r.overall): r.share for r in aggregates.share_by(df, "language", "task").collect()}
    assert shares[None, "t", False] == 1.0 and shares[None, "t", True] == pytest.approx(2 / 3) and shares["en", "t", False] == 0.5


def test_null_stratum(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(100)], "id long, s string")
    got = sampling.proportional(df, "s", 20, "id").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"a": 8, "b": 8, None: 4}


def test_references_reach_the_whole_pool(spark):
    prompts = spark.range(2000).select(F.col("id").alias("key"))
    few = sampling.references(prompts, spark.range(20).select(F.col("id").alias("ref")), 2, "key", "ref").groupBy("ref").count().collect()
    assert len(few) == 20 and all(120 < r["count"] < 290 for r in few)
    many = sampling.references(prompts, spark.range(5000).select(F.col("id").alias("ref")), 2, "key", "ref")
    assert many.count() == 4000 and many.select("ref").distinct().count() > 2500


def test_pool_distractors_take_what_the_pool_has(spark):
    df = spark.range(400).select("id", F.concat(F.lit("a"), F.col("id") % 40).alias("answer"))
    for r in sampling.pool_distractors(df, "answer", "id").collect():
        assert len(set(r.wrong)) == 3 and r.answer not in r.wrong and not any(w.startswith("None") for w in r.wrong)
    two = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, answer string")
    assert {r.id: r.wrong[0] for r in sampling.pool_distractors(two, "answer", "id").collect() if r.id < 3} == {1: "y", 2: "x"}


def test_a_failed_fetch_leaves_no_file(spark, tmp_path):
    def fail(url):
        raise OSError("no")

    with pytest.raises(OSError):
        readers.staged(spark, "http://x/f.txt", str(tmp_path), fail)
    path = readers.staged(spark, "http://x/f.txt", str(tmp_path), lambda url: b"a\nb\n")
    assert [r.value for r in spark.read.text(path).collect()] == ["a", "b"] and readers.staged(spark, "http://x/f.txt", str(tmp_path), fail) == path


def test_numbered_lines_over_blocks(spark, tmp_path):
    (tmp_path / "f.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {r.line: r.value for r in readers.numbered_lines(spark, f"{tmp_path}/f.txt").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"line {i}" for i in range(5000)}


def test_card_counts_what_it_does_not_list(spark):
    card = sinks.data_card(spark.range(10), "t", ("id",), top=3)
    assert "other (7 values) | 7" in card


def test_prefixes_of_few_words(spark):
    texts = [(1, "abcdefgh ijkl"), (2, "one two three four five six"), (3, ""), (4, None), (5, "x" * 200), (6, "日本語のテスト"), (7, "two three")]
    items = [(1, "cdefgh i"), (2, "two three"), (3, ""), (4, None), (5, "x" * 79), (6, "本語"), (7, "one two three four five six seven"), (8, "e"), (9, "x" * 300), (10, "one two three four five six")]
    train, ev = (spark.createDataFrame(x, "key long, text string") for x in (texts, items))
    want = {(i, k) for i, p in items for k, t in texts if p and t and p[:80] in t}
    assert {tuple(r) for r in dedup.prefix_leaks(train, ev).collect()} == want and (9, 5) in want


def test_watch_keeps_what_the_rules_need(spark, tmp_path):
    """Batch by batch, and after a restart, the rules see what they would see in the whole series."""
    from marlstone.streaming import monitors

    values = {("a", "kl"): [0.1, 0.9, 0.8, 0.7, 0.2], ("b", "score"): [0.9, 0.1, 0.2, 0.3, 0.95], ("c", "entropy"): [0.01, 0.5, 0.02, 0.03, 0.04]}
    series, seen, acts, schema = [], [], [], "run string, tag string, step long, value double"

    def run() -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        monitors.watch(stream, acts.append, f"{tmp_path}/log").awaitTermination()

    for i in range(5):
        batch = [(run_, tag, i, v[i]) for (run_, tag), v in values.items()]
        series += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen.append({tuple(r) for r in monitors.stop_reasons(spark.createDataFrame(series, schema)).collect()})
        if i in (2, 4):
            run()
    assert seen == [set(), set(), set(), {("a", "kl"), ("b", "score")}, {("c", "entropy")}]
    assert [set(a) for a in acts] == seen
    spark.createDataFrame([("c", "entropy", 5, 0.01), ("c", "other", 5, None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert acts[5:] == [[("c", "entropy")]]  # other series are not read again


def test_repeats_of_any_age_are_dropped(spark, tmp_path):
    from marlstone.streaming import monitors

    for i, rows in enumerate(([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01")], [(2, "2025-01-01 00:00:00")], [(1, "2026-01-01 00:00:00"), (3, "2020-01-01 00:00:00")])):
        spark.createDataFrame(rows, "k long, t string").select("k", F.to_timestamp("t").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema("k long, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = monitors.drained(spark, monitors.append_new(s, ["k"]), f"r{uuid.uuid4().hex}", "append")
    assert sorted(r.k for r in got.collect()) == [1, 2, 3]


def test_ranks_without_sorting_a_group(spark):
    rng = random.Random(8)
    odd = [float("inf"), float("-inf"), float("nan"), 1e308, -1e308, 5e-324, 0.0]
    rows = [("a", rng.gauss(0, 1)) for _ in range(900)] + [(None, float(rng.randrange(3))) for _ in range(50)] + [("b", x) for x in odd] + [("c", None), ("d", 7.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    for rule in ("min", "n-1"):
        got = {r.g: tuple(r)[1:] for r in aggregates.nearest_rank(df, ["g"], "v", [0, 50, 95, 99], rule, bins=8).collect()}
        want = {}
        for g in ("a", "b", "d", None):
            v = sorted((x for h, x in rows if h == g and x is not None), key=lambda x: (x != x, x))
            want[g] = tuple(v[min(len(v) - 1, q * (len(v) - (rule == "n-1")) // 100)] for q in (0, 50, 95, 99))
        assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))
    plan = aggregates.nearest_rank(df, ["g"], "v", [50])
    assert plan.count() == 4 and aggregates.nearest_rank(df.limit(0), ["g"], "v", [50]).collect() == []
    ints = spark.range(1000).select((F.col("id") * 10**15 - 5 * 10**17).alias("v"))
    assert aggregates.nearest_rank(ints, [], "v", [50]).first()[0] == 0


def test_fold_in_of_nothing(spark):
    from marlstone.plans import pipelines

    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "key long, text string")
    out = pipelines.fold_in(rows, rows.limit(0), rows, F.col("text"))
    assert sorted(r.key for r in out["rows"].collect()) == [1, 2, 3] and out["log"].collect() == [] and out["leaked"].collect() == []


def test_merge_gives_chat_rows_and_a_card(spark):
    from marlstone.functions import prompts
    from marlstone.plans import pipelines

    story = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(i, f"q{i}", s, "src", "en", "t", "Who?", "1", "2", "3", "4", "A") for i, s in enumerate([story("a", 30), story("a", 29), story("b", 30), story("c", 30)])]
    train = spark.createDataFrame(rows, "key long, question_id string, story string, source string, language string, task string, question string, opt_a string, opt_b string, opt_c string, opt_d string, gold string")
    ev = spark.createDataFrame([(1, story("b", 30), "en"), (2, story("z", 30), "zh")], "key long, story string, language string")
    moved = spark.createDataFrame([(1, "z1", story("z", 30)), (2, "z2", story("y", 30))], "key long, question_id string, text string")
    made = moved.select("key", "question_id", prompts.chat(F.lit("s"), F.col("text")).alias("messages"), *(F.lit("x").alias(c) for c in ("ground_truth", "tag", "source", "language", "task")))
    out = pipelines.merge(train, ev, F.col("story"), translated=made)
    assert sorted(r.question_id for r in out["chat"].collect()) == ["q0", "q3", "z2"]
    card = pipelines.merge_card(out)
    assert "| src | 2 | 1.0000 |" in card and "| 4 | 1 | 1 | 2 |" in card
