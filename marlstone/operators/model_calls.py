"""Calls of a chat model per row: an injectable client, retries, endpoints, a response table as cache, and the
operators built on them (evaluation, judging, synthesis, translation, traces, verified distillation).

Rows go through ``mapInArrow``, a partition at a time, with a bounded number of requests in flight.  A client is any
picklable object with ``chat(messages, **parameters) -> dict`` that returns ``content``, ``finish_reason``,
``prompt_tokens`` and ``completion_tokens``, and for ``n`` above 1 also ``choices`` with a content and finish reason each.
``ChatClient`` speaks to an endpoint; ``responses.StoredClient`` keeps what another client answers; ``StubClient`` answers from a hash of the request, so everything runs without a
network and gives the same rows each time.  A call that fails in the end gives a row with ``error`` set; rows are never dropped silently.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import answers, jsontext, prompts
from marlstone.functions.text import PROTOCOLS
from marlstone.operators import joins, responses
from marlstone.operators.lineage import cut

CALLS = "key string, sample_idx int, content string, prompt_tokens int, completion_tokens int, finish_reason string, error string"


@dataclass(frozen=True)
class BackendSpec:
    """A model behind an endpoint; the key's variable is named, never stored."""

    name: str
    model: str
    urls: tuple[str, ...] = ("http://localhost:8000/v1",)
    key_env: str = ""
    extra: dict = field(default_factory=dict)

    def url(self, i: int) -> str:
        """Endpoints in turn."""
        return self.urls[i % len(self.urls)]

    def url_of(self, i: Column) -> Column:
        """The same for a row's number."""
        return F.get(F.array(*map(F.lit, self.urls)), F.pmod(i, F.lit(len(self.urls))).cast("int"))


class RateLimited(Exception):
    pass


class ChatClient:
    """Chat completions over HTTP, from a backend's endpoints in turn.

    A 429 is RateLimited, so that the retry waits longer.  Answers are streamed where the backend's extra parameters or
    the call's ask for thinking; only the visible text is kept.  The key is read from its variable at each request.
    """

    def __init__(self, spec: BackendSpec, timeout: float = 60.0):
        self.spec, self.timeout, self.turn = spec, timeout, 0

    def chat(self, messages: list[dict], **parameters) -> dict:
        thinking = parameters.pop("thinking", False) or self.spec.extra.get("enable_thinking", False)
        parameters.pop("sample", None)  # only tells samples of one request apart
        body = {"model": self.spec.model, "messages": messages, **self.spec.extra, **parameters}
        if thinking:
            body |= {"stream": True, "enable_thinking": True, "stream_options": {"include_usage": True}}
        url, self.turn = self.spec.url(self.turn), self.turn + 1
        head = {"Content-Type": "application/json"}
        if self.spec.key_env:
            head["Authorization"] = f"Bearer {os.environ.get(self.spec.key_env, '')}"
        request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                if thinking:
                    return accumulate([line.decode().rstrip("\r\n") for line in answer])
                return read_completion(json.load(answer))
        except urllib.error.HTTPError as e:
            said = e.read().decode(errors="replace")
            if e.code == 429 or "limit_requests" in said:
                raise RateLimited(said[:500]) from e
            raise RuntimeError(f"HTTP {e.code}: {said[:500]}") from e


def read_completion(body: dict) -> dict:
    """The first choice's text, all choices, and the usage of a completion that was not streamed."""
    choices = [{"content": c["message"].get("content") or "", "finish_reason": c.get("finish_reason")} for c in body["choices"]]
    usage = body.get("usage") or {}
    return choices[0] | {"choices": choices, "prompt_tokens": usage.get("prompt_tokens", 0), "completion_tokens": usage.get("completion_tokens", 0)}


@dataclass(frozen=True)
class StubClient:
    """Answers that depend on nothing but the request: a boxed letter, or what answer makes of the hash and messages."""

    letters: str = "ABCD"
    answer: Callable[[int, list, dict], str] | None = None

    def chat(self, messages: list[dict], **parameters) -> dict:
        n = parameters.pop("n", 1)
        if n > 1:  # each choice is what a request of its own for that sample would give
            made = [self.chat(messages, **parameters | ({"sample": k} if k else {})) for k in range(n)]
            return made[0] | {"choices": made, "completion_tokens": sum(m["completion_tokens"] for m in made)}
        text = json.dumps([messages, sorted(parameters.items())], ensure_ascii=False)
        h = int(hashlib.sha256(text.encode()).hexdigest()[:12], 16)
        content = self.answer(h, messages, parameters) if self.answer else f"Thinking. \\boxed{{{self.letters[h % len(self.letters)]}}}"
        return {"content": content, "finish_reason": "stop", "prompt_tokens": len(text) // 4, "completion_tokens": len(content) // 4}


def with_retry(call: Callable[[], dict], tries: int = 5, base: float = 1.5, pause: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; failures wait base**k seconds, a rate limit pause * (k + 1); the last error is raised."""
    for k in range(tries):
        try:
            return call()
        except RateLimited:
            if k == tries - 1:
                raise
            sleep(pause * (k + 1))
        except Exception:
            if k == tries - 1:
                raise
            sleep(base**k)
    raise ValueError("tries must be positive")


def accumulate(events: list[str]) -> dict:
    """A streamed answer's text and usage from its ``data:`` lines; the usage stands in a late event without choices."""
    text, usage, finish = [], {}, None
    for line in events:
        body = line.removeprefix("data:").strip()
        if not line.startswith("data:") or body == "[DONE]":
            continue
        e = json.loads(body)
        usage = e.get("usage") or usage
        for choice in e.get("choices") or []:
            text.append((choice.get("delta") or {}).get("content") or "")
            finish = choice.get("finish_reason") or finish
    return {"content": "".join(text), "finish_reason": finish, "prompt_tokens": usage.get("prompt_tokens", 0), "completion_tokens": usage.get("completion_tokens", 0)}


def stream_text(events: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """The same over a table of event lines: text and usage per key, in the order of a column."""
    kind = "choices array<struct<delta: struct<content: string>>>, usage struct<prompt_tokens: int, completion_tokens: int>"
    e = F.from_json(F.trim(F.regexp_replace(line, "^data:", "")), kind)
    rows = events.where(F.col(line).startswith("data:") & ~F.col(line).contains("[DONE]")).select(*keys, order, e.alias("e"))
    part = F.array_join(F.transform("e.choices", lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce(part, F.lit("")).alias("t")))), lambda x: x["t"])
    return rows.groupBy(*keys).agg(F.array_join(texts, "").alias("content"), F.max_by("e.usage.completion_tokens", F.when(F.col("e.usage").isNotNull(), F.col(order))).alias("completion_tokens"))


class FlakyClient:
    """A client whose first calls for each request fail, for tests of the retry."""

    def __init__(self, inner, fails: int = 1):
        self.inner, self.fails, self.seen = inner, fails, {}

    def chat(self, messages: list[dict], **parameters) -> dict:
        key = json.dumps([messages, sorted(parameters.items())])
        self.seen[key] = self.seen.get(key, 0) + 1
        if self.seen[key] <= self.fails:
            raise ConnectionError("not yet")
        return self.inner.chat(messages, **parameters)


def _asker(client, parameters: dict, tries: int, wait: float) -> Callable[[dict], list[tuple]]:
    """A request's rows of CALLS, one for each of its n samples; its tokens are counted in the first."""

    def one(row: dict) -> list[tuple]:
        first, n = row["sample_idx"], row["n"]
        extra = parameters | ({"sample": first} if first else {}) | ({"n": n} if n > 1 else {})
        try:
            r = with_retry(lambda: client.chat(row["messages"], **extra), tries, sleep=lambda x: time.sleep(x * wait))
            got = (r.get("choices") or [r])[:n]
            out = [(row["key"], first + k, c["content"], r.get("prompt_tokens", 0) if not k else 0, r.get("completion_tokens", 0) if not k else 0, c.get("finish_reason"), None) for k, c in enumerate(got)]
            return out + [(row["key"], first + k, None, 0, 0, None, "missing: the answer has fewer choices") for k in range(len(got), n)]
        except Exception as e:
            return [(row["key"], first + k, None, 0, 0, None, f"{type(e).__name__}: {e}") for k in range(n)]

    return one


def _caller(ask: Callable[[dict], list[tuple]], in_flight: int):
    """Rows of CALLS in the order in which answers come, in batches of about 256."""

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = ["key", "sample_idx", "content", "prompt_tokens", "completion_tokens", "finish_reason", "error"]
        with ThreadPoolExecutor(in_flight) as pool:
            held: list[tuple] = []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

            for rows in responses.as_they_come(pool, ask, (r for b in batches for r in b.to_pylist()), in_flight):
                held += rows
                if len(held) >= 256:
                    yield batch()
                    held = []
            if held:
                yield batch()

    return run


def parameter_hash(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:12]


def call(rows: DataFrame, client, parameters: dict | None = None, samples: int = 1, in_flight: int = 8, tries: int = 3, cache: DataFrame | None = None, wait: float = 1.0, together: bool = False) -> DataFrame:
    """rows: (key, messages).  A row per key and sample, of CALLS; wait scales the pauses between tries.

    together: all samples of a key by one request for n answers; not with a cache, which may have some of them.

    cache: earlier rows of the same layout; what it has is taken from there, and only the rest is asked for.  Its keys
    should name model, protocol and parameter_hash, so other settings never meet old answers.

    A responses.StoredClient is asked at once, for what its table lacks; every operator of this module that is given one
    reads its answers from the table, however often its result is used.
    """
    if together and cache is not None:
        raise ValueError("samples that are asked for together have no cache")
    each = F.lit(0) if together else F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    todo = rows.select("key", "messages", each.alias("sample_idx"), F.lit(samples if together else 1).alias("n"))
    if isinstance(client, responses.StoredClient):
        if cache is not None:
            raise ValueError("a stored client has its own answers; give no cache")
        settings = parameter_hash((parameters or {}) | ({"n": samples} if together else {}))
        return responses.through(todo, client, settings, _asker(client, parameters or {}, tries, wait), in_flight).select(*[c.split()[0] for c in CALLS.split(", ")])
    if cache is not None:
        done = cache.where("error IS NULL")
        todo, hit = joins.resume(todo, done, ["key", "sample_idx"]), done.join(todo.select("key", "sample_idx"), ["key", "sample_idx"], "left_semi")
    made = todo.select("key", "sample_idx", "messages", "n").mapInArrow(_caller(_asker(client, parameters or {}, tries, wait), in_flight), CALLS)
    return made if cache is None else made.unionByName(hit.select(*made.columns))


def evaluate(questions: DataFrame, client, protocol: str, model: str = "model", cache: DataFrame | None = None, thinking: bool = False) -> DataFrame:
    """questions: (question_id, story, question, options, gold, language, task).  Result rows with all raw responses.

    A single answer is read as the protocol says; several samples are voted on.  Failed calls leave ``pred`` null and are
    counted in ``n_errors``.  finish_reason is the first response's; truncated tells whether any was cut by its length.
    """
    p = dict(PROTOCOLS[protocol])
    samples = p.pop("n")
    template = prompts.SYSTEM_DIRECT if protocol == "direct" else prompts.SYSTEM_COT
    chat = prompts.chat(prompts.system_prompt(F.size("options"), template), prompts.user_prompt(F.col("story"), F.col("question"), F.col("options"), F.col("language")))
    key = F.concat_ws("__", F.lit(model), F.lit(protocol), F.lit(parameter_hash(p | {"n": samples})), "question_id")
    asked = questions.withColumn("key", key)
    got = call(asked.select("key", chat.alias("messages")), client, p | ({"thinking": True} if thinking else {}), samples, cache=cache)
    per = got.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "content"))), lambda s: s["content"]).alias("raw_responses"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.sum("completion_tokens").alias("out_len"), F.min_by("finish_reason", "sample_idx").alias("finish_reason"), F.coalesce(F.bool_or(F.col("finish_reason") == "length"), F.lit(False)).alias("truncated"))
    n = F.size("options")
    read = F.when(F.lit(protocol == "direct"), answers.extract_for_options(F.get("raw_responses", F.lit(0)), n)).otherwise(answers.vote(F.transform("raw_responses", lambda t: answers.extract_cot(t, 26)), 26))
    out = asked.join(per, "key").withColumn("pred", F.when(F.instr(prompts.letter_list(n), F.coalesce(read, F.lit("?"))) > 0, read))
    keep = [c for c in questions.columns if c not in ("story", "question", "options")]
    return out.select(*keep, "pred", F.lit(model).alias("model"), F.lit(protocol).alias("protocol"), F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).alias("correct"), "raw_responses", "n_errors", "out_len", "finish_reason", "truncated")


def evaluate_presets(questions: DataFrame, clients: dict, protocols: list[str]) -> DataFrame:
    """All models under all protocols as one table."""
    out = None
    for model, client in clients.items():
        for p in protocols:
            r = evaluate(questions, client, p, model)
            out = r if out is None else out.unionByName(r)
    return out


def score_difficulty(questions: DataFrame, client, samples: int = 8, parameters: dict | None = None, template: str = prompts.SYSTEM_COT) -> DataFrame:
    """question_id, n_correct, n_total, reward_mean over the samples of one request; failed calls count as wrong."""
    chat = prompts.chat(prompts.system_prompt(F.size("options"), template), prompts.user_prompt(F.col("story"), F.col("question"), F.col("options"), F.col("language")))
    got = call(questions.select(F.col("question_id").alias("key"), chat.alias("messages")), client, parameters or {"temperature": 1.0}, samples, together=True)
    rows = got.join(questions.select(F.col("question_id").alias("key"), "gold"), "key")
    right = F.coalesce(answers.extract_cot(F.col("content"), 26) == F.col("gold"), F.lit(False))
    return rows.groupBy(F.col("key").alias("question_id")).agg(F.count_if(right).alias("n_correct"), F.count("*").alias("n_total"), F.avg(right.cast("int")).alias("reward_mean"))


def transform_rows(rows: DataFrame, client, key: str, system: str, user: Column, read: Callable[[Column], Column], parameters: dict | None = None, samples: int = 1) -> DataFrame:
    """The pattern of all generating operators: ask per row, read the answer into a struct, and tell what became of it.

    Adds result (null if the answer can't be read), and outcome: ok, bad, or failed for a call without an answer.
    """
    asked = rows.select(F.col(key).cast("string").alias("key"), prompts.chat(F.lit(system), user).alias("messages"))
    got = call(asked, client, parameters, samples).withColumn("result", read(F.col("content")))
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("result").isNull(), "bad").otherwise("ok")
    return rows.withColumn("key", F.col(key).cast("string")).join(got.select("key", "sample_idx", "content", "error", "result", outcome.alias("outcome")), "key").drop("key")


def judge(rows: DataFrame, client, key: str, text: Column) -> DataFrame:
    """Verdicts on made questions: four booleans and a reason."""
    return transform_rows(rows, client, key, "Judge the question. Reply as JSON with is_tom, unique_gold, distractors_plausible, overall_good and reason.", text, jsontext.verdict)


def audit_labels(rows: DataFrame, client, key: str, text: Column, fields: tuple[str, ...] = ("label_assessment", "label_confidence", "issue_category")) -> DataFrame:
    """Verdicts on labels as strings; the first field is needed."""
    def read(c: Column) -> Column:
        v = jsontext.parsed(c)
        return F.when(jsontext.text_at(v, f"$.{fields[0]}").isNotNull(), F.struct(*(jsontext.text_at(v, f"$.{f}").alias(f) for f in fields)))

    return transform_rows(rows, client, key, f"Audit the label. Reply as JSON with {', '.join(fields)}.", text, read)


def diagnose(rows: DataFrame, client, key: str, text: Column, categories: tuple[str, ...]) -> DataFrame:
    """One of the categories per wrong answer; another reply is bad."""
    def read(c: Column) -> Column:
        v = jsontext.text_at(jsontext.parsed(c), "$.category")
        return F.when(v.isin(*categories), F.struct(v.alias("category")))

    return transform_rows(rows, client, key, f"Name the error's category, one of {', '.join(categories)}, as JSON with category.", text, read)


@dataclass(frozen=True)
class CategorySpec:
    """What a kind of question is generated from: its task, the letters that may be gold, and a template per language in
    which {gold} stands for the letter that the plan asks for."""

    name: str
    task: str
    templates: tuple[tuple[str, str], ...]
    letters: str = "ABCD"


def spec_plan(spark, specs: list[CategorySpec], n: int) -> DataFrame:
    """n rows over all pairs of spec and language, evenly, with the spec's own letters in turn and its prompt filled in."""
    cells = [(s.name, s.task, s.letters, language, text) for s in specs for language, text in s.templates]
    rows = spark.createDataFrame(cells, "kind string, task string, letters string, language string, template string")
    each = F.explode(F.sequence(F.lit(0), F.lit(n // len(cells) - 1)) if n >= len(cells) else F.array().cast("array<int>"))
    rows = rows.withColumn("i", each).withColumn("gold", F.substring("letters", F.col("i") % F.length("letters") + 1, F.lit(1)))
    return rows.select("kind", "task", "language", "i", "gold", F.replace("template", F.lit("{gold}"), F.col("gold")).alias("prompt"))


#: Said before every specification, so that nothing of a published evaluation set is written down from memory.
ORIGINAL = "Invent people, places and events of your own. Reuse no item of any published test. Write a question with options as JSON."


def synthesize(plan: DataFrame, client, key: str, prompt: Column, examples: Column | None = None, options: int = 4, system: str = "Write a question with options as JSON.", gate: Column | None = None) -> DataFrame:
    """Questions from a generation plan (with gold, where the plan sets one); examples are put before the prompt.

    A question is bad if it has another gold than planned, or if gate (over result) is not true.
    """
    user = prompt if examples is None else F.concat(examples, F.lit("\n\n"), prompt)
    read = jsontext.mcq_object if options == 4 else lambda c: jsontext.option_list_object(c, options)
    out = transform_rows(plan, client, key, system, user, read)
    if "gold" in plan.columns:
        missed = F.col("result.gold") != F.col("gold")
        out = out.withColumn("outcome", F.when(F.coalesce(missed, F.lit(False)), "bad").otherwise(F.col("outcome")))
    if gate is not None:
        out = out.withColumn("outcome", F.when((F.col("outcome") == "ok") & ~F.coalesce(gate, F.lit(False)), "bad").otherwise(F.col("outcome")))
    return out


def translate(rows: DataFrame, client, key: str, user: Column, gold: str = "gold") -> DataFrame:
    """Translations that kept the gold letter."""
    asked = transform_rows(rows, client, key, "Translate to Chinese. Reply as the same JSON.", user, jsontext.mcq_object)
    kept = F.col("result.gold") == F.col(gold)
    return asked.withColumn("outcome", F.when(F.col("outcome") == "ok", F.when(kept, "ok").otherwise("bad")).otherwise(F.col("outcome")))


def reasoning_traces(rows: DataFrame, client, key: str, user: Column, gold: str = "gold", least: int = 3) -> DataFrame:
    """Traces with enough steps whose boxed answer is the gold."""
    from marlstone.functions.text import step_lines

    asked = transform_rows(rows, client, key, prompts.SYSTEM_SFT["en"], user, prompts.trace_parts)
    r, a = F.col("result.reasoning"), F.col("result.answer")
    good = r.isNotNull() & (step_lines(r) >= least) & (answers.boxed_letter(a) == F.col(gold))
    return asked.withColumn("outcome", F.when(F.col("outcome") == "failed", "failed").when(F.coalesce(good, F.lit(False)), "ok").otherwise("bad"))


def distill(
    questions: DataFrame, client, votes: int = 1, needed: int = 1, paraphrase: bool | Column = True, pre_verify: bool | Column = False, paraphraser=None,
    template: str = prompts.SYSTEM_COT, source: str | None = None,
) -> DataFrame:
    """Questions whose story is solved to the gold by at least ``needed`` of ``votes`` samples, paraphrased or as it is.

    paraphrase, pre_verify: for all rows, or a condition for each; a pre-verified row must be solved in its original form
    first.  template: the solver's system prompt.  Each model is asked once for each row and step, and the story that was
    solved is the one returned.  Rows keep ``derived_from``, their question's id, so that whatever comes from an
    evaluation set can be found again and left out by an anti join.  source: a tag's base, to which each row's mode is
    added, ``_paraphrased`` or ``_original``.
    """
    as_column = lambda c: F.lit(c) if isinstance(c, bool) else F.coalesce(c, F.lit(False))
    rows = questions.withColumns({"__told": as_column(paraphrase), "__first": as_column(pre_verify)})
    if pre_verify is not False:
        first = score_difficulty(rows.where("__first"), client, 1, template=template).where("n_correct = 1").select("question_id")
        rows = cut(rows.where("__first").join(first, "question_id", "left_semi").unionByName(rows.where("NOT __first")))
    if paraphrase is not False:
        asked = transform_rows(rows.where("__told"), paraphraser or client, "question_id", "Paraphrase the story. Reply with the story only.", F.col("story"), lambda c: F.when(F.trim(c) != "", F.struct(c.alias("story"))))
        told = asked.where("outcome = 'ok'").withColumn("story", F.col("result.story")).select(*rows.columns)
        rows = cut(told.unionByName(rows.where("NOT __told")))
    solved = score_difficulty(rows, client, votes, template=template).where(F.col("n_correct") >= needed).select("question_id", "n_correct")
    out = rows.join(solved, "question_id").withColumn("derived_from", F.col("question_id"))
    if source is not None:
        out = out.withColumn("source", F.concat(F.lit(f"{source}_"), F.when(F.col("__told"), "paraphrased").otherwise("original")))
    return out.drop("__told", "__first")


def smoke_check(specs: list[BackendSpec], make: Callable[[BackendSpec], object]) -> list[tuple[str, bool]]:
    """Whether each backend answers at all."""
    out = []
    for s in specs:
        try:
            out.append((s.name, bool(make(s).chat([{"role": "user", "content": "ping"}])["content"])))
        except Exception:
            out.append((s.name, False))
    return out


def reproduce(questions: DataFrame, client, settings: dict[str, dict], ids: list[str]) -> DataFrame:
    """The same questions under several settings, one row per question and setting."""
    rows = questions.where(F.col("question_id").isin(*ids))
    chat = prompts.chat(prompts.system_prompt(F.size("options")), prompts.user_prompt(F.col("story"), F.col("question"), F.col("options"), F.col("language")))
    out = None
    for name, p in settings.items():
        one = call(rows.select(F.col("question_id").alias("key"), chat.alias("messages")), client, p).select(F.col("key").alias("question_id"), F.lit(name).alias("setting"), answers.extract_cot(F.col("content"), 26).alias("pred"))
        out = one if out is None else out.unionByName(one)
    return out
