"""Composite pipelines: each is one call over tables, and gives tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import prompts
from marlstone.operators import aggregates as agg
from marlstone.operators import dedup, filters, joins, model_calls
from marlstone.operators import projections as prj
from marlstone.operators import sampling as smp
from marlstone.operators import similarity as sim
from marlstone.operators.lineage import cut


def build_evaluation(raw: DataFrame, fields: tuple[str, ...], needed: tuple[str, ...], n: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Bilingual raw rows as evaluation rows, and a seeded sample of them."""
    rows = prj.unpivot_languages(raw, fields, needed=needed).withColumn("question_id", F.concat_ws("_", "question_id", "language"))
    return rows, smp.sample(rows, n, "question_id", seed)


def recheck(chat: DataFrame, evaluation: DataFrame, text: Column, percent: int = 60, language: str = "zh") -> DataFrame:
    """Translated chat rows (key, messages, ...) with their similarity to the evaluation rows of their language, and
    whether they leak."""
    ev = evaluation.where(F.col("language") == language).select("key", sim.adaptive_grams(text).alias("grams"))
    user = prompts.first_of_role(F.col("messages"), "user")
    leaks = dedup.leakage(chat.select("key", sim.adaptive_grams(user).alias("grams")), ev, percent, inclusive=False)
    return chat.join(leaks.select("key", "max_jaccard", "leaked"), "key")


def merge(train: DataFrame, evaluation: DataFrame, text: Column, leak_percent: int = 60, near_percent: int = 70, translated: DataFrame | None = None, n: int = 4000, seed: int = 42) -> dict[str, DataFrame]:
    """train: (key, source, ...) in key order; evaluation: (key, ...).  Clean rows without near-duplicates, the
    per-source report and the totals; where they are questions also chat rows and a sample of n of these.  Translated
    chat rows join the others unless they leak.
    """
    sets = lambda rows: sim.gram_sets(rows, F.col("text"), "adaptive")
    rows, ev = train.select("key", text.alias("text")), evaluation.select("key", text.alias("text"))
    leaks = cut(dedup.leakage(sets(rows), sets(ev), leak_percent, inclusive=False))
    near = cut(dedup.near_duplicates(rows, near_percent, sets=sets, among=leaks.where("NOT leaked")))
    kept = train.join(near.where("near IS NULL"), "key", "left_semi")
    report = dedup.distribution(leaks.join(train.select("key", "source"), "key"), "source", "max_jaccard")
    totals = leaks.agg(F.count("*").alias("input"), F.count_if("leaked").alias("leaked"))
    totals = totals.select("*", near.agg(F.count("near")).scalar().alias("near_duplicates"), near.agg(F.count("*") - F.count("near")).scalar().alias("kept"))
    out = {"kept": kept, "report": report, "totals": totals}
    if "question" in train.columns:
        chat = prj.to_chat(kept)
        if translated is not None:
            chat = chat.unionByName(recheck(translated, evaluation, text, leak_percent).where("NOT leaked").select(*chat.columns), allowMissingColumns=True)
        out |= {"chat": chat, "subset": smp.sample(chat, n, "question_id", seed)}
    return out


def merge_card(merged: dict[str, DataFrame], title: str = "Data card") -> str:
    """Markdown of what a merge kept per source, what it dropped, and how similar the sources are to the evaluation."""
    from marlstone.sources.sinks import markdown

    sources = agg.frequency(merged["kept"], "source").orderBy("value")
    report = merged["report"].select("source", "n", "mean", "p95", "max").orderBy("source")
    parts = [f"# {title}", "## Sources kept", markdown(sources), "## Dropped", markdown(merged["totals"]), "## Similarity to the evaluation", markdown(report, 3)]
    return "\n\n".join(parts)


def fold_in(base: DataFrame, new: DataFrame, evaluation: DataFrame, text: Column, leak_percent: int = 60, near_percent: int = 70) -> dict[str, DataFrame]:
    """New rows without leaks and without near-duplicates of base or of earlier new rows, appended to base.

    Keys of new follow all of base's.  The log names each dropped row and the row that it is near to.
    """
    sets = lambda rows: sim.gram_sets(rows, F.col("text"), "cased", short="whole")
    old, rows, ev = (df.select("key", text.alias("text")) for df in (base, new, evaluation))
    first = new.agg(F.coalesce(F.min("key"), F.lit(2**63 - 1))).first()[0]  # without new rows all are the base's
    leaks = cut(dedup.leakage(sets(rows), sets(ev), leak_percent, inclusive=False))
    among = old.select("key").union(leaks.where("NOT leaked").select("key"))
    near = cut(dedup.near_duplicates(old.union(rows), near_percent, kept_before=first, sets=sets, among=among))
    kept = new.join(near.where("near IS NULL"), "key", "left_semi")
    return {"rows": base.unionByName(kept, allowMissingColumns=True), "log": near.where("near IS NOT NULL"), "leaked": leaks.where("leaked")}


def cleanup(train: DataFrame, deny: tuple[str, ...], extra: DataFrame, key: str, n: int = 4000, seed: int = 42) -> dict[str, DataFrame]:
    """Without the sources that an audit rejects, with another source, and a sample of the result."""
    rows = filters.deny(train, "source", deny).unionByName(extra, allowMissingColumns=True)
    return {"rows": rows, "sample": smp.sample(rows, n, key, seed), "drops": filters.drop_report(train, {"denied source": F.col("source").isin(*deny)})}


def build_stage(sources: list[DataFrame], evaluation: DataFrame, text: Column, key_text: Column, percent: int = 60, seed: int = 42) -> dict[str, DataFrame]:
    """sources: (key, source, task, ...) in order of preference; the first copy of a text stays unless it leaks.

    Leaks are counted per row, copies included; leaked has their texts' first copies.  key_text is the user's text, or the whole conversation where variants
    in style are to survive.
    """
    rows = joins.union_ordered(sources).withColumn("ord", F.struct("source_ord", "key"))
    graded = rows.withColumn("__t", key_text).withColumn("key2", F.concat_ws("#", "source_ord", "key"))
    leaks = cut(dedup.leakage(graded.select(F.col("key2").alias("key"), sim.word_grams(text).alias("grams")), evaluation, percent))
    part = lambda which: dedup.exact(graded.join(leaks.where(which).select(F.col("key").alias("key2")), "key2", "left_semi"), F.col("__t"), "ord").drop("ord", "__t", "key2")
    kept = cut(part("NOT leaked"))
    report = kept.agg(F.count("*").alias("total")).select("total", leaks.agg(F.count_if("leaked")).scalar().alias("leakage_dropped"))
    return {"rows": smp.shuffle(kept, "key", seed), "leaked": part("leaked"), "report": report, "sources": agg.frequency(kept, "source"), "tasks": agg.frequency(kept, "task")}


def curriculum(train: DataFrame, labels: DataFrame, task_accuracy: DataFrame, key: str, seed: int = 42, limit: float = 0.95) -> dict[str, DataFrame]:
    """Rows without mastered ones, replicated by their task's multiplier, shuffled; options are rebalanced after that."""
    kept = filters.mastery(train, labels, key, limit)
    weighted = kept.join(task_accuracy.select("task", smp.multiplier(F.col("accuracy")).alias("m")), "task", "left")
    rows = smp.replicate(weighted, F.col("m"), key, seed)
    drops = filters.drop_report(train.join(labels.select(key, "reward_mean"), key, "left"), {"no label": F.col("reward_mean").isNull(), "mastered": F.col("reward_mean") >= limit})
    return {"rows": smp.shuffle(rows, key, seed), "drops": drops}


def rebalance(rows: DataFrame, key: str, tag: str, seed: int = 42) -> dict[str, DataFrame]:
    """Options permuted with their gold, one tag for all, and the shares of gold letters after that."""
    out, changed = prj.retag(smp.permute_options(rows, key, seed), tag)
    return {"rows": out, "gold": agg.share_by(out, "source", "gold"), "retagged": rows.agg(changed)}


def audit_train(rows: DataFrame, text: str, group: str = "source") -> dict[str, DataFrame]:
    """Frequencies, gold shares by source, lengths, percentiles and the rate of duplicates."""
    n = rows.withColumn("len", F.length(text))
    return {
        "sources": agg.frequency(rows, group), "gold": agg.share_by(rows, group, "gold"), "lengths": n.agg(F.min("len").alias("min"), F.max("len").alias("max"), F.avg("len").alias("mean")),
        "percentiles": agg.nearest_rank(n.withColumn("all", F.lit(1)), ["all"], "len", [50, 75, 90, 95, 99]).drop("all"), "duplicates": dedup.duplicate_rate(rows, F.col(text)),
    }


def evaluate_and_report(questions: DataFrame, client, protocols: list[str], model: str = "model") -> dict:
    """Result rows, their accuracy cube, and that as Markdown."""
    from marlstone.sources.sinks import markdown

    rows = cut(model_calls.evaluate_presets(questions, {model: client}, protocols))
    cube = agg.accuracy_cube(rows)
    return {"rows": rows, "cube": cube, "markdown": markdown(cube.select("model", "protocol", "n", "overall").orderBy("model", "protocol"))}


def experiment_report(new: DataFrame, old: DataFrame, order: list[str], benches: int) -> dict[str, DataFrame]:
    """Results with fallback to an older run: main table, best protocols, means, truncation, lengths and deltas."""
    rows = joins.fallback(new, old, ["model", "benchmark", "protocol"])
    acc = lambda r: r.groupBy("model", "benchmark", "protocol").agg(agg.accuracy(F.col("correct")).alias("acc"))
    best = agg.best_protocol(rows, order)
    return {
        "main": agg.pivot_accuracy(rows, ["model", "benchmark"], "protocol", order), "best": best, "means": agg.best_mean(best), "complete": agg.best_mean(best, benches),
        "delta": agg.delta(acc(rows), acc(old), ["model", "benchmark", "protocol"], "acc"), "truncation": rows.groupBy("model", "protocol").agg(F.avg(F.col("truncated").cast("int")).alias("rate")),
        "lengths": agg.nearest_rank(rows, ["model"], "out_len", [95], "n-1"), "provenance": rows.groupBy("model", "benchmark", "protocol", "provenance").agg(F.count("*").alias("n")),
    }


def error_analysis(ours: DataFrame, reference: DataFrame, third: DataFrame) -> dict[str, DataFrame]:
    """Contingency, upside, error classes, hot questions, confusion and a sample of errors."""
    pairs = joins.paired(ours, reference, ["question_id"])
    three = joins.error_classes(ours, reference, third)
    return {
        "contingency": joins.contingency(pairs, ["task"]), "upside": joins.closeable_gap(pairs, "task"), "classes": three.groupBy("task", "kind").agg(F.count("*").alias("n")),
        "hot": three.where("kind = 'both_right'").select("question_id"), "confusion": agg.confusion(ours), "samples": smp.per_stratum(ours.where("NOT correct"), "task", 3, "question_id"),
        "changes": joins.changes(reference, ours, "question_id", "task"),
    }


def sweep(results: DataFrame, order: list[str], anchor: str, floor_bench: str, floor: float) -> DataFrame:
    """Each checkpoint's mean of best protocols and its verdict against the anchor."""
    best = agg.best_protocol(results, order)
    means = agg.best_mean(best).join(best.where(F.col("benchmark") == floor_bench).select("model", F.col("acc").alias("floor")), "model", "left")
    ref = means.where(F.col("model") == anchor).select("mean").scalar()
    return means.select("model", "mean", agg.judge_sweep(F.col("mean"), ref, F.coalesce("floor", F.lit(0.0)), floor).alias("verdict"))


def to_training(rows: DataFrame, template: str = prompts.SYSTEM_DIRECT) -> DataFrame:
    return prj.to_chat(rows, template)
