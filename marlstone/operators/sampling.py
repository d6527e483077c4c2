"""Sampling, shuffling, option permutation and reweighting, all seeded by hashes of keys instead of a generator's state.

The order of rows is that of ``md5(seed|key)``: the same on every run, engine and partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lineage import cut
from marlstone.schemas import LETTERS


def draw(seed: int, *parts: Column) -> Column:
    """A hash to order by; a different one for each seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of eight hex digits of the hash."""
    return F.conv(F.substring(draw(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def below(n: int, seed: int, *parts: Column) -> Column:
    """A whole number from 0 to n - 1 of fifteen hex digits of the hash; 0 if n is 0."""
    return F.pmod(F.conv(F.substring(draw(seed, *parts), 1, 15), 16, 10).cast("long"), F.lit(max(1, n)).cast("long"))


def sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """min(n, all) rows: the first in hash order, found per partition before they are merged."""
    return rows.orderBy(draw(seed, F.col(key)), key).limit(n)


def shuffle(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(draw(seed, F.col(key)), key)


def per_stratum(rows: DataFrame, stratum: str, n: int | Column, key: str, seed: int = 42) -> DataFrame:
    """The first n rows of each stratum in hash order."""
    w = Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), F.col(key))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def per_stratum_valid(rows: DataFrame, valid: Column, stratum: str, n: int, key: str, seed: int = 42) -> DataFrame:
    return per_stratum(rows.where(valid), stratum, n, key, seed)


def even_budget(rows: DataFrame, stratum: str, n: int, key: str, seed: int = 42, floor: int = 1, cap: bool = True) -> DataFrame:
    """max(floor, n // strata) of each stratum, then n of all of them if capped."""
    k = rows.select(stratum).distinct().count()
    out = per_stratum(rows, stratum, max(floor, n // max(1, k)), key, seed)
    return sample(out, n, key, seed + 1) if cap else out


def quotas(sizes: dict, n: int) -> dict:
    """Proportional quotas that add up to n where sizes allow: rounded half to even, one at least; a surplus is taken
    from the highest sampling rate, a deficit given to the smallest quota; ties go to the least key."""
    total, out = sum(sizes.values()), {}
    keys = sorted(sizes)
    for k in keys:
        out[k] = max(1, round(n * sizes[k] / total))
    while sum(out.values()) > n:
        most = max(keys, key=lambda k: out[k] / max(1, sizes[k]))
        if out[most] <= 1:
            break
        out[most] -= 1
    while sum(out.values()) < n:
        least = min(keys, key=lambda k: out[k])
        if out[least] >= sizes[least]:
            break
        out[least] += 1
    return out


def proportional(rows: DataFrame, stratum: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """A stratified sample of n rows; a null stratum is one, too.  Only the strata's counts reach the driver.

    The rank is first cut at the largest quota, so each task passes on that many rows of a stratum at most.
    """
    sizes = {(r[0] is None, r[0]): r[1] for r in rows.groupBy(stratum).count().collect()}
    if not sizes:
        return rows
    quota = quotas(sizes, n)
    fits = reduce(lambda a, b: a | b, (F.col(stratum).eqNullSafe(F.lit(s)) & (F.col("__r") <= q) for (_, s), q in quota.items()))
    w = Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), F.col(key))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(quota.values())).where(fits).drop("__r")


def numbered(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """rows with at, their position from 0 in the given order, and how many there are.

    Rows are range-partitioned and sorted; positions are a partition's offset plus the rank in it, so no task holds all.
    """
    ranged = rows.withColumn("__o", F.struct(*order)).repartitionByRange(F.col("__o")).sortWithinPartitions("__o").withColumn("__id", F.monotonically_increasing_id())
    ranged = cut(ranged).withColumn("__p", F.shiftright("__id", 33))
    before, total = [], 0
    for p, k in sorted((r[0], r[1]) for r in ranged.groupBy("__p").count().collect()):  # one row a partition
        before.append((p, total))
        total += k
    offset = F.broadcast(rows.sparkSession.createDataFrame(before, "__p long, __first long"))
    at = F.col("__first") + F.col("__id") - F.shiftleft("__p", 33)
    return ranged.join(offset, "__p").withColumn("at", at).drop("__o", "__id", "__p", "__first"), total


def references(prompts: DataFrame, pool: DataFrame, k: int, key: str, ref_key: str, seed: int = 42) -> DataFrame:
    """k references per prompt, drawn with replacement from the whole pool, each row as likely as any other.

    The pool's rows are numbered in hash order, a draw is a number below their count, and the join is on the number.  An
    empty pool gives null references.
    """
    numbers, n = numbered(pool.select(F.col(ref_key).alias("ref")), [draw(seed, F.col(ref_key)), F.col(ref_key)])
    asks = prompts.select(key, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    asks = asks.withColumn("at", below(n, seed + 1, F.col(key), F.col("i")))
    return asks.join(numbers, "at", "left").select(key, "i", "ref")


def permutation(n: Column, seed: int, *parts: Column) -> Column:
    """The indices from 0 to n - 1 in hash order."""
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(draw(seed, *parts, i).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(made), lambda s: s["i"])


def permute_options(rows: DataFrame, key: str, seed: int = 42, options: str = "options", gold: str = "gold") -> DataFrame:
    """Options in another order, and the gold letter of the same text.  A gold that names no option is left alone."""
    at = F.instr(F.lit(LETTERS), F.col(gold))
    fits = (F.length(gold) == 1) & (at > 0) & (at <= F.size(options))
    out = rows.withColumn("__p", F.when(fits, permutation(F.size(options), seed, F.col(key))))
    new = F.char(F.array_position("__p", at - 1).cast("int") + 64)
    moved = F.transform("__p", lambda i: F.get(F.col(options), i))
    return out.withColumn("__g", F.coalesce(new, F.col(gold))).withColumn(options, F.coalesce(moved, F.col(options))).withColumn(gold, F.col("__g")).drop("__p", "__g")


def permute_prompt(rows: DataFrame, key: str, seed: int = 42, prompt: str = "prompt", gold: str = "gold") -> DataFrame:
    """The same for the option lines that end a prompt, with any separator after the letter; a prompt whose last lines
    are not the letters from A on, each once, or whose gold isn't among them, stays as it is."""
    lines = F.split(prompt, "\n")
    item = r"^\s*([A-Z])\s*[.．、:：]\s*(.*)$"
    k = F.coalesce(F.aggregate(F.reverse(lines), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & x.rlike(item)).cast("int")).alias("n"), (a["on"] & x.rlike(item)).alias("on")), lambda a: a["n"]), F.lit(0))
    out = rows.withColumn("__k", k)
    tail = F.slice(lines, F.size(lines) - F.col("__k") + 1, F.col("__k"))
    letters = F.array_join(F.transform(tail, lambda x: F.regexp_extract(x, item, 1)), "")
    ok = (F.col("__k") >= 2) & (letters == F.substring(F.lit(LETTERS), F.lit(1), F.col("__k"))) & (F.instr(letters, F.col(gold)) > 0) & (F.length(gold) == 1)
    out = out.withColumn("__o", F.when(ok, F.transform(tail, lambda x: F.regexp_extract(x, item, 2)))).withColumn("__h", F.array_join(F.slice(lines, 1, F.size(lines) - F.col("__k")), "\n"))
    out = permute_options(out, key, seed, "__o", gold)
    body = F.array_join(F.transform("__o", lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")
    return out.withColumn(prompt, F.when(F.col("__o").isNotNull(), F.concat("__h", F.lit("\n"), body)).otherwise(F.col(prompt))).drop("__k", "__o", "__h")


def with_distractors(rows: DataFrame, answer: str, wrong: Column, key: str, seed: int = 42) -> DataFrame:
    """Options of the answer and given wrong ones, in hash order, with the gold letter."""
    out = rows.withColumn("options", F.concat(F.array(F.col(answer)), wrong)).withColumn("gold", F.lit("A"))
    return permute_options(out, key, seed)


def pool_distractors(rows: DataFrame, answer: str, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """k wrong answers per row from all answers: distinct, and none the row's own; made-up ones only where there are fewer
    others than k.

    The distinct answers are numbered in hash order; a row takes those that follow a drawn place, around the end and past
    its own answer, so each is as likely as any other and nothing is paired with the whole pool.
    """
    pool = rows.select(F.col(answer).alias("ref")).where("ref IS NOT NULL AND trim(ref) <> ''").distinct()
    numbers, n = numbered(pool, [draw(seed, F.col("ref")), F.col("ref")])
    place = below(n, seed + 1, F.col(key))
    asks = rows.select(key, F.col(answer).alias("__a"), place.alias("__p"), F.explode(F.sequence(F.lit(0), F.lit(min(k, max(0, n - 1))))).alias("i"))
    asks = asks.withColumn("at", F.pmod(F.col("__p") + F.col("i"), F.lit(max(1, n)).cast("long")))
    drawn = asks.join(numbers, "at").where(~F.col("ref").eqNullSafe(F.col("__a"))).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("i", "ref"))).alias("r"))
    texts = F.slice(F.transform("r", lambda s: s["ref"]), 1, k)
    fill = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.lit("None of these ("), i, F.lit(")")))
    return rows.join(drawn.select(key, texts.alias("wrong")), key, "left").withColumn("wrong", F.slice(F.concat(F.coalesce("wrong", F.array().cast("array<string>")), fill), 1, k))


#: Words that a mined noun phrase never begins with, and what stands in where a story has too few.
_NO_HEAD = "(?i)^(the|a|an|this|that|his|her|their|its)$"
FALLBACK = ("the drawer", "the basket", "the cupboard", "the garden")


def mined_distractors(story: Column, gold: Column, k: int = 3) -> Column:
    """Wrong answers from a story: phrases after an article, without the gold, its parts or what it is part of."""
    from marlstone.functions.text import strip_articles

    found = F.regexp_extract_all(F.coalesce(story, F.lit("")), F.lit(r"(?i)\b(?:the|a|an)\s+([a-z]+(?:\s+[a-z]+)?)\b"), F.lit(1))
    g = strip_articles(gold)
    clean = F.filter(F.transform(found, lambda x: strip_articles(x)), lambda x: (F.length(x) > 2) & ~x.contains(g) & ~g.contains(x) & ~x.rlike(_NO_HEAD))
    other = F.filter(F.array(*(F.lit(x) for x in FALLBACK)), lambda x: ~x.contains(g))
    return F.slice(F.array_distinct(F.concat(F.transform(clean, lambda x: F.concat(F.lit("the "), x)), other)), 1, k)


def difficulty(rate: Column) -> Column:
    return F.when(rate >= 0.75, "easy").when(rate >= 0.25, "medium").otherwise("hard")


def multiplier(accuracy: Column) -> Column:
    """How often rows of a task are to occur: more for a task of low accuracy, between 0.7 and 2."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.7), 2.0 - (accuracy - 0.5) * 3.25))


def replicate(rows: DataFrame, times: Column, key: str, seed: int = 42) -> DataFrame:
    """Each row floor(times) times, once more with the fraction as probability; none at all is possible.  Null is once."""
    t = F.coalesce(times, F.lit(1.0))
    n = (F.floor(t) + (uniform(seed, F.col(key)) < t - F.floor(t)).cast("int")).cast("int")
    return rows.withColumn("__c", F.explode(F.array_repeat(F.lit(1), n))).drop("__c")


def generation_plan(spark, kinds: list[str], languages: list[str], n: int, letters: str = "ABCD") -> DataFrame:
    """n rows over all pairs of kind and language, evenly, with gold letters in turn; the plan is kept in the row."""
    pairs = [(k, x) for k in kinds for x in languages]
    each = n // len(pairs)
    cells = spark.createDataFrame(pairs, "kind string, language string")
    return cells.select("kind", "language", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("i")).withColumn("gold", F.substring(F.lit(letters), F.col("i") % len(letters) + 1, F.lit(1))) if each else cells.limit(0).selectExpr("kind", "language", "0 AS i", "'A' AS gold")


def take_valid(rows: DataFrame, valid: Column, n: int, key: str, seed: int = 42) -> DataFrame:
    """n of the valid rows, from a table that was made larger than needed."""
    return sample(rows.where(valid), n, key, seed)


def pick(values: list[str], seed: int, *parts: Column) -> Column:
    """One of the values by hash."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(seed, *parts) * len(values)) + 1).cast("int"))
