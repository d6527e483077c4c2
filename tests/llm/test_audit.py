"""Filter audit and copies against brute force."""

import itertools
import random
import re
from collections import defaultdict

import pytest
from helpers import EDGES, corpus, words

from marlstone.llm import filter_audit


def masks(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, *_ in rows:
        t, w = t or "", words(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]]
        out.append(sum(f << i for i, f in enumerate(fails)))
    return out


def audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    parts = defaultdict(list)
    for (d, _, s), m in zip(rows, masks(rows), strict=True):
        parts[s or ""].append((m, d in good and d is not None, d in toxic and d is not None))
    out = {}
    for part, docs in parts.items():
        total = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                gone = [r for r in left if r[0] & bit]
                left = [r for r in left if not r[0] & bit]
                fails = [r for r in docs if r[0] & bit]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[0] == bit for r in docs), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def table():
    rng = random.Random(5)
    rows = [(d, t, rng.choice(["a", "b", None, ""])) for d, t in corpus(rng)]
    rows += [(10**6 + i, t, "edge") for i, t in enumerate(EDGES)]
    rows += [(None, "no id", "a"), (None, "", "a"), (3, "no id", "b"), (4, "no id", "b"), (4, "no id", "b"), (4, "other text of the id", "b")]
    rows += [(2 * 10**6 + i, rows[i][1], "copy") for i in range(40)]
    long = "A long text of many words. " * 20_000
    rows += [(5 * 10**6, long + "x", "long"), (5 * 10**6 + 1, long + "y", "long"), (5 * 10**6 + 2, long + "x", "long")]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_copies_also_where_hashes_collide(spark, bits):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.part, r.mask) for r in filter_audit.mark_copies(df, df["source"], bits=bits).collect())
    assert got == sorted((d if d is not None else -1, s or "", m) for (d, _, s), m in zip(rows, masks(rows), strict=True))


def test_audit_of_all_orders(spark):
    rows, rng = table(), random.Random(6)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in rows if rng.random() < 0.6 or d == 4]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, mask int, part string").repartition(3)
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_filters(df, lb).collect()}
    merged = [(d, max((q or 0 for e, q, _ in labels if e == d), default=0), max((t or 0 for e, _, t in labels if e == d), default=0)) for d in {d for d, _, _ in labels}]
    assert got == audit(rows, merged)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit_filters(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
