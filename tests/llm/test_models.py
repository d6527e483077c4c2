"""Learned operators and BM25 against plain versions, and the special rows of every operator."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGES
from pyspark.sql import functions as F

import corpus_pipeline

from marlstone.llm import decontaminate, jaccard_join, language_id, packing, preferences, quality_classifier, quality_rules, substring_dedup, token_count, url_filter
from marlstone.llm.textkernel import chunks


def test_discriminant_matches_plain_gaussians(spark):
    """Scores against log-densities of explicitly shrunk covariances, from explicit inverses and determinants."""
    rng = np.random.default_rng(0)
    d, own, ridge = len(quality_classifier.FEATURES), 0.6, 0.05
    y = (rng.random(300) < 0.4).astype(int)
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + y[:, None] * 0.7
    measured = spark.createDataFrame([(4 * i + 1, r.tolist()) for i, r in enumerate(x)], "doc_id long, f array<double>")
    use = np.array([zlib.crc32(str(4 * i + 1).encode()) % 4 != 2 for i in range(300)])
    labels = spark.createDataFrame([(4 * i + 1, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    got = quality_classifier.fit(measured, labels, own, ridge).score(x)
    z = (x - x[use].mean(0)) / x[use].std(0)
    parts = [z[use & (y == c)] for c in (0, 1)]
    spread = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * s for p, s in zip(parts, spread, strict=True)) / use.sum()
    logs = []
    for p, s in zip(parts, spread, strict=True):
        cov = own * s + (1 - own) * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d)
        far = z - p.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(cov), far) - 0.5 * np.linalg.slogdet(cov)[1])
    ratio = logs[1] - logs[0] + math.log((len(parts[1]) + 1) / (len(parts[0]) + 1))
    assert got == pytest.approx(1 / (1 + np.exp(-np.clip(ratio, -30, 30))), abs=1e-6)


def test_svm_reaches_the_optimum():
    """Dual coordinate descent against Newton's method on the same squared hinge loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)) / 3
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1.0, -1.0)
    w = language_id.svm(x, y, rounds=400)
    z = np.concatenate([x, np.ones((80, 1))], 1)
    cost = 10.0 * 80 / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    v = np.zeros(7)
    for _ in range(50):
        on = y * (z @ v) < 1
        v = np.linalg.solve(np.eye(7) + 2 * (z[on] * cost[on][:, None]).T @ z[on], 2 * (z[on] * cost[on][:, None]).T @ y[on])
    assert w == pytest.approx(v, abs=1e-3)


def test_hierarchy_matches_plain_votes():
    """Predictions from whole feature vectors, family first, then the languages within it."""
    rng = random.Random(3)
    sound = {"en": "thwing", "de": "schung", "fr": "eauxqu", "es": "cionll", "fi": "aakytt"}
    text = lambda v: " ".join("".join(rng.choice(sound[v]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 30)))
    langs = [v for v in sound for _ in range(12)]
    texts = [text(v) for v in langs]

    def vectors(ts):
        out = []
        for chunk in chunks(pa.array(ts)):
            h, bound = language_id.trigrams(chunk)
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                out.append(np.bincount(h[a:b], minlength=language_id.DIM) / max(1, b - a))
        return np.array(out)

    tree = language_id.Tree(langs, vectors(texts).astype("<f4"), language_id.FAMILIES)
    new = [text(rng.choice(list(sound))) for _ in range(60)]
    v = vectors(new)

    def choose(key, names, row):
        if len(names) == 1:
            return names[0]
        p = {(i, j): 1 / (1 + math.exp(-4 * (row @ tree.weights[:, tree.place[key, i, j]] + tree.bias[tree.place[key, i, j]]))) for a, i in enumerate(names) for j in names[a + 1 :]}
        won = Counter()
        for (i, j), q in p.items():
            won[i] += (q >= 0.5) + q * 1e-3
            won[j] += (q < 0.5) + (1 - q) * 1e-3
        return max(names, key=lambda n: won[n])

    want = []
    for row in v:
        family = choose("", tree.families, row)
        want.append(choose(family, tree.within[family], row))
    got = [x for chunk in chunks(pa.array(new)) for x in tree.predict(chunk)[0]]
    assert got == want and set(want) == set(sound)


def test_sample_of_each_language_is_exact(spark, monkeypatch):
    rows = [(i, f"word{i} la le", "fr" if i % 3 else "de") for i in range(900)]
    df = spark.createDataFrame(rows + rows[:5] + [(1, None, "fr"), (2, "x", None)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "Tree", lambda langs, x, families: seen.append(Counter(langs)))
    language_id.fit(df, 40)
    assert seen == [{"fr": 40, "de": 40}]
    many = spark.createDataFrame([(4 * i, "abc", f"l{i}") for i in range(200)], "doc_id long, text string, lang string")
    twice = many.where("doc_id >= 700").withColumn("doc_id", F.col("doc_id") + 1)
    language_id.fit(many.union(twice), languages=30)
    used = {f"l{i}": sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in ((4 * i, 4 * i + 1) if i >= 175 else (4 * i,))) for i in range(200)}
    most = sorted(sorted(n for n in used if used[n]), key=lambda n: -used[n])[:30]
    assert set(seen[-1]) == set(most) and sum(seen[-1].values()) == sum(used[n] for n in most)  # those of most rows, ties by name


def test_bm25_scores():
    """Scores of a shard's index against the formula over plain counts; terms of over half of the parts weigh nothing."""
    rng = random.Random(6)
    docs = [[rng.randrange(60) ** 2 // 60 for _ in range(rng.randrange(1, 40))] for _ in range(50)]
    parts = []
    for i, d in enumerate(docs):
        terms, freq = np.unique(np.array(d, np.uint64), return_counts=True)
        parts.append(packing.Part(i, np.zeros(len(d), np.uint16), terms, freq.astype(np.uint32), len(d)))
    index, n, mean = packing.BM25(parts), len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    for s in range(n):
        want = [0.0] * n
        for t in set(docs[s]):
            idf = math.log(max(1.0, (n - df[t] + 0.5) / (df[t] + 0.5)))
            for j, d in enumerate(docs):
                tf = d.count(t)
                if tf and df[t] > 1:
                    want[j] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert index.scores(s) == pytest.approx(want)


def test_seeds_take_the_nearest_unused_parts():
    """Without cuts, a window is the first unused part and the parts of highest BM25 score, ties by order."""
    rng = random.Random(8)
    parts = []
    for i in range(32):
        terms, freq = np.unique(np.array([rng.randrange(40) for _ in range(25)], np.uint64), return_counts=True)
        parts.append(packing.Part(i, np.zeros(128, np.uint16), terms, freq.astype(np.uint32), 25))
    index, unused, want = packing.BM25(parts), list(range(32)), []
    while unused:
        seed = unused.pop(0)
        score = index.scores(seed)
        near = sorted(unused, key=lambda j: (-score[j], j))[:3]
        unused = [j for j in unused if j not in near]
        want.append([seed, *near])
    windows, left = packing.pack_shard(parts, 512, True)
    assert [[p.doc for p, _, _ in w] for w in windows] == want and not left


CLASH = "doc_id long, text string, lang string, score string, n_words string, sig long, bucket int, payload string, __id long, body string"


@pytest.fixture(scope="module")
def odd(spark):
    """Edge texts, each row twice, with columns named like the operators' own."""
    rows = [(i, t, "en", "k", "k", 1, 1, "k", 1, "k") for i, t in enumerate(EDGES)]
    return spark.createDataFrame(rows * 2, CLASH).repartition(3)


def test_repeated_rows_and_clashing_columns(spark, odd):
    n = len(EDGES)
    labels = spark.createDataFrame([(i, i % 2, "k") for i in range(n)] * 2, "doc_id long, quality int, f string")
    assert quality_classifier.score_quality(odd, labels).count() == 2 * n
    assert token_count.token_counts(odd).count() == quality_rules.judge(odd).count() == language_id.identify(odd).count() == 2 * n
    assert sorted(r.doc_id for r in packing.pack_documents(odd).where("start = 0").collect()) == sorted([*range(n)] * 2)
    assert sorted(r.doc_id for r in jaccard_join.jaccard_join(odd).collect()) == list(range(n))
    assert substring_dedup.repeat_digest(odd).count() == 2 * n and substring_dedup.remove_repeats(odd).columns == odd.columns
    items = spark.createDataFrame([(1, EDGES[2], "k"), (1, EDGES[2], "k")], "item_id long, text string, doc_id string")
    found = decontaminate.contained_items(odd, items)
    assert sorted((r.doc_id, r.item_id, r.n_shared) for r in found.collect()) == [(2, 1, 17), (3, 1, 16)]  # the first words differ
    clean = decontaminate.remove_contaminated(odd, items)
    assert clean.columns == odd.columns and clean.count() == 2 * n - 4
    pages = spark.createDataFrame([(1, "http://a.co.uk/x" * 3000, "h", "k", "k")] * 2 + [(2, "http://10.0.0.1:80/", None, "k", "k"), (3, "http://b.co.uk:8080", "", "k", "k")], "page_id long, url string, html string, host string, salt string")
    assert sorted(r.page_id for r in url_filter.judge_urls(pages).collect()) == [1, 1, 2, 3]
    turns = spark.createDataFrame([(1, 0, "user", "q", "k"), (1, 1, "assistant", "a", "k"), (1, 1, "assistant", "b", "k"), (2, 0, "user", "q", "k")] * 2, "conv_id long, turn long, role string, text string, n_common string")
    got = {r.pair_id: (r.n_common, r.chosen, r.rejected) for r in preferences.format_preferences(*preferences.swapped_answers(turns)).collect()}
    assert got[2] == (2, "", "") and got[1][0] == 2 and got[1][1].count("<|assistant|>") == got[1][2].count("<|assistant|>") == 4


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (quality_classifier.score_quality(none, labels), token_count.token_counts(none), quality_rules.judge(none), language_id.identify(none), packing.pack_documents(none), jaccard_join.jaccard_pairs(none), substring_dedup.remove_repeats(none)):
        assert out.count() == 0


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk:8080", "x.com", "10.0.0.1", "10.0.0.1:80", "localhost", ""]
    suffix, domain = url_filter.suffix_and_domain(url_filter.F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(suffix, domain).collect()]
    assert got == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("com", "x.com"), ("10.0.0.1", "10.0.0.1"), ("10.0.0.1", "10.0.0.1"), ("localhost", "localhost"), ("", "")]


def test_stages_take_odd_rows(spark, sf, odd, tmp_path):
    """Every stage keeps the columns it is given, without n_chars, with clashing names, and of an empty table."""
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns, name
            docs.count()
    long = " ".join(f"w{i}" for i in range(40))
    two = spark.createDataFrame([(1, long, "a", 3), (2, f"{long} more", "b", 4)], "doc_id long, text string, n_removed string, n_chars int")
    out = corpus_pipeline.repeated_passages(spark, two, sf)
    assert out.columns == two.columns and {(r.doc_id, r.text, r.n_removed, r.n_chars) for r in out.collect()} == {(1, long, "a", 3), (2, "more", "b", 4)}
