import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGES, components, contained, corpus, kept_words, shingles, words

from marlstone.llm import decontaminate, jaccard_join, substring_dedup
from marlstone.llm.cluster import components as spark_components
from marlstone.llm.fm_index import FMIndex, WaveletMatrix
from marlstone.llm.textkernel import chunks, span_hash

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return corpus(rng) + [(10_000 + i, t) for i, t in enumerate(EDGES)]


def test_near_copies_beyond_a_group_of_signatures(spark):
    """More near copies than a group may have members, so the large-group path decides."""
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(80))
    rows = [(i, base.replace(base.split()[rng.randrange(80)], f"x{i}", 1)) for i in range(150)]
    rows += [(1000 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for i in range(20)]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert substring_dedup.repeat_digest(empty).count() == 0
    assert decontaminate.contained_items(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b", 2, "k"), (2, "a b", 3, "k")], "doc_id long, text string, component_id long, n_removed string")
    assert {tuple(r) for r in jaccard_join.jaccard_join(odd).collect()} == {(1, 1, 1, 1, 1), (2, 1, 1, 1, 1)}
    assert substring_dedup.remove_repeats(odd).columns == odd.columns


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_links_match_brute_force(spark, rows, block_rows):
    """Every link of a document is counted, and each pair of different texts is given once."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    s = {d: shingles(t) for d, t in rows}
    first = {}
    for d, t in sorted(rows):
        first.setdefault(t or "", d)
    near = {(a, b): len(s[a] & s[b]) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    n = dict.fromkeys(s, 0)
    for pair in near:
        for d in pair:
            n[d] += 1
    comp = components(rows)
    got = {tuple(r) for r in jaccard_join.jaccard_join(df, block_rows=block_rows).collect()}
    assert got == {(d, *comp[d], first[t or ""], n[d]) for d, t in rows} and max(n.values()) >= 69
    pairs = [tuple(r) for r in jaccard_join.jaccard_pairs(df, block_rows=block_rows).collect()]
    assert sorted(pairs) == sorted((a, b, o) for (a, b), o in near.items() if {a, b} <= set(first.values()))


def test_repeated_ids(spark):
    """A repeated row counts once; of two texts of one id the one with the least MD5 is the document."""
    a, b = "one two three four five six", "seven eight nine ten eleven"
    least = min((a, b), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    rows = [(1, a), (1, b), (2, a), (2, a), (3, b), (4, a)]
    got = {tuple(r) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    at, bt = (1, 3) if least == a else (2, 1)
    assert got == {(1, len(shingles(least)), 1, 1, 2 if least == a else 1), (2, 2, at, at, 2 if least == a else 1), (3, 1, bt, bt, 1 - (least == a)), (4, 2, at, at, 2 if least == a else 1)}


@pytest.mark.parametrize("cells", [1 << 21, 64])
@pytest.mark.parametrize("vocab", [150, 100_000])
def test_near_pairs(vocab, cells, monkeypatch):
    """Sparse and dense columns, in one block and in many."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(vocab)
    base = rng.integers(0, vocab, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.05, rng.integers(0, vocab, 60), base if i % 3 else rng.integers(0, vocab, 60))).astype(np.uint64) for i in range(90)] + [np.zeros(0, np.uint64)]
    side = np.arange(91) % 2
    want = {(i, j): o for i in range(91) for j in range(i) if len(sets[i]) and 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - o)}
    for s in (None, side):
        got = [(max(p, j), min(p, j), o) for p, js, os in jaccard_join.near_pairs(sets, 80, s) for j, o in zip(js.tolist(), os.tolist(), strict=True)]
        assert sorted(got) == sorted((i, j, o) for (i, j), o in want.items() if s is None or s[i] != s[j]) and got


@pytest.mark.parametrize("sizes", [(4, 5), (5, 5), (100, 125), (100, 126), (80, 100)])
def test_threshold_is_inclusive(spark, sizes):
    """A subset of 4 in 5 shingles is linked, one less is not."""
    a, b = ([f"t{i}" for i in range(k + 4)] for k in sizes)
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows)


def test_signatures_guarantee(spark):
    """Linked sets share as many signatures as either needs."""
    rng = np.random.default_rng(3)
    sign = jaccard_join.Signer(80)
    for n in (1, 2, 3, 4, 5, 7, 12, 40, 300, 2000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            swap = int(rng.integers(0, n // 9 + 1))
            y = np.unique(np.concatenate([x[swap:], rng.integers(0, 2**63, swap).astype(np.uint64)]))
            o = len(np.intersect1d(x, y))
            if 100 * o >= 80 * (len(x) + len(y) - o):
                (a, na), (b, nb) = sign(x), sign(y)
                assert len(np.intersect1d(a, b)) >= max(na, nb)


def test_spark_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.node: r.component for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("shard_words", [200_000, 1000, 40])
def test_repeats_match_brute_force(spark, rows, shard_words):
    """The least shard sends most keys to the windows' path."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeat_digest(df, shard_words=shard_words).collect()}
    want = {d: (len(words(dict(rows)[d])), len(words(dict(rows)[d])) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, k in kept_words(rows).items()}
    assert got == want


@pytest.mark.parametrize("limit", [10**6, 30])
def test_shard_of_several_indexes(limit):
    rng = random.Random(4)
    base = [b"w%d" % rng.randrange(40) for _ in range(30)]
    texts = [[b"w%d" % rng.randrange(40) for _ in range(rng.randrange(8))] + base[rng.randrange(10) : rng.randrange(20, 30)] for _ in range(60)]
    docs = np.array([rng.randrange(30) for _ in texts], np.int64)
    width = 5
    least = {}
    for d, t in zip(docs.tolist(), texts, strict=True):
        for i in range(len(t) - width + 1):
            least[tuple(t[i : i + width])] = min(d, least.get(tuple(t[i : i + width]), d))
    want = sorted((d, k, i) for k, (d, t) in enumerate(zip(docs.tolist(), texts, strict=True)) for i in range(len(t) - width + 1) if least[tuple(t[i : i + width])] < d)
    got = substring_dedup.shard_search(docs, np.arange(60), np.zeros(60, np.int64), np.full(60, 3), [b" ".join(t) for t in texts], width, limit)
    assert sorted((d, k, i) for d, k, a, n in zip(*(x.tolist() for x in got), strict=True) for i in range(a, a + n)) == want and want


@pytest.mark.parametrize("shard_words", [200_000, 40])
def test_rows_of_one_id(spark, shard_words):
    """Rows with equal ids are not compared, and each text loses only what it shares with smaller ids."""
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:30])), (2, " ".join(w[:20])), (2, " ".join(["x"] * 3 + w[5:25])), (2, " ".join(w[30:])), (2, " ".join(w[30:])), (3, " ".join(w[40:]))]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA + ", n_removed int, id string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.repeat_digest(df, shard_words=shard_words).collect())
    assert got == [(1, 30, 0), (2, 20, 20), (2, 23, 20), (2, 30, 0), (2, 30, 0), (3, 20, 20)]
    kept = substring_dedup.remove_repeats(df, shard_words=shard_words, count="gone")
    assert kept.columns == [*df.columns, "gone"] and {(r.n_removed, r.id) for r in kept.collect()} == {(0, "k")}
    assert sorted(r.text for r in kept.where("gone > 0").collect()) == ["", "", "x x x"]
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df, count="n_removed")


def test_texts_without_repeats_stay_as_they_are(spark):
    long = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"  {long}\n"), (2, f"x\n{long} y"), (3, None), (None, long)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.remove_repeats(df, count="n_removed").collect()}
    assert got == {1: (f"  {long}\n", 0), 2: ("x y", 20), 3: (None, 0), None: (long, 0)}


def test_wavelet_rank_and_access():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 37, 500)
    w = WaveletMatrix(seq, 37)
    symbols, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert w.rank(symbols, at).tolist() == [int((seq[:i] == c).sum()) for c, i in zip(symbols, at, strict=True)]
    symbol, seen = w.access(np.arange(500))
    assert symbol.tolist() == seq.tolist() and seen.tolist() == [int((seq[:i] == c).sum()) for i, c in enumerate(seq)]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13])
def test_matching_statistics(width):
    """Lengths, intervals and least owners for sequences in and out of the index, unknown words included."""
    rng = random.Random(width)
    sample = lambda k, v: [b"%d" % rng.randrange(v) for _ in range(k)]
    pieces = [sample(rng.randrange(0, 25), 3) for _ in range(40)]
    base = sample(22, 5)
    pieces += [base[rng.randrange(5) :] for _ in range(5)]
    owners = np.array([rng.randrange(10) for _ in pieces])
    index = FMIndex(pieces, owners, width)
    queries = [sample(rng.randrange(0, 25), 4) for _ in range(30)] + pieces[::3] + [base + sample(2, 3)]
    occ = {}
    for p, o in zip(pieces, owners.tolist(), strict=True):
        for k in range(1, width + 1):
            for i in range(len(p) - k + 1):
                occ.setdefault(tuple(p[i : i + k]), []).append(o)
    query, place, length, low, high = index.matching_statistics([index.encode(q) for q in queries])
    assert len(query) == sum(map(len, queries))
    for q, i, n, a, b in zip(query.tolist(), place.tolist(), length.tolist(), low.tolist(), high.tolist(), strict=True):
        rest = queries[q][i:]
        assert n == next((k for k in range(min(width, len(rest)), 0, -1) if tuple(rest[:k]) in occ), 0) and (not n or b - a == len(occ[tuple(rest[:n])]))
    full = length == width
    want = [min(occ[tuple(queries[q][i : i + width])]) for q, i in zip(query[full].tolist(), place[full].tolist(), strict=True)]
    assert index.least_owner(low[full], high[full]).tolist() == want and want


def test_word_hashes_tell_plain_words_apart():
    """The Thue-Morse word and its complement, over which polynomial hashes modulo a power of two agree, and all short spans."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    chunk = next(chunks(pa.array([t, t.translate(str.maketrans("ab", "ba"))])))
    assert len(set(chunk.word_hashes().tolist())) == 2
    data = np.frombuffer(t[:400].encode(), np.uint8)
    spans = [(a, a + k) for k in (0, 1, 7, 8, 9, 63, 64, 65, 130) for a in range(200)]
    got = span_hash(data, *map(np.array, zip(*spans, strict=True))).tolist()
    names = {}
    assert all(names.setdefault(data[a:b].tobytes(), h) == h for (a, b), h in zip(spans, got, strict=True)) and len(set(names.values())) == len(names)


def test_contained_items_match_brute_force(spark, rows):
    rng = random.Random(9)
    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = []
    for i in range(30):
        w = rng.choice(texts).split()
        a = rng.randrange(len(w) - 30)
        items.append((i, " ".join(w[a : a + rng.randrange(5, 30)]).upper() if i % 5 == 0 else " ".join(w[a : a + 30])))
    items += [(50, "a b"), (51, "never seen"), (52, ""), (53, None), (54, "日本語")]
    got = decontaminate.contained_items(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in got.collect()} == contained(rows, items)
    clean = decontaminate.remove_contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in contained(rows, items)}


def test_large_benchmark(spark, rows):
    items = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows[:40])], "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in decontaminate.contained_items(docs, items).collect()}
    assert {tuple(r) for r in decontaminate.contained_items(docs, items, block_bytes=0).collect()} == whole and whole
