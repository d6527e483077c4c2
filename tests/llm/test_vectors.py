"""Vector codes against plain loops over whole numbers."""

import hashlib
import math
import random

from marlstone.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in kept:
                own[nearest(cut(v)[p], book)[1]].append(cut(v)[p])
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if o else book[e] for e, o in enumerate(own)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], {}
    for i, v, c in kept:
        best = [nearest(x, b) for x, b in zip(cut(v), books, strict=True)]
        error = sum(d for d, _ in best)
        sums[c] = sums.get(c, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, c))
    return sorted(((i if i is not None else -1), code, error, sums[c], digest) for i, code, error, c in out)


def rows_of(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def vectors(n, seed, width=32):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), [rng.choice([-2.5, -1 / 256, -1 / 1024, 0.0, 0.25, 1 / 3, 7.75]) for _ in range(width)], rng.choice([None, 0, 1, 2])) for _ in range(n)]
    rows += [(1, None, 3), (2, [None] + [0.0] * (width - 1), 0), (3, [float("nan")] * width, 1), (4, [0.0] * (width - 1) + [float("-inf")], 1)]
    return rows + [rows[0]] * 50 + [(None, rows[1][1], 5)]


def test_codes_of_ties_repeats_nulls_and_broken_vectors(spark):
    rows = vectors(300, 1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, n_rows int").repartition(5)
    assert rows_of(vector_codes.compress(df)) == brute(rows)


def test_fewer_vectors_than_entries(spark):
    rows = vectors(9, 2)[:9]
    assert rows_of(vector_codes.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_other_widths_and_huge_components_have_no_code(spark):
    rows = [r for r in vectors(80, 3) if r[0] is not None]
    odd = [(10**7, [1.0] * 5, 9), (10**7 + 1, [3e30] + [0.0] * 31, 9), (10**7 + 2, [], 9)]
    got = rows_of(vector_codes.compress(spark.createDataFrame(rows + odd, SCHEMA)))
    assert [r for r in got if r[1] is not None] == brute(rows)
    assert [(r[0], r[2], r[3]) for r in got if r[1] is None] == [(10**7 + i, None, None) for i in range(3)]


def test_empty_tables_and_tables_without_a_vector(spark):
    df = spark.createDataFrame([(1, None, 1), (None, [float("nan")], None)], SCHEMA)
    assert vector_codes.compress(df).collect() == [] and vector_codes.compress(df.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in vector_codes.compress(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()] == [(1, None, None)]
