"""Sum-of-squares packing: exact ids, whole placements, few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGES

from marlstone.llm import bin_packing
from marlstone.llm.packing import tokenizer_path
from marlstone.llm.textkernel import chunks

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_tokenizer_equals_the_library(model):
    rng = random.Random(1)
    some = ["a", "B", "'s", "'", "’", " ", "  ", "\n", "\t", " \n", " ", " ", "　", " ", " ", " ", " ", "é", "日本", ".", ",", "#", "12", "\r\n", "\x0b", "\x1c", "\x85", "<|endoftext|>", "<|", "don't", "́", "😀", "​"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(0, 30))) for _ in range(4000)] + [t or "" for t in EDGES]
    tokenize, got = bin_packing.ByteTokenizer(tokenizer_path("byte_bpe_50k.json")), []
    for chunk in chunks(pa.array(texts), 1 << 14):
        ids, bound = tokenize(chunk)
        got += [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:], strict=True)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts, model, window, end_id=0):
    """Every id of every row in one piece, and every sequence gapless and within the window."""
    want = defaultdict(list)
    for d, t in texts:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, end_id]
        short = len(ids) % window or min(window, len(ids))
        cuts = [0, *range(short, len(ids) + 1, window)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[d].append((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seq[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(p) for d, p in got.items()} == {d: sorted(p) for d, p in want.items()}
    for s in seq.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= window
    return len(seq)


def test_packs_all_documents_close_to_the_bound(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(EDGES)], SCHEMA))
    texts = [tuple(r) for r in docs.collect()]
    rows = bin_packing.pack_best(docs).collect()
    n = check(rows, texts, model, 2048)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1


def test_many_shards_levels_and_repeated_rows(spark, model):
    rng = random.Random(2)
    texts = [(rng.choice([None, *range(300)]), " ".join("w" for _ in range(rng.randrange(0, 90)))) for _ in range(3000)]
    texts += [(7, "w " * 4000)] + [(8, "same text")] * 900
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, number int, length string")
    rows = bin_packing.pack_best(docs, window=64, shard=100, with_ids=True).collect()
    n = check(rows, texts, model, 64)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 64) and {r.sequence_id >> bin_packing.LEVEL + 1 for r in rows} >= {0, 1}
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert bin_packing.pack_best(docs.limit(0)).collect() == []


def test_rule_takes_the_least_sum_of_squares():
    rng = random.Random(3)
    rule, gaps = bin_packing.SumOfSquares(20), []
    for _ in range(400):
        n = rng.randrange(1, 21)

        def after(g, n=n):
            left = [*gaps, 20] if g == 20 else list(gaps)
            left.remove(g)
            left += [g - n] * (g > n)
            return sum(left.count(x) ** 2 for x in set(left))

        least = min(after(g) for g in {*gaps, 20} if g >= n)
        at, offset = rule.place(n)
        g = 20 - offset
        assert after(g) == least
        if g != 20:
            gaps.remove(g)
        gaps += [g - n] * (g > n)


def test_pieces_of_which_no_two_fit_together(spark):
    pieces = spark.range(2000).selectExpr("id AS number", "40L AS length")
    assert bin_packing.place(pieces, window=64, shard=64).select("sequence_id").distinct().count() == 2000
