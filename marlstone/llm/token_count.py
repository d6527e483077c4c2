"""Token counts: each distinct pre-token is counted once, and documents sum the counts of their pre-tokens.

The piece model never merges across the start of a run of word marks, since no piece holds a mark after another symbol
(checked when the model is loaded).  So a text is cut there into pre-tokens, their counts add up exactly, and no
document's ids are ever made.

1. A task cuts its rows into blocks of about ``BLOCK`` bytes.  A block's distinct pre-tokens go to buckets by hash range,
   each once however often the block holds it; the block's frequencies (document, pre-token, how often) are packed.
2. A bucket counts each pre-token once, told apart by its bytes, and answers every block's list with its counts.
3. Answers and frequencies of a block are joined and summed per document.

A pre-token that is in every document reaches its bucket once per block, so buckets are even however skewed the words are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import bucket_of, buckets_for
from marlstone.llm.textkernel import Chunk, chunks, span_hash

BLOCK = 2 << 20
FREQUENCIES = -1
_MARK = "▁".encode()
_loaded: dict[str, tuple] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str) -> tuple:
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(model.get_piece_size()):
            if "▁" in model.id_to_piece(i).lstrip("▁"):
                raise ValueError("a piece holds a word mark after another symbol; counts of pre-tokens would not add up")
        alone = 1 if model.piece_to_id("▁") != model.unk_id() else len(_MARK)  # a mark that nothing follows
        _loaded[path] = model, alone
    return _loaded[path]


def pre_tokens(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and byte span of each pre-token, without the one mark that it begins with (for a row's first: the prefix)."""
    d, offs = chunk.data, chunk.offs
    mark = d == 0x20
    for at in np.flatnonzero(d[:-2] == _MARK[0]) if len(d) > 2 else ():
        if d[at + 1] == _MARK[1] and d[at + 2] == _MARK[2]:
            mark[at] = True
    after = np.zeros(len(d), bool)  # the symbol before is a mark
    after[1:] = d[:-1] == 0x20
    wide = np.flatnonzero(mark & (d != 0x20))
    after[wide[wide + 3 < len(d)] + 3] = True
    heads = offs[:-1][offs[:-1] < offs[1:]]
    start = mark & ~after
    start[heads] = True
    a = np.flatnonzero(start)
    b = np.append(a[1:], len(d))
    first = np.zeros(len(d), bool)
    first[heads] = True
    # the prefix stands for the mark of a row's first pre-token, so that keeps all its own symbols
    skip = np.where(first[a], 0, np.where(d[a] == 0x20, 1, 3))
    row = np.searchsorted(offs, a, side="right") - 1
    return row, a + skip, b


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of 0 or more, each in as few bytes as its largest needs; int64 arrays as they are."""
    arrays = [x if x.dtype == np.int64 else _narrow(x) for x in arrays]
    head = np.array([len(arrays), *(v for x in arrays for v in (len(x), x.dtype.itemsize * (-1 if x.dtype == np.int64 else 1)))], "<i8")
    return head.tobytes() + b"".join(x.tobytes() for x in arrays)


def unpack(b: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(b, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(b, "<i8", 2 * k, 8).tolist(), 8 + 16 * k, []
    for n, wide in zip(sizes[::2], sizes[1::2], strict=True):
        out.append(np.frombuffer(b, "<i8" if wide < 0 else f"<u{wide}", n, at))
        at += n * abs(wide)
    return out


_PACKED = "bucket int, block long, part int, payload binary"


def _block(chunk: Chunk, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes], bytes]:
    """The parts of a chunk's distinct pre-tokens by hash order, each part's tokens, and the packed frequencies."""
    row, a, b = pre_tokens(chunk)
    keys, first, back = np.unique(span_hash(chunk.data, a, b), return_index=True, return_inverse=True)
    pairs, often = np.unique(row * max(1, len(keys)) + back, return_counts=True)
    distinct = np.bincount(pairs // max(1, len(keys)), minlength=len(chunk))
    step = pairs % max(1, len(keys))  # a document's pre-tokens in order, as distances; low and high bytes apart, for the shuffle's compression
    step[1:] -= np.where(np.repeat(np.arange(len(chunk)), distinct)[1:] == np.repeat(np.arange(len(chunk)), distinct)[:-1], step[:-1], 0)
    frequencies = pack(*(x.astype(kind) for x, kind in ((ids, np.int64), (np.diff(chunk.offs), np.uint64), (distinct, np.uint64), (step & 255, np.uint64), (step >> 8, np.uint64), (often, np.uint64), (np.array([len(keys)]), np.uint64))))
    where = bucket_of(keys, buckets)
    cuts = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    lo, hi, raw, asked = a[first], b[first], chunk.data.tobytes(), []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        body = b"".join(raw[p:q] for p, q in zip(lo[x:y].tolist(), hi[x:y].tolist(), strict=True))
        asked.append(pack((hi[x:y] - lo[x:y]).astype(np.uint64)) + body)
    return where[cuts[:-1]], asked, frequencies


def _blocks(buckets: int, block: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(0), block):
                mine = slice(chunk.first, chunk.first + len(chunk))
                where, asked, frequencies = _block(chunk, ids[mine], buckets)
                frequencies = pack(null[mine].astype(np.uint8)) + frequencies
                bucket = np.append(where, number % buckets if buckets > 1 else 0).astype(np.int32)
                part = np.append(where, FREQUENCIES).astype(np.int32)
                cols = [pa.array(bucket), pa.array(np.full(len(part), number)), pa.array(part), pa.array([*asked, frequencies], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "part", "payload"])
                number += 1

    return run


def _count(path: str):
    """A bucket's lists of pre-tokens to their counts; frequencies pass through."""

    def run(batches):
        model, alone = _load(path)
        known: dict[bytes, int] = {b"": alone}
        for batch in batches:
            lists, part, payload = [], batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, b in enumerate(payload):
                if part[i] != FREQUENCIES:
                    size = unpack(b)[0].astype(np.int64)
                    body = b[len(b) - int(size.sum()) :]
                    ends = np.cumsum(size)
                    lists.append((i, [body[x:y] for x, y in zip((ends - size).tolist(), ends.tolist(), strict=True)]))
            new = list({t: None for _, tokens in lists for t in tokens if t not in known})
            known.update(zip(new, map(len, model.encode([t.decode() for t in new], num_threads=1)), strict=True))
            for i, tokens in lists:
                payload[i] = pack(np.array([known[t] for t in tokens], np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(payload, pa.binary())], names=["block", "part", "payload"])

    return run


def _sum(limit: int):
    """Rows sorted by block and part to one row for each document."""

    def close(payload: list[bytes]) -> pa.RecordBatch:
        null = unpack(payload[0])[0]
        ids, size, distinct, low, high, often, k = unpack(payload[0][len(pack(null)) :])
        distinct, token = distinct.astype(np.int64), np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8))
        token -= np.repeat(np.concatenate(([0], token))[np.cumsum(distinct) - distinct], distinct)
        counts = np.concatenate([unpack(b)[0].astype(np.int64) for b in payload[1:]]) if len(payload) > 1 else np.zeros(0, np.int64)
        if len(counts) != int(k[0]):
            raise RuntimeError("counts are missing: the rows of docs must come in the same order when a lost task runs again")
        row = np.repeat(np.arange(len(ids)), distinct)
        n = np.bincount(row, counts[token] * often.astype(np.float64), len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(size.astype(np.int64)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def run(batches):
        block, held = None, []
        for batch in batches:
            for own, part, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != block and held:
                    yield close(held)
                    held = []
                block = own
                held.append(b)
                if (part == FREQUENCIES) != (len(held) == 1):
                    raise RuntimeError("frequencies are missing: the rows of docs must come in the same order when a lost task runs again")
        if held:
            yield close(held)

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, repeated and null ids included.

    docs: doc_id, text, from a scan or a checkpoint, whose rows come in one order; other columns are ignored.  Null text
    counts as empty: no bytes and no tokens.  Neither begin, end nor added special tokens are counted.  An empty table
    gives no rows.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    buckets = buckets_for(docs)
    asked = docs.mapInArrow(_blocks(buckets, block), _PACKED).repartition(buckets, "bucket")
    answered = asked.mapInArrow(_count(path or model_path()), "block long, part int, payload binary")
    whole = answered.repartition(buckets, "block").sortWithinPartitions("block", "part")
    return whole.mapInArrow(_sum(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
