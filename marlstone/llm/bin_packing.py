"""Best-fit packing by the sum-of-squares rule: each piece goes where the squared counts of open sequences per gap become least.

The rule (Csirik et al., 2006) keeps N(g), the number of open sequences with a residual gap of g tokens, and places a piece
so that the sum of N(g)^2 is smallest; so no gap piles up that few pieces fit.  Only lengths matter to it:

1. Tasks tokenize the documents where they are read and cut them into pieces.  A document of at most ``window`` tokens is
   one piece; of a longer one all pieces but the first are full, and full pieces are sequences of their own.
2. The other pieces are dealt evenly to shards of about ``SHARD`` pieces, by their numbers and not by their texts.  A shard
   places its pieces from the longest to the shortest by the rule; sequences that are full are done.
3. The pieces of sequences that stay open, a tenth or less where lengths vary, are dealt again, to fewer shards, level
   after level.  Where one shard holds them all, or where a level didn't halve them since nothing fits together, they
   are placed for good: the rule is the same, but a sequence is opened only where no open one has room.

A level's rows are two numbers a piece; texts and ids are never shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import cut
from marlstone.llm.packing import BLOCK, KNOWN, WordTokenizer, _MARK, tokenizer_path
from marlstone.llm.textkernel import _SPACE, chunks, release

SHARD = 8192
LEVEL, PLACE = 56, 20  # bits of a sequence id below its level, and below its shard


class ByteTokenizer(WordTokenizer):
    """Ids of whole texts by a byte-level BPE through a memory of segments, which tile a text.

    A segment begins where the pre-tokenizer's pattern always begins a piece: at a run of white space after another
    symbol, at the last symbol of a longer run that a word follows, at a word after white space that is no blank, and at
    ASCII punctuation (but the apostrophe) after an ASCII letter.  Texts with other white space than ASCII's, or with
    ``<|``, which may begin a special string, are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.begins = np.array([(self.model.id_to_token(i) or "").startswith("Ġ") for i in range(self.model.get_vocab_size())], bool)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segments of a blank and a word are encoded together, and told apart by the ids that begin with a blank."""
        plain = [i for i, w in enumerate(words) if w[0] == " " and len(w) > 1 and not w[1].isspace()]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        got, alone = [], set(range(len(words))).difference(plain)
        for group, ids in zip(groups, self._encode(["".join(words[i] for i in g) for g in groups]), strict=True):
            begins = np.flatnonzero(self.begins[ids])
            if len(begins) == len(group):
                got.append((np.array(group), ids, np.diff(np.append(begins, len(ids)))))
            else:
                alone.update(group)
        alone = sorted(alone)
        ids = self._encode([words[i] for i in alone])
        got.append((np.array(alone, np.int64), np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)))
        at, flat, sizes = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(at)
        ends = np.cumsum(sizes)
        first, sizes = (ends - sizes)[order], sizes[order]
        return flat[np.arange(len(flat)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)], sizes

    def __call__(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and their bounds by row."""
        if len(self.keys) > KNOWN:
            self.clear()
        d, offs = chunk.data, chunk.offs
        if not len(d):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        white = _SPACE[d]
        low = d | 0x20
        begin = np.zeros(len(d) + 1, bool)
        before, after = np.zeros(len(d), bool), np.ones(len(d), bool)  # white space on the left, and on the right or a row's end
        before[1:], after[:-1] = white[:-1], white[1:]
        ends = offs[1:][offs[1:] > 0] - 1
        after[ends] = True
        begin[:-1] = white & (~before | ~after)
        begin[1:-1] |= ~white[1:] & white[:-1] & (d[:-1] != 0x20) | _MARK[d[1:]] & (low[:-1] >= 97) & (low[:-1] <= 122)
        begin[offs] = True
        start = np.flatnonzero(begin[:-1])
        ids, at, _ = self.look_up(d, start, np.append(start[1:], len(d)))
        bound = at[np.searchsorted(start, offs)]
        odd = np.unique(np.searchsorted(offs, _odd(d), side="right") - 1)
        if len(odd):
            rows = np.split(ids, bound[1:-1])
            for i in odd.tolist():
                rows[i] = np.array(self.model.encode(chunk.text(i).decode(), add_special_tokens=False).ids, np.uint32)
            ids, bound = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        return ids, bound


def _odd(d: np.ndarray) -> np.ndarray:
    """Places in a UTF-8 text with white space beyond ASCII's, with separators of ASCII, or with ``<|``."""
    a, b, c = (np.concatenate((d[k:], np.zeros(k, np.uint8))) for k in range(3))
    wide = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return np.flatnonzero((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | wide | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a >= 0x1C) & (a <= 0x1F) | (a == 0x3C) & (b == 0x7C))


_kept: dict = {}
_PIECES = "number long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_up(path: str, window: int, end_id: int, with_ids: bool):
    """(doc_id, text) to numbered pieces."""

    def run(batches):
        tokenize = _kept.setdefault(path, None) or ByteTokenizer(path)
        _kept[path] = tokenize  # a later task of this worker knows its segments already
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs = batch.column(0)
            for chunk in chunks(batch.column(1), BLOCK):
                ids, bound = tokenize(chunk)
                ids = np.insert(ids, bound[1:], end_id).astype("<u4")  # after each row's ids
                first = bound + np.arange(len(bound))  # where each row begins
                size = np.diff(first)
                count = -(-size // window)
                row = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = (size - (count - 1) * window)[row]  # the length of a row's first piece
                start = np.where(piece == 0, 0, short + (piece - 1) * window)
                length = np.where(piece == 0, short, window)
                raw = memoryview(ids.tobytes())
                at = ((first[:-1][row] + start) * 4).tolist()
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at, length.tolist(), strict=True)]
                cols = [pa.array(number + np.arange(len(row))), docs.take(pa.array(chunk.first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["number", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)
                number += len(row)
        release()

    return run


class SumOfSquares:
    """Sequences of at most window tokens, filled piece by piece; gaps[g]: the open ones with room for g more."""

    def __init__(self, window: int):
        self.window = window
        self.twice = np.zeros(window + 1, np.int64)  # 2 N(g); a full sequence isn't counted, which -1 stands for
        self.twice[0] = -1
        self.gaps: list[list[int]] = [[] for _ in range(window + 1)]
        self.fill: list[int] = []

    def place(self, n: int, any_fit: bool = False) -> tuple[int, int]:
        """The sequence and offset of a piece of n tokens.  Ties go to the least gap, and to an open sequence.

        any_fit: a sequence is opened only if no open one has room.
        """
        w, m = self.window, self.twice
        gap = w
        if n < w:
            change = np.where(m[n:w] > 0, m[: w - n] - m[n:w] + 2, 1 << 60)
            k = int(change.argmin())
            if change[k] <= (1 << 59 if any_fit else m[w - n] + 1):
                gap = n + k
        if gap == w:
            at = len(self.fill)
            self.fill.append(0)
        else:
            at = self.gaps[gap].pop()
            m[gap] -= 2
        if gap > n:
            self.gaps[gap - n].append(at)
            m[gap - n] += 2
        self.fill[at] += n
        return at, self.fill[at] - n


def _place(window: int, level: int, last: bool):
    """(shard, number, length), by shard and from long to short, to (number, length, sequence_id, offset, open)."""

    def close(shard: int, numbers: np.ndarray, lengths: np.ndarray):
        rule = SumOfSquares(window)
        got = np.array([rule.place(n, last) for n in lengths.tolist()], np.int64).reshape(-1, 2)
        is_open = np.zeros(len(numbers), bool) if last else np.array(rule.fill)[got[:, 0]] < window
        seq = ((level << LEVEL) + (shard << PLACE) + got[:, 0]) * 2
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(lengths), pa.array(seq), pa.array(got[:, 1]), pa.array(is_open)], names=["number", "length", "sequence_id", "offset", "open"])

    def run(batches):
        held, shard = [], None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            edges = np.concatenate(([0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1, [rows.shape[1]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if rows[0, a] != shard and held:
                    yield close(shard, *np.concatenate(held, axis=1))
                    held = []
                shard = int(rows[0, a])
                held.append(rows[1:, a:b])
        if held:
            yield close(shard, *np.concatenate(held, axis=1))

    return run


def place(pieces: DataFrame, window: int = 2048, shard: int = SHARD) -> DataFrame:
    """pieces: number (distinct), length (1 to window - 1).  number, sequence_id, offset of each."""
    done, level, n = None, 0, pieces.count()
    while True:
        shards = max(1, -(-n // shard))
        last = shards == 1 or level > 0 and 2 * n > before  # noqa: F821
        dealt = pieces.select(F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard"), "number", "length")
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "number")
        placed = cut(dealt.mapInArrow(_place(window, level, last), "number long, length long, sequence_id long, offset long, open boolean"))
        closed = placed.where("NOT open").select("number", "sequence_id", "offset")
        done = closed if done is None else done.union(closed)
        if last:
            return done
        pieces, level, before = placed.where("open").select("number", "length"), level + 1, n
        n = pieces.count()


def pack_best(docs: DataFrame, path: str | None = None, window: int = 2048, end_id: int = 0, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """Pieces of documents in as few sequences of at most window tokens as the sum-of-squares rule finds.

    docs: doc_id, text; other columns are ignored, whatever their names.  Returns doc_id, piece (from 0), start, length,
    ids_crc32, sequence_id, offset, and with with_ids the piece's ids.  A document is its ids and end_id; null and empty
    texts are the end id alone.  Only documents of more than window tokens are cut; then all pieces but the first are
    full.  Each row is packed: repeated rows, rows of one id and rows without an id are documents of their own.  A text of
    any length is taken whole; an empty table gives no rows.  Equal lengths go by the order of reading.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(docs.mapInArrow(_cut_up(path or tokenizer_path("byte_bpe_50k.json"), window, end_id, with_ids), _PIECES + (", ids array<int>" if with_ids else "")))
    full = pieces.where(F.col("length") == window).withColumns({"sequence_id": 2 * F.col("number") + 1, "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < window)
    out = full.unionByName(short.join(place(short.select("number", "length"), window, shard), "number"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
