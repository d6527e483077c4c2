"""Lexical retrieval packing: a BM25 inverted index per shard gives each seed document its unused neighbours.

Documents are packed where they are read: a task cuts its rows into shards of bounded size, and no text or token is
shuffled.  In a shard the first unused document is a seed.  It fills whole windows by itself; what is left of it opens a
window, and its nearest unused neighbours by BM25 fill that greedily.  The last one is cut where the window ends, and its
rest stays unused.  An open window at the end of a shard is carried into the task's next shard; at the task's end it is
split into sequences whose lengths are powers of two, which need no padding.

Tokens: a text is tokenized word by word with a bounded memory of known word parts; the tokenizer drops white space and
never joins across it, so the ids are those of the whole text.  Each document ends with ``end_id``.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.textkernel import _LOWER, U64, chunks, release, span_hash

SHARD_TOKENS = 1_500_000
SHARD_DOCS = 4096
KNOWN = 1_000_000
BLOCK = 2 << 20
K1, B = 1.2, 0.75
#: ASCII punctuation but the apostrophe, which may begin a contraction.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts through a memory of word parts: pool[start[w]:start[w] + n[w]] are the ids of known part w.

    A word is cut between an ASCII letter and ASCII punctuation, where the tokenizer's own pattern always ends a piece,
    and A-Z are lowered, as the tokenizer does itself; so "Word," and "word" share a part.  Both are left out in blocks
    that hold ``<|``, which may begin a special string.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size()
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(size)], bool)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, U64), np.zeros(0, np.int64)  # hashes in order, and their words' numbers
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word.  Words of letters are one piece of the pattern each, so many of them are encoded as one text
        and told apart by the end-of-piece mark; the others, and any block where that count differs, one by one."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() and w.lower().isalpha()]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join(words[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                for i, piece in zip(group, np.split(ids, ends[:-1]), strict=True):
                    out[i] = piece
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.model.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def _flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and each word's number of ids."""
        got = self._encode(words)
        return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))

    def _add(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        flat, sizes = self._flat([w.decode() for w in words])
        have = len(self.keys)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while have + len(keys) > len(self.start):
            self.start, self.n = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.n))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[have : have + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.n[have : have + len(keys)] = sizes
        self.used += len(flat)
        numbers = np.arange(have, have + len(keys))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, where, keys), np.insert(self.place, where, numbers)
        return numbers

    def __call__(self, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a chunk and their bounds by row; the hashes of its word parts and their bounds by row."""
        if len(self.keys) > KNOWN:
            self.clear()
        data, start, end = chunk.data, chunk.start, chunk.end
        if len(data) > 1 and not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
            low = _LOWER[data]
            letter, mark = (low >= 97) & (low <= 122), _MARK[data]
            cut = np.flatnonzero(letter[:-1] & mark[1:]) + 1
            cut = cut[~np.isin(cut, chunk.offs)]  # the next row begins there
            start, end, data = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut))), low
        bound = np.searchsorted(start, chunk.offs)
        ids, ends, hashes = self.look_up(data, start, end)
        return ids, ends[bound], hashes, bound

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the parts data[start:end] one after the other, where each part's ids begin (and the last ones end), and the parts' hashes."""
        hashes = span_hash(data, start, end)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == keys[old]
        number = np.empty(len(keys), np.int64)
        number[old] = self.place[at[old]]
        if not old.all():
            raw, spans = data.tobytes(), first[~old]
            number[~old] = self._add(keys[~old], [raw[a:b] for a, b in zip(start[spans].tolist(), end[spans].tolist(), strict=True)])
        part = number[back]
        n = self.n[part]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.start[part] - ends[:-1], n)]
        return ids, ends, hashes


class Part:
    """What is not packed yet of a document, with its terms for the index."""

    __slots__ = ("doc", "ids", "at", "terms", "freq", "words")

    def __init__(self, doc, ids, terms, freq, words):
        self.doc, self.ids, self.at, self.terms, self.freq, self.words = doc, ids, 0, terms, freq, words

    @property
    def left(self) -> int:
        return len(self.ids) - self.at


class BM25:
    """Inverted index of a shard's parts.  Terms in more than half of them have no weight in BM25 and are left out."""

    def __init__(self, parts: list[Part]):
        n = len(parts)
        sizes = np.array([len(p.terms) for p in parts], np.int64)
        doc = np.repeat(np.arange(n), sizes)
        terms = np.concatenate([p.terms for p in parts]) if n else np.zeros(0, np.uint64)
        tf = np.concatenate([p.freq for p in parts]).astype(np.float64) if n else np.zeros(0)
        length = np.array([p.words for p in parts], np.float64)
        _, term, df = np.unique(terms, return_inverse=True, return_counts=True)
        idf = np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1.0))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / max(length.mean(), 1e-9))[doc])) if n else tf
        useful = (df[term] > 1) & (idf[term] > 0) if n else np.zeros(0, bool)  # a term of one document finds no other
        doc, term, weight = doc[useful], term[useful], weight[useful]
        order = np.argsort(term, kind="stable")
        self.n, self.doc, self.weight = n, doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.terms, self.of = term, np.searchsorted(doc, np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        lo, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(parts: list[Part], window: int, last: bool) -> tuple[list[list[tuple[Part, int, int]]], list[Part]]:
    """Full windows of (part, start, end), and the parts left over for the next shard; none if this is the last."""
    index, left = BM25(parts), np.array([p.left for p in parts], np.int64)
    windows = []
    for seed, p in enumerate(parts):
        if not left[seed]:
            continue
        while left[seed] >= window:
            windows.append([(p, p.at, p.at + window)])
            p.at += window
            left[seed] -= window
        if not left[seed]:
            continue
        one, space = [(p, p.at, len(p.ids))], window - int(left[seed])
        p.at, left[seed] = len(p.ids), 0
        score = np.where(left > 0, index.scores(seed), -1.0)
        while space and (score := np.where(left > 0, score, -1.0)).max(initial=-1.0) >= 0:
            best = int(score.argmax())
            take = min(space, int(left[best]))
            other = parts[best]
            one.append((other, other.at, other.at + take))
            other.at += take
            left[best] -= take
            space -= take
            score[best] = -1.0 if not left[best] else score[best]
        if space and not last:  # nothing is unused: carry this window on
            for q, a, _ in one:
                q.at = a
            return windows, [q for q, _, _ in one]
        windows.append(one)
    if last and windows and (total := sum(b - a for _, a, b in windows[-1])) < window:
        tail = windows.pop()
        for bit in range(window.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                need, one = 1 << bit, []
                while need:
                    q, a, b = tail.pop(0)
                    c = min(b, a + need)
                    one.append((q, a, c))
                    need -= c - a
                    if c < b:
                        tail.insert(0, (q, c, b))
                windows.append(one)
    return windows, []


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches):
        tokenize = WordTokenizer(path)
        number = TaskContext.get().partitionId() << 40
        parts, tokens = [], 0

        def emit(last: bool):
            nonlocal parts, tokens, number
            windows, parts = pack_shard(parts, window, last)
            tokens = sum(p.left for p in parts)
            rows = []
            for one in windows:
                offset = 0
                for p, a, b in one:
                    ids = p.ids[a:b].astype("<u4")
                    rows.append((p.doc, a, b - a, zlib.crc32(ids.tobytes()), len(p.ids), number, offset, ids))
                    offset += b - a
                number += 1
            cols = list(zip(*rows, strict=True)) or [()] * 8
            out = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array([x.tolist() for x in cols[7]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names + ["ids"] * with_ids)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), BLOCK):
                ids, bound, hashes, words_at = tokenize(chunk)
                for i in range(len(chunk)):
                    own = np.append(ids[bound[i] : bound[i + 1]], np.uint32(end_id))
                    words = np.sort(hashes[words_at[i] : words_at[i + 1]])
                    head = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
                    freq = np.diff(np.append(head, len(words))).astype(np.uint32)
                    parts.append(Part(docs[chunk.first + i], own.astype(np.uint16) if own.max() < 65_536 else own, words[head], freq, len(words)))
                    tokens += len(own)
                    if tokens >= SHARD_TOKENS or len(parts) >= SHARD_DOCS:
                        yield from emit(False)
        yield from emit(True)
        del tokenize, parts
        release()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most window tokens; window is a power of two.

    docs: doc_id, text; other columns are ignored.  Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with with_ids the piece's ids.  Null and empty texts are the end id alone.  Each row is packed, repeated
    rows and rows without an id included; an empty table gives no rows.  A sequence id holds the task and a count.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(path or tokenizer_path(), window, end_id, with_ids), _PIECES + (", ids array<int>" if with_ids else ""))
