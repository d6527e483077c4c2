"""Removal of word windows that also stand in a document with a smaller id, by FM-indexes over shards of the corpus.

1. Each text is cut into maximal runs of windows that share a minimizer, the least hash of the short word grams inside a
   window.  Equal windows have equal minimizers, so whatever repeats meets under one key; packed hashes are shuffled.
   Of very many equal texts in one task some take part, and any with a smaller id; a later one repeats these as a whole.
2. Keys that occur in one document only hold nothing that repeats.  For the others the runs' words are fetched: those of
   all but the largest document are to be indexed, those of all but the smallest are to be streamed.  Keys of the same
   smallest and largest document go to one shard, so that neighbouring runs travel as one piece; keys of many documents
   are dealt over several.
3. A shard holds a compressed FM-index of the distinct pieces to be indexed.  The documents' pieces are streamed against
   it: backward search over the wavelet matrix gives the matching statistics, and each interval of at least ``width``
   words with an occurrence in a smaller document is reported.
4. A key with more runs than a shard holds (a passage that very many documents share) is settled by window instead: a
   grouped minimum over digests of the windows' words, which is pre-aggregated and whose join can be split.

Every word of every text takes part.  Hashes only choose where runs meet; what is reported was matched word by word as
bytes in the index, or has the same 128-bit digest of its text under 1 or of its words under 4.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.cluster import bucket_of, buckets_for, cut
from marlstone.llm.fm_index import FMIndex
from marlstone.llm.textkernel import Chunk, U64, chunks, gram_hashes, mix, release

GRAM = 5
_KEY = U64(0x5851F42D4C957F2D)
FLUSH = 400_000
SHARD_WORDS = 200_000
TOGETHER = 64  # so many documents' runs of a key at most go where other keys of the same documents go
SEGMENT = 64  # windows in a piece at most
_PACKED = "bucket int, payload binary, doc long, tag long, n int"
_ASKED = "kind int, doc long, start int, n int, role int, route long"
ASKED, HOT, COPY = 0, 1, 2
_PIECES = "doc long, tag long, start int, role int, route long, words binary"
_WINDOWS = "doc long, tag long, starts array<int>, digest binary"
_FOUND = "doc long, tag long, starts array<int>, n int"
INDEXED, STREAMED = 1, 2
COPIES = 8  # of one text in a task that take part in the search in any case


def runs(chunk: Chunk, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one minimizer: row, first word in the row, windows, key."""
    words = chunk.word_hashes()
    count = len(words) - width + 1
    if count <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    row = chunk.row_of_word()
    valid = row[:count] == row[width - 1 :]
    g = gram_hashes(words, gram)
    inner = width - gram + 1
    least = g[:count].copy()
    for j in range(1, inner):
        np.minimum(least, g[j : j + count], out=least)
    where = np.zeros(count, np.int64)
    index = np.arange(count)
    for j in range(inner - 1, -1, -1):
        np.copyto(where, index + j, where=g[j : j + count] == least)
    new = valid.copy()
    new[1:] &= (where[1:] != where[:-1]) | ~valid[:-1]
    # a run has 255 windows at most, which its width in the packed rows allows; a minimizer's has inner at most
    a = np.flatnonzero(new)
    stops = np.append(np.flatnonzero(new | ~valid), count)
    b = stops[np.searchsorted(stops, a, side="right")]
    return row[a], a - chunk.words[row[a]], b - a, mix(least[a] ^ _KEY)


def _cut_runs(width: int, gram: int, buckets: int):
    def run(batches):
        held, copies, size, seen = [], [], 0, {}

        def flush():
            doc, start, n, key = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, bucket_of(key, buckets)))
            doc, start, n, key = doc[order], start[order], n[order], key[order]
            where = bucket_of(key, buckets)
            cuts = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)])) if len(where) else np.array([0])
            payload = [_pack(doc[x:y], start[x:y], n[x:y], key[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            bucket = where[cuts[:-1]].tolist() + [d % buckets for d, _, _ in copies]
            doc, tag, n = ([None] * len(payload) + [c[k] for c in copies] for k in range(3))
            cols = [pa.array(bucket, pa.int32()), pa.array(payload + [None] * len(copies), pa.binary()), pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "payload", "doc", "tag", "n"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                row, start, n, key = runs(chunk, width, gram)
                own, raw, new = ids[chunk.first : chunk.first + len(chunk)], chunk.data.tobytes(), np.ones(len(chunk), bool)
                for i in np.flatnonzero(chunk.counts >= width).tolist():
                    doc, name = int(own[i]), _digest(raw[chunk.offs[i] : chunk.offs[i + 1]])
                    least, often = seen.get(name, (doc, 0))
                    seen[name] = min(least, doc), often + 1
                    if often >= COPIES and least < doc:
                        new[i] = False
                        copies.append((doc, _as_tag(name), int(chunk.counts[i]) - width + 1))
                those = new[row]
                held.append((own[row[those]], start[those], n[those], key[those]))
                size += int(those.sum()) + len(copies)
                if size >= FLUSH:
                    yield from flush()
                    held, copies, size = [], [], 0
        if size:
            yield from flush()
        held, copies, seen = [], [], {}
        release()

    return run


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _as_tag(digest: bytes) -> int:
    """Tells rows with one id and different texts apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _least_width(top: int) -> str:
    return "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"


def _pack(doc: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray) -> bytes:
    """Runs in order of document: counts and widths; six low bytes of each key, since the bucket stands for much of the
    rest; distinct documents as distances from the least, how many runs each has; start and windows of each run."""
    table, count = np.unique(doc, return_counts=True)
    gap = (table - table[0]).astype(np.uint64)
    far, many, late = (_least_width(int(x.max())) for x in (gap, count, start))
    six = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    head = np.array([len(doc), len(table), table[0], int(far[-1]), int(many[-1]), int(late[-1])], "<i8")
    return b"".join([head.tobytes(), six.tobytes(), gap.astype(far).tobytes(), count.astype(many).tobytes(), start.astype(late).tobytes(), n.astype("u1").tobytes()])


def _unpack(b: bytes) -> tuple[np.ndarray, ...]:
    rows, k, least, far, many, late = np.frombuffer(b, "<i8", 6).tolist()
    at, out = 48, []
    for kind, n in (("u1", 6 * rows), (f"<u{far}", k), (f"<u{many}", k), (f"<u{late}", rows), ("u1", rows)):
        out.append(np.frombuffer(b, kind, n, at))
        at += n * np.dtype(kind).itemsize
    key, gap, count, start, n = out
    full = np.zeros((rows, 8), np.uint8)
    full[:, :6] = key.reshape(-1, 6)
    return np.repeat(gap.astype(np.int64) + least, count), start.astype(np.int32), n, full.view("<u8").ravel()


def _meet(hot_runs: int):
    """One bucket's runs to those whose key occurs in several documents; copies of whole texts pass through."""

    def run(batches):
        held = {}
        for batch in batches:
            copy = batch.filter(batch.column(1).is_null())
            if len(copy):
                kind, zero = (pa.array(np.full(len(copy), x, np.int32)) for x in (COPY, 0))
                yield pa.RecordBatch.from_arrays([kind, copy.column(2), zero, copy.column(4), zero, copy.column(3)], names=["kind", "doc", "start", "n", "role", "route"])
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if payload.is_valid:
                    held.setdefault(bucket, []).append(_unpack(payload.as_py()))
        for bucket in list(held):
            doc, start, n, key = (np.concatenate(x) for x in zip(*held.pop(bucket), strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            edge = np.ones(len(key), bool)
            edge[1:] = key[1:] != key[:-1]
            at, group = np.flatnonzero(edge), np.cumsum(edge) - 1
            doc = doc[order]
            low, high = np.minimum.reduceat(doc, at)[group], np.maximum.reduceat(doc, at)[group]
            rows = np.flatnonzero(low < high)
            hot = (np.diff(np.append(at, len(key))) > hot_runs)[group[rows]]
            role = (doc[rows] < high[rows]) * INDEXED + (doc[rows] > low[rows]) * STREAMED
            deal = (np.diff(np.append(at, len(key))) // TOGETHER + 1)[group[rows]].astype(U64)
            route = mix(mix(mix(low[rows].view(U64)) + high[rows].view(U64)) + key[rows] % deal).view(np.int64)
            pick = order[rows]
            cols = [pa.array(np.where(hot, HOT, ASKED).astype(np.int32)), pa.array(doc[rows]), pa.array(start[pick]), pa.array(n[pick].astype(np.int32)), pa.array(role.astype(np.int32)), pa.array(route)]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "doc", "start", "n", "role", "route"])
            del doc, start, n, key, order, edge, at, group, low, high, rows, hot, role, deal, route, pick, cols
        release()

    return run


def _segments(row: np.ndarray, start: np.ndarray, n: np.ndarray, role: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring runs of a row and route as one, cut into pieces of SEGMENT windows at most."""
    order = np.lexsort((start, route, row))
    row, start, n, role, route = (x[order] for x in (row, start, n, role, route))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (route[1:] != route[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return row, start, n, role, route
    n, role = np.add.reduceat(n, at), np.bitwise_or.reduceat(role, at)
    k = (n + SEGMENT - 1) // SEGMENT
    off = SEGMENT * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
    row, start, role, route, n = (np.repeat(x, k) for x in (row[at], start[at], role, route[at], n))
    return row, start + off, np.minimum(n - off, SEGMENT), role, route


def _fetch(width: int, hot: bool):
    """(doc_id, text, requests) to pieces with their words, or for hot keys to a row's distinct windows, by a digest of
    their words, with all places of each.

    A request may mean another row of the same id.  What is made of it is still true of this row's text and tag.
    """

    def run(batches):
        for batch in batches:
            asked = batch.column(2)
            asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                part = asked.slice(chunk.first, len(chunk))
                flat = part.flatten()
                row = np.repeat(np.arange(len(chunk)), np.diff(part.offsets.to_numpy()))
                start, n, role, route = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                start, n = start.astype(np.int64), n.astype(np.int64)
                fits = start + n + width - 1 <= chunk.counts[row]
                row, start, n, role, route = _segments(*(x[fits] for x in (row, start, n, role, route)))
                if hot:
                    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, start, role, route, n = np.repeat(row, n), np.repeat(start, n) + off, np.repeat(role, n), np.repeat(route, n), np.ones(len(off), np.int64)
                raw = chunk.data.tobytes()
                tags = np.zeros(len(chunk), np.int64)
                for i in np.unique(row).tolist():
                    tags[i] = _as_tag(_digest(raw[chunk.offs[i] : chunk.offs[i + 1]]))
                a = chunk.words[row] + start
                words = [raw[x:y] for x, y in zip(chunk.start[a].tolist(), chunk.end[a + n + width - 2].tolist(), strict=True)]
                if hot:
                    places: dict[tuple[int, bytes], list[int]] = {}
                    for i, w, x in zip(row.tolist(), words, start.tolist(), strict=True):
                        places.setdefault((i, _digest(b" ".join(w.split()))), []).append(x)
                    row = np.fromiter((i for i, _ in places), np.int64, len(places))
                    cols = [pa.array(ids[chunk.first + row], pa.int64()), pa.array(tags[row]), pa.array(list(places.values()), pa.list_(pa.int32())), pa.array([d for _, d in places], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "tag", "starts", "digest"])
                    continue
                cols = [pa.array(ids[chunk.first + row], pa.int64()), pa.array(tags[row]), pa.array(start.astype(np.int32)), pa.array(role, pa.int32()), pa.array(route, pa.int64()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "tag", "start", "role", "route", "words"])

    return run


def _by_words(numbers: np.ndarray, texts: list[bytes], words: int) -> list[np.ndarray]:
    """The numbers of texts in order, in parts of about so many words."""
    size = np.cumsum([len(texts[i]) // 6 + 1 for i in numbers.tolist()])
    return np.split(numbers, np.flatnonzero(np.diff(size // words)) + 1)


def shard_search(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, roles: np.ndarray, pieces: list[bytes], width: int, words: int = SHARD_WORDS) -> tuple[np.ndarray, ...]:
    """Runs of windows (doc, tag, start, n) that also stand in a smaller document of this shard.

    Pieces that are equal byte for byte are indexed once, with their least document, and streamed once.  A shard of more
    words has several indexes, and each part of the stream is held against all of them.
    """
    number: dict[bytes, int] = {}
    same = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
    texts = list(number)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    those = (roles & INDEXED) > 0
    np.minimum.at(least, same[those], docs[those])
    indexed = np.unique(same[those])
    rows = np.flatnonzero((roles & STREAMED) > 0)
    if not len(indexed) or not len(rows):
        return (np.zeros(0, np.int64),) * 4
    indexes = [FMIndex([texts[i].split() for i in part.tolist()], least[part], width) for part in _by_words(indexed, texts, words)]
    streamed, back = np.unique(same[rows], return_inverse=True)
    found: list[list[np.ndarray]] = []
    for part in _by_words(streamed, texts, words):
        queries = [texts[i].split() for i in part.tolist()]
        owner = None
        for index in indexes:
            query, place, length, low, high = index.matching_statistics([index.encode(q) for q in queries])
            owner = np.full(len(query), np.iinfo(np.int64).max) if owner is None else owner
            hit = np.flatnonzero(length == width)
            owner[hit] = np.minimum(owner[hit], index.least_owner(low[hit], high[hit]))
        hit = np.flatnonzero(owner < np.iinfo(np.int64).max)
        found.append([np.searchsorted(streamed, part[0]) + query[hit], place[hit], owner[hit]])
    query, place, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    bound = np.searchsorted(query, np.arange(len(streamed) + 1))
    n = np.diff(bound)[back]
    at = np.arange(n.sum()) + np.repeat(bound[back] - (np.cumsum(n) - n), n)
    row = np.repeat(rows, n)
    good = owner[at] < docs[row]
    row, place = row[good], place[at[good]]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    row, place, n = row[first], place[first], np.diff(np.append(first, len(row)))
    return docs[row], tags[row], starts[row] + place, n


def _found(doc, tag, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.ListArray.from_arrays(np.arange(len(start) + 1, dtype=np.int32), start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "tag", "starts", "n"])


def _search(width: int):
    """Pieces sorted by route; shards of whole routes, of about SHARD_WORDS words."""

    def run(batches):
        held, words, last = [], 0, None

        def shard():
            docs, tags, starts, roles = (np.concatenate([x[i] for x in held]) for i in range(4))
            return _found(*shard_search(docs, tags, starts, roles, [p for x in held for p in x[4]], width))

        for batch in batches:
            doc, tag, start, role, route = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            pieces = batch.column(5).to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
            for x, y in zip(edge.tolist(), np.append(edge[1:], len(route)).tolist(), strict=True):
                if words >= SHARD_WORDS and route[x] != last:
                    yield shard()
                    held, words = [], 0
                last = route[x]
                held.append((doc[x:y], tag[x:y], start[x:y].astype(np.int64), role[x:y], pieces[x:y]))
                words += sum(map(len, pieces[x:y])) // 6
        if held:
            yield shard()
        del held
        release()

    return run


def repeated_windows(docs: DataFrame, width: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id: doc_id, tag (of the text), starts (words), n (windows).

    docs: doc_id (long; rows without one are left out) and text.  A word w of a document is to go if
    start <= w < start + n + width - 1 for one of its starts.  Texts with fewer words than width have no windows.  Rows
    with equal ids are not compared with each other.
    """
    gram, docs = min(GRAM, width), _plain(docs)
    buckets = buckets_for(docs)
    packed = docs.mapInArrow(_cut_runs(width, gram, buckets), _PACKED)
    met = cut(packed.repartition(buckets, "bucket").mapInArrow(_meet(max(1, shard_words // (width + 4))), _ASKED))

    def fetched(hot: bool) -> DataFrame:
        asked = met.where(F.col("kind") == (HOT if hot else ASKED)).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "n", "role", "route")).alias("asked"))
        return docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_fetch(width, hot), _WINDOWS if hot else _PIECES)

    pieces = fetched(False).repartition(buckets, "route").sortWithinPartitions("route")
    copies = met.where(F.col("kind") == COPY).select("doc", F.col("route").alias("tag"), F.array("start").alias("starts"), "n")
    found = copies.union(pieces.mapInArrow(_search(width), _FOUND))
    if met.where(F.col("kind") == HOT).take(1):
        windows = fetched(True)
        least = windows.groupBy("digest").agg(F.min("doc").alias("least"))
        found = found.union(windows.join(least, "digest").where("doc > least").select("doc", "tag", "starts", F.lit(1).alias("n")))
    return found.withColumnRenamed("doc", "doc_id")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def _keep(width: int, digest: bool):
    """(text, runs, ...rest) to (kept or its digest, n_words, n_removed, ...rest)."""

    def run(batches):
        for batch in batches:
            texts, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept, total, gone = [], [], []
            for text, spans in zip(texts, found, strict=True):
                raw = (text or "").encode()
                words = raw.split()
                total.append(len(words))
                if spans:
                    tag, step = _as_tag(_digest(raw)), np.zeros(len(words) + 1, np.int64)
                    s, n = np.array([(x, r["n"]) for r in spans if r["tag"] == tag for x in r["starts"]], np.int64).reshape(-1, 2).T
                    np.add.at(step, s, 1)
                    np.add.at(step, s + n + width - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                gone.append(total[-1] - len(words))
                if digest:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    kept.append(b" ".join(words).decode() if gone[-1] else text)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), *batch.columns[2:]], names=["kept", "n_words", "n_removed", *batch.schema.names[2:]])

    return run


def _runs_of(docs: DataFrame, width: int, shard_words: int) -> DataFrame:
    return repeated_windows(docs, width, shard_words).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "starts", "n")).alias("runs"))


def repeat_digest(docs: DataFrame, width: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each row of docs.

    docs: doc_id, text; other columns are ignored.  Null text: no words.  Rows without an id are left out; rows with
    equal ids are not compared with each other, and each loses what smaller ids hold; an empty table gives no rows.
    """
    # the same plan of (doc_id, text) as in repeated_windows: Spark deals the texts out once for both joins
    out = _plain(docs).join(_runs_of(docs, width, shard_words), "doc_id", "left").select("text", "runs", "doc_id")
    out = out.mapInArrow(_keep(width, True), "kept string, n_words long, n_removed long, doc_id long")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, width: int = 13, shard_words: int = SHARD_WORDS, count: str | None = None) -> DataFrame:
    """docs with repeated windows removed from text and other columns as they are, whatever their names.

    A text that loses words becomes its kept words joined by one space; any other stays as it was, null included.  Rows
    without an id stay as they are.  count: the name of a further column, the number of words removed; docs has none such.
    """
    if count in docs.columns:
        raise ValueError(f"docs has a column {count} already")
    body = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("body"))
    runs_of = _runs_of(docs, width, shard_words).withColumnRenamed("doc_id", "id")
    joined = body.join(runs_of, "id", "left").select("text", "runs", "body")
    out = joined.mapInArrow(_keep(width, False), f"kept string, n_words long, n_removed long, body {dict(joined.dtypes)['body']}")
    more = [F.col("n_removed").alias(count)] if count else []
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"body.`{c}`") for c in docs.columns], *more)
