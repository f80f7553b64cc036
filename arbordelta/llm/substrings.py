"""Removal of byte strings that also start in a document with a smaller doc_id, by suffix arrays in buckets.

Texts are handled in chunks (about `chunk_bytes` of text). Each window of `length` bytes has an anchor: its least-hashed
gram of `gram` bytes, so equal windows have equal anchors. Consecutive windows with one anchor make a super-window.

1. Chunks send the anchors' hashes (4 bytes) with digests (8 bytes) of their documents to buckets; a bucket tells which anchors
   occur in two different texts. Whole copies of a text with a smaller doc_id are found in the same way and leave.
2. Chunks send the super-windows of those anchors to buckets. A bucket handles them in parts by their anchors, of about
   `part_bytes`: it joins the distinct ones, sorts their suffixes in two stages, computes adjacent common prefixes, and takes
   from each run of prefixes >= length the least doc_id. Its replies are runs of windows.
3. Chunks cut out the bytes of windows for which a smaller doc_id was found.

So every window is judged, and its bytes travel only if its anchor repeats. An anchor costs a chunk two entries at most, and
one that `hot` chunks (4 GB of text) or more have is not sent as super-windows but window by window, each to a bucket of its own hash, so
that no bucket gathers what the input repeats. The number of buckets follows the bytes of the input.

Defined cases: null text is empty; texts shorter than the length lose nothing; equal doc_ids are not smaller than each other;
null doc_ids are greater than all others; repeated rows are judged each; an empty table gives no rows; other columns are
not read. Anchors are told apart by 32 bits and a bucket, which only sends more than is needed; that an anchor is in two texts,
and that super-windows are equal, by 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, text_or_empty
from .shingles import mix
from .suffix_array import common_prefixes, join, suffix_array

LENGTH, GRAM = 50, 20
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15


def rolling(b: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes at each place."""
    def part(k: int) -> np.ndarray:
        if k == 1:
            return b.astype(np.uint64) + np.uint64(1)
        half = part(k // 2)
        m = k // 2
        out = half[: len(half) - m] * np.uint64(pow(_BASE, m, 1 << 64)) + half[m:]
        if k % 2:
            out = out[: len(b) - k + 1] * np.uint64(_BASE) + (b[k - 1 :].astype(np.uint64) + np.uint64(1))
        return out

    return mix(part(n)) if len(b) >= n else np.zeros(0, np.uint64)


def super_windows(b: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts joined in b that end at `ends`: hash of the anchor, first window, number of windows, text of each super-window."""
    w, n = length - gram + 1, len(b) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = rolling(b, gram)
    # The place is part of the compared value, so that the least gram of a window is one place, the first of equals.
    ranked = (h & ~np.uint64(0xFFFF)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(0xFFFF))
    least, span = ranked, 1
    while span * 2 <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    at = np.arange(n)
    anchor = at + ((least[:n].astype(np.int64) & 0xFFFF) - at) % 65536
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    inside = at + length <= ends[text]
    at, anchor, text = at[inside], anchor[inside], text[inside]
    if not len(at):
        return np.zeros(0, np.uint64), at, at, at
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    return h[anchor[first]], at[first], np.diff(np.append(first, len(at))), text[first]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, n, 8), 8 + 8 * n, []
    for size, kind in zip(sizes.tolist(), types):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


class Chunk:
    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.lengths, self.data = ids, lengths, data
        self.ends = np.cumsum(lengths)
        self.bytes = np.frombuffer(data, np.uint8)
        self.key = hashlib.blake2b(ids.tobytes() + lengths.tobytes() + data, digest_size=16).digest()

    def texts(self):
        for a, b in zip((self.ends - self.lengths).tolist(), self.ends.tolist()):
            yield self.data[a:b]


def _chunks(batches, chunk_bytes: int):
    """Chunks of the rows (doc_id, text) in the order read."""
    ids, texts, size = [], [], 0
    for batch in batches:
        own = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, batch.num_rows, 512):
            for i, x in enumerate(batch.column("text").slice(at, 512).cast(pa.binary()).to_pylist()):
                ids.append(own[at + i])
                texts.append(x)
                size += len(x)
                if size >= chunk_bytes:
                    yield Chunk(np.array(ids, np.int64), np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts))
                    ids, texts, size = [], [], 0
    if ids:
        yield Chunk(np.array(ids, np.int64), np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts))


def _by_bucket(bucket: np.ndarray):
    """(bucket, places in ascending order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, starts[1:]))


SENT = "bucket int, chunk binary, kind int, payload binary"
BACK = "chunk binary, bucket int, kind int, payload binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int32(), pa.binary()))], ["bucket", "chunk", "kind", "payload"])


def _back(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.binary()))], ["chunk", "bucket", "kind", "payload"])


def _buckets(batches):
    """Rows of SENT that are ordered by bucket, gathered by bucket."""
    now, rows = None, []
    for batch in batches:
        payloads = batch.column("payload")
        for i, (bucket, *row) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("bucket", "chunk", "kind")))):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append((*row, payloads[i].as_buffer()))
    if rows:
        yield now, rows


def _digests(chunk: Chunk) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in chunk.texts()), np.uint64).reshape(-1, 2)


def _chunk_windows(chunk: Chunk, length: int, gram: int, together: int = 512 << 10) -> tuple[np.ndarray, ...]:
    """super_windows of a chunk, worked out for some texts at a time."""
    cuts = [0, *(np.flatnonzero(np.diff(chunk.ends // together)) + 1).tolist(), len(chunk.ends)]
    parts = []
    for a, z in zip(cuts[:-1], cuts[1:]):
        base = chunk.ends[a] - chunk.lengths[a]
        h, first, count, text = super_windows(chunk.bytes[base : chunk.ends[z - 1]], chunk.ends[a:z] - base, length, gram)
        parts.append((h, first + base, count, text + a))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(chunk: Chunk, length: int, gram: int, buckets: int):
    """Distinct anchors of a chunk as (bucket, 32-bit rest) in a fixed order, the super-windows, and the anchor of each."""
    h, first, count, text = _chunk_windows(chunk, length, gram)
    code = ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    distinct, of = np.unique(code, return_inverse=True)
    return distinct, of, h, first, count, text


def _send_anchors(length: int, gram: int, buckets: int):
    def run(batches):
        for chunk, _ in _with_replies(batches):
            rows, digest = [], _digests(chunk)
            for bucket, own in _by_bucket((digest[:, 0] % np.uint64(buckets)).astype(np.int64)):
                rows.append((bucket, chunk.key, 0, _pack(own, digest[own].ravel(), chunk.ids[own])))
            distinct, of, _, _, _, text = _anchors(chunk, length, gram, buckets)
            short = digest[:, 1][text]
            # An anchor's least and greatest digest: two entries tell if it is in different texts.
            low, high = np.full(len(distinct), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(distinct), np.uint64)
            np.minimum.at(low, of, short)
            np.maximum.at(high, of, short)
            for bucket, own in _by_bucket((distinct >> np.uint64(32)).astype(np.int64)):
                more = np.flatnonzero(low[own] != high[own]).astype(np.uint32)
                rows.append((bucket, chunk.key, 1, _pack(distinct[own].astype(np.uint32), low[own], more, high[own][more])))
            yield _sent(rows)

    return run


def _judge_anchors(hot: int):
    def run(batches):
        for bucket, rows in _buckets(batches):
            out = []
            docs = [(key, *_unpack(p, np.int64, np.uint64, np.int64)) for key, kind, p in rows if kind == 0]
            if docs:
                digest = np.concatenate([d[2].reshape(-1, 2) for d in docs])
                ids = np.concatenate([d[3] for d in docs])
                order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
                d, i = digest[order], ids[order]
                new = np.concatenate([[True], (d[1:] != d[:-1]).any(1)])
                least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
                copy = np.zeros(len(ids), bool)
                copy[order] = i > least
                at = 0
                for key, own, _, _ in docs:
                    if (flags := copy[at : at + len(own)]).any():
                        out.append((key, bucket, 0, _pack(own[flags])))
                    at += len(own)
            sent = [(key, *_unpack(p, np.uint32, np.uint64, np.uint32, np.uint64)) for key, kind, p in rows if kind == 1]
            if sent:
                code, low = np.concatenate([s[1] for s in sent]), np.concatenate([s[2] for s in sent])
                high = np.concatenate([s[2] for s in sent])
                at = 0
                for _, c, _, more, top in sent:
                    high[at + more.astype(np.int64)] = top
                    at += len(c)
                order = np.argsort(code, kind="stable")
                c = code[order]
                starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                sizes = np.diff(np.append(starts, len(c)))
                state = (np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)).astype(np.uint8)
                state[(state > 0) & (sizes >= hot)] = 2
                flags = np.empty(len(code), np.uint8)
                flags[order] = np.repeat(state, sizes)
                at = 0
                for key, c, _, _, _ in sent:
                    if (own := flags[at : at + len(c)]).any():
                        out.append((key, bucket, 1, _pack(np.packbits(own > 0), np.packbits(own > 1))))
                    at += len(c)
            yield _back(out)

    return run


def _content_hashes(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of b (pieces are short): a polynomial, all pieces advanced together."""
    out = size.astype(np.uint64)
    order = np.argsort(-size, kind="stable")
    ranked = size[order]
    for k in range(int(size.max()) if len(size) else 0):
        live = order[: np.searchsorted(-ranked, -k, "left")]
        out[live] = out[live] * np.uint64(_BASE) + b[start[live] + k].astype(np.uint64) + np.uint64(1)
    return mix(out)


def _gather(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return b[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _send_super_windows(length: int, gram: int, buckets: int):
    """Rows with a chunk and its replies -> super-windows to buckets (kind 1), and whole copies (2) and windows settled in the chunk (3)."""

    def run(batches):
        for chunk, replies in _with_replies(batches):
            distinct, of, h, first, count, text = _anchors(chunk, length, gram, buckets)
            copies = np.zeros(len(chunk.ids), bool)
            state = np.zeros(len(distinct), np.uint8)
            span = {b: own for b, own in _by_bucket((distinct >> np.uint64(32)).astype(np.int64))}
            for bucket, kind, payload in replies:
                if kind == 0:
                    copies[_unpack(payload, np.int64)[0]] = True
                else:
                    own = span[bucket]
                    state[own] = sum(np.unpackbits(x, count=len(own)) for x in _unpack(payload, np.uint8, np.uint8))
            rows = [(-1, chunk.key, 2, _pack(np.flatnonzero(copies)))] if copies.any() else []
            keep = (state[of] > 0) & ~copies[text]
            code, h, first, count, text = state[of][keep], h[keep], first[keep], count[keep], text[keep]
            if (code > 1).any():  # hot anchors: every window by itself
                n = np.where(code > 1, count, 1)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                single = np.repeat(code > 1, n)
                first, text, h = np.repeat(first, n) + step * single, np.repeat(text, n), np.repeat(h, n)
                count = np.where(single, 1, np.repeat(count, n))
            else:
                single = np.zeros(len(h), bool)
            size, ids = count + length - 1, chunk.ids[text]
            content = _content_hashes(chunk.bytes, first, size)
            name = np.where(single, content, h)
            target = ((name >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            part = (name >> np.uint64(24)).astype(np.uint8)
            # A string that a smaller doc_id in this chunk has too is settled here.
            order = np.lexsort((ids, content))
            new = np.concatenate([[True], content[order][1:] != content[order][:-1]]) if len(order) else np.zeros(0, bool)
            settled = np.zeros(len(ids), bool)
            if len(order):
                settled[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            if settled.any():
                rows.append((-1, chunk.key, 3, _pack(first[settled].astype(np.int32), count[settled].astype(np.int32))))
            go = np.flatnonzero(~settled)
            for bucket, own in _by_bucket(target[go]):
                own = go[own]
                own = own[np.argsort(part[own], kind="stable")]
                rows.append((bucket, chunk.key, 1, _pack(first[own].astype(np.int32), count[own].astype(np.uint8), ids[own], content[own], part[own], _gather(chunk.bytes, first[own], size[own]))))
            # Rows for the chunk itself need no bucket: they are spread over negative numbers.
            yield _sent([(-1 - chunk.key[0] % buckets if b < 0 else b, *r) for b, *r in rows])

    return run


def _repeated(count: np.ndarray, ids: np.ndarray, content: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether a smaller doc_id has it too, for each window of super-windows whose bytes are joined in b."""
    count = count.astype(np.int64)
    size = count + length - 1
    start = np.cumsum(size) - size
    # One copy of each distinct string, with its least doc_id, goes into the suffix array.
    order = np.lexsort((ids, content))
    new = np.concatenate([[True], content[order][1:] != content[order][:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    own = order[new]
    least = ids[own]
    t = join(_gather(b, start[own], size[own]), size[own])
    at = np.cumsum(size[own] + 1) - (size[own] + 1)
    string = np.repeat(np.arange(len(own)), size[own] + 1)
    sa = suffix_array(t, length)
    place = sa - at[string[sa]]
    window = place < count[own][string[sa]]
    sa, place = sa[window], place[window]
    doc = least[string[sa]]
    runs = np.flatnonzero(np.concatenate([[True], common_prefixes(t, sa, length) < length]))
    smallest = np.repeat(np.minimum.reduceat(doc, runs), np.diff(np.append(runs, len(sa))))
    # by string and window: the least doc_id that has the window
    found = np.empty(int(count[own].sum()), np.int64)
    base = np.cumsum(count[own]) - count[own]
    found[base[string[sa]] + place] = smallest
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return found[np.repeat(base[which], count) + step] < np.repeat(ids, count)


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places as runs: where each begins and how long it is."""
    begins = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return places[begins], np.diff(np.append(begins, len(places)))


def _judge_super_windows(length: int, part_bytes: int):
    def run(batches):
        for bucket, rows in _buckets(batches):
            if bucket < 0:
                yield _back([(key, 0, kind, payload.to_pybytes()) for key, kind, payload in rows])
                continue
            sent = [(key, *_unpack(p, np.int32, np.uint8, np.int64, np.uint64, np.uint8, np.uint8)) for key, _, p in rows]
            # Equal windows have one anchor and so one part; a chunk's super-windows are in the order of their parts.
            parts = min(256, -(-sum(len(s[6]) for s in sent) // part_bytes))
            ends = [np.concatenate([[0], np.cumsum(s[2].astype(np.int64) + length - 1)]) for s in sent]
            cuts = [np.searchsorted(s[5], -(-np.arange(parts + 1) * 256 // parts)) for s in sent]
            hits: list[list[np.ndarray]] = [[] for _ in sent]
            for k in range(parts):
                own = [(j, s, int(c[k]), int(c[k + 1])) for j, (s, c) in enumerate(zip(sent, cuts)) if c[k] < c[k + 1]]
                if not own:
                    continue
                count, ids, content = (np.concatenate([s[i][a:z] for _, s, a, z in own]) for i in (2, 3, 4))
                hit = _repeated(count, ids, content, np.concatenate([s[6][ends[j][a] : ends[j][z]] for j, s, a, z in own]), length)
                at = 0
                for j, s, a, z in own:
                    c = s[2][a:z].astype(np.int64)
                    n = int(c.sum())
                    step = np.arange(n) - np.repeat(np.cumsum(c) - c, c)
                    hits[j].append((np.repeat(s[1][a:z].astype(np.int64), c) + step)[hit[at : at + n]])
                    at += n
            out = []
            for s, found in zip(sent, hits):
                places = np.sort(np.concatenate(found))
                if len(places):
                    out.append((s[0], bucket, 4, _pack(*(x.astype(np.int32) for x in _runs(places)))))
            yield _back(out)

    return run


def _with_replies(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, lengths, data = _unpack(pa.decompress(batch.column("body")[i].as_py(), decompressed_size=batch.column("body_size")[i].as_py(), codec="zstd").to_pybytes(), np.int64, np.int64, np.uint8)
            replies = batch.column("replies")[i].as_py() if "replies" in batch.schema.names else None
            yield Chunk(ids, lengths, data.tobytes()), [(r["bucket"], r["kind"], r["payload"]) for r in replies or []]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int):
    def run(batches):
        for chunk, replies in _with_replies(batches):
            n = len(chunk.bytes)
            edge = np.zeros(n + 1, np.int32)  # +1 where removed windows begin, -1 after they end
            for _, kind, payload in replies:
                if kind == 2:
                    own = _unpack(payload, np.int64)[0]
                    own = own[chunk.lengths[own] >= length]
                    np.add.at(edge, chunk.ends[own] - chunk.lengths[own], 1)
                    np.add.at(edge, chunk.ends[own], -1)
                else:
                    first, count = _unpack(payload, np.int32, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + count + length - 1, -1)
            gone = np.cumsum(edge)[:n] > 0
            rows = []
            for doc_id, a, b in zip(chunk.ids.tolist(), (chunk.ends - chunk.lengths).tolist(), chunk.ends.tolist()):
                own = gone[a:b]
                removed = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
                kept = chunk.bytes[a:b][~own].tobytes() if removed else chunk.data[a:b]
                rows.append((None if doc_id == NO_ID else doc_id, b - a, removed, spans, hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = 2 << 20, bucket_bytes: int = 12 << 20, part_bytes: int = 2 << 20, hot: int = 2_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, total // bucket_bytes)

    def bodies(batches):
        for chunk in _chunks(batches, chunk_bytes):
            body = _pack(chunk.ids, chunk.lengths, chunk.bytes)
            yield pa.RecordBatch.from_arrays([pa.array([chunk.key], pa.binary()), pa.array([len(body)], pa.int64()), pa.array([pa.compress(body, codec="zstd", asbytes=True)], pa.binary())], ["chunk", "body_size", "body"])

    # Written once: what is sent and what is cut are the same chunks, so every reply finds its own.
    chunks = materialize(arrow_map(rows, bodies, "chunk binary, body_size long, body binary"), "chunks")

    def answered(sent: DataFrame, judge, tag: str) -> DataFrame:
        dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
        replies = materialize(arrow_map(dealt, judge, BACK), tag)
        grouped = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kind", "payload")).alias("replies"))
        return chunks.join(grouped.hint("merge"), "chunk", "left")

    found = answered(arrow_map(chunks, _send_anchors(length, gram, buckets), SENT), _judge_anchors(hot), "anchors")
    found = answered(arrow_map(found, _send_super_windows(length, gram, buckets), SENT), _judge_super_windows(length, part_bytes), "windows")
    return arrow_map(found, _cut(length), RESULT)
