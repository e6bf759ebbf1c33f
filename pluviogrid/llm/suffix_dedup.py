"""Operator 5, suffix-array dedup: a logarithmic family of suffix arrays, kept as tables.

Each byte covered by a string of LENGTH bytes that also starts anywhere else goes.

Suffixes are sparse: in each window of LENGTH bytes the KGRAM-byte string with the smallest
hash is its anchor, so equal windows have equal anchors at equal offsets. Consecutive windows
with one anchor are a segment; a segment stands for the suffixes that begin in it. The suffix array of
a batch holds its distinct segments, sorted by the anchor's fingerprint and then by a
BLAKE2b digest of the segment's bytes (only equality matters, not the letters' order), with
counts, in shards of anchors. `SuffixIndex.add` builds the array of a new batch, merge-scans it
against each level that the family has, writes down the long matches found (segments that occur
again, anchors that come with several segments), and then merges the batch with levels of
about its size; levels and matches are Parquet tables in the index's folder, so batches can be added at any time.

`SuffixIndex.resolve` decides documents by the matches: a segment that occurs again is covered whole. Where an
anchor comes with different segments, the windows within decide: those segments' bytes, each
sent once, are sorted by their windows, and neighbours are compared byte by byte. Of an anchor with more
than HOT_SEGMENTS segments (a line that a third of all documents share), 128-bit digests of the windows
are dealt to all shards instead, so it is no single task's.

Null and empty texts have no bytes; repeated rows count as documents of their own, so a text of
LENGTH bytes or more in two rows goes whole; texts of any length are handled whole; ids may be of
any type; an empty table gives an empty result; only doc_id and the text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import as_binary, binary_values, mix64, scratch, table
from .exchange import MESSAGE, chunked, inbox, messages, pack, shards_for, split, total_bytes, unique_pairs, unpack

LENGTH = 200
KGRAM = 32
SLICE = 262_144  # bytes that are fingerprinted at a time, or one text
BATCHES = 4  # that a table is added in
BATCH_BYTES = 4_000_000  # of a task's texts that are sorted at a time
HOT_SEGMENTS = 4096

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = [int(x) | 1 for x in mix64(np.arange(300, 340, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def fingerprints(raw: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each size, a 64-bit fingerprint of the bytes from each position on (short ones at the end are meaningless)."""
    out, level, h = {}, 1, _BYTE[raw]
    parts: dict[int, np.ndarray] = {1: h}
    most = max(sizes)
    needed = {1 << b for s in sizes for b in range(s.bit_length()) if s >> b & 1}
    k = 0
    while level * 2 <= most:
        n = len(h) - level
        if n <= 0:
            break
        g = h[:n] * np.uint64(_STEP[k])
        g += h[level : level + n]
        level, h, k = level * 2, g, k + 1
        if level in needed:
            parts[level] = h
    for s in sizes:
        bits = [1 << b for b in range(s.bit_length() - 1, -1, -1) if s >> b & 1]
        n = len(raw) - s + 1
        if n <= 0:
            out[s] = np.zeros(0, np.uint64)
            continue
        at, total = 0, np.zeros(n, np.uint64)
        for j, b in enumerate(bits):
            if j:
                total *= np.uint64(_STEP[20 + j])
            total += parts[b][at : at + n]
            at += b
        out[s] = mix64(total + np.uint64(s))
    return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest (then leftmost) of each `width` neighbours."""
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Segments:
    """Segments of all the texts of a chunk: first window, windows, anchor's place, and the two keys."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, kgram: int):
        parts, lo = [], 0
        while lo < len(offsets) - 1:  # some documents at a time, so that arrays stay small
            hi = lo + 1
            while hi < len(offsets) - 1 and offsets[hi + 1] - offsets[lo] <= SLICE:
                hi += 1
            parts.append(self._of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], int(offsets[lo]), length, kgram))
            lo = hi
        self.first, self.windows, self.place, self.anchor, self.content = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else self._none()

    @staticmethod
    def _none():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2

    @classmethod
    def _of(cls, raw: np.ndarray, offsets: np.ndarray, base: int, length: int, kgram: int):
        n = np.maximum(0, np.diff(offsets) - length + 1)
        starts = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if not len(starts):
            return cls._none()
        fp = fingerprints(raw, (kgram,))
        at = window_minima(fp[kgram], length - kgram + 1)[starts]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        run = np.flatnonzero(new)
        windows = np.diff(np.concatenate((run, [len(at)])))
        first, place = starts[run], at[run]
        last = first + windows - 1
        text = raw.tobytes()
        content = np.frombuffer(b"".join([hashlib.blake2b(text[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]), np.uint64)
        return first + base, windows, place + base, fp[kgram][place], content


Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # anchors and contents of distinct segments, in order, and their counts


def merged(*levels: Level) -> Level:
    """Levels (or unsorted entries) as one."""
    if not levels:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a, b, n = (np.concatenate(x) for x in zip(*levels, strict=True))
    order, first = unique_pairs(a, b)
    return a[order][first], b[order][first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def find_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each (a, b) among the sorted pairs (x, y), or -1; and how many pairs there have that a."""
    lo, hi = np.searchsorted(x, a), np.searchsorted(x, a, side="right")
    out = np.full(len(a), -1, np.int64)
    todo = np.flatnonzero(lo < hi)
    left, right = lo[todo], hi[todo]
    while len(todo):  # binary search by b among the equal a
        mid = (left + right) // 2
        equal = y[mid] == b[todo]
        out[todo[equal]] = mid[equal]
        less = y[mid] < b[todo]
        left, right = np.where(less, mid + 1, left), np.where(less, right, mid)
        go = ~equal & (left < right)
        todo, left, right = todo[go], left[go], right[go]
    return out, hi - lo


def scan(batch: Level, levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Long matches of a batch's array: anchors and contents of segments that occur again in it or in a level, and anchors that come with other segments."""
    a, b, n = batch
    again = n > 1
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    start = np.flatnonzero(new)
    kinds = np.diff(np.append(start, len(a)))
    several = kinds > 1
    for x, y, _ in levels:
        at, same = find_pairs(x, y, a, b)
        again = again | (at >= 0)
        if len(start):
            several = several | (same[start] > np.add.reduceat((at >= 0).astype(np.int64), start))
    return a[again], b[again], a[start[several]]


def _batch(seg: Segments, shards: int):
    """For each shard, (distinct segments' anchor, content, count, one place each, and where they begin in the order), sorted; and that order."""
    order, first = unique_pairs(seg.anchor, seg.content)
    n = np.diff(np.concatenate((first, [len(order)])))
    rep = order[first]
    of = (seg.anchor[rep] % np.uint64(shards)).astype(np.int64)
    return [(seg.anchor[rep[p]], seg.content[rep[p]], n[p], rep[p], first[p]) for p in split(of, shards)], order


ASKED, MATCHES, LEVEL = 0, 1, 2  # kinds of messages of the index
REPEATED, SEND, WIDE = 1, 2, 4  # flags of a chunk's segments


def insert(rows: pa.Table, absorbed: tuple[int, ...]) -> pa.Table:
    """A shard's part of a new batch: its matches with all levels, and the level that it becomes with the absorbed ones."""
    box = inbox(rows)
    if not box:
        return messages([])
    entries = [unpack(data) for _, _, kind, data in box if kind == ASKED]
    batch = merged(*((a, b, n.astype(np.int64)) for a, b, n in entries))
    levels = {number: tuple(unpack(data)) for _, number, kind, data in box if kind == LEVEL}
    out = [(box[0][0], -1, MATCHES, pack(*scan(batch, list(levels.values()))))]
    whole = merged(batch, *(levels[k] for k in absorbed if k in levels))
    if len(whole[0]):
        out.append((box[0][0], -1, LEVEL, pack(*whole)))
    return messages(out)


def answer_segments(rows: pa.Table, hot_segments: int = HOT_SEGMENTS) -> pa.Table:
    """For each chunk, flags of its segments: REPEATED; SEND where its windows are needed and the chunk is the first that has it, WIDE if the anchor is hot."""
    box = [(shard, chunk, kind, unpack(data)) for shard, chunk, kind, data in inbox(rows)]
    asked = [(shard, chunk, d) for shard, chunk, kind, d in box if kind == ASKED]
    if not asked:
        return messages([])
    found = [d for _, _, kind, d in box if kind == MATCHES] or [[np.zeros(0, np.uint64)] * 3]
    x, y, _ = merged(*((d[0], d[1], np.ones(len(d[0]), np.int64)) for d in found))
    mixed = np.unique(np.concatenate([d[2] for d in found]))
    size = [len(d[0]) for _, _, d in asked]
    a, b = (np.concatenate([d[k] for _, _, d in asked]) for k in (0, 1))
    flags = np.where(find_pairs(x, y, a, b)[0] >= 0, REPEATED, 0).astype(np.uint8)
    order, first = unique_pairs(a, b)  # in the order of chunks within equal pairs
    rep = order[first]
    anchors, which, kinds = np.unique(a[rep], return_inverse=True, return_counts=True)
    single = np.bincount(which, (flags[rep] & REPEATED) == 0, len(anchors)) > 0
    needed = single & np.isin(anchors, mixed)
    flags[rep[needed[which]]] |= SEND
    flags[rep[(needed & (kinds > hot_segments))[which]]] |= WIDE
    parts = np.split(flags, np.cumsum(size)[:-1])
    return messages([(shard, chunk, 1, pack(f)) for (shard, chunk, _), f in zip(asked, parts, strict=True)])


def _windows(raw: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all windows of the segments whose bytes follow each other in raw."""
    size = windows + length - 1
    ends = np.cumsum(size)
    out, lo = [], 0
    while lo < len(windows):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE)))
        base, w = ends[lo] - size[lo], windows[lo:hi]
        at = np.repeat(ends[lo:hi] - size[lo:hi] - base - (np.cumsum(w) - w), w) + np.arange(w.sum())
        out.append(fingerprints(raw[base : ends[hi - 1]], (length,))[length][at])
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def again(k: np.ndarray, f: np.ndarray, raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which windows (anchor k, fingerprint f, at a place in raw) are there more than once: neighbours in their order, compared byte by byte."""
    order = np.lexsort((f, k))
    same = np.flatnonzero((k[order][1:] == k[order][:-1]) & (f[order][1:] == f[order][:-1]))
    step, out = np.arange(length), np.zeros(len(k), bool)
    for lo in range(0, len(same), 16_384):
        i, j = order[same[lo : lo + 16_384]], order[same[lo : lo + 16_384] + 1]
        equal = (raw[at[i][:, None] + step] == raw[at[j][:, None] + step]).all(axis=1)
        out[i[equal]] = out[j[equal]] = True
    return out


def answer_windows(rows: pa.Table, length: int) -> pa.Table:
    """For each chunk, a bit for each window (of segments, or as digests) that it sent: does it occur in another segment too?"""
    box = [(shard, chunk, kind, unpack(data)) for shard, chunk, kind, data in inbox(rows)]
    out, whole, wide = [], [x for x in box if x[2] == 0], [x for x in box if x[2] == 3]
    if whole:
        raw, keys, prints, places, base = np.concatenate([d[2] for *_, d in whole]), [], [], [], 0
        for *_, (a, w, own) in whole:
            size = w + length - 1
            keys.append(np.repeat(a, w)), prints.append(_windows(own, w, length))
            places.append(base + np.repeat(np.cumsum(size) - size - (np.cumsum(w) - w), w) + np.arange(w.sum()))
            base += len(own)
        hit = np.split(again(*(np.concatenate(x) for x in (keys, prints)), raw, np.concatenate(places), length), np.cumsum([len(x) for x in keys])[:-1])
        out += [(shard, chunk, 2, pack(np.packbits(h))) for (shard, chunk, *_), h in zip(whole, hit, strict=True)]
    if wide:
        a, b = (np.concatenate([d[k] for *_, d in wide]) for k in (0, 1))
        x, y, n = merged((a, b, np.ones(len(a), np.int64)))
        hit = np.split(n[find_pairs(x, y, a, b)[0]] > 1, np.cumsum([len(d[0]) for *_, d in wide])[:-1])
        out += [(shard, chunk, 4, pack(np.packbits(h))) for (shard, chunk, *_), h in zip(wide, hit, strict=True)]
    return messages(out)


class SuffixIndex:
    """The family in a folder that all machines share. shards: parts of the key space, for all of its life."""

    def __init__(self, spark: SparkSession, folder: str, shards: int, length: int = LENGTH, kgram: int = KGRAM, hot_segments: int = HOT_SEGMENTS):
        self.hot_segments = hot_segments
        self.spark, self.folder, self.shards, self.length = spark, folder, shards, length
        self.kgram = kgram if length > kgram else max(1, length // 2)
        self.levels: list[tuple[int, str]] = []  # bytes of text in each, and its table; the largest first
        self.tables: list[str] = []  # of all batches, with their matches
        ship(spark)

    def _read(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(MESSAGE).parquet(path).where(F.col("kind") == kind).select("shard", "chunk", "kind", "data")

    def add(self, docs: DataFrame) -> None:
        """A new batch: scanned against all levels, then merged with those of about its size."""
        size, absorbed = total_bytes(docs), []
        shards, length, kgram = self.shards, self.length, self.kgram
        for k in range(len(self.levels) - 1, -1, -1):
            if self.levels[k][0] > 2 * size:
                break
            absorbed.append(k)
            size += self.levels[k][0]

        def ask(batches):
            def out(texts):
                raw, off = binary_values(pa.array(texts, pa.binary()))
                parts, _ = _batch(Segments(raw, off, length, kgram), shards)
                return messages([(s, 0, ASKED, pack(a, b, np.minimum(c, 2).astype(np.uint8))) for s, (a, b, c, _, _) in enumerate(parts) if len(a)]).to_batches()

            held, size = [], 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    held.append(text)
                    size += len(text)
                    if size > BATCH_BYTES:
                        yield from out(held)
                        held, size = [], 0
            yield from out(held)

        rows = docs.select(as_binary("text")).mapInArrow(ask, MESSAGE)
        for k, (_, path) in enumerate(self.levels):
            rows = rows.union(self._read(path, LEVEL).withColumn("chunk", F.lit(k)))
        path, gone = f"{self.folder}/batch-{len(self.tables)}", tuple(absorbed)
        rows.groupBy("shard").applyInArrow(lambda t: insert(t, gone), MESSAGE).write.partitionBy("kind").parquet(path)
        self.levels = [x for k, x in enumerate(self.levels) if k not in absorbed] + [(size, path)]
        self.tables.append(path)

    def resolve(self, docs: DataFrame, spans: bool = False) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of documents that have been added; on request also the spans removed and the kept bytes."""
        rows, _ = chunked(docs, ["doc_id"])
        n, length, kgram = self.shards, self.length, self.kgram
        id_type = docs.schema["doc_id"].dataType.simpleString()
        by_chunk = rows.groupBy("chunk")

        def of(t: pa.Table):
            raw, off = binary_values(t.column("text"))
            return raw, off, Segments(raw, off, length, kgram)

        def ask(t: pa.Table) -> pa.Table:
            chunk = t.column("chunk")[0].as_py()
            parts, _ = _batch(of(t)[2], n)
            return messages([(s, chunk, ASKED, pack(p[0], p[1])) for s, p in enumerate(parts) if len(p[0])])

        def flags_of(box, parts):
            flags = {shard: unpack(data)[0] for shard, _, k, data in box if k == 1}
            return [flags.get(s, np.zeros(len(p[0]), np.uint8)) for s, p in enumerate(parts)]

        def windows_of(seg, p, take):
            """Of those segments: windows, and the place of each window."""
            w, first = seg.windows[p[3][take]], seg.first[p[3][take]]
            return w, np.repeat(first - (np.cumsum(w) - w), w) + np.arange(w.sum())

        def hot(raw, seg, parts, flags):
            """Places and digests of the windows of hot anchors' segments, and which of them go to each shard."""
            at = [windows_of(seg, p, np.flatnonzero(f & WIDE))[1] for p, f in zip(parts, flags, strict=True) if (f & WIDE).any()]
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            text = raw.tobytes() if len(at) else b""
            d = np.frombuffer(b"".join([hashlib.blake2b(text[a : a + length], digest_size=16).digest() for a in at.tolist()]), np.uint64).reshape(-1, 2)
            return at, d, split((d[:, 0] % np.uint64(n)).astype(np.int64), n) if len(at) else []

        def send(t: pa.Table, answers: pa.Table) -> pa.Table:
            if not t.num_rows:
                return messages([])
            chunk = t.column("chunk")[0].as_py()
            raw, _, seg = of(t)
            parts, _ = _batch(seg, n)
            flags, out = flags_of(inbox(answers), parts), []
            for s, (p, f) in enumerate(zip(parts, flags, strict=True)):
                take = np.flatnonzero((f & (SEND | WIDE)) == SEND)
                if len(take):
                    w, first = seg.windows[p[3][take]], seg.first[p[3][take]]
                    size = w + length - 1
                    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    out.append((s, chunk, 0, pack(p[0][take], w, raw[at])))
            _, d, to = hot(raw, seg, parts, flags)
            return messages(out + [(s, chunk, 3, pack(d[p, 0], d[p, 1])) for s, p in enumerate(to) if len(p)])

        def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["spans", "kept"] * spans]
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.list_(pa.int64())), pa.binary()]
            if not t.num_rows:
                return pa.table([pa.array([], t.schema.field("doc_id").type), *(pa.array([], k) for k in kinds[: len(names) - 1])], names=names)
            raw, off, seg = of(t)
            parts, order = _batch(seg, n)
            box = inbox(answers)
            bits = {(shard, k): unpack(data)[0] for shard, _, k, data in box if k in (2, 4)}
            flags, edge = flags_of(box, parts), np.zeros(len(raw) + 1, np.int32)

            def cover(at, size):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)

            for s, (p, f) in enumerate(zip(parts, flags, strict=True)):
                twice = np.flatnonzero(f & REPEATED)
                if len(twice):
                    c = p[2][twice]
                    at = order[np.repeat(p[4][twice] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                    cover(seg.first[at], seg.windows[at] + length - 1)
                take = np.flatnonzero((f & (SEND | WIDE)) == SEND)
                if len(take) and (s, 2) in bits:
                    w, at = windows_of(seg, p, take)
                    cover(at[np.unpackbits(bits[s, 2], count=len(at)).astype(bool) & np.repeat((f[take] & REPEATED) == 0, w)], length)
            at, _, to = hot(raw, seg, parts, flags)
            for s, p in enumerate(to):
                if len(p) and (s, 4) in bits:
                    cover(at[p[np.unpackbits(bits[s, 4], count=len(p)).astype(bool)]], length)
            gone = np.cumsum(edge[:-1]) > 0
            cols: list[list] = [[] for _ in names[1:]]
            for a, b in zip(off[:-1], off[1:], strict=True):
                g, text = gone[a:b], raw[a:b]
                runs = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0])))).reshape(-1, 2)
                kept = text[~g].tobytes() if len(runs) else text.tobytes()
                for c, v in zip(cols, (b - a, int(g.sum()), len(runs), hashlib.sha256(kept).hexdigest(), runs.tolist(), kept), strict=False):
                    c.append(v)
            return pa.table([t.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=names)

        asked = by_chunk.applyInArrow(ask, MESSAGE)
        for path in self.tables:
            asked = asked.union(self._read(path, MATCHES))
        limit = self.hot_segments
        told = asked.groupBy("shard").applyInArrow(lambda t: answer_segments(t, limit), MESSAGE)
        sent = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(send, MESSAGE)
        answers = told.union(sent.groupBy("shard").applyInArrow(lambda t: answer_windows(t, length), MESSAGE))
        more = ", spans array<array<long>>, kept binary" if spans else ""
        return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, spans: bool = False, batches: int = BATCHES) -> DataFrame:
    """SuffixIndex.resolve of all rows of docs, added in batches to an index of their own."""
    spark = docs.sparkSession
    index = SuffixIndex(spark, scratch(spark, "suffixes"), shards_for(spark, total_bytes(docs)), length, kgram)
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(batches)) == k))
    return index.resolve(docs, spans)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
