"""Suffix-array dedup: bytes of strings that already stand in a document with a smaller id go.

A string is min_bytes bytes, a window. Suffixes that can't share a window with another document are left out first: the
key of a window is the least hash of its k-grams, so that equal windows have equal keys, and neighbouring windows mostly
share one. A run is windows in a row with one key. Only runs whose key stands in two chunks, or in two documents of one
chunk, go on; their bytes are dealt out by key. There all suffixes of the runs are put in order by deep-shallow
sorting: a multikey quicksort, whose characters are eight bytes, to a shallow depth, and blind tries for those that agree
so far. Suffixes that agree on a whole window stand together; the smallest document of each such group keeps it.

Texts are packed into chunks, and equal runs of a chunk are sent once, under the smallest id, so that a passage of a third of all documents
costs a row for each chunk. A bucket with more than LIMIT bytes of different runs, as of a hot key with a
different text around it each time, isn't sorted in its task: its windows are grouped by Spark, which gives the same rows.
Equality is always that of bytes; hashes only choose what meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import written
from weekloom.llm.hashing import mix

MIN_BYTES = 50
#: Bytes of texts in a chunk (a longer text is a chunk of its own), and keys that a bucket gets on average.
CHUNK, KEYS = 2_000_000, 1_000_000
#: Bytes of runs that a task sorts itself.
LIMIT = 64_000_000
#: Depth of the multikey quicksort, in characters of eight bytes.
SHALLOW = 3
_BLOCK, _LONGEST, _LOW = 1 << 16, 64, np.uint64((1 << 40) - 1)
CHUNK_SCHEMA = "chunk long, ids array<long>, sizes array<long>, texts binary"
KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary"


def words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each byte on as one big-endian number, without a copy; data ends with seven bytes more."""
    return np.ndarray(max(0, len(data) - 7), ">u8", data, strides=(1,))


def window_keys(data: np.ndarray, n: int) -> np.ndarray:
    """The key of each window of n bytes: the least hash of its k-grams."""
    k = max(8, min(18, n // 2))
    w, count = words(data), len(data) - k + 1
    h = mix(w[:count] * np.uint64(0x9E3779B97F4A7C15))
    for at in {min(8, k - 8), k - 8} - {0}:
        h = mix((h + w[at : at + count]) * np.uint64(0xC2B2AE3D27D4EB4F))
    span = 1
    while span * 2 <= n - k + 1:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    rest = n - k + 1 - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Chunk:
    """Texts of a chunk, in order of their ids; those without an id come last and take no part."""

    def __init__(self, row: dict, n: int, buckets: int):
        self.n, self.buckets = n, buckets
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        total = int(self.ends[-1])
        self.blob = pa.decompress(row["texts"], total, "zstd", asbytes=True) if total else b""
        self.known = sum(x is not None for x in self.ids)
        self.number = np.array(self.ids[: self.known], np.int64)

    def runs(self) -> None:
        """start, stop (of windows), doc, key and bucket of each run."""
        n, size = self.n, int(self.ends[self.known - 1]) if self.known else 0
        data, starts, keys = np.frombuffer(self.blob, np.uint8), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        edges = np.unique(np.concatenate([[0], self.ends[: self.known], np.maximum(0, self.ends[: self.known] - n + 1)]))
        for a in range(0, size - n + 1, _BLOCK):
            key = window_keys(data[a : min(a + _BLOCK, size - n + 1) + n - 1], n)
            cut = np.ones(len(key), bool)
            cut[1:] = key[1:] != key[:-1]
            cut[edges[np.searchsorted(edges, a) : np.searchsorted(edges, a + len(key))] - a] = True
            at = np.flatnonzero(cut)
            starts.append(at + a)
            keys.append(key[at])
        start, key = np.concatenate(starts), mix(np.concatenate(keys))
        stop = np.append(start[1:], max(0, size - n + 1))[: len(start)]
        pieces = -(-(stop - start) // _LONGEST)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, key = np.repeat(start, pieces) + nth * _LONGEST, np.repeat(key, pieces)
            stop = np.minimum(start + _LONGEST, np.repeat(stop, pieces))
        doc = np.searchsorted(self.ends[: self.known], start, "right")
        inside = start + n <= self.ends[doc] if len(start) else np.zeros(0, bool)
        self.start, self.stop, self.doc = start[inside], stop[inside], doc[inside]
        key = key[inside]
        self.bucket = ((key >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        self.key = (self.bucket.astype(np.uint64) << np.uint64(40)) | (key & _LOW)

    def common(self, told: np.ndarray) -> None:
        """Leaves the runs whose key is in two documents of the chunk or was told; which is the number of a run's bytes, first the smallest document that has them."""
        by = np.lexsort((self.doc, self.key))
        key, doc = self.key[by], self.doc[by]
        two = key[1:][(key[1:] == key[:-1]) & (doc[1:] != doc[:-1])]
        on = np.isin(self.key, np.union1d(two, told))
        self.start, self.stop, self.doc, self.key, self.bucket = (x[on] for x in (self.start, self.stop, self.doc, self.key, self.bucket))
        seen, blob, n = {}, self.blob, self.n - 1
        which = [seen.setdefault(blob[a : b + n], len(seen)) for a, b in zip(self.start.tolist(), self.stop.tolist(), strict=True)]
        self.texts, self.which = list(seen), np.array(which, np.int64)
        self.first = np.unique(self.which, return_index=True)[1]


def _packed(keys: np.ndarray) -> bytes:
    """Keys of one bucket, five bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(bucket: int, blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view("<u8")[:, 0].astype(np.uint64) | (np.uint64(bucket) << np.uint64(40))


def _chunk_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, nth = [], [], 0, TaskContext.get().partitionId() << 32

        def made() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            blob = pa.compress(b"".join([texts[i] for i in order]), "zstd", asbytes=True)
            row = {"chunk": nth, "ids": [ids[i] for i in order], "sizes": [len(texts[i]) for i in order], "texts": blob}
            return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for i, x in zip(some.column("doc_id").to_pylist(), some.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(x or b"")
                    held += len(texts[-1])
                    if held >= size:
                        yield made()
                        ids, texts, held, nth = [], [], 0, nth + 1
        if ids:
            yield made()

    return run


def _key_batches(n: int, buckets: int):
    """(bucket, chunk, keys): the different keys of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                chunk = Chunk(row, n, buckets)
                chunk.runs()
                keys = np.unique(chunk.key)
                bucket = (keys >> np.uint64(40)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                blobs = [_packed(x) for x in np.split(keys, edges[1:])] if len(edges) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(np.full(len(edges), row["chunk"])), pa.array(blobs, pa.binary())], ["bucket", "chunk", "keys"])

    return run


def _of_buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, dict | None]]:
    """(bucket, a row's columns) of rows sorted by bucket, and (bucket, None) where a bucket ends."""
    now = None
    for batch in batches:
        for row in batch.select(["bucket", *columns]).to_pylist():
            if now is not None and row["bucket"] != now:
                yield now, None
            now = row["bucket"]
            yield now, row
    if now is not None:
        yield now, None


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, bucket, keys): of each chunk's keys those that another chunk has too."""
    chunks, blobs = [], []
    for bucket, row in _of_buckets(batches, ["chunk", "keys"]):
        if row is not None:
            chunks.append(row["chunk"])
            blobs.append(row["keys"])
            continue
        keys = _unpacked(bucket, b"".join(blobs))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        on, out, at = np.isin(keys, twice), [], 0
        for chunk, blob in zip(chunks, blobs, strict=True):
            own = slice(at, at + len(blob) // 5)
            at = own.stop
            if on[own].any():
                out.append((chunk, bucket, _packed(keys[own][on[own]])))
        yield pa.RecordBatch.from_pylist([dict(zip(("chunk", "bucket", "keys"), x, strict=True)) for x in out], pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary())]))
        chunks, blobs = [], []


def _told(row: dict) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *[_unpacked(x["bucket"], x["keys"]) for x in row["told"] or []]])


def _run_batches(n: int, buckets: int):
    """(bucket, chunk, local, docs, lengths, texts): the different runs of each chunk whose keys are common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                chunk = Chunk(row, n, buckets)
                chunk.runs()
                chunk.common(_told(row))
                bucket = chunk.bucket[chunk.first]
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out = []
                for some in np.split(order, edges[1:]) if len(edges) else []:
                    texts = [chunk.texts[i] for i in some.tolist()]
                    docs, lengths = chunk.number[chunk.doc[chunk.first[some]]], np.fromiter(map(len, texts), "<u4", len(texts))
                    out.append((int(bucket[some[0]]), row["chunk"], some.astype("<u4").tobytes(), docs.astype("<i8").tobytes(), lengths.tobytes(), pa.compress(b"".join(texts), "zstd", asbytes=True)))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("bucket", "chunk", "local", "docs", "lengths", "texts"), x, strict=True)) for x in out],
                    pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("local", "docs", "lengths", "texts"))]),
                )

    return run


def _agreed(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes on which the suffixes at a and b agree, up to depth."""
    w, agreed, on = words(data), np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, depth, 8):
        x = w[a[on] + at].astype(np.uint64) ^ w[b[on] + at].astype(np.uint64)
        same = np.full(len(on), 8)
        for j in range(8):
            same[x >= np.uint64(1 << (8 * j))] = 7 - j
        agreed[on] = at + same
        on = on[same == 8]
    return np.minimum(agreed, depth)


def deep_shallow(data: np.ndarray, suffixes: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at these bytes, by their first depth bytes, and the group of each in that order: equal bytes, equal group.

    data has depth + 8 bytes after each start at least. Multikey quicksort: all groups of suffixes that agree so far are split at
    once by the next character of eight bytes. From shallow characters on, groups are given to blind tries, which grow at once, a
    level at a time: a node's depth is the least number of bytes on which a member agrees with the first one, and its
    members branch by the byte there; no other byte is compared.
    """
    order, group, w = np.arange(len(suffixes)), np.zeros(len(suffixes), np.int64), words(data)
    active = order.copy()  # places of order in groups of more than one
    for level in range(min(shallow, depth // 8)):
        own, character = order[active], w[suffixes[order[active]] + 8 * level].astype(np.uint64)
        by = np.lexsort((character, group[active])) if level else np.argsort(character, kind="stable")
        own, character, old = own[by], character[by], group[active][by]
        order[active] = own
        new = np.ones(len(own), bool)
        new[1:] = (character[1:] != character[:-1]) | (old[1:] != old[:-1])
        first = np.flatnonzero(new)
        group[active] = active[first][np.cumsum(new) - 1]  # named by its first place
        active = active[np.repeat(np.diff(np.append(first, len(own))) > 1, np.diff(np.append(first, len(own))))]
    while len(active):
        start = suffixes[order[active]]
        first = np.flatnonzero(np.diff(group[active], prepend=-1))
        sizes = np.diff(np.append(first, len(active)))
        agreed = _agreed(data, start, np.repeat(start[first], sizes), depth)
        node = np.minimum.reduceat(agreed, first)
        inner = np.repeat(node < depth, sizes)
        if not inner.any():
            break
        active, start, branch = active[inner], start[inner], np.repeat(node, sizes)[inner]
        byte = data[start + branch].astype(np.int64)
        by = np.argsort(group[active] * 256 + byte, kind="stable")
        old, byte = group[active][by], byte[by]
        order[active] = order[active][by]
        new = np.ones(len(by), bool)
        new[1:] = (byte[1:] != byte[:-1]) | (old[1:] != old[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(by)))
        group[active] = active[first][np.cumsum(new) - 1]
        active = active[np.repeat(sizes > 1, sizes)]
    return order, group


def earlier(texts: list[bytes], docs: np.ndarray, n: int) -> np.ndarray:
    """For each run, bits of its windows that also stand in a run of a smaller document."""
    if not len(texts):
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = lengths - n + 1
    of = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    data = np.frombuffer(b"".join(texts) + bytes(n + 16), np.uint8)
    order, group = deep_shallow(data, (np.cumsum(lengths) - lengths)[of] + nth, n)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(docs[of[order]], first)
    gone = np.repeat(least, np.diff(np.append(first, len(order)))) < docs[of[order]]
    bits = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(bits, of[order[gone]], np.uint64(1) << nth[order[gone]].astype(np.uint64))
    return bits


_FOUND = pa.schema([("chunk", pa.int64()), ("local", pa.binary()), ("bits", pa.binary()), ("one", pa.int64()), ("bit", pa.int64()), ("doc", pa.int64()), ("window", pa.binary())])
FOUND_SCHEMA = "chunk long, local binary, bits binary, one long, bit long, doc long, window binary"


def _sort_batches(n: int, limit: int, piece: int = 60_000):
    """(chunk, local, bits) of the runs with windows that go. Of a bucket with more than limit bytes: all windows, one a row."""

    def whole(held: list[dict]) -> Iterator[pa.RecordBatch]:
        runs = [np.frombuffer(b"".join(x[c] for x in held), t) for c, t in (("docs", "<i8"), ("local", "<u4"))]
        texts = [t for x in held for t in cut(x)]
        chunk = np.repeat([x["chunk"] for x in held], [len(x["local"]) // 4 for x in held])
        # windows of one key stand in runs of one key: these stay together
        key = np.concatenate([window_keys(np.frombuffer(b"".join(t[:n] for t in texts[a : a + 10_000]), np.uint8), n)[::n] for a in range(0, len(texts), 10_000)])
        order = np.argsort(key, kind="stable")
        edges, bits, a = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(order)), np.zeros(len(texts), np.uint64), 0
        while a < len(order):
            b = int(edges[min(np.searchsorted(edges, a + piece), len(edges) - 1)])
            some = order[a:b]
            bits[some] = earlier([texts[i] for i in some.tolist()], runs[0][some], n)
            a = b
        on = np.flatnonzero(bits)
        on = on[np.argsort(chunk[on], kind="stable")]
        out = [{"chunk": int(chunk[x[0]]), "local": runs[1][x].tobytes(), "bits": bits[x].astype("<u8").tobytes()} for x in np.split(on, np.flatnonzero(np.diff(chunk[on])) + 1) if len(x)]
        yield pa.RecordBatch.from_pylist(out, _FOUND)

    def cut(row: dict) -> list[bytes]:
        lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        blob = pa.decompress(row["texts"], int(lengths.sum()), "zstd", asbytes=True)
        ends = np.cumsum(lengths)
        return [blob[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]

    def single(row: dict) -> Iterator[pa.RecordBatch]:
        every = zip(cut(row), np.frombuffer(row["docs"], "<i8").tolist(), np.frombuffer(row["local"], "<u4").tolist(), strict=True)
        for t, doc, one in every:
            yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "one": one, "bit": j, "doc": doc, "window": t[j : j + n]} for j in range(len(t) - n + 1)], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, over = [], 0, False
        for _, row in _of_buckets(batches, ["chunk", "local", "docs", "lengths", "texts"]):
            if row is None:
                if held:
                    yield from whole(held)
                held, size, over = [], 0, False
                continue
            held.append(row)
            size += int(np.frombuffer(row["lengths"], "<u4").sum())
            over = over or size > limit
            if over:
                for x in held:
                    yield from single(x)
                held = []

    return run


def _kept_batches(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                chunk = Chunk(row, n, buckets)
                chunk.runs()
                chunk.common(_told(row))
                bits = np.zeros(len(chunk.texts), np.uint64)
                for x in row["found"] or []:
                    np.bitwise_or.at(bits, np.frombuffer(x["local"], "<u4"), np.frombuffer(x["bits"], "<u8").astype(np.uint64))
                data = np.frombuffer(chunk.blob, np.uint8)
                step = np.zeros(len(data) + 1, np.int32)
                later = chunk.number[chunk.doc] > chunk.number[chunk.doc[chunk.first]][chunk.which] if len(chunk.which) else np.zeros(0, bool)
                np.add.at(step, chunk.start[later], 1)
                np.add.at(step, chunk.stop[later] + n - 1, -1)
                some = np.flatnonzero(~later & (bits[chunk.which] > 0)) if len(chunk.which) else np.zeros(0, np.int64)
                run_of, nth = np.nonzero(np.unpackbits(bits[chunk.which[some]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(some) else (some, some)
                at = chunk.start[some[run_of]] + nth if len(some) else some
                np.add.at(step, at, 1)
                np.add.at(step, at + n, -1)
                gone = np.cumsum(step[:-1]) > 0
                before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
                begins, ends = chunk.ends - chunk.sizes, chunk.ends
                real = begins[chunk.sizes > 0]
                before[real] = False  # runs never cross documents
                after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
                after[ends[chunk.sizes > 0] - 1] = False
                lo, hi = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
                kept_ends = np.concatenate([[0], np.cumsum(~gone)])
                kept = data[~gone].tobytes()
                doc = np.searchsorted(ends, lo, "right")
                upto = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ends)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x - begins[doc])) for x in (lo, hi)]
                left = [kept[a:b] for a, b in zip(kept_ends[begins].tolist(), kept_ends[ends].tolist(), strict=True)]
                removed = chunk.sizes - np.fromiter(map(len, left), np.int64, len(left))
                yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes), pa.array(removed), *lists, pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "span_starts", "span_ends", "kept"])

    return run


def kept_bytes(docs: DataFrame, min_bytes: int = MIN_BYTES, chunk: int = CHUNK, keys: int = KEYS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, span_starts, span_ends, kept) for each row: kept is what is left of the text's UTF-8 bytes.

    Each byte goes that is covered by a string of min_bytes bytes (16 at least) that also starts in a document with a smaller doc_id; all
    strings are judged on the input. Spans are the maximal removed runs, in bytes. A null or empty text, and one shorter than min_bytes, loses
    nothing. Rows of one doc_id take nothing from each other; rows without a doc_id lose nothing and nothing goes for
    their sake. An empty table gives no rows. Of other columns only doc_id and text are read, whatever their names.
    """
    if min_bytes < 16:
        raise ValueError("min_bytes must be 16 at least")
    packed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_chunk_batches(chunk), CHUNK_SCHEMA), "chunks", "uncompressed")
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(8, -(-total // 17 // keys))
    by_bucket = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    own = packed.mapInArrow(_key_batches(min_bytes, buckets), "bucket int, chunk long, keys binary")
    shared = written(by_bucket(own).mapInArrow(_shared_batches, "chunk long, bucket int, keys binary"), "shared")
    told = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys")).alias("told"))
    runs = packed.join(told, "chunk", "left").mapInArrow(_run_batches(min_bytes, buckets), "bucket int, chunk long, local binary, docs binary, lengths binary, texts binary")
    found = written(by_bucket(runs).mapInArrow(_sort_batches(min_bytes, limit), FOUND_SCHEMA), "found")
    single = found.where("window is not null")
    least = single.groupBy("window").agg(F.min("doc").alias("least"))
    bits = single.join(least, "window").where("least < doc").groupBy("chunk", "one").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    little = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * j - 1, 2) for j in range(n, 0, -1)]))
    both = found.where("window is null").select("chunk", "local", "bits").unionByName(bits.select("chunk", little(F.col("one"), 4).alias("local"), little(F.col("bits"), 8).alias("bits")))
    found = both.groupBy("chunk").agg(F.collect_list(F.struct("local", "bits")).alias("found"))
    return packed.join(told, "chunk", "left").join(found, "chunk", "left").mapInArrow(_kept_batches(min_bytes, buckets), KEPT_SCHEMA)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, as kept_bytes() says."""
    return kept_bytes(docs, **options).select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
