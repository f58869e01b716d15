"""Token ids of whole texts in a file format of canonical Huffman codes.

Writing: texts are encoded where they are read; ids wait as compressed 16 or 32 bit numbers; their counts, one row per
id of the vocabulary, give one length-limited canonical code for the whole corpus. Documents are then dealt out by
ranges of doc_id, sorted, coded, and packed. A pack is a row of a Parquet table: doc ids and lengths, the bits, and the
bit offset at which each block of BLOCK ids begins. Blocks decode independently, so a task decodes all blocks of a
pack in step, one table lookup for all of them at a time. The code's lengths, one number per id, are a second table.

A pack holds about PACK ids; a document longer than that is a pack of its own, so memory grows with one document only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import kept, new_path, tokenizer_path
from weekloom.llm.hashing import piece_hashes, text_chunks

BLOCK, PACK = 256, 1 << 19
MAX_BITS = 18
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces whose ids a worker keeps (some 20 bytes each), and ids of these (4 bytes each); when they are more, it starts anew.
CACHE, CACHED_IDS = 600_000, 4_000_000

IDS_SCHEMA = "doc_id long, n_tokens long, wide boolean, ids binary"
PACK_SCHEMA = "part int, pack int, first long, n_tokens long, doc_ids array<long>, sizes array<int>, checkpoints array<long>, bits binary"


# ---------------------------------------------------------------- encoding of texts


class Encoder:
    """Whole texts to ids with the tokenizers library.

    The tokenizer's normaliser and splitter never look across ASCII white space, nor across the place between an ASCII
    letter and one of .,;:!? beside it, and take A-Z and a-z alike. A text's ids are those of its pieces between such
    places, in order. Pieces are found and hashed by array operations over a batch of texts, each distinct piece is
    encoded once and kept, and ids are put together by array operations. Texts with "<|", where a special token could
    stand, are encoded as they are.
    """

    SPACE, LETTER, STOP, OTHER = range(4)

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self.kind = np.full(256, self.OTHER, np.uint8)
        self.kind[[*b" \t\n\r\x0b\x0c"]] = self.SPACE
        self.kind[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = self.LETTER
        self.kind[[*b".,;:!?"]] = self.STOP
        self.hashes, self.index = np.empty(0, np.uint64), np.empty(0, np.int32)  # sorted hashes of known pieces, and where their ids are
        self.begin, self.length, self.flat = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.index[at], self.hashes[at] == hashes

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.hashes) + len(pieces) > CACHE or len(self.flat) > CACHED_IDS:
            self.hashes, self.index = self.hashes[:0], self.index[:0]
            self.begin, self.length, self.flat = self.begin[:0], self.length[:0], self.flat[:0]
        ids = self._encode(pieces)
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        own = np.arange(len(self.begin), len(self.begin) + len(n), dtype=np.int32)
        self.begin = np.concatenate([self.begin, (len(self.flat) + np.cumsum(n) - n).astype(np.int32)])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([self.flat, np.fromiter((x for y in ids for x in y), np.uint32, int(n.sum()))])
        by = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[by])
        self.hashes, self.index = np.insert(self.hashes, at, hashes[by]), np.insert(self.index, at, own[by])

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. One of ASCII letters is one word to normaliser and splitter, and goes to the model at once; others of letters alone are one word with one closing token each, so that many go as one text."""
        word = self.tokenizer.model.tokenize
        out: list[list[int]] = [[y.id for y in word(x.lower())] if x.isascii() and x.isalpha() else [] for x in pieces]
        words = [k for k, x in enumerate(pieces) if x.isalpha() and not x.isascii()]
        rest = [k for k, x in enumerate(pieces) if not x.isalpha()]
        for a in range(0, len(words), 500):
            some = words[a : a + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[k] for k in some])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                for k, x in zip(some, np.split(ids, ends[:-1]), strict=True):
                    out[k] = x.tolist()
            else:
                rest += some
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text's closed by END_ID, and the number for each text."""
        import pandas as pd

        odd = {k: self.tokenizer.encode(x.decode(), add_special_tokens=False).ids for k, x in enumerate(texts) if b"<|" in x}
        joined = b" ".join(b"" if k in odd else x for k, x in enumerate(texts)) + b" "
        data = np.frombuffer(joined, np.uint8)
        kind = self.kind[data]
        before, cut = kind[:-1], np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = ((before == self.SPACE) | ((before == self.LETTER) & (kind[1:] == self.STOP)) | ((before == self.STOP) & (kind[1:] == self.LETTER)) | (kind[1:] == self.SPACE))
        starts = np.flatnonzero(cut & (kind != self.SPACE))
        cut[0] = False
        edges = np.flatnonzero(cut)
        ends = edges[np.searchsorted(edges, starts, "right")] if len(starts) else starts
        codes, distinct = pd.factorize(piece_hashes(data, starts, ends))
        where, known = self._find(distinct)
        if not known.all():
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            new = first[~known]
            pieces = [joined[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            if (len(self.hashes) + len(pieces) > CACHE or len(self.flat) > CACHED_IDS) and known.any():  # all of this batch are encoded into the emptied cache
                new = first
                pieces = [joined[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                self._add(distinct, pieces)
            else:
                self._add(distinct[~known], pieces)
            where, _ = self._find(distinct)
        which = where[codes]
        n = self.length[which]
        ends_of = np.cumsum([len(b"" if k in odd else x) + 1 for k, x in enumerate(texts)])
        upto = np.searchsorted(starts, ends_of)  # pieces up to the end of each text
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        sizes = np.diff(np.concatenate([[0], total[upto]]))
        inside = np.arange(total[-1], dtype=np.int32) - np.repeat(total[:-1].astype(np.int32) - self.begin[which], n)
        out = np.insert(self.flat[inside], total[upto], END_ID)
        if odd:
            parts = np.split(out, np.cumsum(sizes + 1)[:-1])
            for k, ids in odd.items():
                parts[k] = np.array([*ids, END_ID], np.uint32)
                sizes[k] = len(ids)
            out = np.concatenate(parts)
        return out, sizes + 1


def _encoder(path: str) -> Encoder:
    """A worker keeps its encoder, with the pieces it has seen, for the tasks that follow."""
    return kept(path, lambda: Encoder(path))


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at, upto, texts in text_chunks(batch):
                ids, sizes = encoder.encode(texts)
                ends = np.cumsum(sizes)
                wide, blobs = [], []
                for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                    own = ids[end - size : end]
                    wide.append(bool(own.max() > 0xFFFF))
                    blobs.append(own.astype("<u4" if wide[-1] else "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at:upto].cast(pa.int64()), pa.array(sizes), pa.array(wide), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "wide", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, wide, ids): each text's ids and END_ID as little-endian 16 or, if wide, 32 bit numbers. A null text is empty."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode_batches(path), IDS_SCHEMA)


def _ids(wide: bool, blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if wide else "<u2")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for wide, blob in zip(batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
            own = np.bincount(_ids(wide, blob.as_buffer()))
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code, at most max_bits, of least total length (package-merge); 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        kinds.append(by < len(leaves))
    take = 2 * len(leaves) - 2
    for kind in reversed(kinds):
        own = int(kind[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[s]):
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes one after another, first bit highest, and the bit at which each id's code begins."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    begins = ends - n
    total = int(ends[-1]) if len(ends) else 0
    word, shift = begins >> 5, 64 - (begins & 31) - n
    value = codes[ids] << shift.astype(np.uint64)
    # codes are shorter than a word, so that one begins in each word but perhaps the last, and bits never overlap
    heads = np.flatnonzero(np.diff(word, prepend=-1)) if len(word) else word
    out = np.zeros((total >> 5) + 2, np.uint64)
    if len(heads):
        out[word[heads]] = np.add.reduceat(value >> np.uint64(32), heads)
        out[word[heads] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], begins


def unpack_bits(bits: bytes, checkpoints: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, int]) -> np.ndarray:
    """Ids of all blocks, decoded in step: sizes has each block's number of ids, checkpoints the bit where it begins."""
    entries, most = table
    data = np.frombuffer(bits + bytes(8), np.uint8)
    # 32 bits from each byte on; a code of at most 24 bits lies in those that begin at its first byte
    window = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    out = np.empty(int(sizes.sum()), np.uint32)
    place, at = np.cumsum(sizes) - sizes, checkpoints.astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    place, at, left = place[order], at[order], sizes[order]
    drop, mask = np.uint32(32 - most), np.uint32((1 << most) - 1)
    for step in range(int(left[0]) if len(left) else 0):
        if left[len(at) - 1] <= step:
            live = int(np.searchsorted(-left, -step, "left"))
            at, place, left = at[:live], place[:live], left[:live]
        key = (window[at >> 3] >> (drop - (at & 7).astype(np.uint32))) & mask
        entry = entries[key]
        out[place + step] = entry >> 5
        at = at + (entry & 31)
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol << 5 | width) for each value of the next bits, and their number: as many as the longest code has."""
    most = max(1, int(lengths.max(initial=0)))
    entries = np.ones(1 << most, np.int64)
    codes = canonical(lengths)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        at = int(codes[s]) << (most - n)
        entries[at : at + (1 << (most - n))] = int(s) << 5 | n
    return entries, most


# ---------------------------------------------------------------- files


def _pack_batches(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, packs, first = TaskContext.get().partitionId(), 0, 0
        codes = canonical(lengths)
        held: list[tuple[int | None, np.ndarray]] = []

        def pack() -> pa.RecordBatch:
            nonlocal packs, first, held
            ids = np.concatenate([x for _, x in held])
            bits, begins = pack_bits(ids, codes, lengths)
            sizes = [len(x) for _, x in held]
            columns = [[part], [packs], [first], [len(ids)], [[d for d, _ in held]], [sizes], [begins[::BLOCK]], [bits]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            packs, first, held = packs + 1, first + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "pack", "first", "n_tokens", "doc_ids", "sizes", "checkpoints", "bits"])

        n = 0
        for batch in batches:
            for doc, wide, blob in zip(batch.column("doc_id").to_pylist(), batch.column("wide").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = _ids(wide, blob)
                if held and n + len(ids) > PACK:
                    yield pack()
                    n = 0
                held.append((doc, ids))
                n += len(ids)
        if held:
            yield pack()

    return run


def _dealt(ids: DataFrame, shuffled: int | None) -> DataFrame:
    """ids in the order of the file: by doc_id, or shuffled by a number, so that copies of a document stand apart."""
    ids = ids.withColumn("h", F.xxhash64("ids"))
    if shuffled is None:
        return ids.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    place = F.md5(F.concat_ws("|", F.lit(f"tokens {shuffled}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "h", F.col("row").cast("string")))
    return ids.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, max_bits: int = MAX_BITS, shuffled: int | None = None) -> None:
    """Writes path/code (id, bits), path/packs, in ascending doc_id order over parts and packs, or with a number for
    shuffled in an order that a hash of that number, doc_id, ids and the row's place in docs gives.

    Rows without a doc_id come first; rows of one doc_id are ordered by a hash of their ids; equal rows are coded each.
    Texts of any length are coded whole. An empty table gives no packs. Only doc_id and text are read. The code (at most
    one number per id of the vocabulary) goes through the driver.
    """
    spark = docs.sparkSession
    waiting = new_path(spark, "ids")
    # numbers of rows, by which copies of a document are told apart, are fixed once they are written
    encoded = encode(docs, tokenizer).withColumn("row", F.monotonically_increasing_id())
    encoded.write.option("compression", "zstd").parquet(waiting)
    ids = spark.read.schema(encoded.schema).parquet(waiting)
    counted = ids.select("wide", "ids").mapInArrow(_count_batches, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    _dealt(ids, shuffled).select("doc_id", "n_tokens", "wide", "ids").mapInArrow(_pack_batches(lengths), PACK_SCHEMA).write.option("compression", "none").parquet(f"{path}/packs")


def _decode_batches(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                starts = np.arange(0, row["n_tokens"], BLOCK)
                ids = unpack_bits(row["bits"], np.array(row["checkpoints"]), np.minimum(BLOCK, row["n_tokens"] - starts), table)
                ends = np.cumsum(row["sizes"])
                begins = ends - row["sizes"]
                raw = memoryview(ids.astype("<u4").tobytes())
                blobs = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["first"]), pa.array(ends - begins), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array([bytes(b) for b in blobs], pa.binary())],
                    ["part", "doc_id", "begin", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): start counts the ids of all documents before; ids are little-endian 32 bit.

    One row for each part goes through the driver, to know how many ids the parts before it hold.
    """
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r.id for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r.id] = r.bits
    packs = spark.read.schema(PACK_SCHEMA).parquet(f"{path}/packs")
    before, starts = 0, []
    for r in packs.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    rows = packs.select("part", "first", "n_tokens", "doc_ids", "sizes", "checkpoints", "bits").mapInArrow(_decode_batches(lengths), "part int, doc_id long, begin long, n_tokens long, ids_crc32 long, ids binary")
    parts = spark.createDataFrame(starts, "part int, before long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def report(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, shuffled: int | None = None) -> DataFrame:
    """Writes docs to path (by default in the shared folder) and gives doc_id, start, n_tokens, ids_crc32 as read from there."""
    path = path or new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, shuffled=shuffled)
    return read(docs.sparkSession, path, with_ids=False)
