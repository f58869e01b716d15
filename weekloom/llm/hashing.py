"""Hashes of words and shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the pieces of data between starts and ends, A-Z as a-z.

    A piece is taken eight bytes at a time; each eight are mixed with their place, bit by bit, and the mixes are added. So
    no pattern of letters, however long, makes sums meet; two pieces do with the chance of random 64-bit numbers.
    """
    folded = np.zeros(len(data) + 8, np.uint8)
    folded[: len(data)] = _FOLD[data]
    eight = np.ndarray(len(data) + 1, "<u8", folded, strides=(1,))
    n = ends - starts
    sums = mix((eight[starts] & _MASK[np.minimum(n, 8)]) ^ _STEP)
    long = np.flatnonzero(n > 8)
    if len(long):
        more = (n[long] - 1) // 8
        first = np.cumsum(more) - more
        nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at, left = np.repeat(starts[long], more) + 8 * nth, np.repeat(n[long], more) - 8 * nth
        sums[long] += np.add.reduceat(mix((eight[at] & _MASK[np.minimum(left, 8)]) ^ mix((nth + 1).astype(np.uint64) * _STEP)), first)
    return mix(sums + n.astype(np.uint64) * _STEP)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space of all texts, A-Z as a-z, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.diff(_SPACE[joined].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    upto = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
    return piece_hashes(joined, starts, ends), np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of so many words; a text of fewer words is one shingle, of none empty."""
    words, counts = word_hashes(texts)
    step = _STEP
    fold = mix(words + step)
    for j in range(1, width):
        upto = max(0, len(words) - j)
        fold[:upto] = mix(fold[:upto] * step + words[j:])
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(fold[at : at + n - width + 1])
        elif n:
            own = mix(words[at : at + 1] + step)
            for j in range(1, n):
                own = mix(own * step + words[at + j : at + j + 1])
            yield own
        else:
            yield fold[:0]
        at += n


def chunks(texts: list[bytes], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts with about so many bytes together."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < chars):
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def text_chunks(batch: pa.RecordBatch, column: str = "text", rows: int = 500) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) of runs of a batch's rows; a null text is empty. Few texts are taken out of the batch at a time."""
    for at in range(0, batch.num_rows, rows):
        texts = [x or b"" for x in batch.column(column).slice(at, rows).cast(pa.binary()).to_pylist()]
        for a, b in chunks(texts):
            yield at + a, at + b, texts[a:b]
