"""Texts of an Arrow batch as one array of bytes: words are found, hashed and numbered for all rows at once.

A batch is looked at in slices of bounded bytes, so what a Python worker holds follows from
SLICE and its longest text, not from the number of rows that Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def separators(*octets: int) -> bytes:
    """A table for cut(): these bytes part words, all others stay as they are."""
    return bytes(0x20 if b in octets else b for b in range(256))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch's rows in order, as (bytes, ends of the rows in them); nulls count as empty."""
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    octets = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield octets[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]
        at = to


class Words:
    """Words of a slice: their bytes in ``data`` from ``starts`` to ``ends``; row k has words first[k] to first[k + 1]."""

    def __init__(self, octets: np.ndarray, row_ends: np.ndarray, table: bytes):
        self.data = np.frombuffer(table, np.uint8)[octets]
        inside = np.zeros(len(octets) + 2, bool)
        inside[1:-1] = self.data != 0x20
        edges = inside[1:] != inside[:-1]
        starts, ends = edges & inside[1:], edges & inside[:-1]
        # a word that would run over the end of a row ends there, and another starts
        through = row_ends[(row_ends > 0) & (row_ends < len(octets))]
        through = through[inside[through] & inside[through + 1]]
        starts[through] = ends[through] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, row_ends)])

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, mixed."""
        up, down = power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word among the slice's distinct words, and these words."""
        lengths = self.ends - self.starts
        packed = self.data[spans(self.starts, lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of many spans, one span after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binaries(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One binary array from (bytes, lengths of the rows) of each slice."""
    lengths = np.concatenate([np.zeros(1, np.int64), *[p[1] for p in parts]])
    data = np.concatenate([np.zeros(0, np.uint8), *[p[0] for p in parts]])
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(lengths) - 1, [None, pa.py_buffer(np.cumsum(lengths).astype(np.int32)), pa.py_buffer(data)]
    )


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(total)


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n consecutive words of a slice lie within one row, by the word they start at."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[n - 1 :] == row[: len(row) - n + 1] if len(row) >= n else np.zeros(0, bool)


def winnow(grams: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions, rising, of the least of every window of w grams of k words in each row, the last of equals.

    grams: of all words of a slice. A row with fewer than w grams is one window.
    """
    if w == 1:
        return np.flatnonzero(whole(first, k))
    found = [np.zeros(0, np.int64)]
    if len(grams) >= w:
        backwards = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)
        at = len(grams) - 1 - (backwards.argmin(axis=1) + np.arange(len(backwards)))
        found.append(at[::-1][whole(first, k + w - 1)])
    n = np.diff(first) - k + 1
    for row in np.flatnonzero((n > 0) & (n < w)).tolist():
        few = grams[first[row] : first[row] + n[row]][::-1]
        found.append(np.array([first[row] + n[row] - 1 - int(few.argmin())]))
    return np.unique(np.concatenate(found))


def row_of(positions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row that holds each word position."""
    return np.searchsorted(first, positions, "right") - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words that hold no spaces."""
    octets = np.frombuffer(b" ".join(words), np.uint8)
    return Words(octets, np.array([len(octets)]), separators(0x20)).hashes()
