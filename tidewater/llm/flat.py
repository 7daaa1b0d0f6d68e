"""Vectorised text kernels: a batch of texts as one UTF-8 buffer, with words, lines and 64-bit slice hashes.

Every kernel works on whole texts. Batches are cut only between texts, so memory follows
``max_bytes`` plus the longest single text, never the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = U64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: True for the bytes that separate words: 09-0D and 20.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=U64)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts of about ``max_bytes``, with the index of their first text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > max_bytes:
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(texts) > start:
        yield start, texts.slice(start)


class FlatText:
    """Texts (null counts as empty) laid end to end; ``offsets[i]:offsets[i + 1]`` is text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        raw = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.offsets = (raw - raw[0]).astype(np.int64)
        size = int(self.offsets[-1])
        self.bytes = np.frombuffer(data, np.uint8)[raw[0] : raw[0] + size] if size else np.empty(0, np.uint8)
        if lower:
            self.bytes = _LOWER[self.bytes]
        self.n = len(texts)
        self._prefix: np.ndarray | None = None

    def _edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of ``inside`` that don't cross texts."""
        size = len(inside)
        if not size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.zeros(size + 1, bool)
        first[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:size]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:size]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each text the index of its first word (one more entry at the end)."""
        starts, ends = self._edges(~IS_SPACE[self.bytes])
        return starts, ends, np.searchsorted(starts, self.offsets).astype(np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Starts and ends of the ``\n``-split lines of every text, and each text's first line.

        Every text has at least one line, which may be empty.
        """
        breaks = np.flatnonzero(self.bytes == 10)
        owner = np.searchsorted(self.offsets, breaks, side="right") - 1
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        text = np.concatenate([np.arange(self.n), owner])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        first = np.searchsorted(text, np.arange(self.n + 1)).astype(np.int64)
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        if self.n:
            ends[first[1:] - 1] = self.offsets[1:]
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each slice; equal bytes have equal hashes wherever they stand."""
        if self._prefix is None:
            powers, _ = _power_tables(len(self.bytes) + 1)
            self._prefix = np.zeros(len(self.bytes) + 1, U64)
            np.cumsum((self.bytes.astype(U64) + U64(1)) * powers[: len(self.bytes)], out=self._prefix[1:])
        inverse = _power_tables(len(self.bytes) + 1)[1]
        body = (self._prefix[ends] - self._prefix[starts]) * inverse[starts]
        return mix(body + (ends - starts).astype(U64) * _LENGTH)

    def code_points(self) -> np.ndarray:
        """Prefix counts of code points: entry i holds those that begin before byte i."""
        out = np.zeros(len(self.bytes) + 1, np.int64)
        np.cumsum((self.bytes & 0xC0) != 0x80, out=out[1:])
        return out

    def counts(self, mark: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        total = np.zeros(len(mark) + 1, np.int64)
        np.cumsum(mark, out=total[1:])
        return np.diff(total[self.offsets])


_ORDER = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


def shingle_sets(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of distinct ``words``-word shingles of A-Z lower-cased text, as sorted 64-bit hashes.

    Returns the hashes of all texts end to end, and offsets. A text with fewer words has its
    whole sequence as one shingle; one without words has the empty set.
    """
    flat = FlatText(texts, lower=True)
    starts, ends, first = flat.words()
    word = flat.hashes(starts, ends)
    count = np.diff(first)
    order = np.resize(_ORDER, words) + np.arange(words, dtype=U64) * U64(2)
    windows = max(0, len(word) - words + 1)
    total = np.zeros(windows, U64)
    for k in range(words):
        total += word[k : k + windows] * order[k]
    total = mix(total)
    sets: list[np.ndarray] = []
    for a, n in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if n >= words:
            sets.append(np.unique(total[a : a + n - words + 1]))
        elif n:
            sets.append(mix((word[a : a + n] * order[:n]).sum(dtype=U64, keepdims=True) + np.array([n], U64) * _LENGTH))
        else:
            sets.append(np.empty(0, U64))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, U64)), offsets
