"""Arrow batches of texts as byte arrays, and the words in them as numpy hashes.

Every function here works on one slice of a batch: whole texts, about a megabyte
together (a longer text makes a slice of its own), so a task's memory follows its
longest text and not the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


@dataclass
class Texts:
    """Rows ``first`` to ``last`` of a batch: bytes end to end, and where each text begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Words:
    """Words of a slice: byte bounds, text number, and a 64-bit hash each."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # bounds[i] to bounds[i + 1]: the words of text i

    def fits(self, length: int) -> np.ndarray:
        """First words of all runs of ``length`` words inside one text."""
        n = len(self.text) - length + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.text[:n] == self.text[length - 1 :])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cuts a column of strings into slices; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    _, bounds, body = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Texts(i, min(j, n), data[offsets[i] : offsets[min(j, n)]], offsets[i : min(j, n) + 1] - offsets[i])
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeds(n: int, start: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))


def byte_classes(chars: str) -> np.ndarray:
    """256 flags, true at the bytes of ``chars`` (ASCII)."""
    flags = np.zeros(256, bool)
    flags[list(chars.encode("ascii"))] = True
    return flags


BLANKS = byte_classes(" \t\n\v\f\r")
ALNUM = byte_classes("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_lower = np.arange(256)
_lower[65:91] += 32
EXACT_VALUES = seeds(256, 1)
LOWER_VALUES = EXACT_VALUES[_lower]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to ``n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, by one running sum."""
    powers, inverse = _power_tables(len(values))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(texts: Texts, word_bytes: np.ndarray, values: np.ndarray) -> Words:
    """Maximal runs of ``word_bytes``; ``values`` gives each byte its part in the hash."""
    data, offsets = texts.data, texts.offsets
    inside = word_bytes[data]
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside.copy()
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(starts, ends, text, run_hashes(values[data], starts, ends), bounds)


def windows(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``length`` words inside one text."""
    first = found.fits(length)
    return first, run_hashes(found.hashes, first, first + length)
