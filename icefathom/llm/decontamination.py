"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that a document holds with at most ``e = m // 16`` edits shares
at least ``m - q + 1 - q * e`` character q-grams with the place where it stands, all of
them on diagonals no further than e apart. Shared q-grams are counted per document, item
and diagonal band; the bands are twice as wide as their step, so that every such place
lies wholly in one of them. Bands that meet the bound are aligned (edit distance of the
whole item against the band's stretch of the document, bit-parallel), and places within
the budget are reported. Latin letters are compared without case and any white space
counts as one blank.

Items of 48 bytes or more use q = 12, shorter ones q = 6, and items below 16 bytes must
stand there unchanged. The benchmark travels to the tasks in blocks of at most
``BLOCK_BYTES`` of text; a larger benchmark makes several passes over the documents, each
stored before the next block is read, so that neither driver nor broadcasts grow with it.

Defined cases: a null or empty text holds nothing; a null or blank item is nowhere; items
with equal texts are all reported. Texts are read whole. Repeated rows give repeated
results, an empty benchmark leaves every document clean. The input's other columns stay;
one called ``spans`` is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.llm.batches import BLANKS, EXACT_VALUES, Texts, run_hashes, slices
from icefathom.llm.columns import shield
from icefathom.session import ensure_checkpoint_dir

#: One edit is allowed for so many bytes of an item.
BYTES_PER_EDIT = 16
LONG_ITEM, LONG_GRAM, SHORT_GRAM = 48, 12, 6
#: Benchmark text that one pass over the documents carries.
BLOCK_BYTES = 16 << 20
_MAP_BITS = 20
_PAIRS_AT_ONCE = 1 << 21
_lowered = np.arange(256, dtype=np.uint8)
_lowered[65:91] += 32
_lowered[BLANKS] = 32

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("edits", T.IntegerType()),
        ]
    )
)


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes without case: ASCII letters, and the two-byte Latin letters of U+00C0 to U+00DE."""
    out = _lowered[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[capital] += 32
    return out


def normalised(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one blank for any white space, where each text begins, and
    the original place of each byte."""
    data = _folded(texts.data)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = True
    places = np.flatnonzero(keep)
    return data[places], np.searchsorted(places, texts.offsets), places


def plain(text: str) -> bytes:
    """One item as documents are compared with it."""
    return b" ".join(_folded(np.frombuffer(text.encode(), np.uint8)).tobytes().split())


@dataclass
class GramIndex:
    """Postings of the q-grams of some items."""

    q: int
    grams: np.ndarray
    first: np.ndarray
    items: np.ndarray
    at: np.ndarray
    seen: np.ndarray

    @classmethod
    def build(cls, items: list[bytes], numbers: list[int], q: int) -> GramIndex:
        hashes, owner, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in numbers:
            data = np.frombuffer(items[n], np.uint8)
            starts = np.arange(max(0, len(data) - q + 1))
            hashes.append(run_hashes(EXACT_VALUES[data], starts, starts + q))
            owner.append(np.full(len(starts), n))
            at.append(starts)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << _MAP_BITS, bool)
        seen[grams >> np.uint64(64 - _MAP_BITS)] = True
        return cls(q, grams, np.append(first, len(every)), np.concatenate(owner)[order], np.concatenate(at)[order], seen)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' q-grams that some item has, and their number in ``grams``."""
        n = len(data) - self.q + 1
        if n <= 0 or not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.arange(n)
        hashes = run_hashes(EXACT_VALUES[data], starts, starts + self.q)
        places = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _MAP_BITS)])
        number = np.minimum(np.searchsorted(self.grams, hashes[places]), len(self.grams) - 1)
        true = self.grams[number] == hashes[places]
        places, number = places[true], number[true]
        inside = offsets[np.searchsorted(offsets, places, "right")] >= places + self.q
        return places[inside], number[inside]


def edit_place(item: bytes, stretch: bytes, budget: int) -> tuple[int, int, int] | None:
    """Least edits of the whole item within ``stretch``: (edits, start, end), or None."""
    found = _least(item, stretch)
    if found is None or found[0] > budget:
        return None
    edits, end = found
    back = _least(item[::-1], stretch[:end][::-1], anchored=True)
    return edits, end - (back[1] if back else len(item)), end


def _least(item: bytes, stretch: bytes, anchored: bool = False) -> tuple[int, int] | None:
    """Bit-parallel edit distance (one bit for each byte of the item): least and its first end.

    ``anchored``: the match begins at the start of the stretch.
    """
    m = len(item)
    if not m:
        return None
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    plus, minus, cost, best, end = full, 0, m, m, 0
    for j, c in enumerate(stretch):
        eq = masks.get(c, 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        rise = minus | (full & ~(eq | plus))
        fall = plus & eq
        if rise & top:
            cost += 1
        elif fall & top:
            cost -= 1
        rise = ((rise << 1) | anchored) & full
        fall = (fall << 1) & full
        plus = fall | (full & ~(vertical | rise))
        minus = rise & vertical
        if cost < best:
            best, end = cost, j + 1
    return best, end


class Benchmark:
    """Items of one block, ready for the tasks."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        kept = [(n, plain(t)) for n, t in rows if t is not None]
        kept = sorted((n, t) for n, t in kept if t and n is not None)
        self.ids = [n for n, _ in kept]
        self.items = [t for _, t in kept]
        self.budget = np.array([len(t) // BYTES_PER_EDIT for t in self.items], np.int64)
        self.long = [i for i, t in enumerate(self.items) if len(t) >= LONG_ITEM]
        self.short = [i for i, t in enumerate(self.items) if BYTES_PER_EDIT <= len(t) < LONG_ITEM]
        self.tiny = [i for i, t in enumerate(self.items) if len(t) < BYTES_PER_EDIT]
        self.sizes = np.array([len(t) for t in self.items], np.int64)

    def indexes(self) -> list[GramIndex]:
        return [GramIndex.build(self.items, own, q) for own, q in ((self.long, LONG_GRAM), (self.short, SHORT_GRAM)) if own]

    def candidates(self, index: GramIndex, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, lowest, highest diagonal) of the bands that meet the lemma's bound."""
        places, number = index.hits(data, offsets)
        if not len(places):
            return
        text = np.searchsorted(offsets, places, "right") - 1
        step = self.budget[index.items] + 1
        many = np.diff(index.first)[number]
        ends = np.cumsum(many)
        kept_keys, kept_counts = [], []
        a = 0
        while a < len(places):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _PAIRS_AT_ONCE, "right")))
            size = many[a:b]
            posting = np.repeat(index.first[number[a:b]], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            item = index.items[posting]
            owner = np.repeat(text[a:b], size)
            # Diagonals from 0: the item's start against the text's start, shifted by its length.
            diagonal = np.repeat(places[a:b], size) - offsets[owner] - index.at[posting] + self.sizes[item]
            band = diagonal // step[posting]
            keys = np.empty(2 * len(band), [("text", np.int64), ("item", np.int64), ("band", np.int64)])
            for half in (0, 1):
                part = slice(half * len(band), (half + 1) * len(band))
                keys["text"][part], keys["item"][part], keys["band"][part] = owner, item, band - half
            lead = (keys["text"] * len(self.items) + keys["item"]).astype(np.int64)
            width = int(keys["band"].max()) + 3
            values, counts = np.unique(lead * width + keys["band"] + 1, return_counts=True)
            kept_keys.append(np.stack((values // width, values % width - 1), axis=1))
            kept_counts.append(counts)
            a = b
        pairs = np.concatenate(kept_keys)
        counts = np.concatenate(kept_counts)
        if len(kept_keys) > 1:
            pairs, inverse = np.unique(pairs, axis=0, return_inverse=True)
            counts = np.bincount(inverse.ravel(), weights=counts).astype(np.int64)
        item = pairs[:, 0] % len(self.items)
        bound = np.maximum(self.sizes[item] - index.q + 1 - index.q * self.budget[item], 1)
        for row in np.flatnonzero(counts >= bound):
            n, wide = int(item[row]), int(self.budget[item[row]]) + 1
            low = int(pairs[row, 1]) * wide - int(self.sizes[n])
            yield int(pairs[row, 0] // len(self.items)), n, low, low + 2 * wide - 1

    def spans(self, part: Texts, indexes: list[GramIndex]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the places of items: (item_id, start, end, edits), bytes of the text."""
        data, offsets, places = normalised(part)
        found: list[dict[tuple[int, int, int], int]] = [{} for _ in range(len(part))]

        def keep(text: int, n: int, start: int, end: int, edits: int) -> None:
            origin = part.offsets[text]
            key = (self.ids[n], int(places[start] - origin), int(places[end - 1] - origin) + 1)
            found[text][key] = min(edits, found[text].get(key, edits))

        for index in indexes:
            for text, n, low, high in self.candidates(index, data, offsets):
                a = max(int(offsets[text]), int(offsets[text]) + low)
                b = min(int(offsets[text + 1]), int(offsets[text]) + high + int(self.sizes[n]))
                place = edit_place(self.items[n], data[a:b].tobytes(), int(self.budget[n])) if b > a else None
                if place:
                    keep(text, n, a + place[1], a + place[2], place[0])
        for n in self.tiny:
            for text in range(len(part)):
                body = data[offsets[text] : offsets[text + 1]].tobytes()
                at = body.find(self.items[n])
                while at >= 0:
                    start = int(offsets[text]) + at
                    keep(text, n, start, start + len(self.items[n]), 0)
                    at = body.find(self.items[n], at + 1)
        return [[(*key, edits) for key, edits in sorted(spots.items())] for spots in found]


def find(docs: DataFrame, bench: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds ``spans``: every place of the text where a benchmark item stands.

    A benchmark of one block is searched when the result is read. Of a larger one each block
    (by hash) is read, searched and its result stored before the next one is read.
    """
    docs, restore = shield(docs, (text,), ("spans",))
    out = docs.withColumn("spans", F.lit(None).cast(SPANS))
    kept = bench.select(F.col(item_key).cast("long").alias("key"), F.col(item_text).alias("text")).distinct()
    total = kept.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    if n > 1:
        ensure_checkpoint_dir(docs.sparkSession)
    for b in range(n):
        own = kept if n == 1 else kept.filter(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == b)
        out = _search(out, Benchmark([(r["key"], r["text"]) for r in own.collect()]), text)  # about BLOCK_BYTES
        if n > 1:
            out = out.checkpoint()
    return restore(out.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))))


def _search(docs: DataFrame, block: Benchmark, text: str) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = block.indexes()
        for batch in rows:
            at, old = (batch.schema.get_field_index(c) for c in (text, "spans"))
            made = [s for part in slices(batch.column(at)) for s in block.spans(part, indexes)]
            before = batch.column(old).to_pylist()
            both = [sorted([tuple(x.values()) for x in b or []] + m) for b, m in zip(before, made)]
            new = pa.array([[dict(zip(("item_id", "start", "end", "edits"), x)) for x in spots] for spots in both], kind)
            yield batch.set_column(old, "spans", new)

    return docs.mapInArrow(batches, docs.schema)
