"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of
what followed. A byte's code length is taken in its longest known context; a byte not
seen there costs an escape (method C: distinct / (total + distinct), without
exclusions) and is looked up one context shorter, down to uniform bytes. The statistics
are frozen after training, so the code length of a text is a sum over its bytes of a
function of ORDER + 1 bytes: tasks look it up in tables, for all languages at once.

Counts are made in tasks over a bounded sample of labelled texts (``SAMPLE_TEXTS`` per
language, whole texts, chosen by hash), summed by Spark, and only then read by the
driver; distinct runs of four bytes bound their size.

Defined cases: a null text, an empty one, or one without any letter is ``und`` with
score 0. Texts are scored whole. A tie goes to the language first in the alphabet.
Repeated rows give repeated results. With nothing to learn from, every text is ``und``.
The input's other columns stay; one called like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.llm.batches import byte_classes, slices
from icefathom.llm.columns import shield

ORDER = 3
#: Training texts per language, about; the parameter that bounds the sample.
SAMPLE_TEXTS = 400
UNDETERMINED = "und"
#: Up to so many distinct byte pairs a square table is kept (64 MB); beyond, a binary search.
MAX_PAIRS = 4096
BLOCK = 1 << 20
#: Bytes whose code lengths a task holds at a time.
STEP = 1 << 16
_LETTERS = byte_classes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_lowered = np.arange(256, dtype=np.uint8)
_lowered[65:91] += 32


def sample(labelled: DataFrame, key: str, lang: str, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """About ``texts`` rows of each language, chosen by a hash of the key."""
    known = labelled.filter(F.col(lang).isNotNull())
    sizes = known.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n")).collect()  # a row per language
    keep = F.lit(False)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    for row in sizes:
        share = min(1.0, texts / row["_n"])
        keep = keep | ((F.col(lang) == row["_lang"]) & (draw < int(share * (1 << 30))))
    return known.filter(keep)


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ORDER blanks before each, so that every byte has a whole context."""
    n = len(offsets) - 1
    shift = np.repeat(np.arange(1, n + 1) * ORDER, np.diff(offsets))
    out = np.full(len(data) + n * ORDER, 32, np.uint8)
    out[np.arange(len(data)) + shift] = _lowered[data]
    return out, offsets + np.arange(n + 1) * ORDER


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """Every run of ``length`` bytes as a number, the last byte lowest."""
    n = len(data) - length + 1
    made = np.zeros(n, np.uint32)
    for i in range(length):
        made = (made << np.uint32(8)) | data[i : i + n]
    return made


def gram_counts(training: DataFrame, lang: str, text: str) -> DataFrame:
    """Counts of runs of ORDER + 1 bytes in each language; shorter ones follow from them."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for part in slices(batch.column(1)):
                for name in sorted(set(langs[part.first : part.last])):
                    own = np.flatnonzero(langs[part.first : part.last] == name)
                    grams = [
                        _grams(_padded(part.data[a:b], np.array([0, b - a]))[0], ORDER + 1)
                        for a, b in zip(part.offsets[own], part.offsets[own + 1])
                        if b > a
                    ]
                    if grams:
                        values, counts = np.unique(np.concatenate(grams), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(values)), pa.array(values.astype(np.int64)), pa.array(counts)],
                            ["lang", "gram", "n"],
                        )

    found = training.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return found.mapInArrow(batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """Frozen code lengths in bits: for each run of k + 1 bytes known to any language,
    and the escape out of each context of k bytes."""

    langs: list[str]
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lookup(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte after the bytes before it, one column per language."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        known = self.grams[order]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out = self.bits[order][at]
        missed = np.flatnonzero(known[at] != grams)
        if len(missed):
            rest = grams[missed]
            contexts = self.contexts[order]
            where = np.minimum(np.searchsorted(contexts, rest >> np.uint32(8)), len(contexts) - 1)
            seen = contexts[where] == rest >> np.uint32(8)
            shorter = rest & np.uint32((1 << (8 * order)) - 1)
            out[missed] = self.lookup(shorter, order - 1) + np.where(seen[:, None], self.escapes[order][where], 0)
        return out


def build(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
    """Trees from the counts of each language."""
    trees = Trees(langs, [], [], [], [])
    for order in range(ORDER + 1):
        low = np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
        per_lang = []
        for lang in langs:
            grams, n = counts[lang]
            values, inverse = np.unique(grams & low, return_inverse=True)
            total = np.bincount(inverse, weights=n)
            contexts, of = np.unique(values >> np.uint32(8), return_inverse=True)
            sums, kinds = np.bincount(of, weights=total), np.bincount(of)
            per_lang.append((values, total / (sums + kinds)[of], contexts, kinds / (sums + kinds)))
        every = np.unique(np.concatenate([p[0] for p in per_lang]))
        spots = np.unique(np.concatenate([p[2] for p in per_lang]))
        bits = np.zeros((len(every), len(langs)), np.float32)
        escapes = np.zeros((len(spots), len(langs)), np.float32)
        for column, (values, share, contexts, out) in enumerate(per_lang):
            # A context that this language has never seen costs nothing to leave.
            escapes[np.searchsorted(spots, contexts), column] = -np.log2(out)
            mine = np.searchsorted(every, values)
            bits[mine, column] = -np.log2(share)
            other = np.ones(len(every), bool)
            other[mine] = False
            away = every[other]
            shorter = away & np.uint32((1 << (8 * order)) - 1)
            left = escapes[np.searchsorted(spots, away >> np.uint32(8)), column]
            one = Trees([lang], trees.grams, [b[:, [column]] for b in trees.bits], trees.contexts, [e[:, [column]] for e in trees.escapes])
            bits[other, column] = one.lookup(shorter, order - 1)[:, 0] + left
        for held, new in ((trees.grams, every), (trees.bits, bits), (trees.contexts, spots), (trees.escapes, escapes)):
            held.append(new)
    return trees


def train(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", texts: int = SAMPLE_TEXTS) -> Trees | None:
    """Trees of all languages in ``labelled``; None if there is nothing to learn."""
    table = gram_counts(sample(labelled, key, lang, texts), lang, text).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    if not langs:
        return None
    names = np.array(table["lang"].to_pylist(), dtype=object)
    grams = table["gram"].to_numpy().astype(np.uint32)
    n = table["n"].to_numpy()
    return build(langs, {lang: (grams[names == lang], n[names == lang]) for lang in langs})


class _Pairs:
    """Finds runs of four bytes by two table reads: rank of each byte pair, then of both."""

    def __init__(self, trees: Trees):
        known = trees.grams[ORDER]
        self.trees = trees
        self.rank = np.zeros(1 << 16, np.int32)
        halves = np.unique(np.concatenate([known >> np.uint32(16), known & np.uint32(0xFFFF)]))
        self.rank[halves] = np.arange(1, len(halves) + 1)
        self.width = len(halves) + 1
        self.row = None
        if self.width > MAX_PAIRS:
            return
        self.row = np.full(self.width * self.width, -1, np.int32)
        self.row[self.rank[known >> np.uint32(16)] * self.width + self.rank[known & np.uint32(0xFFFF)]] = np.arange(len(known))

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Bits of every byte that has ORDER bytes before it."""
        halves = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
        if self.row is None:
            return self.trees.lookup((halves[:-2].astype(np.uint32) << np.uint32(16)) | halves[2:], ORDER)
        rank = self.rank[halves]
        at = self.row[rank[:-2] * self.width + rank[2:]]
        out = self.trees.bits[ORDER][at]
        missed = np.flatnonzero(at < 0)
        if len(missed):
            grams = (halves[missed].astype(np.uint32) << np.uint32(16)) | halves[missed + 2]
            out[missed] = self.trees.lookup(grams, ORDER)
        return out


    def cost(self, padded: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each padded text under each language, block by block.

        The running sum of a block is made in steps, of which only the ends of the texts are kept.
        """
        cost = np.zeros((len(offsets) - 1, len(self.trees.langs)))
        for start in range(0, len(padded) - ORDER, BLOCK):
            size = min(BLOCK, len(padded) - ORDER - start)
            ends = np.clip(np.stack((offsets[:-1], offsets[1:] - ORDER)) - start, 0, size)
            sums = np.zeros((*ends.shape, cost.shape[1]))
            running = np.zeros((1, cost.shape[1]))
            for at in range(0, size, STEP):
                bits = self.bits(padded[start + at : start + min(at + STEP, size) + ORDER])
                running = np.concatenate((running[-1:], bits))
                np.cumsum(running, axis=0, out=running)
                here = (ends >= at) & (ends <= at + len(bits))
                sums[here] = running[ends[here] - at]
            cost += sums[1] - sums[0]
        return cost


def identify(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (share of the winner among the languages) and bits_per_byte."""
    names = ("lang_pred", "score", "bits_per_byte")
    docs, restore = shield(docs, (text,), names)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Pairs(trees) if trees else None
        for batch in rows:
            column = batch.column(batch.schema.get_field_index(text))
            langs, scores, rates = [], [], []
            for part in slices(column):
                sizes = np.diff(part.offsets)
                letters = part.per_text(_LETTERS[part.data]) > 0
                wide = (part.per_text(part.data >= 128) > 0) & ~letters
                for i in np.flatnonzero(wide):  # letters beyond ASCII, in texts without any of ASCII
                    raw = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes()
                    letters[i] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
                if finder is None or not len(part.data):
                    langs += [UNDETERMINED] * len(part)
                    scores += [0.0] * len(part)
                    rates += [None] * len(part)
                    continue
                padded, offsets = _padded(part.data, part.offsets)
                cost = finder.cost(padded, offsets)
                best = cost.argmin(axis=1)
                odds = np.exp2(-np.minimum(cost - cost.min(axis=1, keepdims=True), 1000.0))
                share = 1.0 / odds.sum(axis=1)
                rate = cost[np.arange(len(best)), best] / np.maximum(sizes, 1)
                for i in range(len(part)):
                    langs.append(trees.langs[best[i]] if letters[i] else UNDETERMINED)
                    scores.append(float(share[i]) if letters[i] else 0.0)
                    rates.append(float(rate[i]) if sizes[i] else None)
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    return restore(docs.mapInArrow(batches, schema))


def held_out(key: str = "doc_id"):
    """True for the rows that training must not see."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1
