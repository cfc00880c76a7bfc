"""Quality rules: counted base rules, and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BINS`` hashed n-grams are counted: one over a trusted target
(all documents labelled good), one over all documents. A text's score is
the mean over its n-grams of log2(target share / raw share), so length does not matter.
The n-grams are runs of four bytes of the lower-cased text: they see letters, punctuation
and layout alike, in any language.

The threshold is computed once from all labelled documents (the middle of the gap that best
tells good from bad while at most ``MAX_LOSS`` of the good ones fall below it), and every
document is held against that one number.

Defined cases: a null text counts as empty; a text without n-grams scores 0. Texts are
read whole. Without labels the target equals the corpus, every score is 0, and only the
base rules decide. Repeated rows give repeated results. The input's other columns
stay; one called like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.llm.batches import BLANKS, EXACT_VALUES, Texts, byte_classes, mix, run_hashes, slices, windows, words
from icefathom.llm.columns import shield

BINS = 1 << 14
GRAM = 4
MAX_LOSS = 0.002
WINDOW = 8
_SYMBOLS = byte_classes("#*$%&|<>")
_NEWLINE = byte_classes("\n")
_lowered = np.arange(256, dtype=np.uint8)
_lowered[65:91] += 32


def gram_bins(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every run of GRAM bytes, and where each text's runs begin (one more at the end)."""
    n = np.maximum(np.diff(texts.offsets) - GRAM + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(n)))
    data = _lowered[texts.data]
    if len(data) < GRAM:
        return np.empty(0, np.int64), bounds
    value = np.zeros(len(data) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        value = (value << np.uint32(8)) | data[i : len(data) - GRAM + 1 + i]
    bins = ((value * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
    keep = np.ones(len(value), bool)
    inner = texts.offsets[1:-1]
    for i in range(1, GRAM):  # runs that reach into the next text
        at = inner - i
        keep[at[(at >= 0) & (at < len(keep))]] = False
    if keep.all():
        return bins, bounds
    return bins[keep], bounds


def corpus_counts(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bin over the target's documents and over all documents.

    ``target`` holds the keys of its documents, which may be many: they meet the texts in a
    shuffle join at every size. Each task sends one count per bin, and Spark adds them.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in rows:
            chosen = np.array(batch.column(1).fill_null(False).to_pylist(), bool)
            for part in slices(batch.column(0)):
                bins, bounds = gram_bins(part)
                raw += np.bincount(bins, minlength=BINS)
                own = np.repeat(chosen[part.first : part.last], np.diff(bounds))
                if own.any():
                    good += np.bincount(bins[own], minlength=BINS)
        if raw.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(good), pa.array(raw)], ["bin", "good", "raw"])

    flagged = docs.select(key, text).join(target.select(key).distinct().withColumn("_good", F.lit(True)).hint("merge"), key, "left")
    table = (
        flagged.select(text, "_good")
        .mapInArrow(batches, "bin long, good long, raw long")
        .groupBy("bin")
        .agg(F.sum("good").alias("good"), F.sum("raw").alias("raw"))
        .toArrow()  # at most BINS rows
    )
    good, raw = np.zeros(BINS), np.zeros(BINS)
    at = table["bin"].to_numpy()
    good[at], raw[at] = table["good"].to_numpy(), table["raw"].to_numpy()
    return good, raw


def log_ratios(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log2(target share / raw share) of each bin, one added to every count."""
    if not good.sum():
        return np.zeros(BINS, np.float32)
    ratio = np.log2((good + 1) / (good.sum() + BINS)) - np.log2((raw + 1) / (raw.sum() + BINS))
    return ratio.astype(np.float32)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets, n = texts.data, texts.offsets, len(texts)
    found = words(texts, ~BLANKS, EXACT_VALUES)
    out = {
        "n_words": np.diff(found.bounds),
        "word_chars": texts.per_text(~BLANKS[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": texts.per_text(_SYMBOLS[data]),
    }
    # Lines: cut at newlines and at the ends of texts; those with a word are compared.
    breaks = np.flatnonzero(_NEWLINE[data])
    starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, "right") - 1
    next_break = np.concatenate((breaks, [len(data)]))[np.searchsorted(breaks, starts)] if len(starts) else starts
    ends = np.minimum(next_break, offsets[text + 1]) if len(starts) else starts
    spoken = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends, text = starts[spoken], ends[spoken], text[spoken]
    lines = run_hashes(EXACT_VALUES[data], starts, ends)
    order = np.lexsort((lines, text))
    same = np.zeros(len(lines), bool)
    if len(lines):
        same[1:] = (lines[order][1:] == lines[order][:-1]) & (text[order][1:] == text[order][:-1])
    out["n_dup_lines"] = np.bincount(text[order][same], minlength=n)
    # Words in windows that the same text has twice.
    first, hashes = windows(found, WINDOW)
    keyed = mix(hashes + found.text[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed)
    ranked = keyed[order]
    twice = np.zeros(len(ranked), bool)
    if len(ranked):
        equal = ranked[1:] == ranked[:-1]
        twice[1:] |= equal
        twice[:-1] |= equal
    at = first[order[twice]]
    change = np.zeros(len(found.text) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(change[:-1]) > 0, found.bounds)
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """Replaces the text by the base counts, base_failed and score."""
    names = [*BASE, "base_failed", "score"]
    docs, restore = shield(docs, (text,), (*names, "kept"))
    rest = [f for f in docs.schema.fields if f.name != text]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column = batch.column(batch.schema.get_field_index(text))
            for part in slices(column):
                counts = base_counts(part)
                n = counts["n_words"]
                failed = (n < 20) | (100 * counts["n_repeat_words"] > 30 * n)
                bins, bounds = gram_bins(part)
                total = np.concatenate(([0.0], np.cumsum(ratios[bins], dtype=np.float64)))
                size = np.diff(bounds)
                mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1)
                # Sums in another order end in other last digits: nine decimals are kept.
                new = [pa.array(counts[c].astype(np.int64)) for c in BASE] + [pa.array(failed), pa.array(np.round(mean, 9) + 0.0)]
                kept = [batch.column(batch.schema.get_field_index(f.name)).slice(part.first, len(part)) for f in rest]
                yield pa.RecordBatch.from_arrays(kept + new, [f.name for f in rest] + names)

    kinds = [T.LongType()] * len(BASE) + [T.BooleanType(), T.DoubleType()]
    return restore(docs.mapInArrow(batches, T.StructType(rest + [T.StructField(n, k) for n, k in zip(names, kinds)])))


def threshold(scored: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality") -> float | None:
    """The score below which documents go: best sum of true rates on the labelled documents.

    Scores are put on a grid of 1/1000 first, so the driver reads a histogram.
    """
    step = F.floor(F.col("score") * 1000).alias("step")
    rows = (
        scored.select(key, "score").join(labels.hint("merge"), key)
        .groupBy(step)
        .agg(F.sum(F.when(F.col(good) == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col(good) == 0, 1).otherwise(0)).alias("bad"))
        .orderBy("step")
        .collect()  # scores lie within +-30, so at most 60,000 steps
    )
    goods, bads = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not goods or not bads:
        return None
    best, cut, lost, caught, below = 0.0, None, 0, 0, None
    for r in rows:
        gain = caught / bads - lost / goods
        if lost <= MAX_LOSS * goods and gain > best:
            best, cut = gain, (below + 1 + r["step"]) / 2000.0
        lost, caught, below = lost + r["good"], caught + r["bad"], r["step"]
    return cut


def labelled(labels: DataFrame, key: str = "doc_id", good: str = "quality") -> DataFrame:
    """(key, good): every id that is labelled 1 or 0, with each of its labels once."""
    return labels.filter(F.col(good).isin(0, 1) & F.col(key).isNotNull()).select(key, good).distinct()


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality") -> DataFrame:
    """Base counts, base_failed, score and kept for every document.

    An id that is labelled both ways counts as bad for the threshold.
    """
    known = labelled(labels, key, good).checkpoint()
    ratios = log_ratios(*corpus_counts(docs, known.filter(F.col(good) == 1), key, text))
    scored = score(docs, ratios, text).checkpoint()
    cut = threshold(scored, known.groupBy(key).agg(F.min(good).alias(good)), key, good)
    verdict = F.lit(True) if cut is None else F.col("score") >= F.lit(cut)
    return scored.withColumn("kept", ~F.col("base_failed") & verdict)
