"""Repeated passages by a sparse suffix array, cut down to their first occurrence.

A passage is ``PASSAGE`` (50) words or more that stand somewhere earlier too; earlier
means a smaller document id, or an earlier place of the same document. Words are what
white space separates, compared exactly.

1. Suffixes are retained only where a minimiser stands: of every 50-word window, the
   place with the least hash among its first ``SPAN`` runs of ``KMER`` words. Equal
   windows retain the same place, and at least ``PREFIX`` words of the window follow it.
2. The retained suffixes are sorted by the hash of their first PREFIX words over the
   whole cluster, by range, so that the suffixes of a hot passage fill several tasks. A
   suffix stays if a neighbour shares its prefix (or if it is at the edge of a task,
   where the neighbour is out of sight: keeping one too many changes nothing).
3. Each suffix that stays is extended left and right, to the windows whose minimiser it
   is; the extended windows are sorted in the same way, by hash, document and place, and
   a window is a repeat if its left neighbour is equal. First rows of a task are settled
   by a join with the last rows of all tasks.
4. The words of all repeats of a document, put together, are its spans to remove.

Equal documents of 50 words or more need no suffixes: all but the least id go whole, and
only that one takes part in the sorts.

Defined cases: null, empty and shorter texts have no spans. Rows with a null key are left
as they are. Rows with equal keys and equal texts are one document; equal keys with
different texts are told apart by their digest, and where such texts share a passage at
the same place the least digest counts as the earlier one. Texts are read whole. Other input columns
stay in ``cut``, whatever they are called, and do not pass through ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.llm.batches import BLANKS, EXACT_VALUES, Words, mix, run_hashes, slices, words
from icefathom.llm.columns import shield

PASSAGE = 50
KMER = 8
SPAN = 32
PREFIX = PASSAGE - SPAN + 1


def _digests(found: Words) -> np.ndarray:
    """64-bit digest of each text's words."""
    return run_hashes(mix(found.hashes ^ np.uint64(0x2545F4914F6CDD1D)), found.bounds[:-1], found.bounds[1:]).view(np.int64)


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """For every 50-word window of one text the place of its retained suffix."""
    n = len(hashes) - PASSAGE + 1
    if n <= 0:
        return np.empty(0, np.int64)
    starts = np.arange(len(hashes) - KMER + 1)
    kmers = run_hashes(hashes, starts, starts + KMER)
    # Least value over SPAN places, by doubling; equal values: the leftmost.
    best, width = starts.copy(), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(kmers[b] < kmers[a], b, a)
        width += step
    return best[:n]


def _tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, n_words) of every row."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch.column(1)):
                found = words(part, ~BLANKS, EXACT_VALUES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), pa.array(_digests(found)), pa.array(np.diff(found.bounds))],
                    ["key", "digest", "n_words"],
                )

    return docs.select(F.col(key).cast("long"), text).mapInArrow(batches, "key long, digest long, n_words long")


def _suffixes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(prefix, tag, key, mark, at): the retained suffixes; equal documents have equal tags.

    ``mark`` is the hash of the text as it stands, which finds it again among others of its key.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for part in slices(batch.column(1)):
                found = words(part, ~BLANKS, EXACT_VALUES)
                places, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, (a, b) in enumerate(zip(found.bounds[:-1], found.bounds[1:])):
                    own = np.unique(minimisers(found.hashes[a:b])) + a
                    places.append(own)
                    owner.append(np.full(len(own), i))
                at, of = np.concatenate(places), np.concatenate(owner)
                prefix = run_hashes(found.hashes, at, at + PREFIX)
                digest = _digests(found)[of]
                local = at - found.bounds[of]
                tag = mix(digest.view(np.uint64) + mix(local.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix.view(np.int64)),
                        pa.array(tag.view(np.int64)),
                        pa.array(keys[part.first : part.last][of].astype(np.int64)),
                        pa.array(marks[part.first : part.last][of]),
                        pa.array(local.astype(np.int32)),
                    ],
                    ["prefix", "tag", "key", "mark", "at"],
                )

    kept = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), text, F.xxhash64(text))
    return kept.mapInArrow(batches, "prefix long, tag long, key long, mark long, at int")


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (prefix, tag, key): the first of each tag whose neighbour tag has its prefix."""
    held: pa.RecordBatch | None = None  # the last tag's first row, not settled yet
    settled = True  # it is kept whatever follows: the task's first tag, or like its left neighbour
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        prefix, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.ones(len(prefix), bool)
        fresh[1:] = (prefix[1:] != prefix[:-1]) | (tag[1:] != tag[:-1])
        fresh[0] = last is None or last != (prefix[0], tag[0])
        last = (prefix[-1], tag[-1])
        runs = batch.filter(pa.array(fresh))
        if not runs.num_rows:
            continue
        begins = held is None
        both = runs if begins else pa.Table.from_batches([held, runs]).combine_chunks().to_batches()[0]
        heads = both.column(0).to_numpy()
        near = np.zeros(len(heads), bool)
        near[1:] |= heads[1:] == heads[:-1]
        near[:-1] |= heads[1:] == heads[:-1]
        near[0] |= settled
        if len(heads) > 1:
            yield both.slice(0, len(heads) - 1).filter(pa.array(near[:-1]))
        held, settled = both.slice(len(heads) - 1), bool(near[-1])
    if held is not None:
        yield held


def _windows(joined: DataFrame) -> DataFrame:
    """(window, key, digest, first): the windows whose minimiser is one of the places ``spots``."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, spots = batch.column(0).to_numpy(), batch.column(1)
            for part in slices(batch.column(2)):
                found = words(part, ~BLANKS, EXACT_VALUES)
                own = _digests(found)
                for i, (a, b) in enumerate(zip(found.bounds[:-1], found.bounds[1:])):
                    row = part.first + i
                    hashes = found.hashes[a:b]
                    wanted = np.zeros(len(hashes), bool)
                    wanted[spots[row].values.to_numpy()] = True
                    first = np.flatnonzero(wanted[minimisers(hashes)])
                    made = run_hashes(hashes, first, first + PASSAGE).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(made),
                            pa.array(np.full(len(first), keys[row])),
                            pa.array(np.full(len(first), own[i])),
                            pa.array(first.astype(np.int32)),
                        ],
                        ["window", "key", "digest", "first"],
                    )

    return joined.select("key", "spots", "text").mapInArrow(batches, "window long, key long, digest long, first int")


def _compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (window, key, first, digest): 0 repeats, 1 the task's first row, 2 its last."""
    last, flag, tail = None, False, None
    for batch in rows:
        if not batch.num_rows:
            continue
        window, key, digest, first = (batch.column(i).to_numpy() for i in range(4))
        same = np.zeros(len(window), bool)
        new = np.ones(len(window), bool)
        same[1:] = window[1:] == window[:-1]
        new[1:] = ~same[1:] | (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (digest[1:] != digest[:-1])
        kind = np.where(same & new, 0, -1)
        if last is None:
            kind[0] = 1
        else:
            same[0] = last[0] == window[0]
            new[0] = not same[0] or last[1:] != (key[0], first[0], digest[0])
            kind[0] = 0 if same[0] and (new[0] or flag) else -1
        # A repeated row is what its left neighbour is.
        kind = kind[np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0))]
        last, flag, tail = (window[-1], key[-1], first[-1], digest[-1]), kind[-1] == 0, batch.slice(len(window) - 1)
        keep = kind >= 0
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [*batch.filter(pa.array(keep)).columns, pa.array(kind[keep].astype(np.int32))],
                ["window", "key", "digest", "first", "kind"],
            )
    if tail is not None:
        yield pa.RecordBatch.from_arrays([*tail.columns, pa.array([2], pa.int32())], ["window", "key", "digest", "first", "kind"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, n_words, copy_of, spans) of every document with a key.

    ``spans`` are word ranges (start, end) to remove; a whole copy has ``copy_of``.
    """
    tables = _tables(docs.filter(F.col(key).isNotNull()), key, text).distinct().checkpoint()
    # Stored first, so that a digest with very many copies splits in the join.
    firsts = tables.filter(F.col("n_words") >= PASSAGE).groupBy("digest").agg(F.min("key").alias("first")).checkpoint()
    known = tables.join(firsts, "digest", "left").withColumn("copy_of", F.when(F.col("first") < F.col("key"), F.col("first"))).drop("first")

    suffixes = _suffixes(docs, key, text).repartitionByRange("prefix", "tag", "key").sortWithinPartitions("prefix", "tag", "key")
    kept = suffixes.mapInArrow(_shared, suffixes.schema)
    spots = kept.groupBy("key", "mark").agg(F.collect_set("at").alias("spots"))
    texts = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    order = ["window", "key", "first", "digest"]
    extended = _windows(spots.join(texts, ["key", "mark"])).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = extended.mapInArrow(_compared, "window long, key long, digest long, first int, kind int").checkpoint()

    edge, lasts = rows.filter("kind = 1"), rows.filter("kind = 2")
    before = lasts.select("window", F.struct(*order[1:]).alias("place"))
    late = edge.join(before, "window").filter(F.col("place") < F.struct(*order[1:]))
    found = rows.filter("kind = 0").select("key", "digest", "first").union(late.select("key", "digest", "first"))

    run = Window.partitionBy("key", "digest").orderBy("first")
    gap = F.col("first") - F.lag("first").over(run)
    islands = found.withColumn("island", F.sum(F.when(gap <= PASSAGE, 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    span = islands.groupBy("key", "digest", "island").agg(F.min("first").alias("start"), (F.max("first") + PASSAGE).alias("end"))
    spans = span.groupBy("key", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = known.join(spans, ["key", "digest"], "left")
    return out.select(
        F.col("key").alias(key),
        "digest",
        "n_words",
        "copy_of",
        F.when(F.col("copy_of").isNotNull(), whole).otherwise(F.coalesce("found", none)).alias("spans"),
    )


def cut(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the spans of ``repeats``; a text with nothing left is empty."""
    docs, restore = shield(docs, (key, text), ())
    # A key with several texts has several rows here; each brings its own digest.
    lists = found.filter(F.size("spans") > 0).groupBy(key).agg(F.collect_list(F.struct("digest", "spans")).alias("spans"))
    joined = docs.join(lists, key, "left")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at = batch.schema.get_field_index(text)
            lists = batch.column(batch.schema.get_field_index("spans"))
            column = batch.column(at)
            if lists.null_count == batch.num_rows:
                out = column
            else:
                texts = column.to_pylist()
                told = lists.to_pylist()
                for part in slices(column):
                    hit = [i for i in range(len(part)) if told[part.first + i]]
                    if not hit:
                        continue
                    seen = words(part, ~BLANKS, EXACT_VALUES)
                    digests = _digests(seen)
                    for i in hit:
                        spans = next((x["spans"] for x in told[part.first + i] if x["digest"] == digests[i]), None)
                        if spans:
                            texts[part.first + i] = _without(part.data, part.offsets[i : i + 2], seen, i, spans)
                out = pa.array(texts, column.type)
            kept = [out if f.name == text else batch.column(i) for i, f in enumerate(batch.schema) if f.name != "spans"]
            yield pa.RecordBatch.from_arrays(kept, [f.name for f in batch.schema if f.name != "spans"])

    plain = joined.select(*docs.columns, "spans")
    return restore(plain.mapInArrow(batches, docs.schema))


def _without(data: np.ndarray, bounds: np.ndarray, seen: Words, i: int, spans: list[dict]) -> str:
    """Text i without its spans; a span goes with the white space after it."""
    first, last = int(seen.bounds[i]), int(seen.bounds[i + 1])
    pieces, at = [], int(bounds[0])
    for span in spans:
        pieces.append(data[at : seen.starts[first + span["start"]]].tobytes())
        after = first + span["end"]
        at = int(seen.starts[after]) if after < last else int(bounds[1])
    pieces.append(data[at : int(bounds[1])].tobytes())
    return b"".join(pieces).decode("utf-8", "replace")
