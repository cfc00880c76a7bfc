"""Near-duplicate documents by order MinHash.

A document's k-mers are its runs of three words (lower-cased letters and digits), each
labelled with how often it has occurred before in the text. A sketch draws a hash of
every labelled k-mer, takes the ``PICKED`` least, and hashes them in the order of the
text: two documents agree on it with a chance that falls with their edit distance, not
only with the k-mers they share. ``SKETCHES`` independent sketches are kept.

Equal documents (same words) are joined first, by digest; one representative goes on.
Representatives that share a sketch meet in that sketch's bucket. Buckets are searched as
stars: every member is aligned with one hub a turn, that of most of its buckets among those
that it could match, and members of one component need no further pair, so that a group of
near copies goes on as one. After ``ROUNDS`` turns at most, all members of a bucket that are
in different components are paired exactly: a pair is aligned if its lengths and the bits of
its words allow a match (in buckets of more than ``SMALL_BUCKET`` it must also have a word
in common among the rarest fifth, which no match can do without). The alignment is a banded
longest common subsequence of words; two documents are near copies if it covers 0.8 of the
longer one. Classes are the connected components of the links.

A turn makes one pair a document at most. The last pass can grow with the square of a bucket
of texts that have most words in common, in another order or just below the threshold; the
same pair from many buckets is aligned once, and joins on a hot document are plain
shuffle joins that adaptive execution splits. What finds candidates is a random search:
README has its recall by similarity; a link through any third copy joins the class as
well. Texts that have no three words in a row in common are never compared, however short
they are.

Defined cases: null and empty texts, and texts without a letter or digit, belong to no
class but their own. Texts with fewer than three words are one k-mer. Texts are read
whole. Rows with equal ids are one document and each gets the class; if their texts differ,
the one with the least digest of words is sketched and the one with the least MD5 aligned. A null id has a null class and no links. The input's
other columns do not pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.llm.batches import ALNUM, LOWER_VALUES, mix, run_hashes, seeds, slices, words
from icefathom.llm.components import components
from icefathom.session import stored

KMER = 3
PICKED = 2
SKETCHES = 64
SIMILARITY = 0.8
ROUNDS = 3
#: Buckets of so many members at most are searched by length and bits in the last pass, a member
#: against so many others; larger ones by their rare words too.
SMALL_BUCKET = 8192
#: Buckets of more members than this are searched as matrices, by bits that long texts do not fill.
WIDE_BUCKET = 32
#: Bits of the words of a text, in a matrix too, and at most so many of the keys that a shuffle is spared for.
WORD_BITS = 512
WIDE_BITS = 8192
MARK_BITS = 1 << 27
#: Hashed counters of words, so that what tasks read to order a text's words is bounded.
_SLOTS = 1 << 16
_SEEDS = seeds(SKETCHES, 1000)


def _occurrence(keys: np.ndarray) -> np.ndarray:
    """How many equal values come before each value."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - begin
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The sketches of one document's word hashes."""
    k = min(KMER, len(hashes))
    starts = np.arange(len(hashes) - k + 1)
    kmers = run_hashes(hashes, starts, starts + k)
    labelled = mix(kmers + _occurrence(kmers).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 20) // len(kmers))  # a long text takes its seeds in turns
    for i in range(0, SKETCHES, step):
        value = _SEEDS[i : i + step]
        if len(kmers) > PICKED:
            drawn = mix(labelled[None, :] ^ value[:, None])
            picked = np.sort(np.argpartition(drawn, PICKED, axis=1)[:, :PICKED], axis=1)
        else:
            picked = np.broadcast_to(np.arange(len(kmers)), (len(value), len(kmers)))
        for column in range(picked.shape[1]):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + kmers[picked[:, column]])
        out[i : i + step] = value
    return out


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, digest, sketches) of every row; no sketches where there are no words."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch.column(1)):
                found = words(part, ALNUM, LOWER_VALUES)
                a, b = found.bounds[:-1], found.bounds[1:]
                whole = run_hashes(found.hashes, a, b)
                again = run_hashes(mix(found.hashes ^ np.uint64(0x5851F42D4C957F2D)), a, b)
                lists = [sketch(found.hashes[i:j]).view(np.int64) if j > i else None for i, j in zip(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        pa.array(b - a),
                        pa.array([f"{x:016x}{y:016x}" for x, y in zip(whole, again)]),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["key", "n_words", "digest", "sketches"],
                )

    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("digest", T.StringType()),
            T.StructField("sketches", T.ArrayType(T.LongType())),
        ]
    )
    return docs.select(key, text).mapInArrow(batches, schema)


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of the longer word sequence in the longest common subsequence, 0 if below ``least``.

    Rows and columns that a match of at least ``least`` cannot use lie outside the band.
    """
    n, m = len(a), len(b)
    need = int(np.ceil(least * max(n, m) - 1e-9))
    if not n or not m or min(n, m) < need:
        return 0.0
    # Equal ends belong to some longest subsequence.
    short = min(n, m)
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    differs = np.flatnonzero(a[n - short + head :][::-1] != b[m - short + head :][::-1])
    tail = int(differs[0]) if len(differs) else short - head
    a, b = a[head : n - tail], b[head : m - tail]
    common = head + tail
    if common + min(len(a), len(b)) < need:
        return 0.0
    if len(a) and len(b):
        values_a, counts_a = np.unique(a, return_counts=True)
        values_b, counts_b = np.unique(b, return_counts=True)
        _, at_a, at_b = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
        if common + int(np.minimum(counts_a[at_a], counts_b[at_b]).sum()) < need:
            return 0.0
        # A pair (i, j) of the alignment leaves at most n - need and m - need words out.
        common += _banded(a.tolist(), b.tolist(), m - need, n - need)
    return common / max(n, m) if common >= need else 0.0


def _places(a: list[int]) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Where each word stands: as bits for frequent words, as a list for the others.

    Bits cost a word of the text's length; in a long text only the words that fill a 512th
    of it get them, so that memory stays in proportion to the text.
    """
    spots: dict[int, list[int]] = {}
    for j, w in enumerate(a):
        spots.setdefault(w, []).append(j)
    often = len(a) / 512 if len(a) > 4096 else 0
    masks = {}
    for w in [w for w, at in spots.items() if len(at) > often]:
        bits = bytearray(len(a) // 8 + 1)
        for j in spots.pop(w):
            bits[j >> 3] |= 1 << (j & 7)
        masks[w] = int.from_bytes(bits, "little")
    return masks, spots


def _banded(a: list[int], b: list[int], left: int, right: int) -> int:
    """Longest common subsequence with i - left <= j <= i + right (j in ``a``, i in ``b``)."""
    masks, spots = _places(a)
    # ``row`` holds columns low .. low + width - 1 (all of them if the band is as wide);
    # columns that leave the band are counted.
    width = min(left + right + 1, len(a))
    last = 0 if width == len(a) else len(a)
    window, low, done = (1 << width) - 1, 0, 0
    row = window
    for i, w in enumerate(b):
        move = max(0, min(i - left, last) - low)
        if move:
            gone = row & ((1 << move) - 1)
            done += move - gone.bit_count()
            row = (row >> move) | (((1 << move) - 1) << (width - move)) if move < width else window
            low += move
        hit = masks.get(w)
        if hit is not None:
            hit = (hit >> low) & window
        elif w in spots:
            at = spots[w]
            hit = 0
            for j in at[bisect_left(at, low) : bisect_left(at, low + width)]:
                hit |= 1 << (j - low)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & window
    return done + width - row.bit_count()


def _aligned(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs with both texts."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            hashes = []
            for column in (2, 3):
                lists = []
                for part in slices(batch.column(column)):
                    found = words(part, ALNUM, LOWER_VALUES)
                    lists += [found.hashes[i:j] for i, j in zip(found.bounds[:-1], found.bounds[1:])]
                hashes.append(lists)
            share = [alike(a, b) for a, b in zip(*hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], ["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(batches, schema)


def _tokens(hashes: np.ndarray) -> np.ndarray:
    """Words labelled with their occurrence: equal ones of two texts are their words in common."""
    return mix(hashes + _occurrence(hashes).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _marks(values: DataFrame) -> np.ndarray:
    """Bits at the hashes of the values of a column: at most ``MARK_BITS``, however many there are."""
    n = values.count()
    slots = min(MARK_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64(values.columns[0]), F.lit(slots)) + 1
    told = values.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    marks = np.zeros(slots // 8, np.uint8)
    for row in told.collect():  # <= MARK_BITS / 32768 rows of 4 KB
        marks[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return marks


def _marked(marks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (marks[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be one of ``wanted``: what a join with it would drop stays out of the shuffle."""
    marks = _marks(wanted)

    @F.pandas_udf("boolean")
    def hit(slots: pd.Series) -> pd.Series:
        return pd.Series(_marked(marks, slots.to_numpy()))

    return rows.filter(hit(F.pmod(F.xxhash64(key), F.lit(8 * len(marks)))))


def _word_bits(texts: DataFrame, size: int = WORD_BITS) -> DataFrame:
    """(key, n, bits): the number of words of each text, and a bit for each word."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch.column(1)):
                found = words(part, ALNUM, LOWER_VALUES)
                bits = []
                for i, j in zip(found.bounds[:-1], found.bounds[1:]):
                    flags = np.zeros(size, np.uint8)
                    flags[(_tokens(found.hashes[i:j]) % np.uint64(size)).astype(np.int64)] = 1
                    bits.append(np.packbits(flags).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), pa.array(np.diff(found.bounds), pa.int64()), pa.array(bits, pa.list_(pa.int64()))],
                    ["key", "n", "bits"],
                )

    schema = T.StructType(
        [T.StructField("key", texts.schema["key"].dataType), T.StructField("n", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType()))]
    )
    return texts.mapInArrow(batches, schema)


def _rare_words(texts: DataFrame) -> DataFrame:
    """(key, rare): the rarest words of each text, more than a near copy may lack.

    Two texts that have ``SIMILARITY`` of the longer one in common share one of them: both
    take theirs in one order, by counts that are read from a table of hashed counters.
    """

    def parts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
        for batch in rows:
            for part in slices(batch.column(1)):
                found = words(part, ALNUM, LOWER_VALUES)
                lists = [_tokens(found.hashes[i:j]) for i, j in zip(found.bounds[:-1], found.bounds[1:])]
                yield batch, part.first, lists

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for _, _, lists in parts(rows):
            for tokens in lists:
                total += np.bincount((tokens % np.uint64(_SLOTS)).astype(np.int64), minlength=_SLOTS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    counts = np.zeros(_SLOTS, np.int64)
    for row in texts.mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # <= _SLOTS rows
        counts[row["slot"]] = row["n"]

    def picked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, lists in parts(rows):
            rare = []
            for tokens in lists:
                few = len(tokens) - int(np.ceil(SIMILARITY * len(tokens) - 1e-9)) + 1
                rare.append(tokens[np.lexsort((tokens, counts[(tokens % np.uint64(_SLOTS)).astype(np.int64)]))[:few]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), pa.array(rare, pa.list_(pa.int64()))], ["key", "rare"])

    schema = T.StructType([T.StructField("key", texts.schema["key"].dataType), T.StructField("rare", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(picked, schema)


def _could_match(a: str, b: str) -> Column:
    """Whether lengths and words of two texts allow a match: ``n_a``, ``bits_a`` and those of ``b``.

    Each bit that one has alone is a word of it, or more, that the other lacks.
    """
    need = F.ceil(SIMILARITY * F.greatest(f"n_{a}", f"n_{b}") - 1e-9)

    def lacked(x: str, y: str) -> Column:
        alone = [F.bit_count(F.col(f"bits_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[i]))) for i in range(WORD_BITS // 64)]
        return sum(alone[1:], alone[0]) <= F.col(f"n_{x}") - need

    return (F.least(f"n_{a}", f"n_{b}") >= need) & lacked(a, b) & lacked(b, a)


def _shared(reps: DataFrame) -> DataFrame:
    """(key, bucket) of all buckets that two representatives share."""
    # The hash of a sketch is seeded with its number, so equal values are of one sketch.
    every = reps.select("key", F.explode("sketches").alias("bucket"))
    found = every.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).filter("n > 1").checkpoint()
    # A bucket of two is told by its least and its greatest member. Only the larger ones are joined
    # with their members; stored, so that hot buckets split.
    two = found.filter("n = 2").select(F.explode(F.array("a", "b")).alias("key"), "bucket")
    larger = found.filter("n > 2").select("bucket")
    return two.union(_among(every, "bucket", larger).join(larger.checkpoint(), "bucket").select("key", "bucket"))


def _open(members: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """(key, bucket, root, main, hub) of the buckets whose members are in several components.

    ``main`` is the bucket's largest component, ``hub`` one member of it, drawn anew every turn.
    """
    roots = components(links.filter("similarity > 0")).withColumnsRenamed({"node": "key"})
    placed = members.join(roots, "key", "left").select("key", "bucket", F.coalesce("root", "key").alias("root")).checkpoint()
    return _hubs(placed, turn)


def _hubs(placed: DataFrame, turn: int) -> DataFrame:
    drawn = F.struct(F.xxhash64("key", F.lit(turn)), "key")
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min_by("key", drawn).alias("hub"))
    main = groups.groupBy("bucket").agg(F.min_by(F.struct("root", "hub"), F.struct(-F.col("n"), "root")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("groups"))
    mixed = main.filter("groups > 1").select("bucket", F.col("main.root").alias("main"), F.col("main.hub").alias("hub"), "size").checkpoint()
    return stored(placed.join(mixed, "bucket"))


def _star(open_: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: each member outside of its bucket's main component and one hub.

    It is the hub of most of its buckets among those that it could match.
    """
    votes = stored(open_.filter("root <> main").groupBy("key", "hub").agg(F.count("*").alias("votes")))
    x, y = (bits.select(F.col("key").alias(k), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for k, s in (("key", "x"), ("hub", "y")))
    fit = votes.join(x, "key").join(y, "hub").filter(_could_match("x", "y"))
    best = fit.groupBy("key").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub"))
    return best.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, a row each."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(members: pa.Table) -> pa.Table:
    """(x, y): the pairs of one bucket that could match and have no earlier bucket in common.

    A product of the members' bits counts those that two of them have in common. A pair of
    different components has all its buckets open, so each finds it or rules it out, and the
    first speaks for all.
    """
    outer = np.array([r != m for r, m in zip(members["root"].to_pylist(), members["main"].to_pylist())])
    order = np.argsort(~outer, kind="stable")  # strangers of the main component first
    members = members.take(pa.array(order))
    strangers, n = int(outer.sum()), members["n"].to_numpy()
    codes: dict = {}
    root = np.array([codes.setdefault(r, len(codes)) for r in members["root"].to_pylist()])
    bucket, sketches = members["bucket"][0].as_py(), _matrix(members["sketches"])
    packed = np.ascontiguousarray(_matrix(members["bits"])).view(np.uint8)
    pop = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    step, found = 512, []
    for i in range(0, strangers, step):
        rows = np.arange(i, min(i + step, strangers))
        of_x = np.unpackbits(packed[rows], axis=1).astype(np.float32)
        for j in range(i, len(n), step):
            columns = np.arange(j, min(j + step, len(n)))
            both = (of_x @ np.unpackbits(packed[columns], axis=1).astype(np.float32).T).astype(np.int64)
            n_x, n_y = n[rows][:, None], n[columns][None, :]
            need = np.ceil(SIMILARITY * np.maximum(n_x, n_y) - 1e-9)
            fit = (np.minimum(n_x, n_y) >= need) & (pop[rows][:, None] - both <= n_x - need) & (pop[columns][None, :] - both <= n_y - need)
            fit &= (root[rows][:, None] != root[columns][None, :]) & (rows[:, None] < columns[None, :])
            x, y = np.nonzero(fit)
            x, y = rows[x], columns[y]
            first = (sketches[x] == sketches[y]).argmax(axis=1) if len(x) else x
            own = sketches[x, first] == bucket
            found.append(np.stack((x[own], y[own])))
    x, y = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    key = members["key"].combine_chunks()
    return pa.table({"x": key.take(pa.array(x)), "y": key.take(pa.array(y))})


def _unsettled(open_: DataFrame, bits: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of a bucket that are in no common component and could match.

    Members of a bucket's largest component are not paired with one another, so a hot group of
    copies costs its size for each stranger. In buckets of more than ``WIDE_BUCKET`` a pair is
    ruled out by many more bits, and told once for all its buckets. Members of a bucket of more
    than ``SMALL_BUCKET`` meet at their rare words only.
    """

    def pairs(side: DataFrame, on: list[str]) -> DataFrame:
        x, y = (side.select(*on, "main", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "root", "n", "bits")]) for s in "xy")
        met = x.filter("root_x <> main").drop("main").join(y.drop("main"), on)
        met = met.filter((F.col("root_x") != F.col("root_y")) & _could_match("x", "y"))
        return met.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()

    known = open_.join(bits, "key").drop("hub")
    met = pairs(known.filter(F.col("size") <= min(WIDE_BUCKET, SMALL_BUCKET)).checkpoint(), ["bucket"])
    crowded = open_.filter((F.col("size") > WIDE_BUCKET) & (F.col("size") <= SMALL_BUCKET)).select("bucket", "key", "root", "main")
    keys = stored(crowded.select("key").distinct())
    if not keys.isEmpty():
        own = _among(reps.select("key", "sketches"), "key", keys).join(keys, "key")
        wide = stored(_word_bits(_among(texts, "key", keys), WIDE_BITS).join(own, "key"))
        kind = open_.schema["key"].dataType
        schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind)])
        told = crowded.join(wide, "key").groupBy("bucket").applyInArrow(_blocks, schema)
        met = met.union(told.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    large = open_.filter(F.col("size") > SMALL_BUCKET)
    if large.isEmpty():
        return met
    rare = _rare_words(_among(texts, "key", large.select("key").distinct()))
    worded = known.filter(F.col("size") > SMALL_BUCKET).join(rare, "key").withColumn("word", F.explode("rare")).drop("rare")
    return met.union(pairs(worded.checkpoint(), ["bucket", "word"])).distinct()


def _compared(asked: DataFrame, texts: DataFrame) -> DataFrame:
    asked = stored(asked)
    of_a, of_b = (
        _among(texts, "key", asked.select(k).distinct()).select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab"
    )
    return _aligned(asked.join(of_b, "b").join(of_a, "a"))


def near_links(docs: DataFrame, reps: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Verified links (a, b, similarity), a < b, between representatives that share a sketch.

    After ``rounds`` stars, members of a bucket in different components are paired by lengths and words.

    ``reps`` is (key, sketches), one row for each representative.
    """
    members = stored(_shared(reps))
    # Texts of documents that share any bucket: all rounds read these alone.
    involved = stored(members.select("key").distinct())
    own = _among(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", involved).join(involved, "key", "left_semi")
    texts = own.groupBy("key").agg(F.min_by("text", F.md5("text")).alias("text")).checkpoint()
    bits = stored(_word_bits(texts))
    links, open_ = None, _hubs(members.withColumn("root", F.col("key")), 0)
    for turn in range(1, rounds + 1):
        asked = _star(open_, bits)
        found = stored(_compared(asked if links is None else asked.join(links, ["a", "b"], "left_anti"), texts))
        links = found if links is None else links.union(found)
        gained = found.filter("similarity > 0").count()
        if gained:
            # What is in one component now stays so: the bucket is settled.
            open_ = _open(open_.select("key", "bucket"), links, turn)
        if 10 * gained < found.count() or open_.isEmpty():
            break
    asked = _unsettled(open_, bits, texts, reps)
    links = links.union(stored(_compared(asked.join(links, ["a", "b"], "left_anti"), texts)))
    return links.filter("similarity > 0").dropDuplicates(["a", "b"])


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, class_id, exact_of, n_words): class_id is the least key of the class, exact_of
    the representative of the equal texts."""
    signed = signatures(docs, key, text).checkpoint()
    spoken = signed.filter(F.col("key").isNotNull() & F.col("sketches").isNotNull())
    # Rows with one key are one document: the least digest speaks for it.
    digests = spoken.groupBy("key").agg(F.min("digest").alias("digest"))
    equal = spoken.groupBy("digest").agg(F.min("key").alias("exact_of")).checkpoint()
    # Sketches are shuffled once, when it is known whose are wanted.
    wanted = equal.groupBy(F.col("exact_of").alias("key")).agg(F.min("digest").alias("digest"))
    sketched = spoken.groupBy("key", "digest").agg(F.first("sketches").alias("sketches"))
    reps = sketched.join(wanted, ["key", "digest"]).select("key", "sketches").checkpoint()
    links = near_links(docs.filter(F.col(key).isNotNull()), reps, key, text, rounds)
    roots = components(links).withColumnsRenamed({"node": "exact_of", "root": "class_id"})
    members = digests.join(equal, "digest").join(roots, "exact_of", "left")
    own = members.select(F.col("key"), "exact_of", F.coalesce("class_id", "exact_of").alias("class_id"))
    every = signed.select("key", "n_words").join(own, "key", "left")
    return every.select(
        F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("exact_of", "key").alias("exact_of"), "n_words"
    )
