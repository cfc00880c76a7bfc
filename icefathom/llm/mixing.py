"""Mixing sources to target weights: how often each document is taken.

Words are counted per source, sources get targets that share all words by weight, and a
source's repetition rate is its target over its words. A document is emitted
``floor(rate)`` times, plus once more with a probability equal to the rest of the rate,
drawn from a hash of its id, so that a rerun takes the same copies.

Targets: each source gets its weight's share of all words, but ``most`` times its own
words at the highest; what that leaves over is shared among the others by weight, again and
again until none is above. Every round is one aggregate over the table of sources, of
which the driver sees a single row.

Defined cases: a null text or one of blanks only has size 0, counts for nothing and is
emitted like any other document of its source. A source without words has target 0 and
rate 0. A null source is a source of its own, the last. Documents with equal ids share a
draw (repeated rows are repeated together); documents without an id draw by their text.
An empty table gives an empty one. Other columns stay; one called like an output is
replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icefathom.llm.columns import shield

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that make a draw between 0 and 1.
DRAW_BITS = 52
_EXACT = "decimal(19,0)"


def size_of(text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, key: str, text: str) -> Column:
    """A number in [0, 1) that a document's id (or its text, where it has none) settles."""
    told = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), told).cast("binary")), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / float(1 << DRAW_BITS)


def ranked(table: DataFrame, column: str) -> DataFrame:
    """Adds ``rank``: the place of a distinct ``column`` in its order, nulls last.

    Values are dealt out by range and numbered within their part; only the parts' counts
    meet in one task.
    """
    order = F.col(column).asc_nulls_last()
    parts = table.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each part, so the number of parts bounds this window.
    before = counts.selectExpr("_part as _p", "sum(_n) over (order by _part) - _n as _before")
    inner = parts.selectExpr("*", f"row_number() over (partition by _part order by {column} asc nulls last) - 1 as _at")
    return inner.join(before, F.col("_part") == F.col("_p")).withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_p", "_before", "_at")


@dataclass
class Level:
    """What the sources that are not capped share: ``words`` over ``weight``."""

    words: int
    weight: int


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target``, the words to take from each source, to (source, source_size)."""
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights must be positive and most at least 1")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = (
        ranked(sums, "source")
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", most * F.col("source_size"))
        .checkpoint()
    )
    total = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    whole = level = Level(total["words"] or 0, total["weight"] or 1)

    def above(at: Level) -> Column:
        return F.col("cap").cast(_EXACT) * F.lit(at.weight).cast(_EXACT) < F.col("weight").cast(_EXACT) * F.lit(at.words).cast(_EXACT)

    while True:
        held = weighed.agg(
            F.sum(F.when(above(level), F.col("cap"))).alias("capped"), F.sum(F.when(~above(level), F.col("weight"))).alias("weight")
        ).first()
        after = Level(whole.words - (held["capped"] or 0), held["weight"] or 1)
        if after == level:
            break
        level = after
    share = (F.col("weight") * level.words).cast("double") / float(level.weight)
    return weighed.select("source", "source_size", F.when(above(level), F.col("cap").cast("double")).otherwise(share).alias("target"))


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``copies`` (how often to emit) to every document."""
    docs, restore = shield(docs, (key, source, text), ("size", "source_size", "target", "copies"))
    sized = docs.withColumn("size", size_of(text)).withColumn("_draw", draw(seed, key, text))
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    aims = targets(sums, weights, most).withColumnRenamed("source", "_source")
    placed = sized.join(aims, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(F.col("_draw") < rate - F.floor(rate), 1).otherwise(0)
    return restore(placed.withColumn("copies", (F.floor(rate) + extra).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: every document as often as it is taken, ``copy`` counting from 0."""
    placed = rates(docs, weights, most, seed, key, source, text).filter(F.col("copies") > 0)
    inner, restore = shield(placed, ("copies",), ("copy",))
    told = inner.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return restore(told).drop("size", "source_size", "target", "copies")
