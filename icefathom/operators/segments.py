"""Ordered work on tracks without putting a whole track in one task.

A window partitioned by object alone sends every fix of a busy vessel to one
task. Here a track is cut into time segments, windows are partitioned by
(object, segment), and the few rows a segment needs from its neighbours are
added to it as carried rows. The windows over whole objects only ever see one
summary row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icefathom.functions.numeric import epoch_seconds

SEGMENT = "_segment"
CARRIED = "_carried"
SEGMENT_S = 86400.0
SEGMENT_ROWS = 2_000_000


def add_segment(
    df: DataFrame,
    keys: list[str],
    ts: str,
    seconds: float = SEGMENT_S,
    max_rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Tag rows with an order-preserving time segment inside their key.

    Segments are ``seconds`` long. One partially aggregated count over the key
    and time columns finds segments above ``max_rows``; those alone are cut
    again at approximate time quantiles, so a third of the table landing in
    one segment still splits. ``max_rows=None`` skips the count when the feed
    already bounds fixes per segment.
    """
    slot = F.floor(epoch_seconds(F.col(ts)) / seconds).cast("bigint")
    plain = df.withColumn("_slot", slot)
    if max_rows is None:
        return plain.withColumn(SEGMENT, F.struct(F.col("_slot").alias("slot"), F.lit(0).alias("cut"))).drop("_slot")
    counts = plain.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    worst = counts.agg(F.max("_n")).first()[0]
    if worst is None:
        return plain.withColumn(SEGMENT, F.struct(F.col("_slot").alias("slot"), F.lit(0).alias("cut"))).drop("_slot")
    parts = int(-(-worst // max_rows) + 1)
    at = [i / parts for i in range(1, parts)]
    cuts = (
        plain.join(counts.select(*keys, "_slot"), [*keys, "_slot"], "left_semi")
        .groupBy(*keys, "_slot")
        .agg(F.percentile_approx(epoch_seconds(F.col(ts)), at, F.lit(max(10_000, 10 * parts))).alias("_cuts"))
    )
    joined = plain.join(cuts, [*keys, "_slot"], "left")
    below = F.size(F.filter(F.col("_cuts"), lambda c: c < epoch_seconds(F.col(ts))))
    return joined.withColumn(
        SEGMENT,
        F.struct(F.col("_slot").alias("slot"), F.when(F.col("_cuts").isNull(), 0).otherwise(below).alias("cut")),
    ).drop("_slot", "_cuts")


def carry_neighbours(
    df: DataFrame, keys: list[str], order: list[str], back: int = 1, ahead: int = 0
) -> DataFrame:
    """Add to each segment the ``back`` rows before and ``ahead`` rows after it.

    Added rows have ``_carried`` set; drop them after the window. The edge rows
    come from ``row_number() <= n``, which Spark prunes before the shuffle.
    """
    own = df.withColumn(CARRIED, F.lit(False))
    columns = df.columns
    extra = None
    for count, tail in ((back, True), (ahead, False)):
        if not count:
            continue
        inner = W.partitionBy(*keys, SEGMENT).orderBy(*[F.col(c).desc() if tail else F.col(c).asc() for c in order])
        edge = df.withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= count).drop("_rank")
        across = W.partitionBy(*keys).orderBy(*order)
        if tail:
            frame = across.rowsBetween(-count, -1)
            starts = F.lag(SEGMENT).over(across)
        else:
            frame = across.rowsBetween(1, count)
            starts = F.lead(SEGMENT).over(across)
        border = starts.isNotNull() & (starts != F.col(SEGMENT))
        rows = (
            edge.withColumn("_border", border)
            .withColumn("_near", F.collect_list(F.struct(*columns)).over(frame))
            .filter("_border")
            .select(F.col(SEGMENT).alias("_to"), F.explode("_near").alias("_row"))
            .select(*[F.col("_to").alias(c) if c == SEGMENT else F.col(f"_row.{c}").alias(c) for c in columns])
            .withColumn(CARRIED, F.lit(True))
        )
        extra = rows if extra is None else extra.unionByName(rows)
    return own if extra is None else own.unionByName(extra)


def segment_window(keys: list[str], order: list[str]):
    """Window over one segment of one object."""
    return W.partitionBy(*keys, SEGMENT).orderBy(*order)


def drop_carried(df: DataFrame) -> DataFrame:
    """Only the rows the table had before ``carry_neighbours``."""
    return df.filter(~F.col(CARRIED)).drop(CARRIED)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Running sum along each key, including the current row.

    Sums run inside segments; each segment then gets the total of the earlier
    ones from a table with one row per segment.
    """
    valued = df.withColumn("_v", value)
    local = valued.withColumn(
        "_local", F.sum("_v").over(segment_window(keys, order).rowsBetween(W.unboundedPreceding, 0))
    )
    before = W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        valued.groupBy(*keys, SEGMENT)
        .agg(F.sum("_v").alias("_total"))
        .withColumn("_base", F.sum("_total").over(before))
        .drop("_total")
    )
    # Null-safe, so that rows without a key or a time find their totals too.
    there = totals.select(*[F.col(c).alias(f"_at_{c}") for c in [*keys, SEGMENT]], "_base")
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*keys, SEGMENT]]
    return (
        local.join(there, same, "left")
        .withColumn(out, F.coalesce(F.col("_base") + F.col("_local"), "_base", "_local"))
        .drop("_v", "_local", "_base", *[f"_at_{c}" for c in [*keys, SEGMENT]])
    )
