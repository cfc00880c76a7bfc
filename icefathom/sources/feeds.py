"""Gridded feeds, their operational regimes and which regime may be used where."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names of the three operational regimes.
REGIMES = ("LIVE", "STATIC", "SIMULATION")


def write_feed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Long-form grid in the layout ``read_feed`` prunes: feed, then date."""
    df.hint("rebalance", "feed", "date").write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy(
        "feed", "date"
    ).parquet(path)


def read_feed(
    spark: SparkSession, path: str, feed: str, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Grid rows of one feed; feed and dates prune folders before any file opens."""
    rows = spark.read.parquet(path).filter(F.col("feed") == feed)
    if date_from is not None:
        rows = rows.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        rows = rows.filter(F.col("date") <= F.lit(date_to).cast("date"))
    return rows


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds in one table, each row tagged with its regime."""
    unknown = set(feeds) - set(REGIMES)
    if unknown:
        raise ValueError(f"unknown regimes: {sorted(unknown)}")
    tagged = [df.withColumn("regime", F.lit(regime)) for regime, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def regime_guard(df: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose regime may feed the output, and dropped counts per regime.

    A row without a regime is dropped too.
    """
    fine = F.coalesce(F.col("regime").isin(allowed), F.lit(False))
    dropped = df.filter(~fine).groupBy("regime").agg(F.count(F.lit(1)).alias("n_dropped"))
    return df.filter(fine), dropped
