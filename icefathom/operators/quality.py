"""Validation, deduplication and freshness of incoming fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icefathom.functions.numeric import epoch_seconds
from icefathom.operators.spread import latest_by


def fix_rules(lat: str = "lat", lon: str = "lon", speed: str | None = None) -> dict[str, Column]:
    """Reasons a fix is refused, each with the condition that triggers it."""
    a, o = F.col(lat), F.col(lon)
    rules = {
        "lat_missing": a.isNull() | F.isnan(a),
        "lat_range": (a < -90) | ((a > 90) & ~F.isnan(a)),
        "lon_missing": o.isNull() | F.isnan(o),
        "lon_range": (o < -180) | ((o > 180) & ~F.isnan(o)),
    }
    if speed is not None:
        v = F.col(speed)
        rules["speed_missing"] = v.isNull() | F.isnan(v.cast("double"))
        rules["speed_negative"] = v < 0
    return rules


def tag_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: the names of the rules a row breaks (empty when fine)."""
    hits = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return df.withColumn("reasons", F.filter(hits, lambda r: r.isNotNull()))


def validate(df: DataFrame, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits rows into accepted ones and rejects that carry ``reasons``."""
    tagged = tag_reasons(df, rules or fix_rules())
    ok = tagged.filter(F.size("reasons") == 0).drop("reasons")
    return ok, tagged.filter(F.size("reasons") > 0)


def dedupe_fixes(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key; the lowest ``order`` value wins."""
    return latest_by(df, keys, [F.col(order).asc()])


def feed_freshness(df: DataFrame, now: Column, max_age_h: float, feed: str = "feed", ts: str = "ts") -> DataFrame:
    """Newest row, age in hours and stale flag of every feed."""
    return (
        df.groupBy(feed)
        .agg(F.max(ts).alias("newest"), F.count(F.lit(1)).alias("n_obs"))
        .withColumn("age_h", (epoch_seconds(now) - epoch_seconds(F.col("newest"))) / 3600.0)
        .withColumn("stale", F.col("age_h") > max_age_h)
    )
