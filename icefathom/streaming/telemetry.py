"""Live telemetry: cleaning, state, alerts, sessions, enrichment, matching.

Every function takes and returns a DataFrame and works on batches as well, so
each stream has the same definition as its batch twin. Event time must be a
``timestamp`` (watermarks refuse zone-free ones); ``event_time`` casts it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from icefathom.operators.quality import fix_rules, tag_reasons
from icefathom.operators.spread import block_join, latest_by

#: A batch whose pings are in more slots than these reads all slots between the first and the last.
MOST_SLOTS = 256


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """File stream of Parquet rows with a fixed schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def clean_pings(
    pings: DataFrame, keys: list[str], delay: str, ts: str = "ts", rules: dict[str, Column] | None = None
) -> DataFrame:
    """Valid pings, each key once within the watermark.

    State is one entry per key and watermark delay, so it stays bounded.
    A batch has no watermark and keeps the row of the lowest (ts, ...) order.
    """
    ok = tag_reasons(event_time(pings, ts), rules or fix_rules()).filter(F.size("reasons") == 0).drop("reasons")
    if pings.isStreaming:
        return ok.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return latest_by(ok, keys, [F.col(ts).asc(), *[F.col(c).asc() for c in ok.columns if c not in (ts, *keys)]])


def stream_pings(spark: SparkSession, path: str, schema, keys: list[str], delay: str, **read) -> DataFrame:
    """``clean_pings`` over a file stream."""
    return clean_pings(read_stream(spark, path, schema, **read), keys, delay)


def latest_state(pings: DataFrame, key: str = "vessel_id", ts: str = "ts", row_id: str = "ping_id") -> DataFrame:
    """Newest row per vessel; equal times take the highest id. Use update mode.

    One state row per vessel, whatever the length of its history.
    """
    rest = [c for c in pings.columns if c not in (key, ts, row_id)]
    newest = pings.groupBy(key).agg(F.max(F.struct(ts, row_id, *rest)).alias("_s"))
    return newest.select(key, "_s.*")


def alert_counts(
    alerts: DataFrame, size: str, slide: str | None = None, delay: str | None = None, label: str = "status",
    ts: str = "ts",
) -> DataFrame:
    """Alerts per class in tumbling (no ``slide``) or sliding windows."""
    timed = event_time(alerts, ts)
    if delay is not None and alerts.isStreaming:
        timed = timed.withWatermark(ts, delay)
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        timed.groupBy(span.alias("w"), label)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), label, "n")
    )


def contact_sessions(
    pings: DataFrame, gap: str, delay: str | None = None, key: str = "vessel_id", ts: str = "ts"
) -> DataFrame:
    """Periods of contact per vessel; silence of ``gap`` ends one.

    Sessions merge inside each task before the shuffle (session default), so
    a vessel that reports all the time does not become one big group.
    """
    timed = event_time(pings, ts)
    if delay is not None and pings.isStreaming:
        timed = timed.withWatermark(ts, delay)
    return (
        timed.groupBy(F.session_window(ts, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("n_pings"), F.max(ts).alias("last_ts"))
        .select(key, F.col("s.start").alias("s_start"), "last_ts", "n_pings")
    )


def enrich_stream(
    pings: DataFrame, risk: DataFrame, on: list[str], limit: float, value: str = "cost"
) -> DataFrame:
    """Alerts for pings in a cell whose risk exceeds ``limit``.

    Stream-static inner join: ``risk`` keeps the files it was made from, and a plan
    behind it runs again in every micro-batch. For a stored surface that is renewed while
    the stream runs, use ``enrich_batches``.
    """
    return pings.join(risk, on).filter(F.col(value) > limit)


def enrich_batches(
    surface_path: str, on: list[str], limit: float, sink: Callable[[DataFrame, int], None], value: str = "cost",
    profile: str | None = None, slot: str = "slot",
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: joins each micro-batch with the newest stored surface.

    The surface is a folder of versions (``risk.store_surface``), partitioned by profile and
    slot; every batch lists it afresh, reads the newest version only, and of that the slots
    its pings are in (from the first to the last, if they are more than ``MOST_SLOTS``). An older version stays until readers are done with it. ``sink`` gets
    the alerts and the batch number, by which a repeated batch can overwrite itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(surface_path)
        newest = stored.agg(F.max("version")).first()[0]
        current = stored.filter(F.col("version") == newest)
        if profile is not None:
            current = current.filter(F.col("profile") == profile)
        if slot in on:
            current = current.filter(_in_slots(batch, slot))
        sink(enrich_stream(batch, current.select(*on, value), on, limit, value), number)

    return each


def _in_slots(batch: DataFrame, slot: str) -> Column:
    """Condition on the slots of a batch as literals, so that other slots' files are not read."""
    found = [r[0] for r in batch.select(slot).filter(F.col(slot).isNotNull()).distinct().limit(MOST_SLOTS + 1).collect()]
    if len(found) <= MOST_SLOTS:
        return F.col(slot).isin(found)
    first, last = batch.agg(F.min(slot), F.max(slot)).first()
    return F.col(slot).between(first, last)


def late_rows(query) -> int:
    """Rows that a running or finished stream has dropped as too late, of the progress it still holds."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in json_of(p).get("stateOperators", [])
    )


def json_of(progress) -> dict:
    """A progress report as a dictionary, whichever form this Spark gives it in."""
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def hot_cells(history: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Cells that had more than ``rows`` pings in ``history``, with the number of parts to deal them in."""
    counts = history.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    return counts.select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("salts"))


def event_match(
    pings: DataFrame,
    events: DataFrame,
    on: list[str],
    tol_s: int,
    delay: str = "1 hour",
    ts: str = "ts",
    event_ts: str = "event_ts",
    ping_id: str = "ping_id",
    event_id: str = "event_id",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Pings within ``tol_s`` of a sudden event in the same cell.

    The time bucket makes the interval join an equi-join, in a batch and in a stream: a
    ping is in one bucket, an event in each that it can reach, so a row meets its own hours
    and not all that its cell holds. A stream gives Spark the plain interval as well, from which it knows
    when to drop state on both (watermarked) sides. ``hot`` (``hot_cells`` of earlier
    pings) lists busy cells and a number of parts for each: their pings are dealt over as
    many copies of the (rarer) events, so that many tasks hold their state. Events of
    other cells are not copied.
    """
    left, right = event_time(pings, ts), event_time(events, event_ts)
    near = (F.col(event_ts) >= F.col(ts) - F.expr(f"interval {int(tol_s)} seconds")) & (
        F.col(event_ts) <= F.col(ts) + F.expr(f"interval {int(tol_s)} seconds")
    )
    width = max(int(tol_s) * 2, 1)
    bucket = F.floor(F.unix_seconds(F.col(ts)) / width)
    spread = F.explode(
        F.sequence(
            F.floor((F.unix_seconds(F.col(event_ts)) - int(tol_s) - 1) / width),
            F.floor((F.unix_seconds(F.col(event_ts)) + int(tol_s) + 1) / width),
        )
    )
    if pings.isStreaming or events.isStreaming:
        left, right = left.withColumn("_b", bucket), right.withColumn("_b", spread)
        if hot is not None:
            # One row for each busy cell: a static side that Spark plans by its size.
            left, right = left.join(hot, on, "left"), right.join(hot, on, "left")
        parts = F.coalesce(F.col("salts"), F.lit(1)) if hot is not None else F.lit(1)
        dealt = F.pmod(F.xxhash64(ping_id), parts).cast("int")
        copies = F.explode(F.sequence(F.lit(0), parts - 1))
        a = left.withColumn("_salt", dealt).drop("salts").withWatermark(ts, delay).alias("a")
        b = right.withColumn("_salt", copies).drop("salts").withWatermark(event_ts, delay).alias("b")
        keys = [*on, "_salt", "_b"]
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
        condition = near
        for eq in same:
            condition = eq & condition
        joined = a.join(b, condition)
        return joined.drop(*[F.col(f"b.{c}") for c in keys], F.col("a._salt"), F.col("a._b"))
    return (
        block_join(left.withColumn("_b", bucket), right.withColumn("_b", spread), [*on, "_b"], ping_id, event_id)
        .filter(near)
        .drop("_b")
    )
