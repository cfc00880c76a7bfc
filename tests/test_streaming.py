"""Streams against their batch twins, with late and repeated rows."""

import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from icefathom.sources import state
from icefathom.streaming import telemetry as live

T0 = datetime(2024, 1, 1)
SCHEMA = "vessel_id long, ping_id long, ts timestamp, lat double, lon double, status string"


def feed(spark, folder, batches):
    """Each batch becomes one file, read one per trigger in order."""
    for n, rows in enumerate(batches):
        data = [(v, p, T0 + timedelta(minutes=m), a, o, s) for v, p, m, a, o, s in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return live.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def run(spark, df, mode, tmp_path):
    name = f"m{uuid.uuid4().hex}"
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name), q


BATCHES = [
    [(1, 1, 0, -65.0, 10.0, "ok"), (1, 1, 0, -65.0, 10.0, "ok"), (2, 2, 5, -95.0, 10.0, "ok"), (2, 3, 6, -65.0, 10.0, "fire")],
    [(1, 4, 300, -65.0, 10.0, "ok"), (1, 1, 0, -65.0, 10.0, "ok")],
    [(2, 6, 700, -65.0, 10.0, "ok")],
    # Late by the watermark the second file set (a batch judges lateness by the one before it).
    [(1, 5, 10, -65.0, 10.0, "ok")],
]


def test_clean_drops_repeats_bad_and_late(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", BATCHES)
    out, _ = run(spark, live.clean_pings(stream, ["ping_id"], "30 minutes"), "append", tmp_path)
    assert sorted(r.ping_id for r in out.collect()) == [1, 3, 4, 6]
    batch = live.clean_pings(spark.read.parquet(str(tmp_path / "in")), ["ping_id"], "30 minutes")
    assert sorted(r.ping_id for r in batch.collect()) == [1, 3, 4, 5, 6]


def test_latest_state_update_mode(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", BATCHES)
    cols = ["vessel_id", "ts", "ping_id", "status"]
    out, _ = run(spark, live.latest_state(stream.select(cols)), "complete", tmp_path)
    batch = live.latest_state(spark.read.parquet(str(tmp_path / "in")).select(cols))
    assert sorted(out.collect()) == sorted(batch.collect())
    assert {r.vessel_id: r.ping_id for r in out.collect()} == {1: 4, 2: 6}


def test_latest_state_ties_take_highest_id(spark):
    df = spark.createDataFrame([(1, T0, 3, "a"), (1, T0, 9, "b")], "vessel_id long, ts timestamp, ping_id long, status string")
    assert live.latest_state(df).first().status == "b"


def test_late_alert_is_not_counted(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", BATCHES)
    out, q = run(spark, live.alert_counts(stream, "1 hour", None, "30 minutes"), "append", tmp_path)
    got = {(r.w_start, r.status): r.n for r in out.collect()}
    assert got[(T0, "fire")] == 1
    assert got[(T0 + timedelta(hours=5), "ok")] == 1
    assert got[(T0, "ok")] == 4
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert dropped >= 1 and live.late_rows(q) == dropped


def test_sessions_close_after_the_gap(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", BATCHES)
    out, _ = run(spark, live.contact_sessions(stream, "60 minutes", "30 minutes"), "append", tmp_path)
    got = {(r.vessel_id, r.s_start): r.n_pings for r in out.collect()}
    assert got[(2, T0 + timedelta(minutes=5))] == 2
    assert got[(1, T0 + timedelta(minutes=300))] == 1


@pytest.mark.parametrize(("tol", "busy"), [(60, False), (600, False), (600, True)])
def test_event_match_equals_batch(spark, tmp_path, tol, busy):
    pings = [(p % 3, p, p * 3, -65.0, 0.0, "ok") for p in range(40)]
    events = [(e % 3, 100 + e, e * 7, -65.0, 0.0, "calving") for e in range(15)]
    feed(spark, tmp_path / "p", [pings])
    feed(spark, tmp_path / "e", [events])

    def sides(read):
        p = read(str(tmp_path / "p")).select("ping_id", F.col("vessel_id").alias("cell"), "ts")
        e = read(str(tmp_path / "e")).select(
            F.col("ping_id").alias("event_id"), F.col("vessel_id").alias("cell"), F.col("ts").alias("event_ts")
        )
        past = spark.read.parquet(str(tmp_path / "p")).select(F.col("vessel_id").alias("cell"))
        hot = live.hot_cells(past, ["cell"], 5) if busy else None
        assert hot is None or {r.salts for r in hot.collect()} == {3}
        return live.event_match(p, e, ["cell"], tol, hot=hot).select("ping_id", "event_id")

    schema = spark.createDataFrame([], SCHEMA).schema
    batch = {tuple(r) for r in sides(spark.read.parquet).collect()}
    out, _ = run(spark, sides(lambda path: live.read_stream(spark, path, schema)), "append", tmp_path)
    want = {
        (p, e) for v, p, m, *_ in pings for w, e, n, *_ in events if v == w and abs(m - n) * 60 <= tol
    }
    assert batch == want and {tuple(r) for r in out.collect()} == want


def test_enrich_emits_only_over_limit(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", BATCHES[:1]).withColumn("cell", F.col("vessel_id"))
    risk = spark.createDataFrame([(1, 5.0), (2, 9.0)], "cell long, cost double")
    out, _ = run(spark, live.enrich_stream(stream, risk, ["cell"], 5.0), "append", tmp_path)
    assert {r.vessel_id for r in out.collect()} == {2}


def test_enrichment_sees_a_new_surface(spark, tmp_path):
    """Each micro-batch reads the newest version: the second file meets the second surface."""
    from icefathom.operators import risk as surfaces

    path, seen = str(tmp_path / "surface"), {}

    def surface(cost):
        rows = [("C", 1, v, 0, cost if v == 2 else 0.0) for v in (1, 2)] + [("A", 1, 2, 0, 99.0)]
        return spark.createDataFrame(rows, "profile string, slot int, cell_i long, cell_j int, cost double")

    def sink(alerts, number):
        seen[number] = {r.ping_id for r in alerts.collect()}
        if number == 0:
            surfaces.store_surface(surface(1.0), path, 2)

    surfaces.store_surface(surface(9.0), path, 1)
    stream = feed(spark, tmp_path / "in", BATCHES[:1] + BATCHES[2:3]).withColumns({"cell_i": F.col("vessel_id"), "slot": F.lit(1)})
    each = live.enrich_batches(path, ["cell_i", "slot"], 5.0, sink, profile="C")
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {0: {2, 3}, 1: set()}


def test_stream_keeps_a_table(spark, tmp_path):
    """Newest rows over several batches; old versions stay readable until they are swept out."""
    stream, path = feed(spark, tmp_path / "in", BATCHES), str(tmp_path / "state")
    each = state.upsert_batches(path, ["vessel_id"], ["ts", "ping_id"], buckets=4)
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert state.state_versions(spark, path) == [0, 1, 2, 3]
    latest = live.latest_state(spark.read.parquet(str(tmp_path / "in")))
    cols = ["vessel_id", "ts", "ping_id", "status"]
    assert sorted(state.read_state(spark, path).select(cols).collect()) == sorted(latest.select(cols).collect())
    assert {r.vessel_id: r.ping_id for r in state.read_state(spark, path, 0).collect()} == {1: 1, 2: 3}
    assert state.vacuum_state(spark, path, keep=1) > 0
    assert state.state_versions(spark, path) == [3]
    assert sorted(state.read_state(spark, path).select(cols).collect()) == sorted(latest.select(cols).collect())


def test_repeated_and_broken_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    each = state.upsert_batches(path, ["k"], ["t"], buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, t long, v string")
    read = lambda: sorted(map(tuple, state.read_state(spark, path).collect()), key=str)
    with pytest.raises(ValueError):
        state.read_state(spark, path)
    each(rows(), 0)
    each(rows((1, 1, "a"), (2, 1, "b"), (None, 1, "n")), 1)
    each(rows((1, 5, "c"), (1, 4, "older"), (3, 1, "d")), 2)
    after = read()
    assert after == sorted([(1, 5, "c"), (2, 1, "b"), (3, 1, "d"), (None, 1, "n")], key=str)
    each(rows((1, 9, "again")), 2)  # a number that is done
    assert read() == after
    rows((1, 99, "half")).write.parquet(f"{path}/data/3/_bucket=0")  # data without a manifest
    assert read() == after
    each(rows((2, 1, "tie"), (4, 1, "e")), 3)
    assert read() == sorted([(1, 5, "c"), (2, 1, "tie"), (3, 1, "d"), (4, 1, "e"), (None, 1, "n")], key=str)
    with pytest.raises(ValueError):
        state.upsert_batches(path, ["k"], ["t"], buckets=9)(rows((1, 1, "x")), 4)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "state")
    each = state.upsert_batches(path, ["k"], ["t"], buckets=32)
    each(spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("t")), 0)
    each(spark.createDataFrame([(7, 1)], "k long, t int"), 1)
    assert len(list((tmp_path / "state" / "data" / "0").glob("_bucket=*"))) == 32
    assert len(list((tmp_path / "state" / "data" / "1").glob("_bucket=*"))) == 1
    assert state.read_state(spark, path).count() == 1000


def test_enrichment_reads_the_slots_of_the_batch(spark, tmp_path):
    pings = spark.createDataFrame([(1, 3), (2, 5), (3, None)], "cell long, slot long")
    path = str(tmp_path / "surface")
    surface = spark.range(20).select(F.lit(1).alias("version"), F.col("id").alias("slot"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("cell"), F.lit(9.0).alias("cost"))
    surface.write.partitionBy("version", "slot").parquet(path)
    seen = []
    each = live.enrich_batches(path, ["cell", "slot"], 5.0, lambda alerts, n: seen.append((sorted((r.cell, r.slot) for r in alerts.collect()), len(alerts.inputFiles()))))
    each(pings, 0)
    assert seen[0][0] == [(1, 3), (2, 5)]
    plan = spark.read.parquet(path).filter(live._in_slots(pings, "slot"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [slot" in plan and "IN (3,5)" in plan


def test_a_streamed_event_meets_the_pings_of_its_hours_only(spark, tmp_path, capsys):
    feed(spark, tmp_path / "p", [[(1, p, p * 60, -65.0, 0.0, "ok") for p in range(3)]])
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = live.read_stream(spark, str(tmp_path / "p"), schema)
    pings = rows.select("ping_id", F.col("vessel_id").alias("cell"), "ts")
    events = rows.select(F.col("ping_id").alias("event_id"), F.col("vessel_id").alias("cell"), F.col("ts").alias("event_ts"))
    met = live.event_match(pings, events, ["cell"], 3600)
    assert met.columns == ["ping_id", "cell", "ts", "event_id", "event_ts"]
    met.explain()
    join = next(line for line in capsys.readouterr().out.splitlines() if "StreamingSymmetricHashJoin" in line)
    assert "_b#" in join.split("]")[0]
