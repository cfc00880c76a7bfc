import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.operators import quality
from icefathom.sources import feeds, geojson, state, tracks

NAN = float("nan")
SCHEMA = "id long, lat double, lon double, speed double"


def test_validate_edges(spark):
    rows = [
        (1, -70.0, 10.0, 1.0),
        (2, None, 10.0, 1.0),
        (3, NAN, 10.0, 1.0),
        (4, -90.5, 10.0, 1.0),
        (5, -90.0, 180.0, 0.0),
        (6, -70.0, -180.0, 1.0),
        (7, -70.0, 180.1, 1.0),
        (8, -70.0, None, -1.0),
        (9, 90.0, NAN, 1.0),
    ]
    ok, rejects = quality.validate(spark.createDataFrame(rows, SCHEMA), quality.fix_rules(speed="speed"))
    assert sorted(r.id for r in ok.collect()) == [1, 5, 6]
    reasons = {r.id: r.reasons for r in rejects.collect()}
    assert reasons == {
        2: ["lat_missing"],
        3: ["lat_missing"],
        4: ["lat_range"],
        7: ["lon_range"],
        8: ["lon_missing", "speed_negative"],
        9: ["lon_missing"],
    }


def test_validate_empty(spark):
    ok, rejects = quality.validate(spark.createDataFrame([], SCHEMA))
    assert ok.count() == rejects.count() == 0


def test_dedupe_lowest_id_wins(spark):
    df = spark.createDataFrame([(1, 5, 9), (1, 5, 3), (1, 6, 4)], "id long, ts long, fix_id long")
    assert sorted(quality.dedupe_fixes(df, ["id", "ts"], "fix_id").collect()) == [(1, 5, 3), (1, 6, 4)]


def test_feed_freshness_limit_is_exclusive(spark):
    df = spark.createDataFrame(
        [("radar", datetime(2024, 1, 1)), ("radar", datetime(2024, 1, 3)), ("waves", datetime(2024, 1, 1))],
        "feed string, ts timestamp",
    )
    got = {r.feed: (r.age_h, r.stale) for r in quality.feed_freshness(df, F.lit(datetime(2024, 1, 4)), 24.0).collect()}
    assert got == {"radar": (24.0, False), "waves": (72.0, True)}


def test_read_tracks_keeps_malformed_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "id,fix_id,ts,lat,lon\n1,1,2024-01-01 00:00:00,-65.5,10.25\n1,2,not a time,-65,x\n2,3,2024-01-02 00:00:00,-70,\n"
        "3,4,2024-01-02 00:00:00,-70\n3,5,2024-01-02 00:00:00,-70,1,9\n3,6,\"2024-01-02 00:00:00\",-70,2\n\n"
    )
    good, bad = tracks.split_corrupt(tracks.read_tracks(spark, str(tmp_path)))
    assert sorted((r.fix_id, r.lon) for r in good.collect()) == [(1, 10.25), (3, None), (6, 2.0)]
    assert good.select("id").count() == good.count() == 3
    rejected = ["1,2,not a time,-65,x", "3,4,2024-01-02 00:00:00,-70", "3,5,2024-01-02 00:00:00,-70,1,9"]
    assert sorted(r[0] for r in bad.collect()) == rejected and bad.count() == 3


def test_geojson_collection_and_lines(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"name": "A", "n": 1}, "geometry": {"type": "Point", "coordinates": [10.5, -66.0]}},
        {"type": "Feature", "properties": {"name": "B", "n": 2},
         "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    props = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    points = {r.name: r.coordinates for r in geojson.read_geojson(spark, str(tmp_path / "c.json"), props).collect()}
    assert points == {"A": [10.5, -66.0], "B": None}
    lines = geojson.read_geojson(spark, str(tmp_path / "c.json"), props, "LineString").filter("name = 'B'").first()
    assert lines.coordinates == [[1.0, 2.0], [3.0, 4.0]]

    df = spark.createDataFrame([("A", 1, -66.0, 10.5)], "name string, n int, lat double, lon double")
    geojson.write_features(geojson.to_geojson_points(df, ["name", "n"]), str(tmp_path / "out"))
    again = geojson.read_geojson(spark, str(tmp_path / "out"), props, lines=True).first()
    assert (again.name, again.n, again.coordinates) == ("A", 1, [10.5, -66.0])


def test_feed_reads_only_its_folders(spark, tmp_path):
    rows = [("ice", "2024-01-01", 1, 0.5), ("ice", "2024-01-02", 2, 0.6), ("wave", "2024-01-01", 1, 3.0)]
    df = spark.createDataFrame(rows, "feed string, date string, cell long, value double").withColumn("date", F.to_date("date"))
    feeds.write_feed(df, str(tmp_path / "f"))
    got = feeds.read_feed(spark, str(tmp_path / "f"), "ice", "2024-01-02")
    assert [(r.cell, r.value) for r in got.collect()] == [(2, 0.6)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(feed" in plan


def test_union_and_guard(spark):
    a = spark.createDataFrame([(1, 1.0)], "cell long, value double")
    b = spark.createDataFrame([(2, "x")], "cell long, note string")
    both = feeds.union_feeds({"LIVE": a, "SIMULATION": b})
    assert sorted(both.columns) == ["cell", "note", "regime", "value"]
    kept, dropped = feeds.regime_guard(both, ["LIVE"])
    assert [r.cell for r in kept.collect()] == [1]
    assert [tuple(r) for r in dropped.collect()] == [("SIMULATION", 1)]
    untagged = both.withColumn("regime", F.lit(None).cast("string"))
    assert feeds.regime_guard(untagged, ["LIVE"])[0].count() == 0
    with pytest.raises(ValueError):
        feeds.union_feeds({"GUESS": a})


def test_merge_state_ties(spark):
    old = spark.createDataFrame([(1, 10, 5, "old"), (2, 10, 5, "old"), (3, 10, 5, "old")], "k long, t long, id long, v string")
    new = spark.createDataFrame([(1, 10, 5, "new"), (2, 9, 9, "new"), (4, 1, 1, "new")], "k long, t long, id long, v string")
    got = {r.k: r.v for r in state.merge_state(old, new, ["k"], ["t", "id"]).collect()}
    assert got == {1: "new", 2: "old", 3: "old", 4: "new"}
    assert state.merge_state(old.limit(0), new.limit(0), ["k"], ["t", "id"]).count() == 0


def test_unknown_speed_is_refused(spark):
    rows = [(1, -65.0, 1.0, 3.0), (2, -65.0, 1.0, None), (3, -65.0, 1.0, float("nan")), (4, -65.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, v double")
    ok, bad = quality.validate(df, quality.fix_rules(speed="v"))
    assert [r.id for r in ok.collect()] == [1]
    assert {r.id: r.reasons for r in bad.collect()} == {2: ["speed_missing"], 3: ["speed_missing"], 4: ["speed_negative"]}
