import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icefathom.functions import geo
from icefathom.operators import geometry as g
from icefathom.operators import segments as sg

T0 = datetime(2024, 1, 1)


def track(spark, rows):
    """rows: (id, fix_id, hours, lat, lon)"""
    return spark.createDataFrame(
        [(i, f, T0 + timedelta(hours=h), float(a), float(o)) for i, f, h, a, o in rows],
        "id long, fix_id long, ts timestamp, lat double, lon double",
    )


def random_track(spark, n, seed=1, ids=3, hot=None):
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        i = 0 if hot and f < n * hot else rng.randrange(ids)
        rows.append((i, f, rng.randrange(0, 400) / 4, -60 - 25 * rng.random(), 360 * rng.random() - 180))
    return track(spark, rows)


def test_projection_known_values(spark):
    df = spark.createDataFrame([(-71.0, 0.0), (-90.0, 0.0), (-71.0, 90.0)], "lat double, lon double")
    rows = g.project_3031(df).collect()
    assert rows[0].y == pytest.approx(2082760.1085, abs=1e-3) and abs(rows[0].x) < 1e-6
    assert abs(rows[1].x) < 1e-6 and abs(rows[1].y) < 1e-6
    assert rows[2].x == pytest.approx(2082760.1085, abs=1e-3)


def test_round_trip(spark):
    rng = random.Random(2)
    pts = [(i, -89.999 + 60 * rng.random(), 360 * rng.random() - 180) for i in range(500)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    back = g.unproject_3031(g.project_3031(df).drop("lat", "lon")).collect()
    for r in back:
        _, lat, lon = pts[r.id]
        assert abs(r.lat - lat) < 1e-6 and abs(r.lon - lon) < 1e-6


def test_scale_factor(spark):
    lats = [-60.0, -71.0, -89.0, -90.0]
    df = spark.createDataFrame([(a,) for a in lats], "lat double").withColumn("k", geo.polar_scale(F.col("lat")))
    k = {r.lat: r.k for r in df.collect()}
    assert k[-71.0] == pytest.approx(1.0, abs=1e-9)
    assert k[-90.0] == pytest.approx(0.9727690, abs=1e-5)
    assert k[-89.0] > k[-90.0] and k[-60.0] > 1


def test_distance_and_moves(spark):
    df = spark.createDataFrame([(-65.0, 179.9), (-90.0, 0.0), (-65.0, -180.0)], "lat double, lon double")
    moved = g.move_points(df, F.lit(90.0), F.lit(25.0), out=("mlat", "mlon"))
    out = g.add_distance_km(moved, ("lat", "lon"), ("mlat", "mlon")).collect()
    for r in out:
        assert r.km == pytest.approx(25.0, abs=1e-6)
        assert -180 <= r.mlon < 180
    same = g.add_bearing(df.withColumns({"a": F.col("lat"), "o": F.col("lon")}), ("lat", "lon"), ("a", "o"))
    assert all(0 <= r.bearing < 360 for r in same.collect())


@pytest.mark.parametrize("max_rows", [None, 4, 2_000_000])
@pytest.mark.parametrize("seconds", [3600.0, 86400.0])
def test_segments_change_nothing(spark, max_rows, seconds):
    df = random_track(spark, 400, hot=0.4)
    cut = sg.add_segment(df, ["id"], "ts", seconds, max_rows)
    order = ["ts", "fix_id"]
    w = sg.segment_window(["id"], order)
    near = sg.carry_neighbours(cut, ["id"], order, back=3, ahead=2)
    got = sg.drop_carried(
        near.withColumns({"a": F.lag("fix_id", 3).over(w), "b": F.lag("fix_id").over(w), "c": F.lead("fix_id", 2).over(w)})
    )
    got = sg.running_sum(got, ["id"], order, F.col("fix_id"), "s").select("id", "fix_id", "a", "b", "c", "s")
    whole = W.partitionBy("id").orderBy(*order)
    want = df.select(
        "id", "fix_id", F.lag("fix_id", 3).over(whole).alias("a"), F.lag("fix_id").over(whole).alias("b"),
        F.lead("fix_id", 2).over(whole).alias("c"),
        F.sum("fix_id").over(whole.rowsBetween(W.unboundedPreceding, 0)).alias("s"),
    )
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_hot_segment_is_cut(spark):
    df = track(spark, [(1, f, f / 1000, -65, 0) for f in range(1000)] + [(2, 5000, 0, -65, 0)])
    sizes = sg.add_segment(df, ["id"], "ts", 86400.0, 100).groupBy("id", sg.SEGMENT).count().collect()
    assert max(r["count"] for r in sizes) <= 150
    assert sum(r["count"] for r in sizes) == 1001


def test_leg_metrics_edges(spark):
    df = track(spark, [(1, 1, 0, -65, 0), (1, 2, 1, -65, 1), (1, 3, 1, -65, 1), (1, 4, 30, -64, 1), (2, 9, 5, -70, 3)])
    r = {x.fix_id: x for x in g.leg_metrics(df, "id").collect()}
    assert r[1].leg_km is None and r[9].leg_km is None
    assert r[2].prev_id == 1 and r[2].leg_km == pytest.approx(46.99, abs=0.05)
    assert r[3].leg_h == 0 and r[3].speed_kmh is None
    assert r[4].prev_id == 3 and r[4].leg_h == pytest.approx(29.0)


def test_split_both_ways(spark):
    df = track(
        spark,
        [(1, 1, 0, -60, 179), (1, 2, 30, -62, -179), (1, 3, 60, -62, -170), (1, 4, 90, -64, 178), (2, 5, 0, -60, 180), (2, 6, 1, -60, -180),
         (3, 7, 0, -60, 10)],
    )
    rows = g.split_antimeridian(df, "id").collect()
    one = sorted(((r.part, r.fix_id, r.piece, round(r.lat, 6), r.lon) for r in rows if r.id == 1))
    assert one == [
        (0, 1, 2, -60.0, 179.0), (0, 2, 0, -61.0, 180.0),
        (1, 2, 1, -61.0, -180.0), (1, 2, 2, -62.0, -179.0), (1, 3, 2, -62.0, -170.0),
        (1, 4, 0, pytest.approx(-63.666667, abs=1e-5), -180.0),
        (2, 4, 1, pytest.approx(-63.666667, abs=1e-5), 180.0), (2, 4, 2, -64.0, 178.0),
    ]
    assert all(r.lat == -60.0 for r in rows if r.id == 2)
    assert [r.part for r in rows if r.id == 3] == [0]


def test_split_keeps_length(spark):
    df = random_track(spark, 200, seed=5)
    split = g.split_antimeridian(df, "id").withColumn("k", F.col("fix_id") * 3 + F.col("piece"))
    w = W.partitionBy("id", "part").orderBy("ts", "k")
    km = split.withColumn("km", geo.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    assert km.filter("abs(lon) > 180").count() == 0
    assert km.filter("km is null").select("id", "part").distinct().count() == split.select("id", "part").distinct().count()


def test_part_lines_are_bounded(spark):
    df = track(spark, [(1, f, f / 10, -65, f / 10) for f in range(100)])
    lines = g.part_lines(g.split_antimeridian(df, "id"), "id", points=7).collect()
    assert max(len(r.coords) for r in lines) <= 8
    ordered = sorted(lines, key=lambda r: (r.line.slot, r.line.cut, r.line._block))
    drawn = [c for r in ordered for c in r.coords]
    assert len(drawn) == 100 + len(lines) - 1
    assert all(a.coords[-1] == b.coords[0] for a, b in zip(ordered, ordered[1:]))


def test_features_are_valid_lines(spark):
    import json

    from icefathom.sources import geojson

    df = track(spark, [(1, 1, 0, -65, 170), (1, 2, 0.1, -64, -170), (1, 3, 0.2, -63, -160), (2, 4, 0, -70, 0)])
    split = g.split_antimeridian(df, "id")
    pieces = [json.loads(r.feature)["geometry"] for r in geojson.to_geojson_lines(g.part_lines(split, "id"), ["id", "part"]).collect()]
    assert sorted(p["type"] for p in pieces) == ["LineString", "LineString", "Point"]
    routes = geojson.to_geojson_routes(g.route_lines(split, "id"), ["id"]).collect()
    (route,) = [json.loads(r.feature) for r in routes]
    assert route["properties"] == {"id": 1} and route["geometry"]["type"] == "MultiLineString"
    assert [[round(x, 3) for x, _ in line] for line in route["geometry"]["coordinates"]] == [[170, 180], [-180, -170, -160]]


def test_land_mask_vertex_rules_and_bands(spark):
    square = [(0, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 10.0, 10.0), (2, 10.0, 10.0, 0.0, 10.0), (3, 0.0, 10.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "edge_id int, x1 double, y1 double, x2 double, y2 double")
    pts = [(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 0.0, 0.0), (4, 10.0, 10.0), (5, -1.0, 5.0), (6, 5.0, 10.0), (7, 5.0, 0.0)]
    points = spark.createDataFrame(pts, "id long, x double, y double")
    for band in (1.0, 3.0, 100.0):
        got = {r.id: r.on_land for r in g.land_mask(points, edges, "id", band).collect()}
        assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_land_mask_of_a_long_outline(spark):
    """A star of 10,000 edges against the ray rule; a point meets the edges of its own cell."""
    import random

    draw, n = random.Random(3), 10_000
    ring = []
    for i in range(n):
        angle, far = 2 * math.pi * i / n, 1_000_000 * draw.uniform(0.55, 1.0)
        ring.append((far * math.cos(angle), far * math.sin(angle)))
    edges = [(*ring[i], *ring[(i + 1) % n]) for i in range(n)]
    spots = [(i, draw.uniform(-1.1e6, 1.1e6), draw.uniform(-1.1e6, 1.1e6)) for i in range(400)]

    def inside(x, y):
        return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in edges) % 2 == 1

    points = spark.createDataFrame(spots + [(1000, None, 0.0), (1001, 0.0, None), (1002, 5e6, 5e6)], "id long, x double, y double")
    outline = spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.on_land for r in g.land_mask(points, outline, "id").collect()}
    assert {i: got[i] for i, _, _ in spots} == {i: inside(x, y) for i, x, y in spots}
    assert got[1000] is None and got[1001] is None and got[1002] is False
    cells = points.selectExpr("cast(floor(x / 25000) as bigint) _ci", "cast(floor(y / 25000) as bigint) _cj").filter("_ci is not null and _cj is not null")
    most = g.land_cells(cells, outline, 25_000.0).selectExpr("max(size(_edges)) as n").first().n
    assert most < n / 20


def test_simplify_keeps_ends_and_bends(spark):
    df = track(spark, [(1, 1, 0, -65, 0), (1, 2, 30, -65, 1e-9), (1, 3, 60, -64, 0), (1, 4, 90, -64, 5), (2, 5, 0, -70, 0)])
    kept = {r.fix_id for r in g.simplify_track(df, 1.0, "id").collect()}
    assert {1, 3, 4, 5} <= kept and 2 not in kept
    assert {1, 4, 5} <= {r.fix_id for r in g.simplify_track(df, 1e9, "id", passes=2).collect()}


def test_wind(spark):
    df = spark.createDataFrame([(-90.0, 10.0, 0.0), (0.0, 10.0, 270.0)], "lat double, s double, d double")
    a, b = g.wind_features(df, "s", "d").collect()
    assert a.coriolis == pytest.approx(-2 * 7.2921159e-5) and a.wind_v == pytest.approx(-10)
    assert b.wind_u == pytest.approx(10) and b.coriolis == 0
    assert math.isclose(b.wind_v, 0, abs_tol=1e-9)
