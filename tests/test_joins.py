import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from icefathom.functions.geo import EARTH_RADIUS_KM
from icefathom.operators import geometry, joins, nearest, routes, spread

T0 = datetime(2024, 1, 1)


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))


def points(spark, rows, name):
    return spark.createDataFrame(
        [(i, T0 + timedelta(seconds=s), float(a), float(o)) for i, s, a, o in rows],
        f"{name} long, ts timestamp, lat double, lon double",
    )


def scatter(n, seed, crowd=0.0):
    """Random points round the pole, a share of them in one spot."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < crowd:
            rows.append((i, rng.randrange(86400), -70 + rng.random() * 1e-3, 179.999 + rng.random() * 1e-3))
        else:
            rows.append((i, rng.randrange(86400), -60 - 30 * rng.random(), 360 * rng.random() - 180))
    return rows + [(n, 0, -90.0, 0.0), (n + 1, 0, -70.0, 180.0), (n + 2, 0, -70.0, -180.0), (n + 3, 0, -89.9, 45.0)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("segment_s", [600.0, 86400.0])
def test_asof_equals_brute_force(spark, direction, segment_s):
    rng = random.Random(3)
    left = [(rng.randrange(3), rng.randrange(0, 20000, 50), i) for i in range(150)] + [(9, 5, 999)]
    right = [(rng.randrange(3), rng.randrange(0, 20000, 50), i) for i in range(90)]
    l = spark.createDataFrame([(k, T0 + timedelta(seconds=s), i) for k, s, i in left], "k long, ts timestamp, l long")
    r = spark.createDataFrame([(k, T0 + timedelta(seconds=s), i) for k, s, i in right], "k long, ts timestamp, rid long")
    got = {x.l: x.r_rid for x in joins.asof_join(l, r, ["k"], "ts", "rid", 1500.0, direction, segment_s=segment_s).collect()}
    assert len(got) == len(left)
    for k, s, i in left:
        fits = [(t, rid) for kk, t, rid in right if kk == k and (t <= s if direction == "backward" else t >= s)]
        best = max(fits) if direction == "backward" and fits else None
        if direction == "forward" and fits:
            best = (min(fits)[0], max(rid for t, rid in fits if t == min(fits)[0]))
        want = best[1] if best and abs(best[0] - s) <= 1500 else None
        assert got[i] == want


def test_asof_empty_right_keeps_left(spark):
    l = spark.createDataFrame([(1, T0)], "k long, ts timestamp")
    r = spark.createDataFrame([], "k long, ts timestamp, rid long")
    assert [tuple(x) for x in joins.asof_join(l, r, ["k"], "ts", "rid").collect()] == [(1, T0, None, None)]
    with pytest.raises(ValueError):
        joins.asof_join(l, r, ["k"], "ts", "rid", direction="sideways")


@pytest.mark.parametrize("block", [5, 20_000])
def test_within_km_equals_brute_force(spark, monkeypatch, block):
    real = spread.block_join
    monkeypatch.setattr(joins, "block_join", lambda *a: real(*a, block_rows=block))
    a, b = scatter(120, 1, 0.3), scatter(120, 2, 0.3)
    got = joins.within_km(points(spark, a, "p"), points(spark, b, "q"), 300.0, "p", "q")
    want = {(x[0], y[0]) for x in a for y in b if km(x[2:], y[2:]) <= 300.0}
    rows = [(r.p, r.b_q) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_within_km_skips_missing_positions(spark):
    p = spark.createDataFrame([(1, None, 1.0), (2, -70.0, 1.0)], "p long, lat double, lon double")
    q = p.withColumnRenamed("p", "q")
    assert [(r.p, r.b_q) for r in joins.within_km(p, q, 1.0, "p", "q").collect()] == [(2, 2)]


def test_block_join_splits_hot_keys_exactly(spark):
    left = spark.range(900).select(F.col("id").alias("l"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(600).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    plain = left.join(right, ["k"]).select("k", "l", "r")
    split = spread.block_join(left, right, ["k"], "l", "r", 50).select("k", "l", "r")
    assert split.count() == plain.count() == split.distinct().count()
    assert split.exceptAll(plain).count() == 0


def test_interval_edges_are_inclusive(spark):
    a = points(spark, [(1, 1000, -65, 0)], "p").withColumn("k", F.lit(1))
    b = points(spark, [(i, s, -65, 0) for i, s in enumerate([399, 400, 1000, 1200, 1201])], "q").withColumn("k", F.lit(1))
    got = joins.interval_match(a, b, ["k"], 600.0, 200.0, "p", "q").collect()
    assert sorted(r.b_q for r in got) == [1, 2, 3]


@pytest.mark.parametrize("k", [1, 3, 200])
@pytest.mark.parametrize("cell", [2.0, 500.0])
def test_nearest_equals_brute_force(spark, k, cell):
    a, b = scatter(60, 4, 0.3), scatter(40, 5, 0.3)
    got = nearest.nearest(points(spark, a, "p").drop("ts"), points(spark, b, "q").drop("ts"), k, "p", "q", cell).collect()
    by_point = {}
    for r in got:
        by_point.setdefault(r.p, []).append((r.rank, r.t_q, r.dist_km))
    assert len(by_point) == len(a)
    for p in a:
        want = sorted(km(p[2:], q[2:]) for q in b)[:k]
        have = [d for _, _, d in sorted(by_point[p[0]])]
        assert have == pytest.approx(want, abs=1e-6)


def test_nearest_tie_and_missing(spark):
    p = spark.createDataFrame([(1, -70.0, 0.0), (2, None, None)], "p long, lat double, lon double")
    q = spark.createDataFrame([(8, -71.0, 5.0), (3, -71.0, 5.0), (5, None, 1.0)], "q long, lat double, lon double")
    assert [(r.p, r.t_q) for r in nearest.nearest(p, q, 1, "p", "q").collect()] == [(1, 3)]
    assert nearest.nearest(p, q.limit(0), 1, "p", "q").count() == 0


@pytest.mark.parametrize("cell", [2.0, 300.0])
def test_standoff_equals_brute_force(spark, cell):
    a, b = scatter(120, 6, 0.3), scatter(80, 7, 0.2)
    p = points(spark, a, "p").withColumn("route", F.col("p") % 5)
    got = {r.route: r.standoff_km for r in routes.standoff(p, points(spark, b, "q"), "route", "p", "q", cell).collect()}
    for route in range(5):
        want = min(km(x[2:], y[2:]) for x in a if x[0] % 5 == route for y in b)
        assert got[route] == pytest.approx(want, abs=1e-6)


def test_cpa_head_on_still_and_passed(spark):
    base = geometry.project_3031(points(spark, [(1, 0, -71.0, 0.0)], "p")).withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0)})
    other = geometry.project_3031(points(spark, [(5, 0, -70.5, 0.0)], "q"))

    def run(vy):
        b = other.withColumns({"vx": F.lit(0.0), "vy": F.lit(vy)})
        return joins.cpa(base, b, 12.0, 100.0, 60.0, "p", "q").first()

    still, closing, leaving, slow = run(0.0), run(-10.0), run(10.0), run(-1.0)
    gap = still.cpa_km
    assert still.t_star_h == 0 and gap == pytest.approx(55.7, abs=0.3)
    assert closing.cpa_km == pytest.approx(0, abs=1e-6) and closing.t_star_h == pytest.approx(gap / 10, abs=1e-6)
    assert leaving.t_star_h == 0 and leaving.cpa_km == pytest.approx(gap)
    assert slow.t_star_h == 12.0 and slow.cpa_km == pytest.approx(gap - 12, abs=1e-6)


def test_source_fallback_rules(spark):
    rows = [
        (1, 1, 10.0, T0, 1), (1, 2, 20.0, T0 + timedelta(hours=9), 2),
        (2, 1, 11.0, T0 + timedelta(hours=8), 3), (2, 1, 12.0, T0 + timedelta(hours=8), 4),
        (3, 1, 13.0, T0 - timedelta(days=9), 5),
        (4, 1, 14.0, T0 + timedelta(hours=99), 6),
    ]
    df = spark.createDataFrame(rows, "cell long, priority int, value double, ts timestamp, obs_id long")
    got = joins.source_fallback(df, ["cell"], F.lit(T0 + timedelta(hours=10)), 5.0)
    out = {r.cell: (r.value, r.used_feed, r.is_fallback) for r in got.collect()}
    assert out == {1: (20.0, 2, True), 2: (11.0, 1, False), 3: (None, None, None), 4: (None, None, None)}


def test_sample_env_misses_are_null(spark):
    p = spark.createDataFrame([(1, 1, 1, 1), (2, 9, 9, 9)], "p int, cell_i int, cell_j int, slot int")
    g = spark.createDataFrame([(1, 1, 1, 0.5)], "cell_i int, cell_j int, slot int, sic double")
    assert {r.p: r.sic for r in joins.sample_env(p, g).collect()} == {1: 0.5, 2: None}


def test_fan_out_both_ways(spark):
    df = spark.range(50).withColumnRenamed("id", "cell")
    params = spark.range(9).select(F.col("id").alias("s"), (F.col("id") * 0.5).alias("m"))
    small = spread.fan_out(df, params)
    large = spread.fan_out(df, params, max_rows=3)
    assert small.count() == large.count() == 450
    assert small.exceptAll(large.select(small.columns)).count() == 0
    assert spread.fan_out(df, params.limit(0)).count() == 0
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString()


def test_cpa_moves_the_berg_to_the_vessels_time(spark):
    """A berg seen 3 h ago 30 km off at 10 km/h along x is 60 km off now, not 30."""
    from datetime import datetime

    shape = "{0} long, ts timestamp, lat double, lon double, x double, y double, vx double, vy double"
    ship = spark.createDataFrame([(1, datetime(2024, 1, 1, 3), -71.0, 0.0, 0.0, 2.0e6, 0.0, 0.0)], shape.format("ping_id"))
    berg = spark.createDataFrame([(9, datetime(2024, 1, 1, 0), -71.0, 0.5, 30_000.0, 2.0e6, 10.0, 0.0)], shape.format("fix_id"))
    got = joins.cpa(ship, berg, 12.0, 100.0, 4 * 3600.0, "ping_id", "fix_id").first()
    same = joins.cpa(ship.withColumn("ts", F.col("ts") - F.expr("interval 3 hours")), berg, 12.0, 100.0, 4 * 3600.0, "ping_id", "fix_id").first()
    assert got.t_star_h == 0.0 and got.cpa_km == pytest.approx(2 * same.cpa_km)


def test_watch_gives_each_berg_one_place(spark):
    from icefathom.operators import routes

    rows = [(1, 7, 70, 1.0, 0.5), (1, 7, 71, 2.0, 0.5), (1, 7, 72, 3.0, 0.5), (1, 8, 80, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "v long, b long, f long, cpa_km double, t_star_h double")
    got = routes.collision_watch(df, [("near", 5.0, 1.0)], 2, "v", "f", "b").orderBy("rank").collect()
    assert [(r.b, r.f) for r in got] == [(7, 70), (8, 80)]


def test_unknown_keys_and_sizes_are_sent_or_cut(spark):
    from datetime import datetime

    from icefathom.operators import routes

    rows = [(None, i, datetime(2024, 1, 1 + i), "x" * 100 if i != 1 else None) for i in range(4)]
    df = spark.createDataFrame(rows, "link string, id long, ts timestamp, payload string").withColumn("p", F.lit(1))
    out = routes.bandwidth_budget(df, "link", "p", "ts", "id", "payload", 1600.0, 1.0)
    assert {r.id: r.sent for r in out.collect()} == {0: True, 1: False, 2: True, 3: False}
    rep = routes.budget_report(out, "link").first()
    assert (rep.n_sent, rep.n_cut, rep.bytes_sent, rep.bytes_cut) == (2, 2, 200, 100)


def spot(draw, n, first):
    """Positions within some 100 m of one place, some of them equal."""
    rows = [(first + i, -70.0 + draw.uniform(0, 1e-3), 10.0 + draw.uniform(0, 1e-3)) for i in range(n)]
    return rows[: n - n // 10] + [(first + n - n // 10 + i, -70.0005, 10.0005) for i in range(n // 10)]


def test_nearest_in_one_spot_equals_brute_force(spark):
    from icefathom.functions import geo as fgeo

    draw = random.Random(12)
    a = spark.createDataFrame(spot(draw, 300, 0) + [(9000, None, 1.0), (9001, -60.0, 100.0)], "pid long, lat double, lon double")
    b = spark.createDataFrame(spot(draw, 300, 5000) + [(8000, -61.0, 99.0)], "tid long, lat double, lon double")
    got = {}
    for r in nearest.nearest(a, b, 3, "pid", "tid").collect():
        got.setdefault(r.pid, []).append((r.rank, round(r.dist_km, 9), r.t_tid))
    near = fgeo.haversine_km(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon"))
    every = a.filter("lat is not null").join(b.select("tid", F.col("lat").alias("blat"), F.col("lon").alias("blon")), F.lit(True))
    want = {}
    for r in every.select("pid", "tid", near.alias("km")).collect():
        want.setdefault(r.pid, []).append((r.km, r.tid))
    assert set(got) == set(want)
    for pid, found in got.items():
        best = sorted(want[pid])[:3]
        assert [(round(km, 9), tid) for km, tid in best] == [(km, tid) for _, km, tid in sorted(found)]


def test_pairs_in_one_spot_grow_in_proportion(spark):
    made = {}
    for n in (500, 2000):
        draw = random.Random(n)
        a = spark.createDataFrame(spot(draw, n, 0), "pid long, lat double, lon double")
        b = spark.createDataFrame(spot(draw, n, 10_000), "tid long, lat double, lon double")
        placed, goals, leaves = nearest._setup(a, b, "tid", 1, 2.0, "t_")
        made[n] = placed.join(nearest._short_lists(leaves, goals, []), "_cell").count()
    assert made[2000] < 250 * 2000, made
    assert made[2000] < 8 * made[500]


def test_approaches_from_any_distance_equal_all_pairs(spark):
    """Fast ships far from slow bergs, bergs seen earlier or later, unknown velocities: none is missed."""
    from datetime import datetime

    draw = random.Random(8)
    shape = "{0} long, ts timestamp, lat double, lon double, x double, y double, vx double, vy double"

    def rows(n, speeds, spread):
        out = []
        for i in range(n):
            x, y = draw.uniform(-spread, spread), 1.5e6 + draw.uniform(-spread, spread)
            v = draw.choice(speeds)
            vx, vy = (None, None) if v is None else (v * draw.uniform(-1, 1), v * draw.uniform(-1, 1))
            out.append((i, datetime(2024, 1, 1, draw.randrange(6), draw.randrange(60)), -75.0 + draw.uniform(-2, 2), 0.0, x, y, vx, vy))
        return out

    ships, bergs = rows(150, (0.0, 12.0, 40.0, None), 4e5), rows(150, (0.0, 0.4, 3.0, None), 4e5)
    ships += [(900, datetime(2024, 1, 1, 3), -75.0, 0.0, 0.0, 2.0e6, 0.0, 30.0), (901, datetime(2024, 1, 1, 3), None, 0.0, None, None, 1.0, 1.0)]
    bergs += [(900, datetime(2024, 1, 1, 3), -75.0, 0.0, 0.0, 2.2e6, 0.0, 0.0)]
    a = spark.createDataFrame(ships, shape.format("ping_id"))
    b = spark.createDataFrame(bergs, shape.format("fix_id"))
    got = {(r.ping_id, r.b_fix_id): r.cpa_km for r in joins.approaches(a, b, 12.0, 15.0, 7200.0, "ping_id", "fix_id").collect()}
    wide = joins.cpa(a, b.withColumn("lat", F.lit(-75.0)).withColumn("lon", F.lit(0.0)), 12.0, 20_000.0, 7200.0, "ping_id", "fix_id")
    want = {(r.ping_id, r.b_fix_id): r.cpa_km for r in wide.filter("cpa_km <= 15").collect()}
    assert got == want and len(want) > 20
    assert got[(900, 900)] == pytest.approx(0.0, abs=1e-6)
    assert (900, 900) not in {(r.ping_id, r.b_fix_id) for r in joins.cpa(a, b.withColumn("lat", F.lit(-73.0)), 12.0, 100.0, 7200.0, "ping_id", "fix_id").collect()}
    assert joins.approaches(a.limit(0), b, 12.0, 15.0, 7200.0, "ping_id", "fix_id").count() == 0


def pair_conditions(df):
    """The planned join conditions, one line each."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join Inner" in line]


def test_pairs_compare_numbers_worked_out_once_a_row(spark):
    """No time is cast again for each pair: with a few rows a slot, pairs are most of the work."""
    a = points(spark, [(i, 60 * i, -65, 0) for i in range(30)], "p").withColumn("k", F.lit(1))
    b = points(spark, [(i, 45 * i, -65, 0) for i in range(30)], "q").withColumn("k", F.lit(1))
    found = joins.interval_match(a, b, ["k"], 600.0, 200.0, "p", "q")
    want = {(i, j) for i in range(30) for j in range(30) if -600 <= 45 * j - 60 * i <= 200}
    got = [(r.p, r.b_q) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = joins.within_km(a.drop("k"), b.drop("k"), 50.0, "p", "q", before_s=600.0, after_s=200.0)
    assert {(r.p, r.b_q) for r in near.collect()} == want
    for conditions in (pair_conditions(found), pair_conditions(near)):
        assert conditions and not any("unix_micros" in c for c in conditions)


def test_within_km_tests_the_line_before_the_great_circle(spark):
    """Pairs at the edge, at both ends of the globe and in one spot come out as the great circle has them."""
    from icefathom.functions import geo as fgeo

    spots = [(0, 0, 0.0, 0.0), (1, 0, 0.0, 180.0), (2, 0, 90.0, 0.0), (3, 0, -90.0, 50.0), (4, 0, 0.0, 179.999), (5, 0, 0.0, 1.0)]
    a, b = points(spark, spots, "p"), points(spark, spots, "q")
    for most in (0.0, km(spots[0][2:], spots[5][2:]), 10_100.0, 20_015.0, 30_000.0):
        every = a.crossJoin(b.select(F.col("q"), F.col("lat").alias("la"), F.col("lon").alias("lo")))
        far = fgeo.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))
        want = {(r.p, r.q): r.d for r in every.select("p", "q", far.alias("d")).filter(F.col("d") <= most).collect()}
        found = joins.within_km(a, b, most, "p", "q")
        assert {(r.p, r.b_q): r.dist_km for r in found.collect()} == want
    assert any("_ax" in c for c in pair_conditions(found))


def test_approaches_drop_pairs_before_the_closest_point(spark):
    """Pairs that pass each other too far away, or are too far to meet, end in the join itself."""
    from datetime import datetime

    shape = "{0} long, ts timestamp, lat double, lon double, x double, y double, vx double, vy double"
    at = datetime(2024, 1, 1, 3)
    ships = [(1, at, -75.0, 0.0, 0.0, 2.0e6, 20.0, 0.0)]
    bergs = [(i, at, -75.0, 0.0, 100_000.0, 2.0e6 + off, 0.0, 0.0) for i, off in enumerate((0.0, 9_000.0, 60_000.0, 900_000.0))]
    a, b = spark.createDataFrame(ships, shape.format("ping_id")), spark.createDataFrame(bergs, shape.format("fix_id"))
    found = joins.approaches(a, b, 12.0, 15.0, 7200.0, "ping_id", "fix_id")
    assert sorted(r.b_fix_id for r in found.collect()) == [0, 1]
    last = pair_conditions(found)[0]
    assert "vx" in last and "unix_micros" not in last


def test_vessels_go_only_where_a_berg_has_come(spark, monkeypatch):
    """A vessel has a copy for each reach that bergs have anywhere; those without a berg of it nearby end before the join."""
    shape = "{0} long, ts timestamp, lat double, lon double, x double, y double, vx double, vy double"
    a = spark.createDataFrame([(i, T0, -75.0, 0.0, 3.0e6 * i, 0.0, 1.0, 0.0) for i in range(50)], shape.format("ping_id"))
    bergs = [(i, T0, -75.0, 0.0, 1000.0, 1000.0 * i, 4.0**i, 0.0) for i in range(5)]
    b = spark.createDataFrame(bergs, shape.format("fix_id"))
    joined, block_join = [], joins.block_join
    monkeypatch.setattr(joins, "block_join", lambda left, *rest: joined.append(left.count()) or block_join(left, *rest))
    found = joins.approaches(a, b, 12.0, 15.0, 7200.0, "ping_id", "fix_id")
    want = joins.cpa(a, b, 12.0, 20_000.0, 7200.0, "ping_id", "fix_id").filter("cpa_km <= 15")
    pairs = {(r.ping_id, r.b_fix_id): r.cpa_km for r in found.collect()}
    assert pairs and pairs == {(r.ping_id, r.b_fix_id): r.cpa_km for r in want.collect()}
    # Before, 50 vessels times the reaches.
    assert joined[0] < 50


def test_copies_go_only_where_a_row_of_a_is(spark, monkeypatch):
    a = points(spark, [(1, 0, -65, 10), (2, 90_000, -65, 10)], "p")
    b = points(spark, [(i, 60 * i, -65 - i % 9, 3 * i) for i in range(100)], "q")
    joined, block_join = [], joins.block_join
    monkeypatch.setattr(joins, "block_join", lambda left, right, *rest: joined.append(right.count()) or block_join(left, right, *rest))
    found = joins.within_km(a, b, 100.0, "p", "q", before_s=3600.0, after_s=3600.0)
    want = {
        (i, j)
        for i, s, *at in ((1, 0, -65, 10), (2, 90_000, -65, 10))
        for j in range(100)
        if km(at, (-65 - j % 9, 3 * j)) <= 100 and abs(60 * j - s) <= 3600
    }
    assert {(r.p, r.b_q) for r in found.collect()} == want
    assert joined[0] <= 50  # 27 copies or more of each before


def approach_rows(n_vessels=3, n_bergs=200):
    """Every berg with every vessel several times; equal distances, unknown and endless ones among them."""
    rng, rows = random.Random(3), []
    for v in range(n_vessels):
        for b in range(n_bergs):
            rows += [(v, b, 10 * b + f, float(rng.randint(1, 400)), rng.choice([0.0, 2.0])) for f in range(4)]
    rows += [(7, b, b, 5.0, 0.0) for b in range(30)] + [(8, 1, 1, 3.0, 0.0), (8, 1, 2, 1.0, 0.0), (8, 2, 3, 9.0, 0.0)]
    return rows + [(9, 1, 4, None, 0.0), (9, 2, 5, float("nan"), 0.0), (9, 3, 6, 2.0, 0.0), (9, 4, 7, 2.0, 0.0), (None, 1, 8, 4.0, 0.0)]


def test_bound_of_a_watch_changes_no_row_and_drops_pairs_early(spark, monkeypatch):
    near = spark.createDataFrame(approach_rows(), "v long, b long, f long, cpa_km double, t_star_h double").repartition(3)
    bound = routes.watch_bound(near, 3, "v", "b")
    limits = [("near", 50.0, 1.0)]
    sorted_, latest_by = [], routes.latest_by
    monkeypatch.setattr(routes, "latest_by", lambda df, *rest: sorted_.append(df.count()) or latest_by(df, *rest))
    want = routes.collision_watch(near, limits, 3, "v", "f", "b")
    got = routes.collision_watch(near.join(bound, "v", "left"), limits, 3, "v", "f", "b", "_most").select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # Before, every pair was sorted and one row for each vessel and berg was shuffled.
    assert sorted_[0] == len(approach_rows()) and sorted_[1] < sorted_[0] / 4


@pytest.mark.parametrize("name", ["collision_watch", "collision_watch_any_distance"])
def test_watches_give_their_bound_to_the_operator(small, spark, monkeypatch, name):
    """What the queries sort stays in proportion to the vessels; the closest three are the same without the bound."""
    from icefathom.plans import meetings

    seen, watch = [], routes.collision_watch

    def spied(near, limits, k, vessel, fix, berg, most=None):
        kept = near.filter(F.coalesce(F.col("cpa_km") <= F.col(most), F.lit(True)))
        seen.append((near.count(), kept.count(), watch(near.drop(most), limits, k, vessel, fix, berg).select("vessel_id", "rank", "b_fix_id").collect()))
        return watch(near, limits, k, vessel, fix, berg, most)

    monkeypatch.setattr(meetings.routes, "collision_watch", spied)
    got = getattr(meetings, name)(spark, small).collect()
    every, kept, want = seen[0]
    assert kept <= every and {(r.vessel_id, r["rank"], r.fix_id) for r in got} == {tuple(r) for r in want}


def test_meetings_are_counted_by_bits(spark, monkeypatch):
    """Bergs in one place fill several packs, those far apart packs of their own; each counts once for a vessel."""
    crowd = [(b, b % 3, 0, -65.0, 10.0) for b in range(700)] + [(b, b % 3, 0, -70.0 - b % 9, float(b)) for b in range(700, 720)]
    rows = [(i, *r) for i, r in enumerate(crowd + crowd[:300] + [(5000, 0, 0, None, 1.0)])]
    b = spark.createDataFrame([(i, b, T0 + timedelta(seconds=s), la, lo) for i, b, s, _, la, lo in rows], "q long, berg long, ts timestamp, lat double, lon double")
    a = points(spark, [(1, 0, -65, 10), (2, 60, -65, 10.5), (3, 0, -72, 701), (4, 0, 60, 0)], "p").withColumn("v", F.least("p", F.lit(3)))
    pairs = joins.within_km(a, joins.numbered(b, "berg"), 150.0, "p", "q")
    got = {r.v: (r.n_pairs, r.n_others, r.min_km) for r in joins.meetings(pairs, "v").collect()}
    plain = joins.within_km(a, b, 150.0, "p", "q").groupBy("v").agg(F.count("*"), F.count_distinct("b_berg"), F.min("dist_km"))
    assert got == {r[0]: tuple(r)[1:] for r in plain.collect()}
    assert got[1][:2] == (1000, 700) and got[2][:2] == (1000, 700) and 3 in got
    # One row for 256 bergs is shuffled; before, one for each.
    from icefathom.plans import meetings

    grouped, by_bits = [], joins.meetings
    monkeypatch.setattr(meetings.joins, "meetings", lambda pairs, by: grouped.append(pairs) or by_bits(pairs, by))
    meetings.within_km(spark, "/root/testdata/sf0.001").collect()
    assert "b__pack" in grouped[0].columns and pairs.select("b__pack").distinct().count() < 30
