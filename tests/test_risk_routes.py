import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from icefathom.operators import risk, routes, scenario

REGIME = "cell_i int, cell_j int, ice_type int, conc_tenths double"
RIV = "ice_class int, ice_type int, riv int"


def test_rio_zero_missing_and_linear(spark):
    regime = spark.createDataFrame([(0, 0, 1, 5.0), (0, 0, 2, 5.0), (0, 1, 1, 10.0), (0, 2, 3, 10.0)], REGIME)
    riv = spark.createDataFrame([(1, 1, 2), (1, 2, -2), (2, 1, 3), (2, 2, 1), (2, 3, -1)], RIV)
    got = {(r.cell_j, r.ice_class): (r.rio, r.status) for r in risk.rio(regime, riv).collect()}
    assert got == {
        (0, 1): (0.0, "ok"), (0, 2): (20.0, "ok"), (1, 1): (20.0, "ok"), (1, 2): (30.0, "ok"),
        (2, 1): (None, "riv_missing"), (2, 2): (-10.0, "ok"),
    }
    double = regime.withColumn("conc_tenths", F.col("conc_tenths") * 2)
    twice = {(r.cell_j, r.ice_class): r.rio for r in risk.rio(double, riv).collect()}
    assert all(twice[k] == (None if v[0] is None else 2 * v[0]) for k, v in got.items())
    assert risk.rio(regime.limit(0), riv).count() == 0


def test_rio_noise_does_not_refuse_zero(spark):
    regime = spark.createDataFrame([(0, 0, 1, 0.1), (0, 0, 2, 0.2), (0, 0, 3, 0.3)], REGIME)
    riv = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, -1)], RIV)
    assert risk.rio(regime, riv).first().rio == 0.0


def test_certify_edges(spark):
    rows = [(1, 1, 0.0), (1, 2, 5.0), (2, 1, -0.5), (2, 2, 9.0), (3, 1, None), (3, 2, 4.0), (4, 1, None), (5, 3, 1.0), (5, 2, 1.0)]
    got = {r.route: r for r in risk.certify(spark.createDataFrame(rows, "route int, leg int, rio double"), "route", "leg").collect()}
    assert [got[i].certified for i in range(1, 6)] == [True, False, False, False, True]
    assert (got[2].worst_leg, got[2].worst_rio) == (1, -0.5)
    assert (got[3].worst_leg, got[3].n_unknown) == (2, 1)
    assert got[4].worst_leg is None and got[5].worst_leg == 2


def test_barrier_is_strict(spark):
    cells = spark.createDataFrame([(1, 9.0, False), (2, 9.01, False), (3, None, False), (4, 99.0, True), (5, 99.0, None)],
                                  "c int, depth_m double, land boolean")
    drafts = spark.createDataFrame([(7.0,)], "draft_m double")
    got = {r.c: r.reason for r in risk.hard_barrier(cells, drafts, on_land="land").collect()}
    assert got == {1: "shallow", 2: None, 3: "depth_unknown", 4: "land", 5: "land_unknown"}
    deep = {r.c: r.clearance for r in risk.clearance_class(cells.withColumn("depth_m", F.col("c") * 125.0)).collect()}
    assert deep[4] == "shelf" and deep[5] == "deep"


def test_cost_needs_all_factors(spark):
    cells = spark.createDataFrame([(1, 2.0)], "c int, v double")
    profiles = spark.createDataFrame([("A", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0)], "profile string, " + ", ".join(f"w_{f} double" for f in risk.FACTORS))
    factors = {f: F.col("v") for f in risk.FACTORS}
    r = risk.cost_surface(cells, profiles, factors).first()
    assert (r.cost, r.c_distance, r.c_fuel, r.c_ice) == (6.0, 2.0, 4.0, 0.0)
    factors.pop("fuel")
    with pytest.raises(ValueError):
        risk.cost_surface(cells, profiles, factors)


def test_risk_surface_is_stored_by_profile_and_slot(spark, small, tmp_path):
    import __spark_entry__ as e

    risk.write_risk_surface(e.queries()["risk_surface"](spark, small), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).filter("profile = 'B' and slot = 3")
    assert back.count() > 0
    assert "PartitionFilters: [isnotnull(profile" in back._jdf.queryExecution().executedPlan().toString()


DIMS = ["a", "b", "c"]


def brute_front(rows):
    def beats(y, x):
        return all(p <= q for p, q in zip(y, x)) and any(p < q for p, q in zip(y, x))

    return {r[1] for r in rows if not any(s[0] == r[0] and beats(s[2:], r[2:]) for s in rows)}


@pytest.mark.parametrize("block", [7, 50, 5000])
@pytest.mark.parametrize("high", [6, 1000])
def test_pareto_equals_brute_force(spark, block, high):
    rng = random.Random(block + high)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 5), i, *[rng.randrange(high) for _ in DIMS]) for i in range(600)]
    df = spark.createDataFrame(rows, "voyage int, id int, a int, b int, c int")
    front = routes.pareto_front(df, ["voyage"], DIMS, block)
    got = [r.id for r in front.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_front(rows)
    again = routes.pareto_front(front, ["voyage"], DIMS, block)
    assert {r.id for r in again.collect()} == set(got)


def test_pareto_keeps_equal_rows_of_a_hot_group(spark):
    rows = [(1, i, 1, 1, 1) for i in range(40)] + [(1, 99, 2, 1, 1)]
    df = spark.createDataFrame(rows, "voyage int, id int, a int, b int, c int")
    assert routes.pareto_front(df, ["voyage"], DIMS, 6).count() == 40


def test_corridor_ties(spark):
    df = spark.createDataFrame([(1, 7, 5, 1, 9), (1, 3, 5, 1, 9), (1, 4, 6, 0, 1)], "voyage_id int, route_id int, dist_km int, s int, margin int")
    got = {r.corridor: r.route_id for r in routes.corridors(df, F.col("s")).collect()}
    assert got == {"A": 3, "B": 4, "C": 3}


def test_benchmark_and_summary(spark):
    hist = spark.createDataFrame([(1, 100.0, 10.0), (2, 0.0, None), (3, 50.0, 5.0)], "voyage_id int, km double, hours double")
    plan = spark.createDataFrame([(1, 34.5, 12.0), (2, 5.0, 5.0), (3, 60.0, 5.0), (4, 1.0, 1.0)], "voyage_id int, km double, hours double")
    b = routes.benchmark_voyage(plan, hist)
    got = {r.voyage_id: (r.saving_km_pct, r.saving_h_pct) for r in b.collect()}
    assert got == {1: (65.5, -20.0), 2: (None, None), 3: (-20.0, 0.0), 4: (None, None)}
    s = routes.saving_summary(b).first()
    assert (s.n_voyages, s.n_positive, s.share_positive, s.best_saving_pct) == (2, 1, 0.5, 65.5)


def test_diversion_counts_waypoints(spark):
    schema = "v int, km double, hours double, fuel_t double"
    p = spark.createDataFrame([(1, 10.0, 1.0, 2.0), (2, 5.0, 1.0, 1.0)], schema)
    d = spark.createDataFrame([(1, 14.0, 3.0, 1.0), (3, 1.0, 1.0, 1.0)], schema)
    pp = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "v int, w string")
    dp = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d")], "v int, w string")
    got = {r.v: r for r in routes.diversion_delta(p, d, pp, dp, "v", "w").collect()}
    assert (got[1].delta_km, got[1].delta_hours, got[1].delta_fuel_t) == (4.0, 2.0, -1.0)
    assert (got[1].waypoints_added, got[1].waypoints_removed) == (2, 1)
    assert got[2].delta_km is None and got[3].delta_km is None


def test_violations_counts(spark):
    legs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2)], "route int, cell int")
    cells = spark.createDataFrame([(1, True, 5.0), (2, False, -1.0)], "cell int, blocked boolean, rio double")
    got = {r.route: tuple(r)[1:] for r in routes.violations(legs, cells, ["cell"], "route").collect()}
    assert got == {1: (1, 1, 1, 3), 2: (0, 1, 0, 1)}


def test_budget_boundary_and_segments(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, 1 + (i % 2), t0 + timedelta(hours=13 * i), i, "x" * 10) for i in range(20)]
    df = spark.createDataFrame(rows, "v int, priority int, ts timestamp, id int, payload string")
    out = routes.bandwidth_budget(df, "v", "priority", "ts", "id", "payload", 800.0, 1.0)
    sent = {r.id for r in out.filter("sent").collect()}
    assert sent == {i for i in range(20) if i % 2 == 0}
    rep = routes.budget_report(out, "v").first()
    assert (rep.n_sent, rep.n_cut, rep.bytes_sent, rep.bytes_cut) == (10, 10, 100, 100)


def test_watch_classes_and_top_k(spark):
    rows = [(1, i, d, t) for i, (d, t) in enumerate([(4.0, 0.5), (4.0, 3.0), (50.0, 1.0), (99.0, 0.0)])]
    a = spark.createDataFrame(rows, "v int, f int, cpa_km double, t_star_h double")
    got = routes.collision_watch(a, [("critical", 5.0, 1.0), ("warning", 20.0, 6.0), ("watch", 60.0, 12.0)], 3, "v", "f")
    assert [(r.f, r.risk_class) for r in got.orderBy("rank").collect()] == [(0, "critical"), (1, "warning"), (2, "watch")]


def test_scenario_clip_and_flip(spark):
    cells = spark.createDataFrame([(1, 0.95, 1.0), (2, None, 1.0)], "c int, sic double, wave_m double")
    s = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 1.15, 25.0, 0.5)], "scenario_id int, sic_mult double, berg_shift_km double, wave_add_m double")
    got = {(r.c, r.scenario_id): (r.sic, r.wave_m) for r in scenario.perturb_cells(cells, s).collect()}
    assert got[(1, 1)] == (1.0, 1.5) and got[(1, 0)] == (0.95, 1.0) and got[(2, 1)] == (None, 1.5)
    totals = spark.createDataFrame([(0, 1, 5.0, True), (1, 1, 7.0, False), (1, 2, 7.0, False)], "scenario_id int, route_id int, cost double, certified boolean")
    d = {r.route_id: (r.delta_cost, r.flip) for r in scenario.scenario_delta(totals, 0).collect()}
    assert d == {1: (2.0, "lost"), 2: (None, "unknown")}


def test_density_counts_bergs_once(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0)], "berg_id int, cell_i int, cell_j int")
    got = {r.cell_i: (r.n_bergs, r.n_fixes, r.is_cluster) for r in routes.berg_density(df, 2).collect()}
    assert got == {0: (2, 3, True), 1: (1, 1, False)}
