import heapq
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from icefathom.operators import drift, geometry, pathing, radar, seaice

T0 = datetime(2024, 1, 1)


def grid(spark, rows, cols, seed):
    rng = random.Random(seed)
    cells = [(i, j, rng.randrange(1, 9)) for i in range(rows) for j in range(cols) if rng.random() > 0.1 or (i, j) == (0, 0)]
    return cells, spark.createDataFrame(cells, "i long, j long, cost long")


def dijkstra(edges, start, weight=lambda w, d: w):
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > dist[n]:
            continue
        for m, w in edges.get(n, []):
            nd = d + weight(w, d)
            if nd < dist.get(m, math.inf):
                dist[m] = nd
                heapq.heappush(heap, (nd, m))
    return dist


def test_cost_distance_and_routes(spark):
    cells, nodes = grid(spark, 14, 11, 1)
    edges = pathing.grid_edges(nodes)
    sources = spark.createDataFrame([(7, 0, 0), (8, cells[-1][0], cells[-1][1])], "voyage_id long, i long, j long")
    dist = pathing.cost_distance(edges, sources, tile=4, batch_voyages=1).cache()
    cost = {(i, j): c for i, j, c in cells}
    graph = {
        n: [((n[0] + a, n[1] + b), cost[n] + cost[(n[0] + a, n[1] + b)]) for a in (-1, 0, 1) for b in (-1, 0, 1)
            if (a or b) and (n[0] + a, n[1] + b) in cost]
        for n in cost
    }
    got = {(r.voyage_id, r.i, r.j): r for r in dist.collect()}
    want7 = dijkstra(graph, (0, 0))
    assert {k[1:]: v.dist for k, v in got.items() if k[0] == 7} == want7
    assert {k[1:]: v.dist for k, v in got.items() if k[0] == 8} == dijkstra(graph, tuple(cells[-1][:2]))
    for (v, i, j), r in got.items():
        if r.pi is None:
            assert r.dist == 0
        else:
            step = cost[(i, j)] + cost[(r.pi, r.pj)]
            assert got[(v, r.pi, r.pj)].dist + step == r.dist
    goal = dist.filter("voyage_id = 7").select("voyage_id", "i", "j")
    walks = {}
    for r in pathing.extract_routes(dist, goal).collect():
        walks.setdefault((r.target_i, r.target_j), []).append((r.seq, r.i, r.j))
    assert set(walks) == set(want7)
    for target, steps in walks.items():
        steps.sort()
        assert [s[0] for s in steps] == list(range(len(steps)))
        assert steps[0][1:] == (0, 0) and steps[-1][1:] == target
        assert sum(cost[a[1:]] + cost[b[1:]] for a, b in zip(steps, steps[1:])) == want7[target]


def test_time_sliced_costs(spark):
    rng = random.Random(4)
    rows, n, slots = [], 25, 3
    graph = {}
    for a in range(n):
        for b in {min(n - 1, a + 1), rng.randrange(n), rng.randrange(n)} - {a}:
            ws = sorted(rng.randrange(1, 9) for _ in range(slots))
            graph.setdefault((a, 0), []).append(((b, 0), ws))
            rows += [(a, 0, b, 0, s, float(w)) for s, w in enumerate(ws)]
    edges = spark.createDataFrame(rows, "i long, j long, ni long, nj long, slot int, w double")
    src = spark.createDataFrame([(1, 0, 0)], "voyage_id long, i long, j long")
    got = {(r.i, r.j): r.dist for r in pathing.cost_distance(edges, src, slice_len=10.0, tile=5).collect()}
    assert got == dijkstra(graph, (0, 0), lambda ws, d: ws[min(int(d // 10.0), slots - 1)])


def test_cost_distance_refuses(spark):
    src = spark.createDataFrame([(1, 0, 0)], "voyage_id long, i long, j long")
    chain = spark.createDataFrame([(i, 0, i + 1, 0, 1.0) for i in range(40)], "i long, j long, ni long, nj long, w double")
    with pytest.raises(RuntimeError):
        pathing.cost_distance(chain, src, max_iter=2, tile=2, region=2)
    with pytest.raises(ValueError):
        pathing.cost_distance(chain.withColumn("w", F.lit(0.0)), src)


@pytest.mark.parametrize("tile", [5, 512])
def test_cfar_equals_brute_force(spark, tile):
    rng = random.Random(9)
    px = {(s, r, c): rng.randrange(1, 100) * (30 if rng.random() < 0.02 else 1)
          for s in range(2) for r in range(17) for c in range(13) if rng.random() > 0.05}
    df = spark.createDataFrame([(*k, v) for k, v in px.items()], "scene long, r long, c long, p long")
    got = {(x.scene, x.r, x.c): (x.ring_sum, x.ring_n, x.hit) for x in radar.cfar(df, 1, 3, 2.5, tile).collect()}
    assert set(got) == set(px)
    for (s, r, c), p in px.items():
        ring = [px[(s, a, b)] for a in range(r - 3, r + 4) for b in range(c - 3, c + 4)
                if (s, a, b) in px and max(abs(a - r), abs(b - c)) > 1]
        assert got[(s, r, c)] == (sum(ring), len(ring), p * len(ring) > 2.5 * sum(ring))
    with pytest.raises(ValueError):
        radar.cfar(df, 3, 3, 2.0)


def test_cfar_shuffles_pixels_once(spark):
    df = spark.createDataFrame([(1, 1, 1, 5)], "scene long, r long, c long, p long")
    plan = radar.cfar(df, 1, 3, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_leads_end_at_gaps(spark):
    dark = [(1, 0, c, 1) for c in (0, 1, 2, 4, 5)] + [(1, 0, 3, 99), (1, 1, 0, 1), (1, 1, 2, 1), (1, 1, 3, 1)]
    got = radar.lead_runs(spark.createDataFrame(dark, "scene int, r int, c int, p int"), 10, 2).collect()
    assert sorted((x.r, x.c_start, x.c_end, x.length) for x in got) == [(0, 0, 2, 3), (0, 4, 5, 2), (1, 2, 3, 2)]


def test_regrid_and_cells(spark):
    df = spark.createDataFrame([(-1, 0, 5.0), (0, 0, 1.0), (1, 1, 3.0)], "cell_i int, cell_j int, v double")
    got = {(r.cell_i, r.cell_j): (r.v_min, r.n_fine) for r in radar.regrid(df, 2, {"v": "min"}).collect()}
    assert got == {(-1, 0): (5.0, 1), (0, 0): (1.0, 2)}
    hits = spark.createDataFrame([(1, 3, 12, 7), (1, 9, 19, 9)], "scene int, r int, c int, p int")
    assert tuple(radar.detections_to_cells(hits, 10).first()) == (1, 0, 1, 2, 9, 8.0)


def moving(spark, n=12, step_h=6.0):
    x0, y0, vx, vy = 500_000.0, 1_900_000.0, 2.0, -1.0
    rows = [(1, i, T0 + timedelta(hours=step_h * i), x0 + vx * step_h * i * 1000, y0 + vy * step_h * i * 1000) for i in range(n)]
    df = spark.createDataFrame(rows + [(2, 99, T0, 1e6, 1e6)], "berg_id long, fix_id long, ts timestamp, x double, y double")
    return geometry.unproject_3031(df)


def test_velocity_edges(spark):
    got = {r.fix_id: (r.vx, r.vy) for r in drift.drift_velocity(moving(spark), 3, "berg_id").collect()}
    assert got[99] == (None, None) and got[0] == (None, None)
    assert all(got[i] == (pytest.approx(2.0), pytest.approx(-1.0)) for i in range(1, 12))
    same = spark.createDataFrame([(1, 1, T0, 0.0, 0.0), (1, 2, T0, 5.0, 0.0)], "berg_id long, fix_id long, ts timestamp, x double, y double")
    assert all(r.vx is None for r in drift.drift_velocity(same, 2, "berg_id").collect())
    with pytest.raises(ValueError):
        drift.drift_velocity(same, 1, "berg_id")


def test_forecast_steps_and_perfect_backtest(spark):
    v = drift.drift_velocity(moving(spark), 3, "berg_id")
    ahead = drift.drift_forecast(v.filter("fix_id = 11"), 48, 6).orderBy("horizon_h").collect()
    assert [r.horizon_h for r in ahead] == list(range(0, 49, 6))
    assert ahead[2].x == pytest.approx(500_000.0 + 2.0 * 78 * 1000)
    errors = drift.drift_errors(v, [6, 12], 60.0, "berg_id")
    assert errors.agg(F.max("error_km")).first()[0] < 1e-6
    report = {r.horizon_h: (r.n, r.median_km, r.p95_km) for r in drift.drift_backtest(errors).collect()}
    assert report == {6: (10, 0.0, 0.0), 12: (9, 0.0, 0.0)}


def test_backtest_percentiles_interpolate(spark):
    e = spark.createDataFrame([(6, k / 10) for k in range(1, 11)], "horizon_h int, error_km double")
    r = drift.drift_backtest(e).first()
    assert (r.n, r.median_km, r.p95_km) == (10, pytest.approx(0.55), pytest.approx(0.955))


def test_lags_respect_gaps(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.1), (1, 1, 3, 0.3), (1, 1, 4, 0.4)], "cell_i int, cell_j int, slot int, sic double")
    got = {r.slot: (r.sic_lag1, r.sic_lag2) for r in seaice.lagged_features(df, [1, 2]).collect()}
    assert got == {1: (None, None), 3: (None, 0.1), 4: (0.3, None)}


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_models_save_load_and_clip(spark, tmp_path, kind):
    from pyspark.ml import PipelineModel

    rows = [(i / 200, (i * 7 % 13) / 13, min(1.0, i / 180)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, sic double")
    model = seaice.fit_sea_ice(df, ["a", "b"], kind=kind, trees=4, depth=3)
    model.write().overwrite().save(str(tmp_path / kind))
    scored = seaice.predict(PipelineModel.load(str(tmp_path / kind)), df)
    assert scored.filter("sic_pred < 0 or sic_pred > 1").count() == 0
    assert seaice.regression_report(scored, "sic", "sic_pred").first().r2 > 0.8
    with pytest.raises(ValueError):
        seaice.fit_sea_ice(df, ["a"], kind="guess")


def test_reports(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0), (None, 9.0)], "y double, p double")
    r = seaice.regression_report(df, "y", "p").first()
    assert (r.n, r.mae, r.r2) == (3, pytest.approx(1 / 3), pytest.approx(0.5))
    c = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "t int, p int")
    out = seaice.classification_report(c, F.col("t") == 1, F.col("p") == 1).first()
    assert (out.tp, out.fp, out.fn, out.tn, out.accuracy, out.precision, out.recall) == (1, 0, 1, 2, 0.75, 1.0, 0.5)
    none = seaice.classification_report(c.filter("t = 0"), F.col("t") == 1, F.col("p") == 1).first()
    assert none.precision is None and none.recall is None


def slotted_line(spark, n=30, w=1.0, slots=400):
    """A line of nodes with the same weight in every slot."""
    rows = [(i, 0, j, 0, w, s) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n for s in range(slots)]
    return spark.createDataFrame(rows, "i long, j long, ni long, nj long, w double, slot int")


def test_time_slices_keep_every_predecessor(spark):
    """Costs that are whole multiples of a slice of 0.1 fall in one slot for both steps."""
    edges = slotted_line(spark)
    starts = spark.createDataFrame([(1, 0, 0)], "voyage_id long, i long, j long")
    got = pathing.cost_distance(edges, starts, slice_len=0.1, tile=8).collect()
    assert len(got) == 30
    assert all((r.pi is None) == (r.i == 0) for r in got) and all(r.pi == r.i - 1 for r in got if r.i)


def test_unreached_targets_have_no_route(spark):
    edges = slotted_line(spark, 6, 1.0, 1).drop("slot")
    starts = spark.createDataFrame([(1, 0, 0)], "voyage_id long, i long, j long")
    wanted = spark.createDataFrame([(1, 5, 0), (1, 99, 0)], "voyage_id long, i long, j long")
    dist = pathing.cost_distance(edges, starts).checkpoint()
    assert {(r.target_i, r.seq) for r in pathing.extract_routes(dist, wanted).collect()} == {(5, s) for s in range(6)}
    assert [(r.i, r.j) for r in pathing.unreachable(dist, wanted).collect()] == [(99, 0)]


def test_targets_bound_the_search(spark):
    """Costs of targets equal the full search, and far nodes are not kept."""
    import random

    draw = random.Random(4)
    nodes = spark.createDataFrame([(i, j, draw.randint(1, 9)) for i in range(40) for j in range(12)], "i long, j long, cost long")
    starts = spark.createDataFrame([(v, 0, v) for v in range(5)], "voyage_id long, i long, j long")
    wanted = spark.createDataFrame([(v, 9, 5) for v in range(4)] + [(4, 30, 1), (4, 2, 2)], "voyage_id long, i long, j long")
    edges = pathing.grid_edges(nodes)
    full = {(r.voyage_id, r.i, r.j): r.dist for r in pathing.cost_distance(edges, starts, tile=4, batch_voyages=2).collect()}
    near = {(r.voyage_id, r.i, r.j): r.dist for r in pathing.cost_distance(edges, starts, tile=4, batch_voyages=2, targets=wanted).collect()}
    assert len(near) < 0.7 * len(full)
    assert all(full[k] == d for k, d in near.items())
    assert all(near[(r.voyage_id, r.i, r.j)] == full[(r.voyage_id, r.i, r.j)] for r in wanted.collect())


def test_fractional_pixels_keep_their_value(spark):
    rows = [(1, r, c, 0.9 if (r, c) == (5, 5) else 0.05) for r in range(11) for c in range(11)]
    px = spark.createDataFrame(rows, "scene long, r long, c long, p double")
    hits = radar.cfar(px, 1, 3, 3.0).filter("hit").collect()
    assert [(h.r, h.c, h.p) for h in hits] == [(5, 5, 0.9)]
    with pytest.raises(ValueError):
        radar.cfar(px.withColumn("p", F.col("p").cast("string")), 1, 3, 3.0)


def test_predictions_for_every_row(spark):
    rows = [(float(i % 7), float(i % 7) / 7) for i in range(70)] + [(None, 0.5), (float("nan"), 0.5), (3.0, None)]
    df = spark.createDataFrame(rows, "x double, sic double")
    model = seaice.fit_sea_ice(df, ["x"], trees=1, depth=2)
    got = seaice.predict(model, df).collect()
    assert len(got) == 73
    assert sum(r.sic_pred is None for r in got) == 2 and all(0 <= r.sic_pred <= 1 for r in got if r.sic_pred is not None)
    assert tuple(seaice.usable_rows(df, ["x"]).first()) == (70, 3)


WIDER = "/root/testdata/sf0.01"


def test_path_queries_cover_the_grid_and_voyages_grow_with_it(spark):
    from icefathom.plans import load_all
    from icefathom.plans.registry import QUERIES
    from icefathom.plans.views import view

    load_all()
    nodes = view(spark, WIDER, "grid_nodes")
    column = {r.i for r in nodes.filter("j = 25").select("i").collect()}
    assert max(column) > 20
    routes_ = QUERIES["routes_to_targets"](spark, WIDER).filter("reached").select("voyage_id", "target_i").distinct().collect()
    assert {(r.voyage_id, r.target_i) for r in routes_} == {(v, i) for v in (0, 1) for i in column}
    assert QUERIES["cost_distance_tiles"](spark, WIDER).count() == 2 * nodes.count()

    steps = {}
    for r in pathing.grid_edges(nodes).collect():
        steps.setdefault((r.i, r.j), []).append(((r.ni, r.nj), r.w))
    legs = {}
    for r in QUERIES["voyages_across"](spark, WIDER).collect():
        legs.setdefault(r.voyage_id, []).append((r.seq, (r.i, r.j)))
    assert len(legs) == nodes.filter("i % 4 = 0 and j = 0").count() > 2
    for v, leg in legs.items():
        path = [at for _, at in sorted(leg)]
        assert (path[0], path[-1]) == ((4 * v, 0), (4 * v, 25))
        cost = sum(dict(steps[x])[y] for x, y in zip(path, path[1:]))
        best, todo = {path[0]: 0}, [(0, path[0])]
        while todo:
            d, at = heapq.heappop(todo)
            for to, w in steps[at]:
                if d == best[at] and d + w < best.get(to, float("inf")):
                    best[to] = d + w
                    heapq.heappush(todo, (d + w, to))
        assert cost == best[path[-1]]


def test_model_queries_return_predictions_and_errors(spark):
    from icefathom.plans import load_all
    from icefathom.plans.registry import QUERIES

    load_all()
    rows = QUERIES["predict_forest"](spark, WIDER).collect()
    assert all(0 <= r.sic_pred <= 1 for r in rows) and len({r.sic_pred for r in rows}) > 1
    for r in QUERIES["predict_boosting_report"](spark, WIDER).collect():
        assert r.mae > 0 and r.mean_mae > 0 and r.closer_than_mean == (r.mae < r.mean_mae)


def test_directed_search_over_regions_equals_the_plain_one(spark):
    """Any region size, few and many batches, one-way edges: same costs; landmarks settle fewer nodes."""
    draw = random.Random(11)
    cost = {(i, j): draw.randint(1, 3) + draw.random() for i in range(20) for j in range(14)}
    rows, graph = [], {}
    for (i, j), c in cost.items():
        for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0), (1, 1)):
            if (i + a, j + b) in cost and draw.random() > 0.05:
                w = c + cost[(i + a, j + b)]
                rows.append((i - 5, j, i + a - 5, j + b, w))
                graph.setdefault((i - 5, j), []).append(((i + a - 5, j + b), w))
    edges = spark.createDataFrame(rows, "i long, j long, ni long, nj long, w double")
    begin = [(v, -5 + v, 2 * v) for v in range(6)]
    goals = [(v, -5 + v + 6, 2 * v + 3) for v in range(6)] + [(0, 12, 12), (5, 999, 999)]
    starts = spark.createDataFrame(begin, "voyage_id long, i long, j long")
    wanted = spark.createDataFrame(goals, "voyage_id long, i long, j long")
    want = {v: dijkstra(graph, (i, j)) for v, i, j in begin}
    whole = pathing.cost_distance(edges, starts, tile=3, region=3).collect()
    assert {(r.voyage_id, r.i, r.j) for r in whole} == {(v, *n) for v in want for n in want[v]}
    assert all(math.isclose(r.dist, want[r.voyage_id][(r.i, r.j)], rel_tol=1e-9) for r in whole)
    kept = {}
    for directed in (False, True):
        near = pathing.cost_distance(edges, starts, tile=3, region=3, targets=wanted, directed=directed, batch_voyages=3).checkpoint()
        got = {(r.voyage_id, r.i, r.j): r.dist for r in near.collect()}
        assert all(math.isclose(d, want[v][(i, j)], rel_tol=1e-9) for (v, i, j), d in got.items())
        assert {(v, i, j) for v, i, j in goals if (i, j) in want[v]} <= set(got)
        routes_ = pathing.extract_routes(near, wanted, block=10).collect()
        legs = {}
        for r in routes_:
            legs.setdefault((r.voyage_id, r.target_i, r.target_j), []).append((r.seq, (r.i, r.j)))
        for (v, i, j), leg in legs.items():
            path = [at for _, at in sorted(leg)]
            assert path[0] == begin[v][1:] and path[-1] == (i, j)
            assert math.isclose(sum(dict(graph[x])[y] for x, y in zip(path, path[1:])), want[v][(i, j)], rel_tol=1e-9)
        kept[directed] = len(got)
    assert kept[True] < kept[False] < len(whole)


def test_routes_refuse_circles_and_gaps(spark):
    circle = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 1, 0, 0)], "voyage_id long, i long, j long, pi long, pj long")
    goal = spark.createDataFrame([(1, 0, 0)], "voyage_id long, i long, j long")
    with pytest.raises(Exception, match="circle"):
        pathing.extract_routes(circle, goal).collect()
    gap = circle.filter("j = 0")
    with pytest.raises(Exception, match="no row"):
        pathing.extract_routes(gap, goal).collect()


def test_estimates_do_not_grow_with_the_rounds(spark):
    # A region a tile: 12 rounds. Every one doubled the digits of the estimated size before.
    edges = pathing.grid_edges(spark.range(24).selectExpr("id as i", "0L as j", "1L as cost"))
    src = spark.createDataFrame([(1, 0, 0)], "voyage_id long, i long, j long")
    dist = pathing.cost_distance(edges, src, tile=2, region=1)
    assert int(dist._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 5000
    assert {(r.i, r.dist) for r in dist.collect()} == {(i, 2.0 * i) for i in range(24)}

def test_routes_take_few_passes_over_many_blocks(spark, monkeypatch):
    # Before, a round a block: 60 here. Two voyages in trees of their own, places below zero too.
    n, passes = 120, []
    dealt = pathing.overlay.dealt
    monkeypatch.setattr(pathing.overlay, "dealt", lambda df, keys: passes.append(keys) or dealt(df, keys))
    rows = [(1, i, 0, i - 1 if i > -5 else None, 0 if i > -5 else None) for i in range(-5, n)]
    rows += [(2, i, j, *((i, j - 1) if j else (i - 1, 0) if i else (None, None))) for i in range(9) for j in range(9)]
    shape = "voyage_id long, i long, j long, pi long, pj long"
    goals = [(1, n - 1, 0), (1, 7, 0), (1, -5, 0), (2, 8, 8), (2, 8, 0), (2, 3, 5), (2, 0, 0), (2, 50, 50)]
    got = pathing.extract_routes(spark.createDataFrame(rows, shape), spark.createDataFrame(goals, "voyage_id long, i long, j long"), block=2)
    before, want = {r[:3]: r for r in rows}, set()
    for goal in goals[:-1]:
        way = [goal]
        while before[way[-1]][3] is not None:
            way.append((goal[0], *before[way[-1]][3:]))
        want |= {(*goal, seq, *at[1:]) for seq, at in enumerate(reversed(way))}
    found = [(r.voyage_id, r.target_i, r.target_j, r.seq, r.i, r.j) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert len(passes) <= 4
    with pytest.raises(RuntimeError, match="more than 40 blocks"):
        pathing.extract_routes(spark.createDataFrame(rows, shape), spark.createDataFrame(goals[:1], "voyage_id long, i long, j long"), 40, block=2)
    # A circle over several blocks never ended.
    ring = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (1, 1), (1, 0)]
    circle = spark.createDataFrame([(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], shape)
    with pytest.raises(ValueError, match="circle"):
        pathing.extract_routes(circle, circle.select("voyage_id", "i", "j").limit(1), block=2)


def test_ends_of_goals_are_made_where_they_can_bound(spark, monkeypatch):
    made = []
    goal_ends = pathing.overlay.goal_ends
    monkeypatch.setattr(pathing.overlay, "goal_ends", lambda arcs, goals, *a: made.append(goals.collect()) or goal_ends(arcs, goals, *a))
    edges = pathing.grid_edges(spark.range(40).selectExpr("id div 4 as i", "id % 4 as j", "1 + id % 3 as cost"))
    at = "voyage_id long, i long, j long"
    starts = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], at)
    goals = spark.createDataFrame([(1, 2, 2), (1, 9, 3), (2, 1, 3), (2, 3, 0)], at)
    near = pathing.cost_distance(edges, starts, targets=goals, tile=2, region=2, directed=False)
    full = {(r.voyage_id, r.i, r.j): r.dist for r in pathing.cost_distance(edges, starts, tile=2, region=2).collect()}
    got = {(r.voyage_id, r.i, r.j): r.dist for r in near.collect()}
    assert {tuple(g) for g in goals.collect()} <= set(got) and all(full[k] == d for k, d in got.items())
    # Voyage 1 has goals in several regions: before, its ends were made too, and read again every round.
    assert {r.voyage_id for r in made[0]} == {2}


def test_regions_are_longer_where_the_grid_is_narrow(spark, monkeypatch):
    rounds, solver = [], pathing.overlay._region_solver
    monkeypatch.setattr(pathing.overlay, "_region_solver", lambda: rounds.append(1) or solver())
    # 33 x 1 tiles, regions of 4 x 4: before, a round for every four rows of tiles.
    nodes = spark.range(128).selectExpr("id div 2 - 7 as i", "id % 2 + 4 as j", "1 + id % 5 as cost")
    src = spark.createDataFrame([(1, -7, 4)], "voyage_id long, i long, j long")
    got = {(r.i, r.j): r.dist for r in pathing.cost_distance(pathing.grid_edges(nodes), src, tile=2, region=4).collect()}
    whole = {(r.i, r.j): r.dist for r in pathing.cost_distance(pathing.grid_edges(nodes), src, tile=64).collect()}
    assert len(got) == 128 and got == whole
    assert len(rounds) - 1 <= 6
    assert pathing.overlay.region_sides(32, 1500, 4) == (256, 32)
    assert pathing.overlay.region_sides(32, 4, 1500) == (32, 256)
    assert pathing.overlay.region_sides(32, 900, 900) == (32, 32)
