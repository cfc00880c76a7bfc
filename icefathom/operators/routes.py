"""Route totals, corridors, Pareto fronts, diversions, benchmarks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from icefathom.operators import segments as sg
from icefathom.operators.nearest import nearest_by_group
from icefathom.operators.spread import latest_by
from icefathom.session import ensure_checkpoint_dir

FRONT_BLOCK = 256
FRONT_REGIONS = 256


def route_totals(legs: DataFrame, route: str, fuel_t_per_km: Column | float) -> DataFrame:
    """Distance, time, fuel, least standoff, worst RIO and leg count per route."""
    rate = fuel_t_per_km if isinstance(fuel_t_per_km, Column) else F.lit(float(fuel_t_per_km))
    optional = {
        "standoff_km": F.min("standoff_km").alias("min_standoff_km"),
        "rio": F.min("rio").alias("worst_rio"),
    }
    return legs.groupBy(route).agg(
        F.sum("leg_km").alias("km"),
        F.sum("leg_h").alias("hours"),
        F.sum(F.col("leg_km") * rate).alias("fuel_t"),
        *[agg for name, agg in optional.items() if name in legs.columns],
        F.count("leg_km").alias("n_legs"),
    )


def corridors(
    candidates: DataFrame, score: Column, distance: str = "dist_km", margin: str = "margin",
    voyage: str = "voyage_id", route: str = "route_id",
) -> DataFrame:
    """Three picks per voyage: A shortest, B least score, C widest margin.

    Ties go to the lowest route id. A candidate whose measure is unknown cannot win; if
    all are unknown the pick is null. One partially aggregated pass.
    """
    row = F.struct(*[c for c in candidates.columns if c != voyage])

    def least(measure: Column) -> Column:
        return F.min_by(row, F.when(measure.isNotNull(), F.struct(measure.alias("_m"), F.col(route))))

    picks = candidates.groupBy(voyage).agg(
        least(F.col(distance)).alias("A"), least(score).alias("B"), least(-F.col(margin)).alias("C")
    )
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("corridor"), F.col(n).alias("r")) for n in "ABC"]))
    return picks.select(voyage, long.alias("_p")).select(voyage, "_p.corridor", "_p.r.*")


def _dominates(y: Column, x: Column, dims: list[str]) -> Column:
    no_worse = better = None
    for d in dims:
        le, lt = y[d] <= x[d], y[d] < x[d]
        no_worse = le if no_worse is None else no_worse & le
        better = lt if better is None else better | lt
    return no_worse & better


def _block_fronts(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Front of each (bounded) block, by an array test that emits no pairs."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    front = F.filter("_rows", lambda x: ~F.exists("_rows", lambda y: _dominates(y, x, dims)))
    return packed.select(F.inline(front))


def pareto_front(
    df: DataFrame, by: list[str], minimise: list[str], block_rows: int = FRONT_BLOCK
) -> DataFrame:
    """Rows of each group no other row of the group dominates.

    Groups of at most ``block_rows`` rows are tested as one array each. Larger
    ones, found by a count, work on their distinct points: blocks by hash keep
    their own front, then what is left is compared region by region. A region
    is a box of quantiles (at most ``FRONT_REGIONS`` per group); regions wholly
    behind another are dropped and a point only meets regions that can hold a
    dominator, again as bounded arrays. Rows come back by a semi-join, so any
    number of equal rows costs one point. Rows with a null measure are left out.
    """
    clean = df.filter(" and ".join(f"{d} is not null" for d in minimise))
    big = (
        clean.groupBy(*by)
        .agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_m"))
        .filter(F.col("_m") > 1)
    )
    if big.isEmpty():
        return _block_fronts(clean, by, minimise)
    small = clean.join(big, by, "left_anti")
    hot = clean.join(big.select(*by), by, "left_semi")
    return _block_fronts(small, by, minimise).select(*df.columns).unionByName(
        hot.join(_hot_front(hot, big, by, minimise, block_rows), [*by, *minimise], "left_semi").select(*df.columns)
    )


def _hot_front(hot: DataFrame, big: DataFrame, by: list[str], dims: list[str], block_rows: int) -> DataFrame:
    """Undominated distinct points of large groups."""
    ensure_checkpoint_dir(hot.sparkSession)
    spots = hot.select(*by, *dims).distinct().join(big, by)
    salted = spots.withColumn("_b", F.pmod(F.xxhash64(*dims), F.col("_m")).cast("int")).drop("_m")
    left = _block_fronts(salted, [*by, "_b"], dims).drop("_b").checkpoint()

    cut_dims = dims[:8]
    per_dim = max(2, int(FRONT_REGIONS ** (1 / len(cut_dims)) + 1e-9))
    at = [i / per_dim for i in range(1, per_dim)]
    cuts = left.groupBy(*by).agg(*[F.percentile_approx(F.col(d), at, F.lit(1000)).alias(f"_q_{d}") for d in cut_dims])

    def above(d: str) -> Column:
        return F.size(F.filter(F.col(f"_q_{d}"), lambda c: c < F.col(d))).cast("string")

    placed = left.join(cuts, by).withColumn("_region", F.concat_ws("-", *[above(d) for d in cut_dims]))
    # Read several times below: kept once, which also keeps the plan small.
    placed = placed.drop(*[f"_q_{d}" for d in cut_dims]).checkpoint()

    corners = placed.groupBy(*by, "_region").agg(
        *[F.min(d).alias(f"_lo_{d}") for d in dims], *[F.max(d).alias(f"_hi_{d}") for d in dims]
    )
    other = corners.select(
        *by, F.col("_region").alias("_other"),
        *[F.col(f"_lo_{d}").alias(f"_olo_{d}") for d in dims], *[F.col(f"_hi_{d}").alias(f"_ohi_{d}") for d in dims],
    )
    may, wholly, strictly = F.lit(True), F.lit(True), F.lit(False)
    for d in dims:
        may = may & (F.col(f"_olo_{d}") <= F.col(f"_hi_{d}"))
        wholly = wholly & (F.col(f"_ohi_{d}") <= F.col(f"_lo_{d}"))
        strictly = strictly | (F.col(f"_ohi_{d}") < F.col(f"_lo_{d}"))
    relation = corners.join(other, by).select(
        *by, "_region", "_other", may.alias("_may"), (wholly & strictly).alias("_gone")
    ).checkpoint()
    gone = relation.filter("_gone").select(*by, "_region").distinct()
    alive = placed.join(gone, [*by, "_region"], "left_anti").checkpoint()

    blocks = alive.groupBy(*by, "_region").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_k"))
    rivals = (
        alive.join(blocks, [*by, "_region"])
        .groupBy(*by, F.col("_region").alias("_other"), F.pmod(F.xxhash64(*dims, F.lit(1)), F.col("_k")).alias("_b"))
        .agg(F.collect_list(F.struct(*dims)).alias("_rivals"))
        .drop("_b")
    )
    consult = relation.filter("_may").select(*by, "_region", "_other")
    here = F.struct(*dims)
    beaten = (
        alive.join(consult, [*by, "_region"])
        .join(rivals, [*by, "_other"])
        .filter(F.exists("_rivals", lambda y: _dominates(y, here, dims)))
        .select(*by, *dims)
        .distinct()
    )
    return alive.join(beaten, [*by, *dims], "left_anti").select(*by, *dims)


def diversion_delta(
    planned: DataFrame, diverted: DataFrame, planned_points: DataFrame, diverted_points: DataFrame,
    voyage: str, waypoint: str, measures: tuple[str, ...] = ("km", "hours", "fuel_t"),
) -> DataFrame:
    """Differences in totals plus waypoints added and removed, per voyage."""
    p = planned.select(voyage, *[F.col(m).alias(f"_p_{m}") for m in measures])
    d = diverted.select(voyage, *[F.col(m).alias(f"_d_{m}") for m in measures])
    totals = p.join(d, voyage, "full").select(
        voyage, *[(F.col(f"_d_{m}") - F.col(f"_p_{m}")).alias(f"delta_{m}") for m in measures]
    )
    # Both waypoint lists in one pass: which side has each waypoint.
    sides = planned_points.select(voyage, waypoint, F.lit(1).alias("_p"), F.lit(0).alias("_d")).unionByName(
        diverted_points.select(voyage, waypoint, F.lit(0).alias("_p"), F.lit(1).alias("_d"))
    )
    changes = (
        sides.groupBy(voyage, waypoint)
        .agg(F.max("_p").alias("_p"), F.max("_d").alias("_d"))
        .groupBy(voyage)
        .agg(
            F.sum(F.when((F.col("_p") == 0) & (F.col("_d") == 1), 1).otherwise(0)).alias("waypoints_added"),
            F.sum(F.when((F.col("_p") == 1) & (F.col("_d") == 0), 1).otherwise(0)).alias("waypoints_removed"),
        )
    )
    return totals.join(changes, voyage, "full")


def benchmark_voyage(
    routes: DataFrame, historical: DataFrame, voyage: str = "voyage_id", km: str = "km", hours: str = "hours"
) -> DataFrame:
    """Saving in percent against the sailed track, per voyage.

    Zero or missing history gives null; every route stays.
    """
    h = historical.select(voyage, F.col(km).alias("_hk"), F.col(hours).alias("_hh"))

    def saving(old: str, new: str) -> Column:
        return F.when(F.col(old) != 0, (F.col(old) - F.col(new)) * 100.0 / F.col(old))

    return (
        routes.join(h, voyage, "left")
        .withColumns({"saving_km_pct": saving("_hk", km), "saving_h_pct": saving("_hh", hours)})
        .drop("_hk", "_hh")
    )


def saving_summary(benchmark: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Share of voyages with a positive saving, and the best saving."""
    positive = F.sum((F.col("saving_km_pct") > 0).cast("bigint"))
    known = F.count("saving_km_pct")
    return benchmark.groupBy(*(group or [])).agg(
        known.alias("n_voyages"),
        positive.alias("n_positive"),
        F.when(known > 0, positive / known).alias("share_positive"),
        F.max("saving_km_pct").alias("best_saving_pct"),
    )


def violations(legs: DataFrame, cells: DataFrame, on: list[str], route: str) -> DataFrame:
    """Grounding legs (cell blocked) and ice-breach legs (RIO < 0) per route.

    ``cells`` needs ``blocked`` and ``rio``; legs off the grid are counted as
    unknown.
    """
    joined = legs.join(cells.select(*on, "blocked", "rio"), on, "left")
    return joined.groupBy(route).agg(
        F.sum(F.coalesce(F.col("blocked"), F.lit(False)).cast("bigint")).alias("groundings"),
        F.sum(F.coalesce(F.col("rio") < 0, F.lit(False)).cast("bigint")).alias("ice_breaches"),
        F.sum(F.col("blocked").isNull().cast("bigint")).alias("n_unknown"),
        F.count(F.lit(1)).alias("n_legs"),
    )


def berg_density(points: DataFrame, min_pts: int, berg: str = "berg_id", cell: list[str] | None = None) -> DataFrame:
    """Distinct bergs and fixes per cell; ``is_cluster`` from ``min_pts`` bergs on.

    Two aggregation levels, so a crowded cell is counted from one row per berg.
    """
    cell = cell or ["cell_i", "cell_j"]
    per_berg = points.groupBy(*cell, berg).agg(F.count(F.lit(1)).alias("_n"))
    return per_berg.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_bergs"), F.sum("_n").alias("n_fixes")
    ).withColumn("is_cluster", F.col("n_bergs") >= min_pts)


def standoff(
    route_points: DataFrame, hazards: DataFrame, route: str, point_id: str, hazard_id: str, cell_km: float = 2.0
) -> DataFrame:
    """Least distance of each route to any hazard, with the hazard and the fix.

    Hazards in one place count once. Uses the nearest-hazard search, never the
    list of all close pairs.
    """
    # Positions come out of the aggregate as values: a filter on them then
    # stays above it instead of repeating whatever formula made them below.
    spots = (
        hazards.groupBy(F.col("lat").alias("_a"), F.col("lon").alias("_o"))
        .agg(F.min(hazard_id).alias(hazard_id), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
        .drop("_a", "_o")
    )
    near = nearest_by_group(
        route_points.select(route, point_id, "lat", "lon"), spots, route, point_id, hazard_id, cell_km
    )
    return near.select(route, F.col("dist_km").alias("standoff_km"), F.col("target_id").alias("hazard_id"), "point_id")


def collision_watch(
    approaches: DataFrame, limits: list[tuple[str, float, float]], k: int, vessel: str, berg_fix: str, berg: str | None = None,
    most: str | None = None,
) -> DataFrame:
    """Risk class of each approach and the ``k`` closest per vessel.

    With ``berg`` each berg takes one place, with its closest approach. Pairs of a vessel and a berg
    grow with the square of the tables, and so would what is sorted and shuffled here: with the
    ``most`` of ``watch_bound`` in a column, what is farther off is dropped as it comes.

    ``limits`` lists (class, km, hours), most severe first; an approach within
    both gets the class, others are ``clear``.
    """
    label = F.lit("clear")
    for name, km, hours in reversed(limits):
        label = F.when((F.col("cpa_km") <= km) & (F.col("t_star_h") <= hours), name).otherwise(label)
    if most is not None:
        approaches = approaches.filter(F.coalesce(F.col("cpa_km") <= F.col(most), F.lit(True))).drop(most)
    if berg is not None:
        approaches = latest_by(approaches, [vessel, berg], [F.col("cpa_km"), F.col("t_star_h"), F.col(berg_fix)])
    order = W.partitionBy(vessel).orderBy("cpa_km", "t_star_h", berg_fix)
    return (
        approaches.withColumn("risk_class", label)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def watch_bound(approaches: DataFrame, k: int, vessel: str, berg: str, most: str = "_most") -> DataFrame:
    """For each vessel a distance that its ``k`` closest bergs do not exceed; null where fewer may be near.

    Bergs are dealt into classes: the k-th least of the least distances of the classes is that of
    k different bergs at most. A task holds one row of numbers per vessel, whatever the pairs.
    """
    n = max(8, 4 * k)
    own = F.pmod(F.xxhash64(berg), F.lit(n))
    least = approaches.groupBy(vessel).agg(*[F.min(F.when(own == c, F.col("cpa_km"))).alias(f"_c{c}") for c in range(n)])
    return least.select(vessel, F.get(F.array_sort(F.array_compact(F.array(*[f"_c{c}" for c in range(n)]))), F.lit(k - 1)).alias(most))


def bandwidth_budget(
    features: DataFrame, key: str, priority: str, ts: str, row_id: str, payload: str, bps: float, seconds: float,
    segment_s: float = sg.SEGMENT_S,
) -> DataFrame:
    """Keeps features by priority while they fit ``bps`` x ``seconds`` / 8 bytes.

    Adds ``bytes``, the running total and ``sent``; what was cut stays visible. A feature
    of unknown size is cut; a null key is a link like any other.
    """
    sized = sg.add_segment(features.withColumn("bytes", F.octet_length(payload).cast("bigint")), [key], ts, segment_s)
    by_priority = sized.withColumn(
        sg.SEGMENT,
        F.struct(F.col(priority).alias("p"), F.col(f"{sg.SEGMENT}.slot").alias("s"), F.col(f"{sg.SEGMENT}.cut").alias("c")),
    )
    total = sg.running_sum(by_priority, [key], [priority, ts, row_id], F.col("bytes"), "running_bytes")
    fits = F.col("bytes").isNotNull() & (F.col("running_bytes") <= F.lit(bps * seconds / 8.0))
    return total.withColumn("sent", F.coalesce(fits, F.lit(False))).drop(sg.SEGMENT)


def budget_report(budgeted: DataFrame, key: str) -> DataFrame:
    """Features and bytes sent and cut, per link."""
    sent = F.col("sent")
    return budgeted.groupBy(key).agg(
        F.sum(sent.cast("bigint")).alias("n_sent"),
        F.sum((~sent).cast("bigint")).alias("n_cut"),
        F.sum(F.when(sent, F.col("bytes")).otherwise(0)).alias("bytes_sent"),
        F.sum(F.when(sent, 0).otherwise(F.coalesce("bytes", F.lit(0)))).alias("bytes_cut"),
    )
