"""Registered queries: ice risk, cost surfaces, routes, corridors, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from icefathom.functions.numeric import fixed
from icefathom.operators import geometry, nearest, pathing, risk, routes, scenario, spread
from icefathom.plans import inputs
from icefathom.plans import sqltext as t
from icefathom.plans.inputs import CELL_LAND_SQL, COST_SQL, ENV_SQL, RIO_SQL
from icefathom.plans.registry import registered
from icefathom.plans.tracks import LEGS_SQL
from icefathom.plans.views import view


@registered(
    f"""with {RIO_SQL} select cell_i, cell_j, ice_class, {t.fx('rio')} as rio, cast(n_types as bigint) as n_types,
    cast(n_missing as bigint) as n_missing, case when n_missing = 0 then 'ok' else 'riv_missing' end as status from rio""",
    ("ice_regime", "riv"),
)
def rio(spark, sf_dir):
    r = inputs.rio_table(spark, sf_dir)
    return r.select("cell_i", "cell_j", "ice_class", fixed(F.col("rio")).alias("rio"), "n_types", "n_missing", "status")


@registered(
    f"""with {RIO_SQL}, placed as (select vessel_id, ping_id, ice_class, {t.PING_CELL} from pings),
    scored as (select p.vessel_id, p.ping_id, r.rio from placed p left join rio r using (cell_i, cell_j, ice_class))
    select vessel_id, bool_and(coalesce(rio >= 0, false)) as certified, {t.fx('min(rio)')} as worst_rio,
      first(ping_id order by rio, ping_id) filter (where rio is not null) as worst_leg, cast(sum(case when rio is null then 1 else 0 end) as bigint) as n_unknown,
      count(*) as n_legs from scored group by 1""",
    ("pings", "ice_regime", "riv"),
)
def certify(spark, sf_dir):
    p = inputs.placed_pings(spark, sf_dir).select("vessel_id", "ping_id", "ice_class", "cell_i", "cell_j")
    legs = p.join(inputs.rio_table(spark, sf_dir), ["cell_i", "cell_j", "ice_class"], "left")
    return risk.certify(legs, "vessel_id", "ping_id").withColumn("worst_rio", fixed(F.col("worst_rio")))


@registered(
    f"""with {ENV_SQL}, {COST_SQL} select cell_i, cell_j, slot, profile, {t.fx('cost', 5)} as cost,
    {t.fx('c_ice', 5)} as c_ice, {t.fx('c_berg', 5)} as c_berg, {t.fx('c_depth', 5)} as c_depth, {t.fx('c_fuel', 5)} as c_fuel
    from priced""",
    ("env_cells", "berg_fixes", "profiles"),
)
def cost_surface(spark, sf_dir):
    s = risk.cost_surface(
        inputs.env_with_bergs(spark, sf_dir), view(spark, sf_dir, "profiles"), inputs.cost_factors()
    )
    return s.select(
        "cell_i", "cell_j", "slot", "profile",
        *[fixed(F.col(c), 5).alias(c) for c in ("cost", "c_ice", "c_berg", "c_depth", "c_fuel")],
    )


@registered(
    """select cell_i, cell_j, slot, draft_m, case when depth_m <= 0 then 'land' when depth_m is null then 'depth_unknown'
      when not (depth_m > draft_m + 2.0e0) then 'shallow' end as reason,
      depth_m <= 0 or depth_m is null or not (depth_m > draft_m + 2.0e0) as blocked
    from env_cells cross join (select distinct draft_m from pings) d""",
    ("env_cells", "pings"),
)
def hard_barrier(spark, sf_dir):
    """Each cell against each draft of the fleet; dry cells count as land."""
    cells = view(spark, sf_dir, "env_cells").select("cell_i", "cell_j", "slot", "depth_m", (F.col("depth_m") <= 0).alias("dry"))
    drafts = inputs.pings(spark, sf_dir).select("draft_m").distinct()
    return risk.hard_barrier(cells, drafts, on_land="dry").select("cell_i", "cell_j", "slot", "draft_m", "reason", "blocked")


@registered(
    """select cell_i, cell_j, slot, case when depth_m is null then 'unknown' when depth_m > 500 then 'deep'
    when depth_m > 0 then 'shelf' else 'dry' end as clearance from env_cells""",
    ("env_cells",),
)
def clearance_class(spark, sf_dir):
    return risk.clearance_class(view(spark, sf_dir, "env_cells")).select("cell_i", "cell_j", "slot", "clearance")


SURFACE_SQL = f"""{RIO_SQL}, {ENV_SQL}, {COST_SQL}, {CELL_LAND_SQL},
surface as (
  select p.*, r.rio, case when l.on_land then 'land' when l.on_land is null then 'land_unknown'
    when p.depth_m is null then 'depth_unknown' when not (p.depth_m > 9.0e0) then 'shallow' end as reason
  from priced p left join cell_land l on l.cell_i = p.cell_i and l.cell_j = p.cell_j
  left join rio r on r.cell_i = p.cell_i and r.cell_j = p.cell_j and r.ice_class = 2)"""


def _surface(spark, sf_dir):
    env = inputs.env_with_bergs(spark, sf_dir).join(inputs.cell_land(spark, sf_dir), ["cell_i", "cell_j"], "left")
    return risk.risk_surface(
        env,
        view(spark, sf_dir, "ice_regime"),
        view(spark, sf_dir, "riv"),
        view(spark, sf_dir, "profiles"),
        inputs.cost_factors(),
        draft_m=7.0,
        ice_class=2,
        on_land="on_land",
    )


@registered(
    f"""with {SURFACE_SQL} select cell_i, cell_j, slot, profile, {t.fx('cost', 5)} as cost, {t.fx('rio')} as rio, reason,
    reason is not null as blocked, reason is null and coalesce(rio >= 0, false) as passable from surface""",
    ("env_cells", "berg_fixes", "profiles", "ice_regime", "riv", "land_edges"),
)
def risk_surface(spark, sf_dir):
    """Flagship: cost, ice risk index and barrier per cell, slot and profile."""
    return _surface(spark, sf_dir).select(
        "cell_i", "cell_j", "slot", "profile", fixed(F.col("cost"), 5).alias("cost"), fixed(F.col("rio")).alias("rio"),
        "reason", "blocked", "passable",
    )


@registered(
    f"""with {LEGS_SQL}, {RIO_SQL}, placed as (select ping_id, {t.PING_CELL} from pings),
    scored as (select l.*, r.rio from legs l join placed p using (ping_id)
      left join rio r on r.cell_i = p.cell_i and r.cell_j = p.cell_j and r.ice_class = l.ice_class),
    gap as (select p.ping_id, min({t.hav('p.lat', 'p.lon', 'b.lat', 'b.lon')}) as standoff_km from pings p cross join berg_fixes b group by 1)
    select vessel_id, {t.fx('sum(leg_km)', 2)} as km, {t.fx('sum(leg_h)', 3)} as hours, {t.fx('sum(leg_km * 0.05e0)', 2)} as fuel_t,
      {t.fx('min(standoff_km)')} as min_standoff_km, {t.fx('min(rio)')} as worst_rio, count(leg_km) as n_legs
    from scored left join gap using (ping_id) group by 1""",
    ("pings", "ice_regime", "riv", "berg_fixes"),
)
def route_totals(spark, sf_dir):
    """Totals of each vessel's track, with standoff of every fix and the ice index of its cells."""
    p = inputs.placed_pings(spark, sf_dir).select(
        "vessel_id", "ping_id", "ts", "lat", "lon", "ice_class", "cell_i", "cell_j"
    )
    legs = geometry.leg_metrics(p, "vessel_id", "ts", "ping_id")
    index = inputs.rio_table(spark, sf_dir).select("cell_i", "cell_j", "ice_class", "rio")
    near = nearest.nearest(
        p.select("ping_id", "lat", "lon"), inputs.bergs(spark, sf_dir).select("fix_id", "lat", "lon"), 1, "ping_id", "fix_id"
    ).select("ping_id", F.col("dist_km").alias("standoff_km"))
    full = legs.join(index, ["cell_i", "cell_j", "ice_class"], "left").join(near, "ping_id", "left")
    totals = routes.route_totals(full, "vessel_id", 0.05)
    return totals.select(
        "vessel_id",
        fixed(F.col("km"), 2).alias("km"),
        fixed(F.col("hours"), 3).alias("hours"),
        fixed(F.col("fuel_t"), 2).alias("fuel_t"),
        fixed(F.col("min_standoff_km")).alias("min_standoff_km"),
        fixed(F.col("worst_rio")).alias("worst_rio"),
        "n_legs",
    )


@registered(
    """with scored as (select *, dist_km + 2 * time_h + 5 * risk as score, 100 - risk as margin from candidates),
    ranked as (select *, row_number() over (partition by voyage_id order by dist_km, route_id) as a,
      row_number() over (partition by voyage_id order by score, route_id) as b,
      row_number() over (partition by voyage_id order by margin desc, route_id) as c from scored)
    select voyage_id, 'A' as corridor, route_id, dist_km, score, margin from ranked where a = 1
    union all select voyage_id, 'B', route_id, dist_km, score, margin from ranked where b = 1
    union all select voyage_id, 'C', route_id, dist_km, score, margin from ranked where c = 1""",
    ("candidates",),
)
def corridors(spark, sf_dir):
    c = view(spark, sf_dir, "candidates").withColumns(
        {"score": F.col("dist_km") + 2 * F.col("time_h") + 5 * F.col("risk"), "margin": 100 - F.col("risk")}
    )
    picks = routes.corridors(c, F.col("score"))
    return picks.select("voyage_id", "corridor", "route_id", "dist_km", "score", "margin")


PARETO_SQL = """select voyage_id, route_id from candidates x where not exists (select 1 from candidates y
  where y.voyage_id = x.voyage_id and y.dist_km <= x.dist_km and y.time_h <= x.time_h and y.risk <= x.risk and y.fuel_t <= x.fuel_t
  and (y.dist_km < x.dist_km or y.time_h < x.time_h or y.risk < x.risk or y.fuel_t < x.fuel_t))"""


@registered(PARETO_SQL, ("candidates",))
def pareto_front(spark, sf_dir):
    c = view(spark, sf_dir, "candidates")
    front = routes.pareto_front(c, ["voyage_id"], ["dist_km", "time_h", "risk", "fuel_t"])
    return front.select("voyage_id", "route_id")


def _ends(c):
    """Lowest and highest route of each voyage, by the fixture rule."""
    row = F.struct(F.col("route_id"), F.col("dist_km").alias("km"), F.col("time_h").alias("hours"), "fuel_t")
    picked = c.groupBy("voyage_id").agg(F.min(row).alias("lo"), F.max(row).alias("hi"), F.count(F.lit(1)).alias("n"))
    return picked.filter("n > 1").select("voyage_id", "lo.*"), picked.filter("n > 1").select("voyage_id", "hi.*")


PLANNED_SQL = """sailed as (
  select voyage_id, arg_min(dist_km, route_id) as lo_km, arg_min(time_h, route_id) as lo_h
  from candidates where voyage_id % 7 <> 3 group by 1),
bench as (
  select c.voyage_id, case when lo_km <> 0 then (lo_km - hi_km) * 100.0e0 / lo_km end as saving_km_pct,
    case when lo_h <> 0 then (lo_h - hi_h) * 100.0e0 / lo_h end as saving_h_pct
  from (select voyage_id, arg_max(dist_km, route_id) as hi_km, arg_max(time_h, route_id) as hi_h from candidates group by 1) c
  left join sailed using (voyage_id))"""


ENDS_SQL = """ends as (
  select voyage_id, arg_min(dist_km, route_id) as lo_km, arg_max(dist_km, route_id) as hi_km,
    arg_min(time_h, route_id) as lo_h, arg_max(time_h, route_id) as hi_h,
    arg_min(fuel_t, route_id) as lo_fuel, arg_max(fuel_t, route_id) as hi_fuel
  from candidates group by 1 having count(*) > 1)"""


@registered(
    f"""with {ENDS_SQL}, planned as (select distinct vessel_id as voyage_id, ping_id % 20 as waypoint from pings where ping_id % 2 = 0),
    diverted as (select distinct vessel_id as voyage_id, ping_id % 20 as waypoint from pings where ping_id % 3 = 0),
    changes as (select voyage_id, cast(sum(case when p.waypoint is null then 1 else 0 end) as bigint) as waypoints_added,
      cast(sum(case when d.waypoint is null then 1 else 0 end) as bigint) as waypoints_removed
      from planned p full join diverted d using (voyage_id, waypoint) group by 1)
    select voyage_id, hi_km - lo_km as delta_km, hi_h - lo_h as delta_hours, hi_fuel - lo_fuel as delta_fuel_t,
      waypoints_added, waypoints_removed from ends full join changes using (voyage_id)""",
    ("candidates", "pings"),
)
def diversion_delta(spark, sf_dir):
    planned, diverted = _ends(view(spark, sf_dir, "candidates"))
    p = inputs.pings(spark, sf_dir).select(
        F.col("vessel_id").alias("voyage_id"), (F.col("ping_id") % 20).alias("waypoint"), "ping_id"
    )
    return routes.diversion_delta(
        planned, diverted, p.filter("ping_id % 2 = 0"), p.filter("ping_id % 3 = 0"), "voyage_id", "waypoint"
    )


BENCH_SQL = f"""{ENDS_SQL}, bench as (select voyage_id,
  case when lo_km <> 0 then (lo_km - hi_km) * 100.0e0 / lo_km end as saving_km_pct,
  case when lo_h <> 0 then (lo_h - hi_h) * 100.0e0 / lo_h end as saving_h_pct from ends)"""


@registered(
    f"with {BENCH_SQL} select voyage_id, {t.fx('saving_km_pct')} as saving_km_pct, {t.fx('saving_h_pct')} as saving_h_pct from bench",
    ("candidates",),
)
def benchmark_voyage(spark, sf_dir):
    sailed, planned = _ends(view(spark, sf_dir, "candidates"))
    b = routes.benchmark_voyage(planned, sailed)
    return b.select(
        "voyage_id", fixed(F.col("saving_km_pct")).alias("saving_km_pct"), fixed(F.col("saving_h_pct")).alias("saving_h_pct")
    )


@registered(
    f"""with {BENCH_SQL} select count(saving_km_pct) as n_voyages,
    cast(sum(case when saving_km_pct > 0 then 1 else 0 end) as bigint) as n_positive,
    {t.fx('sum(case when saving_km_pct > 0 then 1 else 0 end) / count(saving_km_pct)', 6)} as share_positive,
    {t.fx('max(saving_km_pct)')} as best_saving_pct from bench""",
    ("candidates",),
)
def saving_summary(spark, sf_dir):
    sailed, planned = _ends(view(spark, sf_dir, "candidates"))
    s = routes.saving_summary(routes.benchmark_voyage(planned, sailed))
    return s.withColumns(
        {"share_positive": fixed(F.col("share_positive"), 6), "best_saving_pct": fixed(F.col("best_saving_pct"))}
    )


@registered(
    f"""with {RIO_SQL}, {CELL_LAND_SQL}, cells as (select e.cell_i, e.cell_j, e.slot, coalesce(l.on_land, true) or depth_m is null or not (depth_m > 9.0e0) as blocked, r.rio
      from env_cells e left join cell_land l on l.cell_i = e.cell_i and l.cell_j = e.cell_j left join rio r on r.cell_i = e.cell_i and r.cell_j = e.cell_j and r.ice_class = 2),
    placed as (select vessel_id, {t.PING_CELL} from pings)
    select vessel_id, cast(sum(case when blocked then 1 else 0 end) as bigint) as groundings,
      cast(sum(case when rio < 0 then 1 else 0 end) as bigint) as ice_breaches,
      cast(sum(case when blocked is null then 1 else 0 end) as bigint) as n_unknown, count(*) as n_legs
    from placed left join cells using (cell_i, cell_j, slot) group by 1""",
    ("pings", "env_cells", "ice_regime", "riv", "land_edges"),
)
def violations(spark, sf_dir):
    index = inputs.rio_table(spark, sf_dir).filter("ice_class = 2").select("cell_i", "cell_j", "rio")
    reason = risk.barrier_reason(F.col("depth_m"), F.lit(7.0), F.col("on_land"))
    cells = (
        view(spark, sf_dir, "env_cells")
        .join(inputs.cell_land(spark, sf_dir), ["cell_i", "cell_j"], "left")
        .select("cell_i", "cell_j", "slot", reason.isNotNull().alias("blocked"))
        .join(index, ["cell_i", "cell_j"], "left")
    )
    p = inputs.placed_pings(spark, sf_dir).select("vessel_id", "cell_i", "cell_j", "slot")
    return routes.violations(p, cells, ["cell_i", "cell_j", "slot"], "vessel_id")


FEATURE_SQL = """sized as (
  select vessel_id, ping_id, ts, case status when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as priority,
    cast(length(status || '|' || vessel_id || '|' || ping_id) as bigint) as bytes from pings),
totals as (select *, cast(sum(bytes) over (partition by vessel_id order by priority, ts, ping_id rows unbounded preceding) as bigint)
  as running_bytes from sized)"""


def _budget(spark, sf_dir):
    rank = F.when(F.col("status") == "error", 1).when(F.col("status") == "purchase", 2).when(F.col("status") == "signup", 3)
    features = inputs.pings(spark, sf_dir).select(
        "vessel_id", "ping_id", "ts", rank.otherwise(4).alias("priority"),
        F.concat_ws("|", "status", F.col("vessel_id").cast("string"), F.col("ping_id").cast("string")).alias("payload"),
    )
    return routes.bandwidth_budget(features, "vessel_id", "priority", "ts", "ping_id", "payload", 2400.0, 1.0)


@registered(
    f"with {FEATURE_SQL} select vessel_id, ping_id, bytes, running_bytes, running_bytes <= 300 as sent from totals", ("pings",)
)
def bandwidth_budget(spark, sf_dir):
    """Messages of each vessel that fit one second of a 2.4 kbit/s link."""
    return _budget(spark, sf_dir).select("vessel_id", "ping_id", "bytes", "running_bytes", "sent")


@registered(
    f"""with {FEATURE_SQL} select vessel_id, cast(sum(case when running_bytes <= 300 then 1 else 0 end) as bigint) as n_sent,
    cast(sum(case when running_bytes <= 300 then 0 else 1 end) as bigint) as n_cut,
    cast(sum(case when running_bytes <= 300 then bytes else 0 end) as bigint) as bytes_sent,
    cast(sum(case when running_bytes <= 300 then 0 else bytes end) as bigint) as bytes_cut from totals group by 1""",
    ("pings",),
)
def budget_report(spark, sf_dir):
    return routes.budget_report(_budget(spark, sf_dir), "vessel_id")


@registered(
    f"""select cell_i, cell_j, slot, scenario_id, {t.fx('least(1.0e0, sic * sic_mult)', 5)} as sic,
    {t.fx('wave_m + wave_add_m')} as wave_m from env_cells cross join scenarios""",
    ("env_cells", "scenarios"),
)
def scenario_cells(spark, sf_dir):
    cells = scenario.perturb_cells(view(spark, sf_dir, "env_cells"), view(spark, sf_dir, "scenarios"))
    return cells.select(
        "cell_i", "cell_j", "slot", "scenario_id", fixed(F.col("sic"), 5).alias("sic"), fixed(F.col("wave_m")).alias("wave_m")
    )


@registered(
    f"""select fix_id, scenario_id, {t.fx(t.moved_lat('lat', '45.0e0', 'berg_shift_km'), 7)} as lat,
    {t.fx(t.moved_lon('lat', 'lon', '45.0e0', 'berg_shift_km'), 7)} as lon from berg_fixes cross join scenarios""",
    ("berg_fixes", "scenarios"),
)
def scenario_bergs(spark, sf_dir):
    b = inputs.bergs(spark, sf_dir).select("fix_id", "lat", "lon")
    moved = scenario.perturb_bergs(b, view(spark, sf_dir, "scenarios"), F.lit(45.0))
    return moved.select("fix_id", "scenario_id", fixed(F.col("lat"), 7).alias("lat"), fixed(F.col("lon"), 7).alias("lon"))


@registered(
    f"""with perturbed as (select cell_i, cell_j, slot, scenario_id, least(1.0e0, sic * sic_mult) as sic, wave_m + wave_add_m as wave_m
      from env_cells cross join scenarios),
    placed as (select vessel_id, {t.PING_CELL} from pings),
    totals as (select scenario_id, vessel_id, sum(2.0e0 * sic + 0.5e0 * wave_m) as cost, max(sic) <= 0.7e0 as certified
      from placed join perturbed using (cell_i, cell_j, slot) group by 1, 2)
    select coalesce(s.scenario_id, b.other) as scenario_id, coalesce(s.vessel_id, b.vessel_id) as vessel_id, {t.fx('s.cost - b.cost', 4)} as delta_cost,
      case when b.certified is null or s.certified is null then 'unknown' when b.certified and not s.certified then 'lost'
        when not b.certified and s.certified then 'gained' else 'same' end as flip
    from (select * from totals where scenario_id <> 0) s full join (select b.*, o.scenario_id as other
      from totals b cross join (select distinct scenario_id from totals where scenario_id <> 0) o where b.scenario_id = 0) b
    on b.vessel_id = s.vessel_id and b.other = s.scenario_id""",
    ("pings", "env_cells", "scenarios"),
)
def scenario_delta(spark, sf_dir):
    """Cost change and lost certification of each vessel's track under each scenario."""
    cells = scenario.perturb_cells(
        view(spark, sf_dir, "env_cells").select("cell_i", "cell_j", "slot", "sic", "wave_m"), view(spark, sf_dir, "scenarios")
    )
    p = inputs.placed_pings(spark, sf_dir).select("vessel_id", "cell_i", "cell_j", "slot")
    visits = p.groupBy("vessel_id", "cell_i", "cell_j", "slot").agg(F.count(F.lit(1)).alias("n"))
    totals = (
        visits.join(cells, ["cell_i", "cell_j", "slot"])
        .groupBy("scenario_id", "vessel_id")
        .agg(
            F.sum(F.col("n") * (2.0 * F.col("sic") + 0.5 * F.col("wave_m"))).alias("cost"),
            (F.max("sic") <= 0.7).alias("certified"),
        )
    )
    delta = scenario.scenario_delta(totals, 0, "vessel_id")
    return delta.select("scenario_id", "vessel_id", fixed(F.col("delta_cost"), 4).alias("delta_cost"), "flip")


EDGES_SQL = """edges as (
  select a.i, a.j, b.i as ni, b.j as nj, a.cost + b.cost as w from grid_nodes a join grid_nodes b
  on b.i between a.i - 1 and a.i + 1 and b.j between a.j - 1 and a.j + 1 and not (a.i = b.i and a.j = b.j)),
starts as (select cast(case when j = 0 then 0 else 1 end as bigint) as voyage_id, i, j from grid_nodes where (i = 0 and j = 0) or (i = 0 and j = 49)),
dist(voyage_id, i, j, d) using key (voyage_id, i, j) as (
  select voyage_id, i, j, cast(0 as bigint) from starts
  union (select t.voyage_id, e.ni, e.nj, min(t.d + e.w) from dist t join edges e on e.i = t.i and e.j = t.j
    left join recurring.dist r on r.voyage_id = t.voyage_id and r.i = e.ni and r.j = e.nj
    where r.d is null or t.d + e.w < r.d group by 1, 2, 3)),
pred as (select * from (select b.voyage_id, b.i, b.j, a.i as pi, a.j as pj,
    row_number() over (partition by b.voyage_id, b.i, b.j order by a.i, a.j) as rn
  from dist b join edges e on e.ni = b.i and e.nj = b.j join dist a on a.voyage_id = b.voyage_id and a.i = e.i and a.j = e.j
  where a.d + e.w = b.d) x where rn = 1)"""


def _distances(spark, sf_dir):
    nodes = view(spark, sf_dir, "grid_nodes")
    starts = nodes.filter("i = 0 and j in (0, 49)").select(
        F.when(F.col("j") == 0, 0).otherwise(1).cast("bigint").alias("voyage_id"), "i", "j"
    )
    return pathing.cost_distance(pathing.grid_edges(nodes), starts)


@registered(
    f"""with recursive {EDGES_SQL} select d.voyage_id, d.i, d.j, cast(d.d as double) as dist, p.pi, p.pj
    from dist d left join pred p using (voyage_id, i, j)""",
    ("grid_nodes",),
)
def cost_distance(spark, sf_dir):
    """Two voyages from the northern corners to every node of the whole grid."""
    return _distances(spark, sf_dir)


@registered(
    f"""with recursive {EDGES_SQL}, goal as (select i, j from grid_nodes where i = (select max(i) from grid_nodes)),
    walk as (select s.voyage_id, g.i as target_i, g.j as target_j, g.i, g.j, cast(0 as bigint) as back
        from goal g cross join (select distinct voyage_id from starts) s
      union all select w.voyage_id, w.target_i, w.target_j, p.pi, p.pj, w.back + 1
        from walk w join pred p on p.voyage_id = w.voyage_id and p.i = w.i and p.j = w.j)
    select voyage_id, target_i, target_j, i, j, max(back) over (partition by voyage_id, target_i, target_j) - back as seq from walk""",
    ("grid_nodes",),
)
def extract_routes(spark, sf_dir):
    """Routes of both voyages to every node of the last grid row."""
    dist = _distances(spark, sf_dir).checkpoint()
    last = dist.agg(F.max("i").alias("i"))
    goal = dist.join(last, "i", "left_semi").select("voyage_id", "i", "j")
    return pathing.extract_routes(dist, goal)


@registered(
    f"with {PLANNED_SQL} select voyage_id, {t.fx('saving_km_pct')} as saving_km_pct, {t.fx('saving_h_pct')} as saving_h_pct from bench",
    ("candidates",),
)
def benchmark_without_history(spark, sf_dir):
    """Savings where every seventh voyage has no sailed track: it stays, with nulls."""
    c = view(spark, sf_dir, "candidates")
    row = F.struct(F.col("route_id"), F.col("dist_km").alias("km"), F.col("time_h").alias("hours"))
    ends = c.groupBy("voyage_id").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    sailed = ends.filter("voyage_id % 7 <> 3").select("voyage_id", "lo.*")
    b = routes.benchmark_voyage(ends.select("voyage_id", "hi.*"), sailed)
    return b.select(
        "voyage_id", fixed(F.col("saving_km_pct")).alias("saving_km_pct"), fixed(F.col("saving_h_pct")).alias("saving_h_pct")
    )


HOLED_SQL = """holed as (select voyage_id, route_id, case when route_id % 3 <> 0 then dist_km end as dist_km,
    case when route_id % 4 <> 0 then dist_km + 2 * time_h + 5 * risk end as score,
    case when route_id % 5 <> 0 then 100 - risk end as margin from candidates)"""


@registered(
    f"""with {HOLED_SQL}, voyages as (select distinct voyage_id from holed),
    ranked as (
      select 'A' as corridor, *, row_number() over (partition by voyage_id order by dist_km, route_id) as rn from holed where dist_km is not null
      union all select 'B', *, row_number() over (partition by voyage_id order by score, route_id) from holed where score is not null
      union all select 'C', *, row_number() over (partition by voyage_id order by margin desc, route_id) from holed where margin is not null)
    select v.voyage_id, n.corridor, r.route_id, r.dist_km, r.score, r.margin
    from voyages v cross join (select unnest(['A', 'B', 'C']) as corridor) n
    left join ranked r on r.voyage_id = v.voyage_id and r.corridor = n.corridor and r.rn = 1""",
    ("candidates",),
)
def corridors_with_gaps(spark, sf_dir):
    """Corridors where some measures are unknown: an unknown measure never wins."""
    c = view(spark, sf_dir, "candidates").select(
        "voyage_id",
        "route_id",
        F.when(F.col("route_id") % 3 != 0, F.col("dist_km")).alias("dist_km"),
        F.when(F.col("route_id") % 4 != 0, F.col("dist_km") + 2 * F.col("time_h") + 5 * F.col("risk")).alias("score"),
        F.when(F.col("route_id") % 5 != 0, 100 - F.col("risk")).alias("margin"),
    )
    picks = routes.corridors(c, F.col("score"))
    return picks.select("voyage_id", "corridor", "route_id", "dist_km", "score", "margin")


@registered(
    """with sized as (
      select case when ping_id % 11 <> 0 then vessel_id end as vessel_id, ping_id, ts, ping_id % 4 as priority,
        case when ping_id % 9 <> 0 then cast(length(status) as bigint) end as bytes from pings),
    totals as (select *, cast(sum(bytes) over (partition by vessel_id order by priority, ts, ping_id rows unbounded preceding) as bigint)
      as running_bytes from sized)
    select vessel_id, ping_id, bytes, running_bytes, bytes is not null and coalesce(running_bytes <= 300, false) as sent from totals""",
    ("pings",),
)
def bandwidth_with_gaps(spark, sf_dir):
    """Messages without a link or without a known size: each is sent or cut, none is lost."""
    features = inputs.pings(spark, sf_dir).select(
        F.when(F.col("ping_id") % 11 != 0, F.col("vessel_id")).alias("vessel_id"),
        "ping_id",
        "ts",
        (F.col("ping_id") % 4).alias("priority"),
        F.when(F.col("ping_id") % 9 != 0, F.col("status")).alias("payload"),
    )
    sent = routes.bandwidth_budget(features, "vessel_id", "priority", "ts", "ping_id", "payload", 2400.0, 1.0)
    return sent.select("vessel_id", "ping_id", "bytes", "running_bytes", "sent")


def _tiled(spark, sf_dir, targets=None):
    nodes = view(spark, sf_dir, "grid_nodes")
    starts = nodes.filter("i = 0 and j in (0, 49)").select(
        F.when(F.col("j") == 0, 0).otherwise(1).cast("bigint").alias("voyage_id"), "i", "j"
    )
    wanted = None
    if targets is not None:
        at = nodes.filter(targets).select("i", "j")
        wanted = spread.fan_out(at, starts.select("voyage_id").distinct())
    return pathing.cost_distance(pathing.grid_edges(nodes), starts, tile=16, targets=wanted, directed=False)


@registered(
    f"""with recursive {EDGES_SQL} select d.voyage_id, d.i, d.j, cast(d.d as double) as dist, p.pi, p.pj
    from dist d left join pred p using (voyage_id, i, j)""",
    ("grid_nodes",),
)
def cost_distance_tiles(spark, sf_dir):
    """Distances to every node of the whole grid over tiles of 16 x 16 nodes: rims crossed grow with the table."""
    return _tiled(spark, sf_dir)


def _routes_with_misses(dist, at):
    """Routes to the places ``at``, and those that none reaches."""
    outside = dist.select("voyage_id").distinct().select("voyage_id", F.lit(-1).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("j"))
    goal = dist.filter(at).select("voyage_id", "i", "j").unionByName(outside)
    found = pathing.extract_routes(dist, goal).withColumn("reached", F.lit(True))
    nothing = F.lit(None).cast("bigint")
    missed = pathing.unreachable(dist, goal).select(
        "voyage_id", F.col("i").alias("target_i"), F.col("j").alias("target_j"), nothing.alias("i"), nothing.alias("j"),
        nothing.alias("seq"), F.lit(False).alias("reached"),
    )
    return found.unionByName(missed)


@registered(
    f"""with recursive {EDGES_SQL}, goal as (select voyage_id, i, j from (select distinct voyage_id from starts) v
      cross join (select i, j from grid_nodes where j = 25 union all select -1, -1) g),
    walk as (select g.voyage_id, g.i as target_i, g.j as target_j, g.i, g.j, cast(0 as bigint) as back from goal g join dist d using (voyage_id, i, j)
      union all select w.voyage_id, w.target_i, w.target_j, p.pi, p.pj, w.back + 1
        from walk w join pred p on p.voyage_id = w.voyage_id and p.i = w.i and p.j = w.j)
    select voyage_id, target_i, target_j, i, j, max(back) over (partition by voyage_id, target_i, target_j) - back as seq, true as reached from walk
    union all select voyage_id, i, j, null, null, null, false from goal g where not exists (
      select 1 from dist d where d.voyage_id = g.voyage_id and d.i = g.i and d.j = g.j)""",
    ("grid_nodes",),
)
def routes_to_targets(spark, sf_dir):
    """Routes to the whole of a column and to one place outside the grid, which none reaches.

    The search stops at the cost of the farthest of the places it can reach.
    """
    return _routes_with_misses(_tiled(spark, sf_dir, "j = 25").checkpoint(), "j = 25")


@registered()
def voyages_across(spark, sf_dir):
    """Routes of a voyage from every fourth row of the grid, over tiles of 8 x 8 nodes: voyages grow with the table.

    Each crosses to the column j = 25 in its own row; its search stops at that place's cost.
    """
    nodes = view(spark, sf_dir, "grid_nodes")
    voyage = F.floor(F.col("i") / 4).cast("bigint").alias("voyage_id")
    starts = nodes.filter("i % 4 = 0 and j = 0").select(voyage, "i", "j")
    goal = nodes.filter("i % 4 = 0 and j = 25").select(voyage, "i", "j")
    dist = pathing.cost_distance(pathing.grid_edges(nodes), starts, tile=8, targets=goal, directed=False).checkpoint()
    return pathing.extract_routes(dist, goal)
