"""Registered queries: joins of pings, bergs, stations and feeds; drift and collision."""

from __future__ import annotations

from pyspark.sql import functions as F

from icefathom.functions import geo
from icefathom.functions.numeric import fixed
from icefathom.operators import clusters, drift, geometry, joins, nearest, routes
from icefathom.plans import inputs
from icefathom.plans import sqltext as t
from icefathom.plans.registry import registered
from icefathom.plans.views import view
from icefathom.session import stored


@registered(
    f"""with placed as (select ping_id, {t.PING_CELL} from pings)
    select ping_id, {t.fx('sic', 4)} as sic, {t.fx('depth_m')} as depth_m, {t.fx('wave_m')} as wave_m, n_obs
    from placed p left join env_cells e using (cell_i, cell_j, slot)""",
    ("pings", "env_cells"),
)
def sample_env(spark, sf_dir):
    p = inputs.placed_pings(spark, sf_dir).select("ping_id", "cell_i", "cell_j", "slot")
    met = joins.sample_env(p, view(spark, sf_dir, "env_cells"))
    return met.select(
        "ping_id",
        fixed(F.col("sic"), 4).alias("sic"),
        fixed(F.col("depth_m")).alias("depth_m"),
        fixed(F.col("wave_m")).alias("wave_m"),
        "n_obs",
    )


def _asof(spark, sf_dir, direction):
    p = inputs.pings(spark, sf_dir).select("ping_id", (F.col("vessel_id") - 1).alias("berg_id"), "ts", "t_s")
    b = inputs.bergs(spark, sf_dir).select("berg_id", "fix_id", "ts", "lat")
    met = joins.asof_join(p, b, ["berg_id"], "ts", "fix_id", 12 * 3600.0, direction)
    return met.select("ping_id", "r_fix_id", fixed(F.col("r_lat"), 4).alias("r_lat"))


def _asof_sql(op: str) -> str:
    gap = "abs(epoch_us(p.ts) - epoch_us(b.ts)) <= 43200e6"
    return f"""select p.ping_id, case when {gap} then b.fix_id end as r_fix_id,
    {t.fx(f'case when {gap} then b.lat end', 4)} as r_lat
    from (select *, vessel_id - 1 as on_id from pings) p asof left join berg_fixes b on p.on_id = b.berg_id and p.ts {op} b.ts"""


@registered(_asof_sql(">="), ("pings", "berg_fixes"))
def asof_join(spark, sf_dir):
    """Last fix of the vessel's berg at or before each ping, at most 12 h old."""
    return _asof(spark, sf_dir, "backward")


@registered(_asof_sql("<="), ("pings", "berg_fixes"))
def asof_join_forward(spark, sf_dir):
    """First fix of the vessel's berg at or after each ping, at most 12 h away."""
    return _asof(spark, sf_dir, "forward")


@registered(
    f"""with aged as (select *, (epoch_us(timestamp '2024-01-30 12:00:00') - epoch_us(ts)) / 3.6e9 as age_h from feed_obs),
    ranked as (select *, row_number() over (partition by cell order by priority, ts desc, obs_id) as rn
      from aged where age_h between 0 and 6),
    keys as (select distinct cell from feed_obs)
    select k.cell, {t.fx('r.value')} as value, r.priority as used_feed, r.obs_id as used_id, r.priority > 1 as is_fallback
    from keys k left join ranked r on r.cell = k.cell and r.rn = 1""",
    ("feed_obs",),
)
def source_fallback(spark, sf_dir):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    best = joins.source_fallback(view(spark, sf_dir, "feed_obs"), ["cell"], now, 6.0)
    return best.select("cell", fixed(F.col("value")).alias("value"), "used_feed", "used_id", "is_fallback")


@registered(
    f"""with pairs as (select p.vessel_id, b.berg_id, {t.hav('p.lat', 'p.lon', 'b.lat', 'b.lon')} as km
      from pings p join berg_fixes b on abs(p.lat - b.lat) < 1.0e0 and epoch_us(b.ts) - epoch_us(p.ts) between -86400e6 and 86400e6)
    select vessel_id, count(*) as n_pairs, count(distinct berg_id) as n_bergs, {t.fx('min(km)')} as min_km
    from pairs where km <= 100.0e0 group by 1""",
    ("pings", "berg_fixes"),
)
def within_km(spark, sf_dir):
    """Berg fixes within 100 km and a day of each vessel's pings, summed up per vessel."""
    p = inputs.pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "lat", "lon")
    b = inputs.bergs(spark, sf_dir).select("berg_id", "fix_id", "ts", "lat", "lon")
    pairs = joins.within_km(p, joins.numbered(b, "berg_id"), 100.0, "ping_id", "fix_id", before_s=86400.0, after_s=86400.0)
    return joins.meetings(pairs, "vessel_id").select(
        "vessel_id", "n_pairs", F.col("n_others").alias("n_bergs"), fixed(F.col("min_km")).alias("min_km")
    )


@registered(
    f"""select ping_id, cast(rn as int) as rank, station_id, {t.fx('km')} as dist_km from (
      select *, row_number() over (partition by ping_id order by km, station_id) as rn from (
        select p.ping_id, s.station_id, {t.hav('p.lat', 'p.lon', 's.lat', 's.lon')} as km
        from pings p cross join stations s) d) r where rn <= 3""",
    ("pings", "stations"),
)
def nearest_station(spark, sf_dir):
    p = inputs.pings(spark, sf_dir).select("ping_id", "lat", "lon")
    s = view(spark, sf_dir, "stations").select("station_id", "lat", "lon")
    near = nearest.nearest_station(p, s, 3, "ping_id")
    return near.select("ping_id", "rank", F.col("s_station_id").alias("station_id"), fixed(F.col("dist_km")).alias("dist_km"))


def _velocity_sql(view_name: str, key: str, row: str, back: int) -> str:
    """CTE of a track with projected position and velocity over ``back`` steps."""
    return f"""(select {key}, {row}, ts, lat, lon, x, y,
      case when us > first_value(us) over w then (x - first_value(x) over w) / 1000.0e0 / ((us - first_value(us) over w) / 3.6e9) end as vx,
      case when us > first_value(us) over w then (y - first_value(y) over w) / 1000.0e0 / ((us - first_value(us) over w) / 3.6e9) end as vy
      from (select *, {t.px('lat', 'lon')} as x, {t.py('lat', 'lon')} as y, epoch_us(ts) as us from {view_name}) s
      window w as (partition by {key} order by ts, {row} rows between {back} preceding and current row))"""


CPA_SQL = f"""v as {_velocity_sql('pings', 'vessel_id', 'ping_id', 1)},
b as {_velocity_sql('berg_fixes', 'berg_id', 'fix_id', 2)},
close as (
  select v.vessel_id, v.ping_id, b.berg_id, b.fix_id, {t.scale('v.lat')} as k,
         (b.x - v.x) / 1000.0e0 + coalesce(b.vx, 0) * ((epoch_us(v.ts) - epoch_us(b.ts)) / 3.6e9) as rx,
         (b.y - v.y) / 1000.0e0 + coalesce(b.vy, 0) * ((epoch_us(v.ts) - epoch_us(b.ts)) / 3.6e9) as ry,
         coalesce(b.vx, 0) - coalesce(v.vx, 0) as wx, coalesce(b.vy, 0) - coalesce(v.vy, 0) as wy
  from v join b on abs(v.lat - b.lat) < 1.0e0 and abs(epoch_us(v.ts) - epoch_us(b.ts)) <= 10800e6
  where {t.hav('v.lat', 'v.lon', 'b.lat', 'b.lon')} <= 100.0e0),
timed as (
  select *, case when wx * wx + wy * wy = 0 then 0.0e0 else greatest(0.0e0, least(12.0e0,
    -((rx / k) * (wx / k) + (ry / k) * (wy / k)) / ((wx / k) * (wx / k) + (wy / k) * (wy / k)))) end as t_h from close),
approach as (
  select vessel_id, ping_id, berg_id, fix_id, t_h,
    sqrt(power(rx / k + wx / k * t_h, 2) + power(ry / k + wy / k * t_h, 2)) as d_km from timed)"""


def _approaches(vessels, bergs):
    return joins.cpa(vessels, bergs, 12.0, 100.0, 10800.0, "ping_id", "fix_id")


def _closest_bergs(spark, sf_dir, approaches):
    """The three bergs that come closest to every vessel among the pairs that ``approaches`` makes.

    They are made twice: first for a bound per vessel, then to keep those within it.
    """
    limits = [("critical", 5.0, 1.0), ("warning", 20.0, 6.0), ("watch", 60.0, 12.0)]
    vessels, bergs = stored(inputs.moving_pings(spark, sf_dir)), stored(inputs.moving_bergs(spark, sf_dir))
    bound = stored(routes.watch_bound(approaches(vessels, bergs), 3, "vessel_id", "b_berg_id"))
    near = approaches(vessels.join(bound, "vessel_id", "left"), bergs)
    top = routes.collision_watch(near, limits, 3, "vessel_id", "b_fix_id", "b_berg_id", "_most")
    return top.select(
        "vessel_id", "rank", "ping_id", F.col("b_fix_id").alias("fix_id"), "risk_class", fixed(F.col("cpa_km")).alias("cpa_km")
    )


@registered(
    f"with {CPA_SQL} select ping_id, fix_id, {t.fx('t_h')} as t_star_h, {t.fx('d_km')} as cpa_km from approach",
    ("pings", "berg_fixes"),
)
def cpa(spark, sf_dir):
    """Closest approach within 12 h for pairs 100 km and 3 h apart."""
    a = _approaches(inputs.moving_pings(spark, sf_dir), inputs.moving_bergs(spark, sf_dir))
    return a.select(
        "ping_id",
        F.col("b_fix_id").alias("fix_id"),
        fixed(F.col("t_star_h")).alias("t_star_h"),
        fixed(F.col("cpa_km")).alias("cpa_km"),
    )


@registered(
    f"""with {CPA_SQL}, classed as (
      select *, case when d_km <= 5.0e0 and t_h <= 1.0e0 then 'critical' when d_km <= 20.0e0 and t_h <= 6.0e0 then 'warning'
        when d_km <= 60.0e0 and t_h <= 12.0e0 then 'watch' else 'clear' end as risk_class,
        row_number() over (partition by vessel_id order by d_km, t_h, fix_id) as rn
      from (select *, row_number() over (partition by vessel_id, berg_id order by d_km, t_h, fix_id) as own from approach) a where own = 1)
    select vessel_id, cast(rn as int) as rank, ping_id, fix_id, risk_class, {t.fx('d_km')} as cpa_km from classed where rn <= 3""",
    ("pings", "berg_fixes"),
)
def collision_watch(spark, sf_dir):
    """The three bergs that come closest to every vessel, with their risk class."""
    return _closest_bergs(spark, sf_dir, _approaches)


REACH_SQL = CPA_SQL.replace(
    "abs(v.lat - b.lat) < 1.0e0 and ", ""
).replace(f"\n  where {t.hav('v.lat', 'v.lon', 'b.lat', 'b.lon')} <= 100.0e0", "")


def _all_approaches(vessels, bergs, limit_km):
    return joins.approaches(vessels, bergs, 12.0, limit_km, 10800.0, "ping_id", "fix_id")


@registered(
    f"with {REACH_SQL} select ping_id, fix_id, {t.fx('t_h')} as t_star_h, {t.fx('d_km')} as cpa_km from approach where d_km <= 20.0e0",
    ("pings", "berg_fixes"),
)
def cpa_from_any_distance(spark, sf_dir):
    """Closest approaches of 20 km or less within 12 h, however far apart the two are now."""
    a = _all_approaches(inputs.moving_pings(spark, sf_dir), inputs.moving_bergs(spark, sf_dir), 20.0)
    return a.select(
        "ping_id", F.col("b_fix_id").alias("fix_id"), fixed(F.col("t_star_h")).alias("t_star_h"), fixed(F.col("cpa_km")).alias("cpa_km")
    )


@registered(
    f"""with {REACH_SQL}, near as (select * from approach where d_km <= 60.0e0), classed as (
      select *, case when d_km <= 5.0e0 and t_h <= 1.0e0 then 'critical' when d_km <= 20.0e0 and t_h <= 6.0e0 then 'warning'
        when d_km <= 60.0e0 and t_h <= 12.0e0 then 'watch' else 'clear' end as risk_class,
        row_number() over (partition by vessel_id order by d_km, t_h, fix_id) as rn
      from (select *, row_number() over (partition by vessel_id, berg_id order by d_km, t_h, fix_id) as own from near) a where own = 1)
    select vessel_id, cast(rn as int) as rank, ping_id, fix_id, risk_class, {t.fx('d_km')} as cpa_km from classed where rn <= 3""",
    ("pings", "berg_fixes"),
)
def collision_watch_any_distance(spark, sf_dir):
    """The three bergs that come closest to every vessel, from however far."""
    return _closest_bergs(spark, sf_dir, lambda vessels, bergs: _all_approaches(vessels, bergs, 60.0))


@registered(
    """select p.ping_id, o.obs_id from pings p join feed_obs o on o.cell = p.vessel_id % 50 and o.regime = 'LIVE'
    and epoch_us(o.ts) - epoch_us(p.ts) between -7200e6 and 3600e6""",
    ("pings", "feed_obs"),
)
def interval_match(spark, sf_dir):
    """Radar passes from 2 h before to 1 h after each ping."""
    p = inputs.pings(spark, sf_dir).select("ping_id", (F.col("vessel_id") % 50).alias("cell"), "ts")
    passes = view(spark, sf_dir, "feed_obs").filter("regime = 'LIVE'").select("cell", "obs_id", "ts")
    met = joins.interval_match(p, passes, ["cell"], 7200.0, 3600.0, "ping_id", "obs_id")
    return met.select("ping_id", F.col("b_obs_id").alias("obs_id"))


@registered(
    f"""with b as {_velocity_sql('berg_fixes', 'berg_id', 'fix_id', 2)}
    select berg_id, fix_id, {t.fx('vx', 4)} as vx, {t.fx('vy', 4)} as vy from b""",
    ("berg_fixes",),
)
def drift_velocity(spark, sf_dir):
    v = inputs.moving_bergs(spark, sf_dir)
    return v.select("berg_id", "fix_id", fixed(F.col("vx"), 4).alias("vx"), fixed(F.col("vy"), 4).alias("vy"))


@registered(
    f"""with b as {_velocity_sql('berg_fixes', 'berg_id', 'fix_id', 2)},
    last_fix as (select * from (select *, row_number() over (partition by berg_id order by ts desc, fix_id desc) as rn from b) r
      where rn = 1),
    ahead as (select berg_id, cast(h as int) as horizon_h, x + coalesce(vx, 0) * h * 1000.0e0 as fx, y + coalesce(vy, 0) * h * 1000.0e0 as fy
      from last_fix cross join (select unnest(range(0, 49, 6)) as h) s)
    select berg_id, horizon_h, {t.fx('ilat', 4)} as lat, {t.fx('ilon', 4)} as lon
    from {t.inverse_columns('ahead', 'fx', 'fy', 'berg_id, horizon_h')} i""",
    ("berg_fixes",),
)
def drift_forecast(spark, sf_dir):
    """Positions 0 to 48 h ahead of each berg's newest fix."""
    from icefathom.operators.spread import latest_by

    newest = latest_by(
        inputs.moving_bergs(spark, sf_dir), ["berg_id"], [F.col("ts").desc(), F.col("fix_id").desc()]
    )
    ahead = drift.drift_forecast(newest, 48, 6)
    return ahead.select("berg_id", "horizon_h", fixed(F.col("lat"), 4).alias("lat"), fixed(F.col("lon"), 4).alias("lon"))


@registered(
    f"""with b as {_velocity_sql('berg_fixes', 'berg_id', 'fix_id', 2)},
    ahead as (select berg_id, fix_id, ts, h, ts + to_hours(h) as target, x + vx * h * 1000.0e0 as fx, y + vy * h * 1000.0e0 as fy
      from b cross join (select unnest([6, 12, 24, 48]) as h) s where vx is not null),
    geo as (select * from {t.inverse_columns('ahead', 'fx', 'fy', 'berg_id, fix_id, ts, h, target')} i),
    met as (select g.*, m.lat as tlat, m.lon as tlon, m.ts as tts
      from geo g asof join berg_fixes m on g.berg_id = m.berg_id and g.target >= m.ts),
    err as (select cast(h as int) as horizon_h, floor({t.hav('ilat', 'ilon', 'tlat', 'tlon')} * 1000.0e0 + 0.5e0) as metres
      from met where tts > ts and epoch_us(target) - epoch_us(tts) <= 21600e6)
    select horizon_h, count(*) as n, {t.fx('quantile_cont(metres, 0.5) / 1000.0e0', 6)} as median_km,
      {t.fx('quantile_cont(metres, 0.95) / 1000.0e0', 6)} as p95_km from err group by 1""",
    ("berg_fixes",),
)
def drift_backtest(spark, sf_dir):
    """Forecast error against the track itself at 6, 12, 24 and 48 h."""
    errors = drift.drift_errors(inputs.moving_bergs(spark, sf_dir), [6, 12, 24, 48], 6 * 3600.0, "berg_id")
    report = drift.drift_backtest(errors)
    return report.select(
        "horizon_h", "n", fixed(F.col("median_km"), 6).alias("median_km"), fixed(F.col("p95_km"), 6).alias("p95_km")
    )


DENSITY_SQL = f"""density as (
  select cell_i, cell_j, count(distinct berg_id) as n_bergs, count(*) as n_fixes from (
    select berg_id, cast(floor({t.px('lat', 'lon')} / 50000.0e0) as bigint) as cell_i,
           cast(floor({t.py('lat', 'lon')} / 50000.0e0) as bigint) as cell_j from berg_fixes) p group by 1, 2)"""


def _density(spark, sf_dir):
    b = geometry.project_3031(inputs.bergs(spark, sf_dir).select("berg_id", "lat", "lon"))
    return routes.berg_density(geometry.add_cell(b, 50_000.0), 2)


@registered(
    f"with {DENSITY_SQL} select cell_i, cell_j, n_bergs, n_fixes, n_bergs >= 2 as is_cluster from density", ("berg_fixes",)
)
def berg_density(spark, sf_dir):
    return _density(spark, sf_dir)


@registered(
    f"""with recursive spots as (select fix_id, {t.px('lat', 'lon')} as x, {t.py('lat', 'lon')} as y from berg_fixes),
    near as (select a.fix_id, b.fix_id as other from spots a join spots b
      on b.x between a.x - 60000.0e0 and a.x + 60000.0e0 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3.6e9),
    core as (select fix_id from near group by 1 having count(*) >= 4),
    links as (select n.fix_id, n.other from near n join core c on c.fix_id = n.fix_id join core d on d.fix_id = n.other),
    reach as (select fix_id, fix_id as root from core
      union select l.other, r.root from reach r join links l on l.fix_id = r.fix_id),
    named as (select fix_id, min(root) as cluster_id from reach group by 1),
    edge as (select n.fix_id, min(k.cluster_id) as cluster_id from near n join named k on k.fix_id = n.other
      where n.fix_id not in (select fix_id from core) group by 1)
    select s.fix_id, case when k.fix_id is not null then 'core' when e.fix_id is not null then 'border'
      when s.x is not null then 'noise' end as kind, coalesce(k.cluster_id, e.cluster_id) as cluster_id
    from spots s left join named k on k.fix_id = s.fix_id left join edge e on e.fix_id = s.fix_id""",
    ("berg_fixes",),
)
def berg_clusters(spark, sf_dir):
    """Clusters of berg fixes by density, across cells: four fixes within 60 km of each other's core."""
    b = geometry.project_3031(inputs.bergs(spark, sf_dir).select("fix_id", "lat", "lon"))
    return clusters.density_clusters(b, 60_000.0, 4, "fix_id").select("fix_id", "kind", "cluster_id")


@registered(
    f"""with {DENSITY_SQL},
    centres as (select cell_i, cell_j, (cell_i + 0.5e0) * 50000.0e0 as x, (cell_j + 0.5e0) * 50000.0e0 as y
      from density where n_bergs >= 2),
    packs as (select distinct cell_i, cell_j, (cell_i - 19.5e0) * 125000.0e0 as x, (cell_j - 4.5e0) * 500000.0e0 as y
      from env_cells where sic >= 0.8e0),
    hazards as (select 'berg-' || fix_id as hazard_id, lat, lon from berg_fixes
      union all select 'cell-' || cell_i || '-' || cell_j, ilat, ilon
      from {t.inverse_columns('centres', 'x', 'y', 'cell_i, cell_j')} c
      union all select 'ice-' || cell_i || '-' || cell_j, ilat, ilon
      from {t.inverse_columns('packs', 'x', 'y', 'cell_i, cell_j')} k),
    met as (select p.vessel_id, p.ping_id, h.hazard_id, {t.hav('p.lat', 'p.lon', 'h.lat', 'h.lon')} as km
      from pings p cross join hazards h)
    select vessel_id, {t.fx('min(km)')} as standoff_km, arg_min(hazard_id, km) as hazard_id, arg_min(ping_id, km) as point_id
    from met group by 1""",
    ("pings", "berg_fixes", "env_cells"),
)
def standoff(spark, sf_dir):
    """Least distance of each vessel's track to any berg fix, berg cluster or cell of heavy ice."""
    single = inputs.bergs(spark, sf_dir).select(
        F.concat(F.lit("berg-"), F.col("fix_id").cast("string")).alias("hazard_id"), "lat", "lon"
    )
    x, y = (F.col("cell_i") + 0.5) * 50_000.0, (F.col("cell_j") + 0.5) * 50_000.0
    cluster = _density(spark, sf_dir).filter("is_cluster").select(
        F.concat_ws("-", F.lit("cell"), F.col("cell_i").cast("string"), F.col("cell_j").cast("string")).alias("hazard_id"),
        geo.polar_lat(x, y).alias("lat"),
        geo.polar_lon(x, y).alias("lon"),
    )
    ix, iy = (F.col("cell_i") - 19.5) * 125_000.0, (F.col("cell_j") - 4.5) * 500_000.0
    packs = view(spark, sf_dir, "env_cells").filter("sic >= 0.8").select("cell_i", "cell_j").distinct().select(
        F.concat_ws("-", F.lit("ice"), F.col("cell_i").cast("string"), F.col("cell_j").cast("string")).alias("hazard_id"),
        geo.polar_lat(ix, iy).alias("lat"),
        geo.polar_lon(ix, iy).alias("lon"),
    )
    p = inputs.pings(spark, sf_dir)
    near = routes.standoff(p, single.unionByName(cluster).unionByName(packs), "vessel_id", "ping_id", "hazard_id")
    return near.select("vessel_id", fixed(F.col("standoff_km")).alias("standoff_km"), "hazard_id", "point_id")
