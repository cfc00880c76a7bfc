"""Registered queries: sources, quality, projection, track geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.functions import geo
from icefathom.functions.numeric import fixed
from icefathom.operators import geometry as g
from icefathom.operators import joins, quality
from icefathom.plans import inputs
from icefathom.plans import sqltext as t
from icefathom.plans.registry import registered
from icefathom.plans.views import view
from icefathom.session import ensure_checkpoint_dir
from icefathom.sources import feeds, geojson, state, tracks


@registered(
    f"""select 'sea_ice' as feed, slot, cell_i, cell_j, {t.fx('sic', 4)} as value
    from env_cells where slot between 4 and 9""",
    ("env_cells",),
)
def read_feed(spark, sf_dir):
    """Two feeds written in the long layout, one read back over a date range."""
    cells = view(spark, sf_dir, "env_cells").withColumn("date", F.make_date(F.lit(2024), "slot", F.lit(1)))
    long = cells.select(
        "date",
        "cell_i",
        "cell_j",
        F.inline(
            F.array(
                F.struct(F.lit("sea_ice").alias("feed"), F.col("sic").alias("value")),
                F.struct(F.lit("bathymetry").alias("feed"), F.col("depth_m").alias("value")),
            )
        ),
    )
    folder = f"{ensure_checkpoint_dir(spark)}/feeds-{uuid.uuid4().hex}"
    feeds.write_feed(long, folder)
    rows = feeds.read_feed(spark, folder, "sea_ice", "2024-04-01", "2024-09-01")
    return rows.select("feed", F.month("date").alias("slot"), "cell_i", "cell_j", fixed(F.col("value"), 4).alias("value"))


@registered(
    f"""select vessel_id as id, ping_id as fix_id, cast(floor(epoch_us(ts) / 1e6) as bigint) as s, {t.fx('lat', 6)} as lat,
    {t.fx('lon', 6)} as lon from pings where ping_id % 50 <> 0""",
    ("pings",),
)
def read_tracks(spark, sf_dir):
    """Pings written as CSV with a broken latitude now and then, the readable lines read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/tracks-{uuid.uuid4().hex}"
    inputs.pings(spark, sf_dir).select(
        F.col("vessel_id").alias("id"),
        F.col("ping_id").alias("fix_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("ping_id") % 50 == 0, "not a number").otherwise(F.col("lat").cast("string")).alias("lat"),
        "lon",
    ).write.option("header", True).csv(folder)
    good, _ = tracks.split_corrupt(tracks.read_tracks(spark, folder))
    return good.select(
        "id", "fix_id", F.unix_seconds("ts").alias("s"), fixed(F.col("lat"), 6).alias("lat"), fixed(F.col("lon"), 6).alias("lon")
    )


@registered(
    "select ping_id from pings where ping_id % 50 = 0", ("pings",)
)
def read_tracks_rejects(spark, sf_dir):
    """The lines that could not be read, by their fix; no cache, one column."""
    folder = f"{ensure_checkpoint_dir(spark)}/rejects-{uuid.uuid4().hex}"
    inputs.pings(spark, sf_dir).select(
        F.col("vessel_id").alias("id"),
        F.col("ping_id").alias("fix_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("ping_id") % 50 == 0, "not a number").otherwise(F.col("lat").cast("string")).alias("lat"),
        "lon",
    ).write.option("header", True).csv(folder)
    _, bad = tracks.split_corrupt(tracks.read_tracks(spark, folder))
    return bad.select(F.split("_corrupt_record", ",")[1].cast("bigint").alias("ping_id"))


@registered(
    f"select station_id, name, 'Point' as geometry_type, {t.fx('lon', 4)} as lon, {t.fx('lat', 4)} as lat from stations",
    ("stations",),
)
def read_geojson(spark, sf_dir):
    """The station catalogue as a GeoJSON file, read back as columns."""
    folder = f"{ensure_checkpoint_dir(spark)}/stations-{uuid.uuid4().hex}"
    geojson.write_features(geojson.to_geojson_points(view(spark, sf_dir, "stations"), ["station_id", "name"]), folder)
    props = T.StructType([T.StructField("station_id", T.LongType()), T.StructField("name", T.StringType())])
    back = geojson.read_geojson(spark, folder, props, lines=True)
    return back.select(
        "station_id", "name", "geometry_type",
        fixed(F.col("coordinates")[0], 4).alias("lon"), fixed(F.col("coordinates")[1], 4).alias("lat"),
    )


def _by_regime(spark, sf_dir):
    obs = view(spark, sf_dir, "feed_obs")
    return feeds.union_feeds({r: obs.filter(F.col("regime") == r).drop("regime") for r in feeds.REGIMES})


@registered(f"select regime, cell, obs_id, priority, {t.fx('value')} as value from feed_obs", ("feed_obs",))
def union_feeds(spark, sf_dir):
    return _by_regime(spark, sf_dir).select("regime", "cell", "obs_id", "priority", fixed(F.col("value")).alias("value"))


@registered(
    """select regime, case when regime in ('LIVE', 'STATIC') then 'kept' else 'dropped' end as outcome,
    cast(count(*) as bigint) as n from feed_obs group by 1, 2""",
    ("feed_obs",),
)
def regime_guard(spark, sf_dir):
    kept, dropped = feeds.regime_guard(view(spark, sf_dir, "feed_obs"), ["LIVE", "STATIC"])
    passed = kept.groupBy("regime").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("kept"))
    stopped = dropped.select("regime", F.col("n_dropped").alias("n"), F.lit("dropped").alias("outcome"))
    return passed.unionByName(stopped).select("regime", "outcome", "n")


@registered(
    """select vessel_id, ping_id, t_s, status from (select *, row_number() over (
    partition by vessel_id order by ts desc, ping_id desc) as rn from pings) p where rn = 1""",
    ("pings",),
)
def merge_state(spark, sf_dir):
    """Even pings as stored state, odd ones as the update."""
    p = inputs.pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "t_s", "status")
    merged = state.merge_state(
        p.filter(F.col("ping_id") % 2 == 0), p.filter(F.col("ping_id") % 2 == 1), ["vessel_id"], ["ts", "ping_id"]
    )
    return merged.select("vessel_id", "ping_id", "t_s", "status")


@registered(
    """select ping_id, concat_ws(',', case when lat is null then 'lat_missing' end,
      case when lat < -90 or lat > 90 then 'lat_range' end, case when lon is null then 'lon_missing' end,
      case when lon < -180 or lon > 180 then 'lon_range' end, case when speed < 0 then 'speed_negative' end) as reasons
    from (select ping_id, case when ping_id % 11 <> 0 then lat * 1.25e0 end as lat,
      case when ping_id % 13 <> 0 then lon * 1.05e0 end as lon, cast(ping_id % 17 - 1 as double) as speed from pings) p""",
    ("pings",),
)
def validate(spark, sf_dir):
    """Pings with errors put in; accepted rows have no reason."""
    raw = inputs.pings(spark, sf_dir).select(
        "ping_id",
        F.when(F.col("ping_id") % 11 != 0, F.col("lat") * 1.25).alias("lat"),
        F.when(F.col("ping_id") % 13 != 0, F.col("lon") * 1.05).alias("lon"),
        (F.col("ping_id") % 17 - 1).cast("double").alias("speed"),
    )
    ok, rejects = quality.validate(raw, quality.fix_rules(speed="speed"))
    return ok.select("ping_id", F.lit("").alias("reasons")).unionByName(
        rejects.select("ping_id", F.concat_ws(",", "reasons").alias("reasons"))
    )


@registered(
    """select vessel_id, cast(floor(t_s / 21600.0e0) as bigint) as quarter, min(ping_id) as ping_id
    from pings group by 1, 2""",
    ("pings",),
)
def dedupe_fixes(spark, sf_dir):
    p = inputs.pings(spark, sf_dir).select("vessel_id", F.floor(F.col("t_s") / 21600.0).alias("quarter"), "ping_id")
    return quality.dedupe_fixes(p, ["vessel_id", "quarter"], "ping_id")


@registered(
    f"""select priority, cast(floor(epoch_us(max(ts)) / 1e6) as bigint) as newest_s, count(*) as n_obs,
    {t.fx("(epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(max(ts))) / 3.6e9", 4)} as age_h,
    (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(max(ts))) / 3.6e9 > 1.0e0 as stale
    from feed_obs group by 1""",
    ("feed_obs",),
)
def feed_freshness(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    fresh = quality.feed_freshness(view(spark, sf_dir, "feed_obs"), now, 1.0, "priority")
    return fresh.select(
        "priority",
        F.unix_seconds(F.col("newest").cast("timestamp")).alias("newest_s"),
        "n_obs",
        fixed(F.col("age_h"), 4).alias("age_h"),
        "stale",
    )


@registered(
    f"select ping_id, {t.fx(t.px('lat', 'lon'), 2)} as x, {t.fx(t.py('lat', 'lon'), 2)} as y from pings", ("pings",)
)
def project_3031(spark, sf_dir):
    p = g.project_3031(inputs.pings(spark, sf_dir).select("ping_id", "lat", "lon"))
    return p.select("ping_id", fixed(F.col("x"), 2).alias("x"), fixed(F.col("y"), 2).alias("y"))


@registered(
    f"""with xy as (select ping_id, {t.px('lat', 'lon')} as x, {t.py('lat', 'lon')} as y from pings)
    select ping_id, {t.fx('ilat', 6)} as lat, {t.fx('ilon', 6)} as lon from {t.inverse_columns('xy', 'x', 'y', 'ping_id')} i""",
    ("pings",),
)
def unproject_3031(spark, sf_dir):
    xy = g.project_3031(inputs.pings(spark, sf_dir).select("ping_id", "lat", "lon")).select("ping_id", "x", "y")
    back = g.unproject_3031(xy)
    return back.select("ping_id", fixed(F.col("lat"), 6).alias("lat"), fixed(F.col("lon"), 6).alias("lon"))


@registered(
    f"select ping_id, {t.fx(t.hav('lat', 'lon', '-67.6e0', '62.87e0'))} as km from pings", ("pings",)
)
def add_distance_km(spark, sf_dir):
    """Distance of each ping to one base."""
    p = inputs.pings(spark, sf_dir).select("ping_id", "lat", "lon", F.lit(-67.6).alias("blat"), F.lit(62.87).alias("blon"))
    return g.add_distance_km(p, ("lat", "lon"), ("blat", "blon")).select("ping_id", fixed(F.col("km")).alias("km"))


@registered(
    f"""select fix_id, {t.fx(t.bearing('lat', 'lon', '-75.0e0', '10.0e0'), 4)} as bearing,
    {t.fx(t.moved_lat('lat', '90.0e0', '25.0e0'), 5)} as moved_lat,
    {t.fx(t.moved_lon('lat', 'lon', '90.0e0', '25.0e0'), 5)} as moved_lon from berg_fixes""",
    ("berg_fixes",),
)
def bearing_and_move(spark, sf_dir):
    """Bearing to a waypoint, and every berg moved 25 km east."""
    b = inputs.bergs(spark, sf_dir).select("fix_id", "lat", "lon", F.lit(-75.0).alias("wlat"), F.lit(10.0).alias("wlon"))
    with_bearing = g.add_bearing(b, ("lat", "lon"), ("wlat", "wlon"))
    moved = g.move_points(with_bearing, F.lit(90.0), F.lit(25.0), out=("moved_lat", "moved_lon"))
    return moved.select(
        "fix_id",
        fixed(F.col("bearing"), 4).alias("bearing"),
        fixed(F.col("moved_lat"), 5).alias("moved_lat"),
        fixed(F.col("moved_lon"), 5).alias("moved_lon"),
    )


@registered(
    f"""select ping_id, cast(floor({t.px('lat', 'lon')} / 50000.0e0) as bigint) as cell_i,
    cast(floor({t.py('lat', 'lon')} / 50000.0e0) as bigint) as cell_j from pings""",
    ("pings",),
)
def add_cell(spark, sf_dir):
    p = g.project_3031(inputs.pings(spark, sf_dir).select("ping_id", "lat", "lon"))
    return g.add_cell(p, 50_000.0).select("ping_id", "cell_i", "cell_j")


LEGS_SQL = f"""lagged as (
  select vessel_id, ping_id, t_s, ice_class, ts, lat, lon, lag(ping_id) over w as prev_id, lag(lat) over w as plat, lag(lon) over w as plon,
         {t.us('ts')} - lag({t.us('ts')}) over w as gap_us
  from pings window w as (partition by vessel_id order by ts, ping_id)),
coursed as (
  select *, {t.hav('plat', 'plon', 'lat', 'lon')} as leg_km, gap_us / 3.6e9 as leg_h,
         {t.bearing('plat', 'plon', 'lat', 'lon')} as course from lagged),
legs as (
  select *, case when leg_h > 0 then leg_km / leg_h end as speed_kmh,
         course - lag(course) over (partition by vessel_id order by ts, ping_id) as turn from coursed)"""


@registered(
    f"""with {LEGS_SQL} select vessel_id, ping_id, prev_id, {t.fx('leg_km')} as leg_km, {t.fx('leg_h', 5)} as leg_h,
    {t.fx('speed_kmh', 2)} as speed_kmh, {t.fx(t.wrap('turn'), 2)} as course_change from legs""",
    ("pings",),
)
def leg_metrics(spark, sf_dir):
    p = inputs.pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "lat", "lon")
    legs = g.leg_metrics(p, "vessel_id", "ts", "ping_id")
    return legs.select(
        "vessel_id",
        "ping_id",
        "prev_id",
        fixed(F.col("leg_km")).alias("leg_km"),
        fixed(F.col("leg_h"), 5).alias("leg_h"),
        fixed(F.col("speed_kmh"), 2).alias("speed_kmh"),
        fixed(F.col("course_change"), 2).alias("course_change"),
    )


SPLIT_SQL = """seen as (
  select vessel_id, ping_id, ts, lat, lon, lag(lat) over w as plat, lag(lon) over w as plon from pings
  window w as (partition by vessel_id order by ts, ping_id)),
counted as (
  select *, coalesce(abs(lon - plon) > 180.0e0, false) as jump,
         cast(sum(case when abs(lon - plon) > 180.0e0 then 1 else 0 end) over (
           partition by vessel_id order by ts, ping_id rows unbounded preceding) as bigint) as part from seen),
edged as (
  select *, case when plon > 0 then 180.0e0 else -180.0e0 end as edge,
         case when plon > 0 then lon + 360.0e0 else lon - 360.0e0 end - plon as span from counted),
cutlat as (
  select *, plat + (lat - plat) * (case when span = 0 then 0.0e0 else (edge - plon) / span end) as clat from edged),
split as (
  select vessel_id, ping_id, ts, 2 as piece, part, lat, lon from cutlat
  union all select vessel_id, ping_id, ts, 0, part - 1, clat, edge from cutlat where jump
  union all select vessel_id, ping_id, ts, 1, part, clat, -edge from cutlat where jump)"""


@registered(
    f"with {SPLIT_SQL} select vessel_id, ping_id, piece, part, {t.fx('lat', 5)} as lat, {t.fx('lon', 5)} as lon from split",
    ("pings",),
)
def split_antimeridian(spark, sf_dir):
    p = inputs.pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "lat", "lon")
    out = g.split_antimeridian(p, "vessel_id", "ts", "ping_id")
    return out.select(
        "vessel_id", "ping_id", "piece", "part", fixed(F.col("lat"), 5).alias("lat"), fixed(F.col("lon"), 5).alias("lon")
    )


@registered(
    f"""with {SPLIT_SQL}, days as (select *, cast(floor(epoch_us(ts) / 8.64e10) as bigint) as day from split),
    pieces as (select *, lag(day) over v as pday, lag(lon) over v as plon, lag(lat) over v as plat from days
      window v as (partition by vessel_id, part order by ts, ping_id, piece)),
    drawn as (select vessel_id, part, day, lon, lat from pieces
      union all select vessel_id, part, day, plon, plat from pieces where pday <> day)
    select vessel_id, part, day, count(*) as n_points, {t.fx('min(lon)', 4)} as west, {t.fx('max(lat)', 4)} as north,
      count(*) > 1 as is_line from drawn group by 1, 2, 3""",
    ("pings",),
)
def geojson_lines(spark, sf_dir):
    """Routes as GeoJSON lines, read back from the text for the report."""
    p = inputs.pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "lat", "lon")
    lines = g.part_lines(g.split_antimeridian(p, "vessel_id", "ts", "ping_id"), "vessel_id", "ts", "ping_id")
    text = geojson.to_geojson_lines(lines, ["vessel_id", "part", "line"])
    feature = (
        "geometry struct<type string, coordinates string>,"
        " properties struct<vessel_id bigint, part bigint, line struct<slot bigint>>"
    )
    parsed = text.select(F.from_json("feature", feature).alias("f"))
    is_line = F.col("f.geometry.type") == "LineString"
    body = F.when(is_line, F.col("f.geometry.coordinates")).otherwise(F.concat(F.lit("["), "f.geometry.coordinates", F.lit("]")))
    coords = F.col("coords")
    return parsed.withColumns({"coords": F.from_json(body, "array<array<double>>"), "is_line": is_line}).select(
        "f.properties.vessel_id",
        "f.properties.part",
        F.col("f.properties.line.slot").alias("day"),
        F.size(coords).cast("bigint").alias("n_points"),
        fixed(F.array_min(F.transform(coords, lambda c: c[0])), 4).alias("west"),
        fixed(F.array_max(F.transform(coords, lambda c: c[1])), 4).alias("north"),
        "is_line",
    )


@registered(
    f"""with {SPLIT_SQL}, steps as (select *, lag(lat) over v as qlat, lag(lon) over v as qlon, count(*) over (partition by vessel_id, part) as n
      from split window v as (partition by vessel_id, part order by ts, ping_id, piece))
    select vessel_id, count(distinct part) as n_lines, count(*) as n_points, cast(min(n) as bigint) as shortest,
      {t.fx(f"sum({t.hav('qlat', 'qlon', 'lat', 'lon')})", 2)} as km from steps where n > 1 group by 1""",
    ("pings",),
)
def geojson_routes(spark, sf_dir):
    """Each vessel's route as one GeoJSON MultiLineString, measured from the text."""
    p = inputs.pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "lat", "lon")
    lines = g.route_lines(g.split_antimeridian(p, "vessel_id", "ts", "ping_id"), "vessel_id", "ts", "ping_id")
    text = geojson.to_geojson_routes(lines, ["vessel_id"])
    feature = "type string, geometry struct<type string, coordinates array<array<array<double>>>>, properties struct<vessel_id bigint>"
    drawn = text.select(F.from_json("feature", feature).alias("f")).filter("f.geometry.type = 'MultiLineString'")
    parts = drawn.select("f.properties.vessel_id", F.posexplode("f.geometry.coordinates").alias("part", "line"))
    ends = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))
    legs = parts.select("vessel_id", F.size("line").cast("bigint").alias("n"), F.explode(ends).alias("leg"))
    km = geo.haversine_km(F.col("leg.a")[1], F.col("leg.a")[0], F.col("leg.b")[1], F.col("leg.b")[0])
    length = legs.groupBy("vessel_id").agg(fixed(F.sum(km), 2).alias("km"))
    counts = parts.groupBy("vessel_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("line")).alias("n_points"), F.min(F.size("line")).cast("bigint").alias("shortest")
    )
    return counts.join(length, "vessel_id")


LAND_SQL = f"""xy as (select ping_id, {t.px('lat', 'lon')} as x, {t.py('lat', 'lon')} as y from pings),
land as (
  select xy.ping_id, coalesce(sum(case when (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    then 1 else 0 end), 0) % 2 = 1 as inside from xy cross join land_edges group by 1)"""


@registered(f"with {LAND_SQL} select ping_id, case when ping_id % 17 <> 0 then inside end as on_land from land", ("pings", "land_edges"))
def land_mask(spark, sf_dir):
    p = g.project_3031(inputs.pings(spark, sf_dir).select("ping_id", "lat", "lon"))
    unknown = p.withColumn("x", F.when(F.col("ping_id") % 17 != 0, F.col("x")))
    return g.land_mask(unknown, view(spark, sf_dir, "land_edges"), "ping_id").select("ping_id", "on_land")


@registered(
    f"""with near as (select vessel_id, ping_id, lat, lon, lag(lat) over w as alat, lag(lon) over w as alon,
      lead(lat) over w as blat, lead(lon) over w as blon from pings
      window w as (partition by vessel_id order by ts, ping_id)),
    off as (select vessel_id, ping_id, case when {t.hav('alat', 'alon', 'blat', 'blon')} = 0 then {t.hav('alat', 'alon', 'lat', 'lon')}
      else abs(asin(sin({t.hav('alat', 'alon', 'lat', 'lon')} / {t.R}) * sin(radians({t.bearing('alat', 'alon', 'lat', 'lon')}
        - {t.bearing('alat', 'alon', 'blat', 'blon')})))) * {t.R} end as km from near)
    select vessel_id, ping_id from off where km is null or km >= 0.3e0""",
    ("pings",),
)
def simplify_track(spark, sf_dir):
    p = inputs.pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "lat", "lon")
    return g.simplify_track(p, 0.3, "vessel_id", "ts", "ping_id").select("vessel_id", "ping_id")


@registered(
    f"""with placed as (select ping_id, lat, lon, {t.PING_CELL} from pings)
    select p.ping_id, {t.fx('2 * 7.2921159e-5 * sin(radians(lat)) * 1e6', 4)} as coriolis_e6,
      {t.fx('-e.wind_ms * sin(radians(lon + 180.0e0))')} as wind_u,
      {t.fx('-e.wind_ms * cos(radians(lon + 180.0e0))')} as wind_v
    from placed p left join env_cells e using (cell_i, cell_j, slot)""",
    ("pings", "env_cells"),
)
def wind_features(spark, sf_dir):
    """Wind at each ping; the fixture has no direction, so one is made from the longitude."""
    p = inputs.placed_pings(spark, sf_dir).select("ping_id", "lat", "lon", "cell_i", "cell_j", "slot")
    met = joins.sample_env(p, view(spark, sf_dir, "env_cells").select("cell_i", "cell_j", "slot", "wind_ms"))
    w = g.wind_features(met.withColumn("wind_from", F.col("lon") + 180.0), "wind_ms", "wind_from")
    return w.select(
        "ping_id",
        fixed(F.col("coriolis") * 1e6, 4).alias("coriolis_e6"),
        fixed(F.col("wind_u")).alias("wind_u"),
        fixed(F.col("wind_v")).alias("wind_v"),
    )
