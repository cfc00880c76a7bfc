"""Projection, distances, legs, date-line splits, land mask, simplification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icefathom.functions import geo
from icefathom.functions.numeric import NO_CELL, cell_index, clamp, join_cell
from icefathom.operators import segments as sg
from icefathom.session import ensure_checkpoint_dir


def project_3031(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds EPSG:3031 ``x`` and ``y`` in metres."""
    return df.withColumns(
        {"x": geo.polar_x(F.col(lat), F.col(lon)), "y": geo.polar_y(F.col(lat), F.col(lon))}
    )


def unproject_3031(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds latitude and longitude of EPSG:3031 ``x`` and ``y``."""
    return df.withColumns(
        {lat: geo.polar_lat(F.col("x"), F.col("y")), lon: geo.polar_lon(F.col("x"), F.col("y"))}
    )


def add_distance_km(df: DataFrame, a: tuple[str, str], b: tuple[str, str], out: str = "km") -> DataFrame:
    """Adds the great-circle distance between two (lat, lon) column pairs."""
    return df.withColumn(out, geo.haversine_km(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])))


def add_bearing(df: DataFrame, a: tuple[str, str], b: tuple[str, str], out: str = "bearing") -> DataFrame:
    """Adds the initial bearing from one (lat, lon) column pair to another."""
    return df.withColumn(out, geo.bearing_deg(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])))


def move_points(
    df: DataFrame, bearing: Column, km: Column, lat: str = "lat", lon: str = "lon", out: tuple[str, str] = ("lat", "lon")
) -> DataFrame:
    """Moves every point along a great circle."""
    a, o = F.col(lat), F.col(lon)
    return df.withColumns(
        {
            out[0]: geo.destination_lat(a, bearing, km),
            out[1]: geo.destination_lon(a, o, bearing, km),
        }
    )


def add_cell(df: DataFrame, size_m: float) -> DataFrame:
    """Adds the grid cell of EPSG:3031 ``x`` and ``y``."""
    return df.withColumns(
        {"cell_i": cell_index(F.col("x"), size_m), "cell_j": cell_index(F.col("y"), size_m)}
    )


def leg_metrics(
    df: DataFrame, key: str, ts: str = "ts", row_id: str = "fix_id", segment_s: float = sg.SEGMENT_S
) -> DataFrame:
    """Adds the leg that ends at each fix: length, duration, speed, course.

    ``course_change`` is the turn against the previous leg, -180 <= c < 180.
    The first fix of a track has null leg columns.
    """
    order = [ts, row_id]
    cut = sg.add_segment(df, [key], ts, segment_s)
    w = sg.segment_window([key], order)
    lat, lon = F.col("lat"), F.col("lon")
    # One previous row is enough for the leg; the turn reads one more.
    with_prev = sg.carry_neighbours(cut, [key], order, back=2).withColumns(
        {
            "prev_id": F.lag(row_id).over(w),
            "prev_lat": F.lag("lat").over(w),
            "prev_lon": F.lag("lon").over(w),
            "_prev_us": F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w),
        }
    )
    course = geo.bearing_deg(F.col("prev_lat"), F.col("prev_lon"), lat, lon)
    legs = with_prev.withColumns(
        {
            "leg_km": geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), lat, lon),
            "leg_h": (F.unix_micros(F.col(ts).cast("timestamp")) - F.col("_prev_us")) / F.lit(3.6e9),
            "course": course,
        }
    )
    turn = F.col("course") - F.lag("course").over(w)
    return (
        sg.drop_carried(
            legs.withColumns(
                {
                    "speed_kmh": F.when(F.col("leg_h") > 0, F.col("leg_km") / F.col("leg_h")),
                    "course_change": turn - F.floor((turn + 180.0) / 360.0) * 360.0,
                }
            )
        )
        .drop("_prev_us", sg.SEGMENT)
    )


def split_antimeridian(
    df: DataFrame, key: str, ts: str = "ts", row_id: str = "fix_id", segment_s: float = sg.SEGMENT_S
) -> DataFrame:
    """Cuts tracks where they cross the date line.

    Every crossing adds two rows at +/-180 with an interpolated latitude: the
    end of the old part (``piece`` 0) and the start of the new one (``piece``
    1); fixes themselves have ``piece`` 2. ``part`` counts crossings so far.
    """
    order = [ts, row_id]
    cut = sg.add_segment(df, [key], ts, segment_s)
    w = sg.segment_window([key], order)
    prev = sg.drop_carried(
        sg.carry_neighbours(cut, [key], order).withColumns(
            {"_plat": F.lag("lat").over(w), "_plon": F.lag("lon").over(w)}
        )
    )
    jump = F.coalesce(F.abs(F.col("lon") - F.col("_plon")) > 180.0, F.lit(False))
    parts = sg.running_sum(prev.withColumn("_jump", jump), [key], order, F.col("_jump").cast("bigint"), "part")
    east = F.col("_plon") > 0
    edge = F.when(east, F.lit(180.0)).otherwise(F.lit(-180.0))
    unrolled = F.when(east, F.col("lon") + 360.0).otherwise(F.col("lon") - 360.0)
    span = unrolled - F.col("_plon")
    frac = F.when(span == 0, F.lit(0.0)).otherwise((edge - F.col("_plon")) / span)
    cut_lat = F.col("_plat") + (F.col("lat") - F.col("_plat")) * frac

    def piece(n: int, part: Column, lat: Column, lon: Column) -> Column:
        return F.struct(F.lit(n).alias("piece"), part.alias("part"), lat.alias("lat"), lon.alias("lon"))

    own = piece(2, F.col("part"), F.col("lat"), F.col("lon"))
    pieces = F.when(
        F.col("_jump"),
        F.array(piece(0, F.col("part") - 1, cut_lat, edge), piece(1, F.col("part"), cut_lat, -edge), own),
    ).otherwise(F.array(own))
    keep = [c for c in df.columns if c not in ("lat", "lon")]
    return parts.select(*keep, F.inline(pieces))


def part_lines(
    split: DataFrame, key: str, ts: str = "ts", row_id: str = "fix_id", points: int = 10_000,
    segment_s: float = sg.SEGMENT_S,
) -> DataFrame:
    """Nested lines ``array<struct<lon,lat>>`` of a split track.

    A part is given as consecutive ``line`` pieces of one time segment and at
    most ``points`` new vertices each, so no list grows with the track. Every piece
    begins with the last vertex of the piece before it: put together they draw the part
    without a gap. A part of one fix is one piece of one vertex.
    """
    order = [ts, row_id, "piece"]
    cut = sg.add_segment(split, [key], ts, segment_s)
    w = sg.segment_window([key], order)
    near = sg.carry_neighbours(cut, [key], order).withColumns(
        {"_plon": F.lag("lon").over(w), "_plat": F.lag("lat").over(w), "_ppart": F.lag("part").over(w)}
    )
    numbered = sg.drop_carried(near).withColumn("_block", F.floor((F.row_number().over(w) - 1) / points))
    linked = F.when(F.col("_ppart") == F.col("part"), F.struct(F.col("_plon").alias("lon"), F.col("_plat").alias("lat")))
    packed = numbered.groupBy(key, "part", sg.SEGMENT, "_block").agg(
        F.sort_array(F.collect_list(F.struct(*order, "lon", "lat"))).alias("_pts"),
        F.min_by(linked, F.struct(*order)).alias("_before"),
    )
    own = F.transform("_pts", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return packed.select(
        key,
        "part",
        F.struct(F.col(f"{sg.SEGMENT}.slot"), F.col(f"{sg.SEGMENT}.cut"), F.col("_block")).alias("line"),
        F.when(F.col("_before").isNull(), own).otherwise(F.concat(F.array("_before"), own)).alias("coords"),
    )


def route_lines(split: DataFrame, key: str, ts: str = "ts", row_id: str = "fix_id") -> DataFrame:
    """One row per route: ``lines``, its parts in order, as a MultiLineString has them.

    Parts of a single fix are no lines and are left out (``part_lines`` keeps them as
    points). A feature is one value, so this is for routes; a telemetry history of any
    length goes out as ``part_lines``.
    """
    order = [ts, row_id, "piece"]
    parts = split.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct(*order, "lon", "lat"))).alias("_pts"))
    line = F.transform("_pts", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    lines = parts.filter(F.size("_pts") > 1).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("part", line.alias("coords")))).alias("_lines")
    )
    return lines.select(key, F.col("_lines.coords").alias("lines"))


def land_cells(cells: DataFrame, edges: DataFrame, cell_m: float) -> DataFrame:
    """What the outline looks like in each of the given grid cells (``_ci``, ``_cj``).

    ``_far``: whether the right end of the cell's lower side is inside the outline;
    ``_low``: x where the outline crosses the lower side; ``_edges``: the edges that touch
    the cell. A cell carries its own piece of the outline only, whatever the outline's length.
    """
    size = F.lit(float(cell_m))

    def index(value: Column) -> Column:
        return F.floor(value / size).cast("bigint")

    y_low, y_high = F.least("y1", "y2"), F.greatest("y1", "y2")
    x_low, x_high = F.least("x1", "x2"), F.greatest("x1", "x2")
    x_at = (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    # Lower sides that an edge crosses (its upper end lies above, its lower end not).
    crossings = (
        edges.filter(F.col("y1") != F.col("y2"))
        .withColumns({"_first": F.ceil(y_low / size).cast("bigint"), "_last": F.ceil(y_high / size).cast("bigint") - 1})
        .filter("_first <= _last")
        .withColumn("_cj", F.explode(F.sequence("_first", "_last")))
        .withColumn("_y", F.col("_cj") * size)
        .select("_cj", x_at.alias("_x"))
        .select("_cj", index(F.col("_x")).alias("_ci"), "_x")
        .groupBy("_cj", "_ci")
        .agg(F.collect_list("_x").alias("_low"))
    )
    # Edges by the cells they touch: per row of cells the stretch of x inside that row.
    y_a, y_b = F.greatest(y_low, F.col("_cj") * size), F.least(y_high, (F.col("_cj") + 1) * size)
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    x_a, x_b = F.col("x1") + slope * (y_a - F.col("y1")), F.col("x1") + slope * (y_b - F.col("y1"))
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, x_low).otherwise(F.greatest(x_low, F.least(x_a, x_b) - 1e-6 * size))
    right = F.when(flat, x_high).otherwise(F.least(x_high, F.greatest(x_a, x_b) + 1e-6 * size))
    touching = (
        edges.withColumn("_cj", F.explode(F.sequence(index(y_low), index(y_high))))
        .withColumn("_ci", F.explode(F.sequence(index(left), index(right))))
        .groupBy("_cj", "_ci")
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    )
    wanted = cells.select("_ci", "_cj").distinct().withColumn("_asked", F.lit(True))
    rows = wanted.join(crossings, ["_ci", "_cj"], "full")
    east = W.partitionBy("_cj").orderBy(F.col("_ci").desc()).rowsBetween(W.unboundedPreceding, -1)
    far = rows.withColumn("_n", F.when(F.col("_low").isNull(), 0).otherwise(F.size("_low")))
    far = far.withColumn("_far", F.coalesce(F.sum("_n").over(east), F.lit(0)) % 2 == 1).drop("_n")
    return far.filter("_asked").drop("_asked").join(touching, ["_ci", "_cj"], "left")


def land_mask(points: DataFrame, edges: DataFrame, key: str, cell_m: float = 25_000.0) -> DataFrame:
    """Adds ``on_land``: the position lies inside the outline; null where it is unknown.

    The grid cell of a point knows whether one of its corners is inside and which edges
    touch it. The answer is that corner's, turned once for every crossing on the way from
    the corner along the lower side and up to the point. Points meet the edges of their own
    cell, and the points themselves are joined once, by cell.
    """
    ensure_checkpoint_dir(points.sparkSession)
    placed = points.withColumns({"_ci": join_cell(F.col("x"), cell_m), "_cj": join_cell(F.col("y"), cell_m)})
    # Stored first: both sides of the join are then plain shuffles, whose hot cells split.
    cells = land_cells(placed.filter(f"_ci <> {NO_CELL} and _cj <> {NO_CELL}"), edges, cell_m).checkpoint()
    joined = placed.join(cells, ["_ci", "_cj"], "left")
    x, y, base = F.col("x"), F.col("y"), F.col("_cj") * F.lit(float(cell_m))

    def climbed(e: Column) -> Column:
        over = (e["x1"] > x) != (e["x2"] > x)
        at = (e["y2"] - e["y1"]) * (x - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]
        return over & (at > base) & (at <= y)

    along = F.when(F.col("_low").isNull(), 0).otherwise(F.size(F.filter("_low", lambda c: c > x)))
    up = F.when(F.col("_edges").isNull(), 0).otherwise(F.size(F.filter("_edges", climbed)))
    inside = F.coalesce(F.col("_far"), F.lit(False)) != ((along + up) % 2 == 1)
    known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return joined.withColumn("on_land", F.when(known, inside)).drop("_ci", "_cj", "_far", "_low", "_edges")


def simplify_track(
    df: DataFrame, tol_km: float, key: str, ts: str = "ts", row_id: str = "fix_id", passes: int = 1,
    segment_s: float = sg.SEGMENT_S,
) -> DataFrame:
    """Drops fixes closer than ``tol_km`` to the chord between their neighbours.

    Track ends stay. Each pass looks at the track the pass before left.
    """
    order = [ts, row_id]
    w = sg.segment_window([key], order)
    current = df
    for n in range(passes):
        if n:
            # A pass reads its input more than once: keep the last result.
            ensure_checkpoint_dir(df.sparkSession)
            current = current.checkpoint()
        cut = sg.add_segment(current, [key], ts, segment_s)
        near = sg.carry_neighbours(cut, [key], order, back=1, ahead=1).withColumns(
            {
                "_alat": F.lag("lat").over(w),
                "_alon": F.lag("lon").over(w),
                "_blat": F.lead("lat").over(w),
                "_blon": F.lead("lon").over(w),
            }
        )
        off = off_chord_km(
            (F.col("_alat"), F.col("_alon")), (F.col("_blat"), F.col("_blon")), (F.col("lat"), F.col("lon"))
        )
        current = (
            sg.drop_carried(near.withColumn("_off", off))
            .filter(F.col("_off").isNull() | (F.col("_off") >= tol_km))
            .select(*df.columns)
        )
    return current


def off_chord_km(a: tuple[Column, Column], b: tuple[Column, Column], p: tuple[Column, Column]) -> Column:
    """Cross-track distance of ``p`` from the great circle a-b (null at an open end)."""
    reach = geo.haversine_km(*a, *p)
    angle = F.radians(geo.bearing_deg(*a, *p) - geo.bearing_deg(*a, *b))
    sine = F.sin(reach / geo.EARTH_RADIUS_KM) * F.sin(angle)
    cross = F.abs(F.asin(clamp(sine, -1.0, 1.0))) * geo.EARTH_RADIUS_KM
    return F.when(geo.haversine_km(*a, *b) == 0, reach).when(a[0].isNotNull() & b[0].isNotNull(), cross)


def wind_features(df: DataFrame, speed: str, direction: str, lat: str = "lat") -> DataFrame:
    """Adds Coriolis ``f`` and the wind vector; ``direction`` is where wind comes from."""
    s, d = F.col(speed), F.radians(F.col(direction))
    return df.withColumns(
        {
            "coriolis": geo.coriolis(F.col(lat)),
            "wind_u": -s * F.sin(d),
            "wind_v": -s * F.cos(d),
        }
    )
