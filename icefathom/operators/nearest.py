"""Exact nearest neighbours between two tables by equi-joins only.

Targets are summarised into a pyramid of nested boxes over the globe's
straight-line coordinates, points into cells; both keep the tight bounding box
of what they hold. Cells walk down the pyramid: at every level a cell keeps
the boxes that can still hold one of its k nearest targets, because they are
no farther than what the k-th best box guarantees. Only points and targets of
the leaf boxes left over are compared. Straight-line distance orders targets
as the great circle does, so pole and date line need no care.

Both sides follow density: where a box holds more than ``LEAF_ROWS`` targets the pyramid
goes on below the given cell size until it holds fewer, cells of more than ``CELL_ROWS``
points are cut again, and of targets in one place only the ``k`` lowest ids are kept. So n
points and n targets in one harbour make pairs in proportion to n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icefathom.functions import geo
from icefathom.functions.numeric import join_cell
from icefathom.session import ensure_checkpoint_dir

FAN = 4
BOX = ["_bx", "_by", "_bz"]
SLACK_KM = 1e-6
LEAF_ROWS = 32
CELL_ROWS = 64
#: Levels below the given cell size: 4**8 times finer, about 3 cm for cells of 2 km.
MOST_DEPTH = 8


def _with_xyz(df: DataFrame, lat: str, lon: str, mark: str) -> DataFrame:
    a, o = F.col(lat), F.col(lon)
    return df.withColumns(
        {f"{mark}x": geo.unit_x(a, o), f"{mark}y": geo.unit_y(a, o), f"{mark}z": geo.unit_z(a)}
    )


def _hull(mark: str) -> list[Column]:
    return [f(f"{mark}{c}").alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "_lo"), (F.max, "_hi"))]


def _levels(side: float) -> int:
    levels = 1
    while side * FAN ** (levels - 1) < geo.EARTH_RADIUS_KM + 1:
        levels += 1
    return levels


def _pyramid(goals: DataFrame, levels: int, depth: int) -> DataFrame:
    """Boxes of every level with their parent, hull and target count.

    ``_leaf`` boxes are compared target by target.
    """
    places = goals.groupBy(*BOX).agg(*_hull("_t"), F.count(F.lit(1)).alias("_n"))
    hull = [f"{n}{c}" for c in "xyz" for n in ("_lo", "_hi")]
    scale = F.pow(F.lit(float(FAN)), F.col("_lv"))
    at_levels = places.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    nested = at_levels.select(
        "_lv", *[F.floor(F.col(b) / scale).alias(b) for b in BOX], *hull, "_n"
    )
    merged = nested.groupBy("_lv", *BOX).agg(
        *[(F.min if n == "_lo" else F.max)(f"{n}{c}").alias(f"{n}{c}") for c in "xyz" for n in ("_lo", "_hi")],
        F.sum("_n").alias("_n"),
    )
    leaf = (F.col("_lv") == 0) | ((F.col("_lv") <= depth) & (F.col("_n") <= LEAF_ROWS))
    # Boxes below a leaf stay in the table; the walk never gets to them.
    return merged.select("*", *[F.floor(F.col(b) / FAN).alias(f"_p{b}") for b in BOX], leaf.alias("_leaf"))


def _leaf_of(goals: DataFrame, pyramid: DataFrame, depth: int) -> DataFrame:
    """Targets with the leaf box they belong to (``_lv`` and its indices)."""
    if not depth:
        return goals.withColumn("_lv", F.lit(0))
    scale = F.pow(F.lit(float(FAN)), F.col("_lv"))
    fine = [F.col(b).alias(f"_f{b}") for b in BOX]
    paths = (
        goals.select(*BOX).distinct()
        .withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .select("_lv", *fine, *[F.floor(F.col(b) / scale).alias(b) for b in BOX])
    )
    ends = paths.join(pyramid.filter("_leaf").select("_lv", *BOX), ["_lv", *BOX])
    # The uppermost leaf above a place is the one the walk arrives at.
    top = ends.groupBy(*[f"_f{b}" for b in BOX]).agg(F.max(F.struct("_lv", *BOX)).alias("_l"))
    named = goals.withColumnsRenamed({b: f"_f{b}" for b in BOX})
    return named.join(top, [f"_f{b}" for b in BOX]).select(
        *[c for c in goals.columns if c not in BOX], F.col("_l._lv").alias("_lv"), *[F.col(f"_l.{b}").alias(b) for b in BOX]
    )


def _gap(c: str) -> Column:
    """Distance along one axis from the cell centre to a box (0 inside)."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.col(f"_lo{c}") - F.col(f"_c{c}"), F.col(f"_c{c}") - F.col(f"_hi{c}"))


def _far(c: str) -> Column:
    return F.greatest(F.abs(F.col(f"_lo{c}") - F.col(f"_c{c}")), F.abs(F.col(f"_hi{c}") - F.col(f"_c{c}")))


def _length(parts: list[Column]) -> Column:
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def _leaf_lists(placed: DataFrame, pyramid: DataFrame, levels: int, depth: int, k: int) -> DataFrame:
    """Per cell the leaf boxes that may hold a wanted target.

    ``_low`` is a lower bound of the distance from any point of the cell to
    the box, ``_sure`` an upper bound of the k-th best distance of any of
    its points.
    """
    cells = placed.groupBy("_cell").agg(*_hull("_p")).select(
        "_cell",
        *[((F.col(f"_lo{c}") + F.col(f"_hi{c}")) / 2).alias(f"_c{c}") for c in "xyz"],
        (_length([F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"]) / 2).alias("_r"),
    )
    cell = ["_cell", "_cx", "_cy", "_cz", "_r"]
    halves = F.array(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))
    front = cells
    for b in BOX:
        front = front.withColumn(f"_p{b}", F.explode(halves))
    hull = [f"{n}{c}" for c in "xyz" for n in ("_lo", "_hi")]
    kept = [*BOX, "_lv", "_leaf", "_n", *hull]
    top = pyramid.filter(F.col("_lv") == levels - 1).select(*kept)
    front = front.select(*cell, *[F.col(f"_p{b}").alias(b) for b in BOX]).join(top, BOX)
    for level in range(levels - 1, -1, -1):
        if level < levels - 1:
            children = pyramid.filter(F.col("_lv") == level).select(*[f"_p{b}" for b in BOX], *kept)
            open_boxes = front.filter("not _leaf") if level < depth else front
            parents = open_boxes.select(*cell, *[F.col(b).alias(f"_p{b}") for b in BOX])
            below = parents.join(children, [f"_p{b}" for b in BOX]).select(*cell, *kept)
            # Leaves that were reached above stay as they are.
            front = below.unionByName(front.filter("_leaf").select(*cell, *kept)) if level < depth else below
        near, far = _length([_gap(c) for c in "xyz"]), _length([_far(c) for c in "xyz"])
        measured = front.select(*cell, *kept, (near - F.col("_r")).alias("_low"), (far + F.col("_r")).alias("_up"))
        mine = W.partitionBy("_cell")
        if k > 1:
            # The bound is met by the first box that brings the count to k.
            so_far = F.sum("_n").over(mine.orderBy("_up").rowsBetween(W.unboundedPreceding, 0))
            counted = measured.withColumn("_ok", F.when(so_far >= k, F.col("_up")))
            sure = F.coalesce(F.min("_ok").over(mine), F.lit(float("inf")))
        else:
            counted, sure = measured, F.min("_up").over(mine)
        front = (
            counted.withColumn("_sure", sure)
            .filter(F.col("_low") <= F.col("_sure") + SLACK_KM)
            .select(*cell, *kept, "_low", "_sure")
        )
        if level < depth:
            # The walk below the cell size joins and unites the front with itself.
            front = front.checkpoint()
    return front.select(*cell, *BOX, "_lv", "_low", "_sure")


def _cut_dense(placed: DataFrame, side: float) -> DataFrame:
    """Points by cell; cells of more than CELL_ROWS points are cut finer, by their count."""

    def cell(fine: Column) -> Column:
        at = F.lit(side) / F.pow(F.lit(float(FAN)), fine)
        return F.struct(fine.alias("d"), *[join_cell(F.col(f"_p{c}"), at).alias(c) for c in "xyz"])

    plain = placed.withColumn("_cell", cell(F.lit(0)))
    for _ in range(MOST_DEPTH):
        dense = plain.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CELL_ROWS)
        # Points of one place stay together whatever the cell: finer than MOST_DEPTH is not tried.
        step = F.greatest(F.lit(1), F.ceil(F.log(F.col("_n") / CELL_ROWS) / F.log(F.lit(float(FAN * FAN))))).cast("int")
        finer = dense.select("_cell", F.least(F.lit(MOST_DEPTH), F.col("_cell.d") + step).alias("_d")).filter("_d > _cell.d").checkpoint()
        if finer.isEmpty():
            break
        joined = plain.join(finer, "_cell", "left")
        plain = joined.withColumn("_cell", F.when(F.col("_d").isNull(), F.col("_cell")).otherwise(cell(F.col("_d")))).drop("_d").checkpoint()
    return plain


def _depth(goals: DataFrame, side: float) -> int:
    """Levels below ``side`` until no box holds more than LEAF_ROWS targets (at most MOST_DEPTH).

    Each look counts the boxes once and goes down as far as the fullest one needs when its
    targets are spread evenly over its extent.
    """
    depth = 0
    while depth < MOST_DEPTH:
        at = side / FAN**depth
        boxes = {b: join_cell(F.col(f"_t{c}"), at) for b, c in zip(BOX, "xyz")}
        full = goals.withColumns(boxes).groupBy(*BOX).agg(F.count(F.lit(1)).alias("_n"), *_hull("_t")).filter(F.col("_n") > LEAF_ROWS)
        extent = F.greatest(*[F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"], F.lit(at / FAN**MOST_DEPTH))
        wanted = F.log(F.lit(at) / (extent * F.sqrt(F.lit(float(LEAF_ROWS)) / F.col("_n")))) / F.log(F.lit(float(FAN)))
        need = full.agg(F.max(F.greatest(F.lit(1), F.ceil(wanted).cast("int"))).alias("d")).first()["d"]
        if need is None:
            return depth
        depth = min(MOST_DEPTH, depth + need)
    return depth


def _setup(points: DataFrame, targets: DataFrame, target_id: str, k: int, cell_km: float, prefix: str):
    ensure_checkpoint_dir(points.sparkSession)
    side = float(cell_km)
    placed = _cut_dense(_with_xyz(points.filter("lat is not null and lon is not null"), "lat", "lon", "_p"), side)
    lat, lon = f"{prefix}lat", f"{prefix}lon"
    named = targets.select(*[F.col(c).alias(f"{prefix}{c}") for c in targets.columns])
    # In one place only the k lowest ids can be wanted; ranks up to k are cut before the shuffle.
    same = W.partitionBy(lat, lon).orderBy(f"{prefix}{target_id}")
    lowest = named.withColumn("_rk", F.row_number().over(same)).filter(F.col("_rk") <= k).drop("_rk")
    goals = _with_xyz(lowest, lat, lon, "_t").checkpoint()
    depth = _depth(goals, side)
    levels = _levels(side) + depth
    fine = {b: join_cell(F.col(f"_t{c}"), side / FAN**depth) for b, c in zip(BOX, "xyz")}
    goals = goals.withColumns(fine)
    # Every level reads the pyramid, a table of occupied boxes: kept once.
    pyramid = _pyramid(goals, levels, depth).checkpoint()
    return placed, _leaf_of(goals, pyramid, depth), _leaf_lists(placed, pyramid, levels, depth, k)


def _short_lists(leaves: DataFrame, goals: DataFrame, keep: list[str]) -> DataFrame:
    """Targets any point of each cell may want."""
    chord = _length([F.col(f"_c{c}") - F.col(f"_t{c}") for c in "xyz"])
    wanted = [c for c in goals.columns if c not in ("_tx", "_ty", "_tz", "_lv", *BOX)]
    return (
        leaves.join(goals, ["_lv", *BOX])
        .filter(chord - F.col("_r") <= F.col("_sure") + SLACK_KM)
        .select("_cell", *keep, *wanted)
    )


def nearest(
    points: DataFrame, targets: DataFrame, k: int, point_id: str, target_id: str,
    cell_km: float = 2.0, prefix: str = "t_",
) -> DataFrame:
    """``k`` nearest targets of each point with ``dist_km`` and ``rank``.

    Ties go to the lowest target id. Points without a position get no row.
    """
    placed, goals, leaves = _setup(points, targets, target_id, k, cell_km, prefix)
    pairs = placed.drop("_px", "_py", "_pz").join(_short_lists(leaves, goals, []), "_cell").drop("_cell")
    dist = geo.haversine_km(F.col("lat"), F.col("lon"), F.col(f"{prefix}lat"), F.col(f"{prefix}lon"))
    best = W.partitionBy(point_id).orderBy("dist_km", f"{prefix}{target_id}")
    return (
        pairs.withColumn("dist_km", dist)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )


def nearest_by_group(
    points: DataFrame, targets: DataFrame, group: str, point_id: str, target_id: str, cell_km: float = 2.0
) -> DataFrame:
    """The closest (point, target) pair of every group of points.

    A leaf box of one cell is dropped for a group when another cell of the
    group guarantees something closer.
    """
    placed, goals, found = _setup(points, targets, target_id, 1, cell_km, "t_")
    leaves = found.checkpoint()
    visits = placed.select(group, "_cell").distinct()
    sure = leaves.groupBy("_cell").agg(F.min("_sure").alias("_best"))
    best = visits.join(sure, "_cell").groupBy(group).agg(F.min("_best").alias("_best"))
    useful = (
        visits.join(leaves, "_cell")
        .join(best, group)
        .filter(F.col("_low") <= F.col("_best") + SLACK_KM)
        .withColumn("_sure", F.least("_sure", "_best"))
        .drop("_best", "_low")
    )
    lists = _short_lists(useful, goals, [group])
    dist = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    pair = F.struct(dist.alias("dist_km"), F.col(f"t_{target_id}").alias("target_id"), F.col(point_id).alias("point_id"))
    return (
        placed.select(group, point_id, "lat", "lon", "_cell")
        .join(lists, [group, "_cell"])
        .groupBy(group)
        .agg(F.min(pair).alias("_b"))
        .select(group, "_b.*")
    )


def nearest_station(points: DataFrame, stations: DataFrame, k: int, point_id: str, cell_km: float = 20.0) -> DataFrame:
    """``k`` nearest stations or shelters of each point."""
    return nearest(points, stations, k, point_id, "station_id", cell_km, "s_")
