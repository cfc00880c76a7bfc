"""Clusters of points by density, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icefathom.operators.spread import block_join
from icefathom.session import ensure_checkpoint_dir

#: Two cells with at most so many pairs of points are compared point by point, others box by box.
PAIR_ROWS = 10_000
#: Boxes are cut into so many parts along each axis at every level.
CUT = 4


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; ``root`` is the least node of its component.

    Each round every root hooks itself to the least root that a link of any of its nodes
    reaches, and nodes then take their root's root: whole components merge at once, so
    rounds grow with the logarithm of a component's length. Links inside one component are
    dropped as soon as they are. Rounds end in reliable checkpoints.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct().checkpoint()
    roots = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")).checkpoint()
    edges = edges.filter("u <> v")
    while not edges.isEmpty():
        # Edges join roots here: every root above some neighbour goes to the least one.
        up = edges.groupBy(F.col("v").alias("from")).agg(F.min("u").alias("to")).checkpoint()
        while True:
            far = up.select(F.col("from").alias("to"), F.col("to").alias("top"))
            longer = up.join(far, "to", "left").select("from", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")).checkpoint()
            up = longer.select("from", "to")
            if longer.filter("moved").isEmpty():
                break
        hooks = up.withColumnRenamed("from", "root")
        roots = roots.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")).checkpoint()
        ends = edges
        for end in ("u", "v"):
            ends = ends.join(up.select(F.col("from").alias(end), F.col("to").alias(f"{end}_to")), end, "left").withColumn(
                end, F.coalesce(f"{end}_to", end)
            ).drop(f"{end}_to")
        edges = ends.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().checkpoint()
    return roots


def _gap(reach: float, far: bool) -> Column:
    """Whether two boxes (a, b) have a pair (``far``: only pairs) within ``reach``, by their borders."""

    def along(axis: str) -> Column:
        a0, a1, b0, b1 = (F.col(f"{side}_{axis}{end}") for side in "ab" for end in (0, 1))
        return F.greatest(a1 - b0, b1 - a0) if far else F.greatest(a0 - b1, b0 - a1, F.lit(0.0))

    return along("x") * along("x") + along("y") * along("y") <= reach * reach


def _touching(core: DataFrame, reach: float, side: float, pair_rows: int) -> DataFrame:
    """Pairs of cells (a, b), a < b, that hold core points within ``reach`` of each other.

    Crowded cells are never compared point by point: their points are boxed ever finer, a pair
    of boxes whose farthest corners are within reach settles its cells, one whose borders are
    out of reach is dropped, and only what is left is cut again. Boxes are as tight as their
    points, so points in one place end it.
    """
    x, y = F.col("x"), F.col("y")
    inside = core.withColumns({"u": x / side - F.col("cell.i"), "v": y / side - F.col("cell.j")})

    def boxes(points: DataFrame, level: int) -> DataFrame:
        n = CUT**level
        part = F.struct(F.floor(F.col("u") * n).cast("long").alias("u"), F.floor(F.col("v") * n).cast("long").alias("v"))
        above = F.struct(F.floor(part.u / CUT).cast("long").alias("u"), F.floor(part.v / CUT).cast("long").alias("v"))
        named = points.withColumns({"part": part, "above": above})
        ends = [f("x" if c == "x" else "y").alias(f"{c}{e}") for c in "xy" for e, f in ((0, F.min), (1, F.max))]
        return named.groupBy("cell", "part", "above").agg(F.count("*").alias("n"), *ends)

    def as_side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*[F.col(c).alias(s if c == "cell" else f"{s}_{c}") for c in df.columns])

    first = boxes(inside, 0).checkpoint()
    steps = F.sequence(F.lit(-2), F.lit(2))
    spread = first.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    shifted = F.struct((F.col("cell.i") + F.col("di")).alias("i"), (F.col("cell.j") + F.col("dj")).alias("j"))
    a = as_side(spread.withColumn("meet", shifted).drop("di", "dj"), "a").withColumnRenamed("a_meet", "b")
    open_ = a.join(as_side(first, "b"), "b").filter((F.col("a") < F.col("b")) & _gap(reach, False))
    settled, level = None, 0
    small = None
    while True:
        open_ = open_.withColumn("sure", _gap(reach, True)).checkpoint()
        sure = open_.filter("sure").select("a", "b").distinct()
        settled = sure if settled is None else settled.union(sure)
        rest = open_.filter(~F.col("sure")).join(sure, ["a", "b"], "left_anti")
        few = rest.filter(F.col("a_n") * F.col("b_n") <= pair_rows).select("a", "b", "a_part", "b_part").withColumn("level", F.lit(level))
        small = few if small is None else small.union(few)
        crowded = rest.filter(F.col("a_n") * F.col("b_n") > pair_rows).select("a", "b", "a_part", "b_part").checkpoint()
        if crowded.isEmpty():
            break
        level += 1
        wanted = crowded.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        finer = boxes(inside.join(wanted, "cell", "left_semi"), level).checkpoint()
        at_a = crowded.withColumnRenamed("a_part", "a_above").join(as_side(finer, "a"), ["a", "a_above"])
        open_ = at_a.withColumnRenamed("b_part", "b_above").join(as_side(finer, "b"), ["b", "b_above"]).filter(_gap(reach, False))
    # What is left is compared by points, level by level; pairs of boxes are small by now.
    small = small.join(settled, ["a", "b"], "left_anti").checkpoint()
    for depth in range(level + 1):
        n = CUT**depth
        part = F.struct(F.floor(F.col("u") * n).cast("long").alias("u"), F.floor(F.col("v") * n).cast("long").alias("v"))
        points = inside.select("cell", part.alias("part"), "x", "y")
        near = small.filter(F.col("level") == depth)
        for s in "ab":
            near = near.join(points.select(F.col("cell").alias(s), F.col("part").alias(f"{s}_part"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")), [s, f"{s}_part"])
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        settled = settled.union(near.filter(dx * dx + dy * dy <= reach * reach).select("a", "b").distinct())
    return settled.distinct()


def density_clusters(points: DataFrame, reach: float, min_pts: int, point: str, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Clusters of points (``x``, ``y``) by density, across the borders of cells.

    A point with at least ``min_pts`` points within ``reach``, itself counted, is ``core``; core
    points within reach of each other are one cluster, named by its least core point. Other
    points within reach of a core point are ``border`` and belong to the least cluster they
    reach; the rest is ``noise`` without a cluster. A point without a place has neither.

    Cells are small enough that all points of one are within reach of each other. So a cell of
    ``min_pts`` points has core points only, and only points of emptier cells, fewer than
    ``min_pts`` to a cell, are counted against their neighbours; clusters are components of cells,
    not of points. Returns the input with ``kind`` and ``cluster_id``; ``point`` must be unique.
    """
    if reach <= 0 or min_pts < 1:
        raise ValueError("need reach > 0 and min_pts >= 1")
    ensure_checkpoint_dir(points.sparkSession)
    side = reach * 0.7071
    cell = F.struct(*[F.floor(F.col(c) / side).cast("long").alias(n) for c, n in (("x", "i"), ("y", "j"))])
    placed = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    spots = placed.select(F.col(point).alias("id"), F.col("x").cast("double"), F.col("y").cast("double")).withColumn("cell", cell).checkpoint()
    full = spots.groupBy("cell").agg((F.count("*") >= min_pts).alias("full"))
    told = spots.join(full, "cell").checkpoint()

    def close(few: DataFrame, many: DataFrame) -> DataFrame:
        """Pairs (id, b_id, b_cell) within reach; ``few`` goes to the 25 cells around."""
        steps = F.sequence(F.lit(-2), F.lit(2))
        out = few.select("id", "x", "y", "cell").withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
        out = out.withColumn("at", F.struct((F.col("cell.i") + F.col("di")).alias("i"), (F.col("cell.j") + F.col("dj")).alias("j")))
        other = many.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cell").alias("at"))
        met = block_join(out.select("id", "x", "y", "at"), other, ["at"], "id", "b_id")
        dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
        return met.filter(dx * dx + dy * dy <= reach * reach).select("id", "b_id", F.col("at").alias("b_cell"))

    sparse = told.filter(~F.col("full"))
    counted = close(sparse, spots).groupBy("id").agg(F.count("*").alias("n"))
    more = counted.filter(F.col("n") >= min_pts).select("id").withColumn("dense", F.lit(True))
    judged = told.join(more, "id", "left").withColumn("core", F.col("full") | F.coalesce("dense", F.lit(False))).drop("dense", "full").checkpoint()
    core = judged.filter("core")
    own = core.groupBy("cell").agg(F.min("id").alias("least")).checkpoint()
    roots = connected(_touching(core, reach, side, pair_rows)).withColumnRenamed("node", "cell")
    rooted = own.join(roots, "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    named = rooted.groupBy("root").agg(F.min("least").alias("cluster_id"))
    of_cell = rooted.join(named, "root").select("cell", "cluster_id").checkpoint()
    inner = core.join(of_cell, "cell").select("id", F.lit("core").alias("kind"), "cluster_id")
    reached = close(judged.filter(~F.col("core")), core).select("id", F.col("b_cell").alias("cell")).distinct()
    edge = reached.join(of_cell, "cell").groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    outer = edge.select("id", F.lit("border").alias("kind"), "cluster_id")
    found = inner.union(outer).withColumnRenamed("id", point)
    lone = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"), F.lit("noise"))
    return points.join(found, point, "left").withColumn("kind", F.coalesce("kind", lone))
