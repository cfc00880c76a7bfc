"""Radar scenes as pixel tables: target detection, leads, regridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.operators.clusters import connected
from icefathom.session import ensure_checkpoint_dir

TILE = 512


def cfar(pixels: DataFrame, guard: int, train: int, alpha: float, tile: int = TILE) -> DataFrame:
    """Constant-false-alarm test against the ring around each pixel.

    ``hit`` iff p * n > alpha * ring sum; the ring is the training box less
    the guard box and ``n`` its pixels inside the scene. Scenes are cut into
    tiles with a rim of ``train`` pixels, shuffled once; the row and column
    box sums both run inside that partitioning. Pixels keep their value: integers
    and decimals are summed exactly, floating point as double.
    """
    if not 0 <= guard < train <= tile:
        raise ValueError("need 0 <= guard < train <= tile")

    kind = pixels.schema["p"].dataType
    if isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType):
        kind = T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()
    elif not isinstance(kind, T.DecimalType):
        raise ValueError(f"pixels must be numbers, not {kind.simpleString()}")

    def tiles(at: str) -> Column:
        return F.sequence(F.floor((F.col(at) - train) / tile), F.floor((F.col(at) + train) / tile))

    rimmed = (
        pixels.filter("p is not null")
        .select("scene", "r", "c", F.col("p").cast(kind).alias("p"))
        .withColumn("_tr", F.explode(tiles("r")))
        .withColumn("_tc", F.explode(tiles("c")))
    )
    area = ["scene", "_tr", "_tc"]
    filled = _fill_holes(rimmed, area).repartition(*area)
    along = W.partitionBy(*area, "r").orderBy("c")
    down = W.partitionBy(*area, "c").orderBy("r")
    rows = filled.withColumns(
        {
            "_ws": F.sum("p").over(along.rangeBetween(-train, train)),
            "_wn": F.count("p").over(along.rangeBetween(-train, train)),
            "_gs": F.sum("p").over(along.rangeBetween(-guard, guard)),
            "_gn": F.count("p").over(along.rangeBetween(-guard, guard)),
        }
    )
    boxes = rows.withColumns(
        {
            "_WS": F.sum("_ws").over(down.rangeBetween(-train, train)),
            "_WN": F.sum("_wn").over(down.rangeBetween(-train, train)),
            "_GS": F.sum("_gs").over(down.rangeBetween(-guard, guard)),
            "_GN": F.sum("_gn").over(down.rangeBetween(-guard, guard)),
        }
    ).select(
        "*",
        (F.coalesce("_WS", F.lit(0)) - F.coalesce("_GS", F.lit(0))).alias("ring_sum"),
        (F.col("_WN") - F.col("_GN")).alias("ring_n"),
    )
    home = (F.floor(F.col("r") / tile) == F.col("_tr")) & (F.floor(F.col("c") / tile) == F.col("_tc"))
    return boxes.filter(home & F.col("p").isNotNull()).select(
        "scene", "r", "c", "p", "ring_sum", "ring_n",
        (F.col("p").cast("double") * F.col("ring_n") > F.lit(float(alpha)) * F.col("ring_sum").cast("double")).alias("hit"),
    )


def _fill_holes(rimmed: DataFrame, area: list[str]) -> DataFrame:
    """Empty pixels where a tile has holes, so that column sums meet every row.

    One partially aggregated pass finds tiles with fewer pixels than their
    extent; complete scenes go on unchanged.
    """
    extent = rimmed.groupBy(*area).agg(
        F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c").alias("_c0"), F.max("c").alias("_c1"),
        F.count(F.lit(1)).alias("_n"),
    )
    full = (F.col("_r1") - F.col("_r0") + 1) * (F.col("_c1") - F.col("_c0") + 1)
    holed = extent.filter(F.col("_n") < full)
    if holed.isEmpty():
        return rimmed
    every = (
        holed.withColumn("r", F.explode(F.sequence("_r0", "_r1")))
        .withColumn("c", F.explode(F.sequence("_c0", "_c1")))
        .select("scene", "r", "c", "_tr", "_tc")
    )
    empty = every.join(rimmed, [*area, "r", "c"], "left_anti").withColumn("p", F.lit(None).cast(rimmed.schema["p"].dataType))
    return rimmed.unionByName(empty)


def detections_to_cells(hits: DataFrame, size: int) -> DataFrame:
    """Hits per scene and cell with their peak and mean."""
    return hits.groupBy(
        "scene", F.floor(F.col("r") / size).alias("cell_i"), F.floor(F.col("c") / size).alias("cell_j")
    ).agg(F.count(F.lit(1)).alias("n_hits"), F.max("p").alias("peak"), F.avg("p").alias("mean_p"))


def detection_objects(hits: DataFrame) -> DataFrame:
    """One row per object: hits that touch along an edge or a corner, over any border of tiles.

    Hits of a row that stand side by side are one run, so a large target is few nodes; runs
    meet those of the next row through the columns they touch, an equi-join that stays in
    proportion to the hits; objects are the connected components. ``object_r`` and ``object_c``
    name the object by its first pixel; ``centre`` is weighted by the signal (by the pixels
    where the signal sums to zero).
    """
    row = W.partitionBy("scene", "r").orderBy("c")
    clean = hits.filter("scene is not null and r is not null and c is not null and p is not null")
    runs = (
        clean.withColumn("_island", F.col("c") - F.row_number().over(row))
        .groupBy("scene", "r", "_island")
        .agg(
            F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"), F.max("p").alias("peak"),
            F.sum("p").alias("p"), F.sum(F.col("p").cast("double") * F.col("c")).alias("pc"), F.sum("c").alias("cs"),
        )
        .drop("_island")
        .withColumn("run", F.struct("scene", "r", "c0"))
    )
    ensure_checkpoint_dir(hits.sparkSession)
    runs = runs.checkpoint()
    upper = runs.select("scene", (F.col("r") + 1).alias("r"), F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("c"), F.col("run").alias("a"))
    lower = runs.select("scene", "r", F.explode(F.sequence("c0", "c1")).alias("c"), F.col("run").alias("b"))
    roots = connected(upper.join(lower, ["scene", "r", "c"]).select("a", "b").distinct())
    named = runs.join(roots.withColumnRenamed("node", "run"), "run", "left").withColumn("root", F.coalesce("root", "run"))
    p, n = F.sum("p").cast("double"), F.sum("n")
    return (
        named.groupBy("root")
        .agg(
            n.alias("n_pixels"), F.max("peak").alias("peak"), F.min("r").alias("r_min"), F.max("r").alias("r_max"),
            F.min("c0").alias("c_min"), F.max("c1").alias("c_max"),
            F.when(p != 0, F.sum(F.col("p").cast("double") * F.col("r")) / p).otherwise(F.sum(F.col("n") * F.col("r")) / n).alias("centre_r"),
            F.when(p != 0, F.sum("pc") / p).otherwise(F.sum("cs") / n).alias("centre_c"),
        )
        .select("root.scene", F.col("root.r").alias("object_r"), F.col("root.c0").alias("object_c"), "*")
        .drop("root")
    )


def lead_runs(pixels: DataFrame, max_p: float, min_len: int) -> DataFrame:
    """Runs of neighbouring dark pixels along a row: candidate leads.

    A missing pixel ends a run. Rows of a scene are bounded by its width.
    """
    row = W.partitionBy("scene", "r").orderBy("c")
    dark = pixels.filter(F.col("p") <= max_p).withColumn("_island", F.col("c") - F.row_number().over(row))
    return (
        dark.groupBy("scene", "r", "_island")
        .agg(F.min("c").alias("c_start"), F.max("c").alias("c_end"), F.count(F.lit(1)).alias("length"),
             F.min("p").alias("darkest"))
        .filter(F.col("length") >= min_len)
        .drop("_island")
    )


def regrid(
    fine: DataFrame, factor: int, how: dict[str, str], i: str = "cell_i", j: str = "cell_j", by: list[str] | None = None
) -> DataFrame:
    """Coarser grid: each value column aggregated by mean, min, max or sum."""
    make = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
    return fine.groupBy(
        *(by or []), F.floor(F.col(i) / factor).alias(i), F.floor(F.col(j) / factor).alias(j)
    ).agg(*[make[op](col).alias(f"{col}_{op}") for col, op in how.items()], F.count(F.lit(1)).alias("n_fine"))
