"""Ice risk index, certification, cost surfaces and depth barriers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icefathom.operators.spread import fan_out

# Fixed names: the seven cost factors; profiles carry one weight per factor.
FACTORS = ("distance", "ice", "berg", "current", "wave", "depth", "fuel")


def rio(ice_regime: DataFrame, riv: DataFrame, cell: list[str] | None = None) -> DataFrame:
    """RIO = sum of C_i x RIV_i per cell and ice class.

    A class without an index value for an ice type present in the cell gives
    an error row (``status`` riv_missing, ``rio`` null), never a silent zero.
    """
    cell = cell or ["cell_i", "cell_j"]
    per_class = fan_out(ice_regime, riv.select("ice_class").distinct())
    scored = per_class.join(riv, ["ice_class", "ice_type"], "left")
    return (
        scored.groupBy(*cell, "ice_class")
        .agg(
            F.sum(F.col("conc_tenths") * F.col("riv")).alias("_rio"),
            F.sum(F.col("riv").isNull().cast("bigint")).alias("n_missing"),
            F.count(F.lit(1)).alias("n_types"),
        )
        .withColumns(
            {
                # Summation noise must not turn an exact 0 into a refusal.
                "rio": F.when(F.col("n_missing") == 0, F.round("_rio", 9)),
                "status": F.when(F.col("n_missing") == 0, "ok").otherwise("riv_missing"),
            }
        )
        .drop("_rio")
    )


def certify(route_legs: DataFrame, route: str, leg: str, rio_col: str = "rio") -> DataFrame:
    """Route is certified only if every leg has RIO >= 0; unknown is a refusal."""
    value = F.col(rio_col)
    return route_legs.groupBy(route).agg(
        F.bool_and(F.coalesce(value >= 0, F.lit(False))).alias("certified"),
        F.min(value).alias("worst_rio"),
        F.min_by(F.col(leg), F.when(value.isNotNull(), F.struct(value, F.col(leg)))).alias("worst_leg"),
        F.sum(value.isNull().cast("bigint")).alias("n_unknown"),
        F.count(F.lit(1)).alias("n_legs"),
    )


def cost_surface(cells: DataFrame, profiles: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """Weighted sum of the seven factors for each cell and profile.

    ``factors`` gives one expression per name in ``FACTORS``; each weighted
    contribution is kept as ``c_<factor>`` next to ``cost``.
    """
    missing = set(FACTORS) - set(factors)
    if missing:
        raise ValueError(f"factors without an expression: {sorted(missing)}")
    valued = cells.withColumns({f"_f_{name}": factors[name] for name in FACTORS})
    parts = {f"c_{name}": F.col(f"w_{name}") * F.col(f"_f_{name}") for name in FACTORS}
    spread = fan_out(valued, profiles).withColumns(parts)
    total = reduce(lambda a, b: a + b, [F.col(f"c_{name}") for name in FACTORS])
    return spread.withColumn("cost", total).drop(
        *[f"_f_{name}" for name in FACTORS], *[f"w_{name}" for name in FACTORS]
    )


def barrier_reason(depth: Column, draft: Column, on_land: Column, margin_m: float = 2.0) -> Column:
    """Why a cell is closed to a hull, null when it is open; what is unknown closes it."""
    return (
        F.when(on_land, "land")
        .when(on_land.isNull(), "land_unknown")
        .when(depth.isNull(), "depth_unknown")
        .when(~(depth > draft + margin_m), "shallow")
    )


def hard_barrier(
    cells: DataFrame, drafts: DataFrame, depth: str = "depth_m", draft: str = "draft_m",
    on_land: str | None = None, margin_m: float = 2.0,
) -> DataFrame:
    """Blocked flag and reason for each cell and draft.

    Water must be deeper than draft + margin (strict); unknown depth blocks.
    """
    land = F.col(on_land) if on_land else F.lit(False)
    reason = barrier_reason(F.col(depth), F.col(draft), land, margin_m)
    return fan_out(cells, drafts).withColumn("reason", reason).withColumn("blocked", F.col("reason").isNotNull())


def clearance_class(cells: DataFrame, deep_m: float = 500.0, depth: str = "depth_m") -> DataFrame:
    """Deep-water flag, kept apart from the hard barrier."""
    d = F.col(depth)
    label = F.when(d.isNull(), "unknown").when(d > deep_m, "deep").when(d > 0, "shelf").otherwise("dry")
    return cells.withColumn("clearance", label)


def risk_surface(
    env: DataFrame,
    ice_regime: DataFrame,
    riv: DataFrame,
    profiles: DataFrame,
    factors: dict[str, Column],
    draft_m: float,
    ice_class: int,
    on_land: str | None = None,
) -> DataFrame:
    """Cost, RIO and barrier per cell, slot and profile for one hull.

    RIO is per cell, so it is joined to the grid before the profiles multiply
    the rows. ``on_land`` names the column of ``env`` that ``land_mask`` made.
    """
    index = rio(ice_regime, riv.filter(F.col("ice_class") == ice_class)).select("cell_i", "cell_j", "rio", "status")
    joined = env.join(index, ["cell_i", "cell_j"], "left")
    land = F.col(on_land) if on_land else F.lit(False)
    reason = barrier_reason(F.col("depth_m"), F.lit(float(draft_m)), land)
    closed = joined.withColumn("reason", reason).withColumn("blocked", F.col("reason").isNotNull())
    return cost_surface(closed, profiles, factors).withColumn(
        "passable", ~F.col("blocked") & F.coalesce(F.col("rio") >= 0, F.lit(False))
    )


def store_surface(surface: DataFrame, path: str, version: int) -> None:
    """Adds a version of the surface; readers of older ones are not disturbed."""
    write_risk_surface(surface, f"{path}/version={version}", "errorifexists")


def write_risk_surface(surface: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stores the surface so readers prune by profile and slot; files follow its size."""
    surface.hint("rebalance", "profile", "slot").write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy(
        "profile", "slot"
    ).parquet(path)
