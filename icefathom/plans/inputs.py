"""Inputs several queries share, built from the fixture views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from icefathom.operators import geometry, risk, routes
from icefathom.operators.drift import drift_velocity
from icefathom.plans.views import view


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pings")


def bergs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "berg_fixes")


def placed_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings with the grid cell and slot the fixture rules give them."""
    return pings(spark, sf_dir).withColumns(
        {
            "cell_i": (F.col("vessel_id") % 40).cast("int"),
            "cell_j": (F.col("ping_id") % 10).cast("int"),
            "slot": (F.floor(F.col("t_s") / 216000.0) + 1).cast("int"),
        }
    )


def env_with_bergs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment grid plus the number of bergs each cell holds."""
    placed = bergs(spark, sf_dir).select(
        "berg_id", (F.col("berg_id") % 40).cast("int").alias("cell_i"), (F.col("fix_id") % 10).cast("int").alias("cell_j")
    )
    density = routes.berg_density(placed, 3).select("cell_i", "cell_j", "n_bergs")
    return view(spark, sf_dir, "env_cells").join(density, ["cell_i", "cell_j"], "left")


def cost_factors(draft_m: float = 7.0) -> dict[str, Column]:
    """One expression per cost factor over ``env_with_bergs``."""
    n = F.coalesce(F.col("n_bergs"), F.lit(0)).cast("double")
    return {
        "distance": F.lit(1.0),
        "ice": F.col("sic"),
        "berg": n / (n + 1.0),
        "current": F.sqrt(F.col("cur_u") * F.col("cur_u") + F.col("cur_v") * F.col("cur_v")),
        "wave": F.col("wave_m") / 10.0,
        "depth": F.lit(1.0) / (F.greatest(F.col("depth_m") - draft_m, F.lit(0.0)) + 1.0),
        "fuel": (F.col("sic") + 1.0) * (F.col("wave_m") / 20.0 + 1.0),
    }


# The same grid and factors as SQL, for the oracle.
ENV_SQL = """env as (
  select e.*, d.n_bergs from env_cells e left join (
    select cast(berg_id % 40 as int) as cell_i, cast(fix_id % 10 as int) as cell_j, count(distinct berg_id) as n_bergs
    from berg_fixes group by 1, 2) d on d.cell_i = e.cell_i and d.cell_j = e.cell_j)"""
COST_SQL = """costs as (
  select e.*, p.profile, p.w_distance * 1.0e0 as c_distance, p.w_ice * sic as c_ice,
         p.w_berg * (cast(coalesce(n_bergs, 0) as double) / (cast(coalesce(n_bergs, 0) as double) + 1.0e0)) as c_berg,
         p.w_current * sqrt(cur_u * cur_u + cur_v * cur_v) as c_current, p.w_wave * (wave_m / 10.0e0) as c_wave,
         p.w_depth * (1.0e0 / (greatest(depth_m - 7.0e0, 0.0e0) + 1.0e0)) as c_depth,
         p.w_fuel * ((sic + 1.0e0) * (wave_m / 20.0e0 + 1.0e0)) as c_fuel
  from env e cross join profiles p),
priced as (select *, c_distance + c_ice + c_berg + c_current + c_wave + c_depth + c_fuel as cost from costs)"""
RIO_SQL = """rio as (
  select cell_i, cell_j, ice_class, sum(case when riv is null then 1 else 0 end) as n_missing, count(*) as n_types,
         case when sum(case when riv is null then 1 else 0 end) = 0 then round(sum(conc_tenths * riv), 9) end as rio
  from (select i.*, c.ice_class, r.riv from ice_regime i cross join (select distinct ice_class from riv) c
        left join riv r on r.ice_class = c.ice_class and r.ice_type = i.ice_type) x
  group by 1, 2, 3)"""


def rio_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rio(view(spark, sf_dir, "ice_regime"), view(spark, sf_dir, "riv"))


def moving_pings(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """Projected pings with velocity."""
    cols = pings(spark, sf_dir).select("vessel_id", "ping_id", "ts", "lat", "lon")
    return drift_velocity(geometry.project_3031(cols), n, "vessel_id", "ts", "ping_id")


def moving_bergs(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """Projected berg fixes with velocity."""
    cols = bergs(spark, sf_dir).select("berg_id", "fix_id", "ts", "lat", "lon")
    return drift_velocity(geometry.project_3031(cols), n, "berg_id", "ts", "fix_id")


def cell_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each grid cell's centre lies on land, by the fixture's places of cells."""
    cells = view(spark, sf_dir, "env_cells").select("cell_i", "cell_j").distinct()
    centres = cells.withColumns({"x": (F.col("cell_i") - 20) * 125000.0, "y": (F.col("cell_j") - 5) * 500000.0})
    known = centres.withColumn("x", F.when(F.col("cell_i") % 13 != 7, F.col("x")))
    return geometry.land_mask(known, view(spark, sf_dir, "land_edges"), "cell_i", 250_000.0).select("cell_i", "cell_j", "on_land")


# The same as SQL; every thirteenth column of cells has no known place.
CELL_LAND_SQL = """cell_land as (
  select cell_i, cell_j, case when cell_i % 13 <> 7 then sum(case when (y1 > y) <> (y2 > y)
      and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1 end as on_land
  from (select distinct cell_i, cell_j, (cell_i - 20) * 125000.0e0 as x, (cell_j - 5) * 500000.0e0 as y from env_cells) c
  cross join land_edges group by cell_i, cell_j)"""
