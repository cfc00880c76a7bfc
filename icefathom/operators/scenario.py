"""What-if perturbations and their effect on routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icefathom.functions import geo
from icefathom.functions.numeric import clamp
from icefathom.operators.spread import fan_out


def perturb_cells(cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One copy of the grid per scenario: more ice (at most 1) and higher waves."""
    return fan_out(cells, scenarios).withColumns(
        {
            "sic": clamp(F.col("sic") * F.col("sic_mult"), 0.0, 1.0),
            "wave_m": F.col("wave_m") + F.col("wave_add_m"),
        }
    ).drop("sic_mult", "berg_shift_km", "wave_add_m")


def perturb_bergs(bergs: DataFrame, scenarios: DataFrame, bearing: Column) -> DataFrame:
    """One copy of the bergs per scenario, moved along ``bearing``."""
    moved = fan_out(bergs, scenarios)
    lat, lon, km = F.col("lat"), F.col("lon"), F.col("berg_shift_km")
    return moved.withColumns(
        {"lat": geo.destination_lat(lat, bearing, km), "lon": geo.destination_lon(lat, lon, bearing, km)}
    ).drop("sic_mult", "berg_shift_km", "wave_add_m")


def apply_scenarios(
    cells: DataFrame, bergs: DataFrame, scenarios: DataFrame, bearing: Column
) -> tuple[DataFrame, DataFrame]:
    """Perturbed grid and perturbed bergs, each tagged with ``scenario_id``."""
    return perturb_cells(cells, scenarios), perturb_bergs(bergs, scenarios, bearing)


def scenario_delta(
    totals: DataFrame, base_id: int, route: str = "route_id", measures: tuple[str, ...] = ("cost",),
    certified: str = "certified",
) -> DataFrame:
    """Change of each scenario against the baseline, with certification flips.

    Every route of the baseline has a row in every scenario. Where a side is missing or
    its certification is null the flip is ``unknown``, never ``same``.
    """
    base = totals.filter(F.col("scenario_id") == base_id).select(
        route, *[F.col(m).alias(f"_b_{m}") for m in measures], F.col(certified).alias("_b_cert")
    )
    flip = (
        F.when(F.col("_b_cert").isNull() | F.col(certified).isNull(), "unknown")
        .when(F.col("_b_cert") & ~F.col(certified), "lost")
        .when(~F.col("_b_cert") & F.col(certified), "gained")
        .otherwise("same")
    )
    others = totals.filter(F.col("scenario_id") != base_id)
    expected = fan_out(base, others.select("scenario_id").distinct())
    return (
        others.join(expected, ["scenario_id", route], "full")
        .select(
            "scenario_id", route, *[(F.col(m) - F.col(f"_b_{m}")).alias(f"delta_{m}") for m in measures],
            flip.alias("flip"),
        )
    )
