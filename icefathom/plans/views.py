"""Views over the driver tables that stand for the polar inputs.

Each body runs unchanged in Spark SQL and in the SQL oracle; `FIXTURES.md`
explains what every view stands for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icefathom.operators.spread import fan_out

BASE_TABLES = {
    "events": ("pings", "berg_fixes", "feed_obs"),
    "lineitem": ("ice_regime", "env_cells"),
    "orders": ("sar_pixels", "ground_truth", "candidates"),
    "region": ("riv", "scenarios", "profiles"),
    "nation": ("riv", "land_edges"),
    "supplier": ("stations",),
    "part": ("grid_nodes",),
}

VIEWS = {
    "pings": """
select user_id as vessel_id, event_id as ping_id, ts, t_s,
       -60.0e0 - (user_id % 10) - h * 0.005e0 - value / 10000.0e0 as lat,
       ((user_id * 24 + h * 0.05e0) % 360) - 180 as lon,
       5.0e0 + (user_id % 7) as draft_m,
       cast(user_id % 5 as int) as ice_class,
       event_type as status
from (select *, cast(((extract(day from ts) - 1) * 24 + extract(hour from ts)) as bigint) as h,
             cast(((extract(day from ts) - 1) * 24 + extract(hour from ts)) * 3600
                  + extract(minute from ts) * 60 + floor(extract(second from ts)) as bigint) as t_s
      from events) e
where user_id % 3 <> 0
""",
    "berg_fixes": """
select user_id as berg_id, event_id as fix_id, ts, t_s,
       -60.1e0 - ((user_id + 1) % 10) - h * 0.002e0 - value / 20000.0e0 as lat,
       (((user_id + 1) * 24 + h * 0.01e0) % 360) - 180 as lon
from (select *, cast(((extract(day from ts) - 1) * 24 + extract(hour from ts)) as bigint) as h,
             cast(((extract(day from ts) - 1) * 24 + extract(hour from ts)) * 3600
                  + extract(minute from ts) * 60 + floor(extract(second from ts)) as bigint) as t_s
      from events) e
where user_id % 3 = 0
""",
    "ice_regime": """
select cell_i, cell_j, ice_type, 10.0e0 * q / sum(q) over (partition by cell_i, cell_j) as conc_tenths
from (select cast(l_partkey % 40 as int) as cell_i, cast(l_suppkey % 10 as int) as cell_j,
             cast(l_linenumber as int) as ice_type, sum(l_quantity) as q
      from lineitem group by 1, 2, 3) g
""",
    "riv": """
select distinct cast(r_regionkey as int) as ice_class, cast(n_nationkey % 7 + 1 as int) as ice_type,
       cast(3 - r_regionkey - (n_nationkey % 7) + 2 as int) as riv
from region cross join nation
""",
    "env_cells": """
select cast(l_partkey % 40 as int) as cell_i, cast(l_suppkey % 10 as int) as cell_j,
       cast(extract(month from l_shipdate) as int) as slot,
       sum(l_quantity) / (50.0e0 * count(*)) as sic,
       cast((sum(l_linenumber) * 37) % 900 - 100 as double) as depth_m,
       max(l_linenumber) * 0.5e0 as wave_m,
       max(l_quantity) / 100.0e0 as cur_u, min(l_quantity) / 100.0e0 as cur_v,
       max(l_quantity) / 2.0e0 as wind_ms, cast(count(*) as bigint) as n_obs
from lineitem group by 1, 2, 3
""",
    "sar_pixels": """
select cast(floor(o_orderkey / 2500.0e0) as bigint) as scene,
       cast(floor((o_orderkey % 2500) / 50.0e0) as bigint) as r,
       cast(o_orderkey % 50 as bigint) as c,
       cast(round(o_totalprice * 100) as bigint) as p
from orders
""",
    "ground_truth": """
select cast(floor(o_orderkey / 2500.0e0) as bigint) as scene,
       cast(floor((o_orderkey % 2500) / 50.0e0) as bigint) as r,
       cast(o_orderkey % 50 as bigint) as c,
       cast(case when o_orderpriority like '1%' then 1 else 0 end as int) as is_target
from orders
""",
    "stations": """
select s_suppkey as station_id, s_name as name,
       -62.0e0 - (s_suppkey % 20) * 0.9e0 as lat,
       cast((s_suppkey * 37) % 360 - 180 as double) as lon
from supplier
""",
    "candidates": """
select o_custkey as voyage_id, o_orderkey as route_id,
       cast(floor(o_totalprice / 100.0e0) as bigint) as dist_km,
       cast((o_orderkey * 7919) % 500 as bigint) as time_h,
       cast((o_orderkey * 104729) % 100 as bigint) as risk,
       cast((o_orderkey * 1299709) % 900 as bigint) as fuel_t
from orders
""",
    "land_edges": """
select n_nationkey as edge_id,
       round((2000000.0e0 + 200000.0e0 * (n_nationkey % 3)) * cos(2 * pi() * n_nationkey / 25.0e0), 2) as x1,
       round((2000000.0e0 + 200000.0e0 * (n_nationkey % 3)) * sin(2 * pi() * n_nationkey / 25.0e0), 2) as y1,
       round((2000000.0e0 + 200000.0e0 * (((n_nationkey + 1) % 25) % 3)) * cos(2 * pi() * ((n_nationkey + 1) % 25) / 25.0e0), 2) as x2,
       round((2000000.0e0 + 200000.0e0 * (((n_nationkey + 1) % 25) % 3)) * sin(2 * pi() * ((n_nationkey + 1) % 25) / 25.0e0), 2) as y2
from nation
""",
    "grid_nodes": """
select cast(floor(p_partkey / 50.0e0) as bigint) as i, cast(p_partkey % 50 as bigint) as j,
       cast(1 + p_size as bigint) as cost
from part
""",
    "feed_obs": """
select cast(case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3
                 when 'signup' then 4 else 5 end as int) as priority,
       case when event_type in ('click', 'view') then 'LIVE'
            when event_type in ('purchase', 'signup') then 'STATIC' else 'SIMULATION' end as regime,
       cast(user_id % 50 as bigint) as cell, event_id as obs_id, ts, value
from events
""",
    "scenarios": """
select cast(r_regionkey as int) as scenario_id, 1.0e0 + 0.05e0 * r_regionkey as sic_mult,
       12.5e0 * r_regionkey as berg_shift_km, 0.5e0 * r_regionkey as wave_add_m
from region
""",
    "profiles": """
select case r_regionkey when 0 then 'A' when 1 then 'B' else 'C' end as profile,
       1.0e0 as w_distance, 1.0e0 * r_regionkey as w_ice, 2.0e0 * r_regionkey as w_berg,
       0.5e0 * r_regionkey as w_current, 0.5e0 * r_regionkey as w_wave,
       0.25e0 * r_regionkey as w_depth, 0.1e0 * r_regionkey as w_fuel
from region where r_regionkey < 3
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view over the parquet tables in ``sf_dir``."""
    if name == "riv":
        return _riv(spark, sf_dir)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t, used_by in BASE_TABLES.items() if name in used_by}
    return over(spark, name, **tables)


def over(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """One fixture view over the given tables; the caller's session keeps its own views."""
    body = VIEWS[name]
    for table in tables:
        body = re.sub(rf"\bfrom {table}\b", f"from {{{table}}}", body)
    return spark.sql(body, **tables)


def _riv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``riv`` view without its cross join: each class with every ice type."""
    classes = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("ice_class"))
    types = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") % 7 + 1).cast("int").alias("ice_type"))
    value = (F.lit(6) - F.col("ice_class") - F.col("ice_type")).cast("int")
    return fan_out(classes.distinct(), types.distinct()).withColumn("riv", value)


def with_views(sql: str, *names: str) -> str:
    """SQL text with the named view bodies in front as common table expressions.

    ``sql`` starts with ``with``/``with recursive`` and its own expressions,
    or with a plain ``select``.
    """
    ctes = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in names)
    body = sql.strip()
    for head in ("with recursive ", "with "):
        if body.startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"with {ctes}\n{body}"
