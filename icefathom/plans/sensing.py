"""Registered queries: radar, sea-ice features and models, live telemetry and its batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from icefathom.functions.numeric import fixed
from icefathom.operators import radar, risk, seaice
from icefathom.plans import inputs
from icefathom.plans import sqltext as t
from icefathom.plans.inputs import COST_SQL, ENV_SQL
from icefathom.plans.registry import registered
from icefathom.plans.views import over, view
from icefathom.plans.voyages import _surface
from icefathom.session import ensure_checkpoint_dir
from icefathom.sources import state
from icefathom.streaming import telemetry as live

CFAR_SQL = """boxes as (
  select a.scene, a.r, a.c, a.p,
    cast(sum(case when abs(b.r - a.r) > 1 or abs(b.c - a.c) > 1 then b.p else 0 end) as bigint) as ring_sum,
    cast(sum(case when abs(b.r - a.r) > 1 or abs(b.c - a.c) > 1 then 1 else 0 end) as bigint) as ring_n
  from sar_pixels a join sar_pixels b on b.scene = a.scene and b.r between a.r - 3 and a.r + 3 and b.c between a.c - 3 and a.c + 3
  group by 1, 2, 3, 4),
cfar as (select *, p * ring_n > 2 * ring_sum as hit from boxes)"""


def _hits(spark, sf_dir):
    return radar.cfar(view(spark, sf_dir, "sar_pixels"), 1, 3, 2.0)


@registered(f"with {CFAR_SQL} select scene, r, c, p, ring_sum, ring_n, hit from cfar", ("sar_pixels",))
def cfar(spark, sf_dir):
    return _hits(spark, sf_dir)


@registered(
    """with pixels as (select scene, r, c, cast(floor(p / 100.0e0) / 10000.0e0 as decimal(12, 4)) as p from sar_pixels),
    boxes as (select a.scene, a.r, a.c, a.p,
        sum(case when abs(b.r - a.r) > 1 or abs(b.c - a.c) > 1 then b.p else 0 end) as ring_sum,
        sum(case when abs(b.r - a.r) > 1 or abs(b.c - a.c) > 1 then 1 else 0 end) as ring_n
      from pixels a join pixels b on b.scene = a.scene and b.r between a.r - 3 and a.r + 3 and b.c between a.c - 3 and a.c + 3
      group by 1, 2, 3, 4)
    select scene, r, c, cast(p as double) as p, cast(ring_sum as double) as ring_sum, cast(ring_n as bigint) as ring_n,
      cast(p as double) * ring_n > 1.5e0 * cast(ring_sum as double) as hit from boxes""",
    ("sar_pixels",),
)
def cfar_decibel(spark, sf_dir):
    """Targets in fractional backscatter, kept as exact decimals."""
    value = (F.floor(F.col("p") / 100).cast("decimal(18,0)") / 10000).cast("decimal(12,4)")
    hits = radar.cfar(view(spark, sf_dir, "sar_pixels").select("scene", "r", "c", value.alias("p")), 1, 3, 1.5)
    return hits.select("scene", "r", "c", F.col("p").cast("double").alias("p"), F.col("ring_sum").cast("double").alias("ring_sum"), "ring_n", "hit")


@registered(
    f"""with {CFAR_SQL} select scene, cast(floor(r / 10.0e0) as bigint) as cell_i, cast(floor(c / 10.0e0) as bigint) as cell_j,
    count(*) as n_hits, max(p) as peak, {t.fx('avg(p)')} as mean_p from cfar where hit group by 1, 2, 3""",
    ("sar_pixels",),
)
def detections_to_cells(spark, sf_dir):
    cells = radar.detections_to_cells(_hits(spark, sf_dir).filter("hit"), 10)
    return cells.withColumn("mean_p", fixed(F.col("mean_p")))


@registered(
    f"""with recursive {CFAR_SQL}, hits as (select scene, r, c, p from cfar where hit),
    touch as (select a.scene, a.r, a.c, b.r as nr, b.c as nc from hits a join hits b
      on b.scene = a.scene and b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1),
    reach as (select scene, r, c, r as fr, c as fc from hits
      union select t.scene, t.nr, t.nc, x.fr, x.fc from reach x join touch t on t.scene = x.scene and t.r = x.r and t.c = x.c),
    named as (select h.*, (select min(struct_pack(r := x.fr, c := x.fc)) from reach x
      where x.scene = h.scene and x.r = h.r and x.c = h.c) as root from hits h)
    select scene, root.r as object_r, root.c as object_c, cast(count(*) as bigint) as n_pixels, max(p) as peak, min(r) as r_min,
      max(r) as r_max, min(c) as c_min, max(c) as c_max, {t.fx('sum(cast(p as double) * r) / sum(cast(p as double))')} as centre_r,
      {t.fx('sum(cast(p as double) * c) / sum(cast(p as double))')} as centre_c
    from named group by 1, 2, 3""",
    ("sar_pixels",),
)
def detection_objects(spark, sf_dir):
    """Radar objects: touching hits as one target with its extent, peak and centre."""
    found = radar.detection_objects(_hits(spark, sf_dir).filter("hit"))
    return found.withColumns({"centre_r": fixed(F.col("centre_r")), "centre_c": fixed(F.col("centre_c"))})


@registered(
    """with dark as (select *, c - row_number() over (partition by scene, r order by c) as island from sar_pixels where p <= 18000000)
    select scene, r, min(c) as c_start, max(c) as c_end, count(*) as length, min(p) as darkest from dark
    group by scene, r, island having count(*) >= 3""",
    ("sar_pixels",),
)
def lead_runs(spark, sf_dir):
    return radar.lead_runs(view(spark, sf_dir, "sar_pixels"), 18_000_000, 3)


@registered(
    f"""select scene, cast(floor(r / 5.0e0) as bigint) as r, cast(floor(c / 5.0e0) as bigint) as c, {t.fx('avg(p)')} as p_mean,
    count(*) as n_fine from sar_pixels group by 1, 2, 3""",
    ("sar_pixels",),
)
def regrid(spark, sf_dir):
    coarse = radar.regrid(view(spark, sf_dir, "sar_pixels"), 5, {"p": "mean"}, "r", "c", ["scene"])
    return coarse.withColumn("p_mean", fixed(F.col("p_mean")))


@registered(
    f"""with {CFAR_SQL} select scene, cast(sum(case when hit and is_target = 1 then 1 else 0 end) as bigint) as tp,
      cast(sum(case when hit and is_target = 0 then 1 else 0 end) as bigint) as fp,
      cast(sum(case when not hit and is_target = 1 then 1 else 0 end) as bigint) as fn,
      cast(sum(case when not hit and is_target = 0 then 1 else 0 end) as bigint) as tn,
      {t.fx("avg(case when hit = (is_target = 1) then 1.0e0 else 0.0e0 end)", 6)} as accuracy,
      {t.fx("sum(case when hit and is_target = 1 then 1.0e0 else 0 end) / nullif(sum(case when hit then 1 else 0 end), 0)", 6)} as "precision",
      {t.fx("sum(case when hit and is_target = 1 then 1.0e0 else 0 end) / nullif(sum(is_target), 0)", 6)} as recall
    from cfar join ground_truth using (scene, r, c) group by 1""",
    ("sar_pixels", "ground_truth"),
)
def classification_report(spark, sf_dir):
    """Detections against the observed labels, per scene."""
    both = _hits(spark, sf_dir).select("scene", "r", "c", "hit").join(view(spark, sf_dir, "ground_truth"), ["scene", "r", "c"])
    report = seaice.classification_report(both, F.col("is_target") == 1, F.col("hit"), ["scene"])
    return report.withColumns({c: fixed(F.col(c), 6) for c in ("accuracy", "precision", "recall")})


LAG_SQL = """lagged as (
  select a.cell_i, a.cell_j, a.slot, a.sic, b.sic as sic_lag1, c.sic as sic_lag2 from env_cells a
  left join env_cells b on b.cell_i = a.cell_i and b.cell_j = a.cell_j and b.slot = a.slot - 1
  left join env_cells c on c.cell_i = a.cell_i and c.cell_j = a.cell_j and c.slot = a.slot - 2)"""


@registered(
    f"""with {LAG_SQL} select cell_i, cell_j, slot, {t.fx('sic', 5)} as sic, {t.fx('sic_lag1', 5)} as sic_lag1,
    {t.fx('sic_lag2', 5)} as sic_lag2 from lagged""",
    ("env_cells",),
)
def lagged_features(spark, sf_dir):
    lagged = seaice.lagged_features(view(spark, sf_dir, "env_cells"), [1, 2])
    return lagged.select("cell_i", "cell_j", "slot", *[fixed(F.col(c), 5).alias(c) for c in ("sic", "sic_lag1", "sic_lag2")])


@registered(
    f"""with {LAG_SQL}, known as (select * from lagged where sic is not null and sic_lag1 is not null),
    means as (select slot, avg(sic) as m from known group by 1)
    select k.slot, count(*) as n, {t.fx('avg(abs(sic - sic_lag1))', 6)} as mae,
      {t.fx('1 - sum((sic - sic_lag1) * (sic - sic_lag1)) / sum((sic - m) * (sic - m))', 6)} as r2
    from known k join means using (slot) group by 1""",
    ("env_cells",),
)
def regression_report(spark, sf_dir):
    """Persistence forecast (the previous slot) against the observed ice, per slot."""
    lagged = seaice.lagged_features(view(spark, sf_dir, "env_cells"), [1])
    report = seaice.regression_report(lagged, "sic", "sic_lag1", ["slot"])
    return report.withColumns({c: fixed(F.col(c), 6) for c in ("mae", "r2")})


def _model_rows(spark, sf_dir):
    cells = view(spark, sf_dir, "env_cells").withColumn("speed", F.sqrt(F.col("cur_u") ** 2 + F.col("cur_v") ** 2))
    return seaice.lagged_features(cells, [1, 2]).na.drop(subset=["sic_lag1", "sic_lag2"])


FEATURES = ["sic_lag1", "sic_lag2", "wind_ms", "wave_m", "speed", "depth_m"]


LAGGED_SQL = """lagged as (
  select e.*, a.sic as sic_lag1, b.sic as sic_lag2 from env_cells e
  left join env_cells a on a.cell_i = e.cell_i and a.cell_j = e.cell_j and a.slot = e.slot - 1
  left join env_cells b on b.cell_i = e.cell_i and b.cell_j = e.cell_j and b.slot = e.slot - 2)"""


@registered()
def predict_forest(spark, sf_dir):
    """Random forest fitted on earlier slots, scored on later ones."""
    rows = _model_rows(spark, sf_dir)
    model = seaice.fit_sea_ice(rows.filter("slot <= 9"), FEATURES, trees=10, depth=4)
    return seaice.predict(model, rows.filter("slot > 9")).select("cell_i", "cell_j", "slot", "sic", "sic_pred")


@registered()
def predict_boosting_report(spark, sf_dir):
    """Gradient boosting fitted on earlier slots: errors by later slot, beside those of the training mean."""
    rows = _model_rows(spark, sf_dir)
    train = rows.filter("slot <= 9")
    model = seaice.fit_sea_ice(train, FEATURES, kind="boosting", trees=5, depth=3)
    scored = seaice.predict(model, rows.filter("slot > 9"))
    report = seaice.regression_report(scored, "sic", "sic_pred", ["slot"])
    mean = train.agg(F.avg("sic")).first()[0]
    plain = seaice.regression_report(scored.withColumn("mean_pred", F.lit(mean)), "sic", "mean_pred", ["slot"])
    both = report.join(plain.select("slot", F.col("mae").alias("mean_mae")), "slot")
    return both.withColumn("closer_than_mean", F.col("mae") < F.col("mean_mae"))


STUMP_SQL = """train as (select wave_m, sic from env_cells where slot <= 9),
levels as (select wave_m, lead(wave_m) over (order by wave_m) as nxt from (select distinct wave_m from train) d),
cuts as (select (wave_m + nxt) / 2.0e0 as cut from levels where nxt is not null),
sides as (select cut, wave_m <= cut as low, avg(sic) as mean, sum(sic * sic) - sum(sic) * sum(sic) / count(*) as sse
  from cuts cross join train group by 1, 2),
best as (select cut from sides group by cut order by sum(sse), cut limit 1)"""


@registered(
    f"""with {STUMP_SQL} select e.wave_m, count(*) as n, {t.fx('min(s.mean)', 6)} as sic_pred
    from env_cells e join sides s on s.low = (e.wave_m <= s.cut) join best b on b.cut = s.cut
    where e.slot > 9 group by 1""",
    ("env_cells",),
)
def fit_stump(spark, sf_dir):
    """One tree of depth one on wave height: the split and both means follow from the data alone."""
    rows = view(spark, sf_dir, "env_cells")
    model = seaice.fit_sea_ice(rows.filter("slot <= 9"), ["wave_m"], trees=1, depth=1)
    scored = seaice.predict(model, rows.filter("slot > 9"))
    return scored.groupBy("wave_m").agg(F.count(F.lit(1)).alias("n"), fixed(F.min("sic_pred"), 6).alias("sic_pred"))


@registered(
    f"""with {STUMP_SQL} select e.cell_i, e.cell_j, e.slot, case when e.cell_i % 6 <> 5 then {t.fx('s.mean', 6)} end as sic_pred
    from env_cells e join sides s on s.low = (e.wave_m <= s.cut) join best b on b.cut = s.cut""",
    ("env_cells",),
)
def predict_all_rows(spark, sf_dir):
    """Every row comes back; where the feature is unknown (every sixth column of cells) the prediction is null."""
    rows = view(spark, sf_dir, "env_cells")
    model = seaice.fit_sea_ice(rows.filter("slot <= 9"), ["wave_m"], trees=1, depth=1)
    holed = rows.withColumn("wave_m", F.when(F.col("cell_i") % 6 != 5, F.col("wave_m")))
    return seaice.predict(model, holed).select("cell_i", "cell_j", "slot", fixed(F.col("sic_pred"), 6).alias("sic_pred"))


# Live telemetry. The stream_* queries run the same functions as a real stream
# over the events file (available-now trigger, file sink, checkpointed) and
# read the sink back; append mode emits what the final watermark has closed.

DAY_H = 3_600_000_000


def _event_schema(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").schema


def _live_pings(spark, sf_dir, streaming: bool):
    """Pings off the event stream, by the fixture rule."""
    if streaming:
        events = live.read_stream(spark, sf_dir, _event_schema(spark, sf_dir), "events.parquet")
    else:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return live.event_time(over(spark, "pings", events=events))


def _run(spark, stream):
    """Runs a stream to the end into Parquet and returns what it wrote."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


CLEAN_SQL = "select vessel_id, ping_id, t_s, status from pings where lat between -90 and 90 and lon between -180 and 180"


@registered(CLEAN_SQL, ("pings",))
def clean_pings(spark, sf_dir):
    clean = live.clean_pings(_live_pings(spark, sf_dir, False), ["ping_id"], "1 hour")
    return clean.select("vessel_id", "ping_id", "t_s", "status")


@registered(CLEAN_SQL, ("pings",))
def stream_clean_pings(spark, sf_dir):
    clean = live.clean_pings(_live_pings(spark, sf_dir, True), ["ping_id"], "1 hour")
    return _run(spark, clean.select("vessel_id", "ping_id", "t_s", "status"))


LATEST_SQL = """select vessel_id, ping_id, t_s, status from (select *, row_number() over (
    partition by vessel_id order by ts desc, ping_id desc) as rn from pings) p where rn = 1"""


@registered(LATEST_SQL, ("pings",))
def latest_state(spark, sf_dir):
    p = _live_pings(spark, sf_dir, False).select("vessel_id", "ts", "ping_id", "t_s", "status")
    return live.latest_state(p).select("vessel_id", "ping_id", "t_s", "status")


@registered(LATEST_SQL, ("pings",))
def stream_latest_state(spark, sf_dir):
    """The same rows from a table that a stream keeps."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = _live_pings(spark, sf_dir, True).select("vessel_id", "ts", "ping_id", "t_s", "status")
    each = state.upsert_batches(f"{folder}/state", ["vessel_id"], ["ts", "ping_id"])
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.read_state(spark, f"{folder}/state").drop("ts")


def _windows_sql(size_h: int, slide_h: int, closed_before_h: int | None = None) -> str:
    size, slide = size_h * DAY_H, slide_h * DAY_H
    closed = (
        f" where w_start_us + {size} <= (select max(epoch_us(ts)) from pings) - {closed_before_h * DAY_H}"
        if closed_before_h is not None
        else ""
    )
    return f"""with spans as (select status, (epoch_us(ts) // {slide} - k) * {slide} as w_start_us from pings
      cross join (select unnest(range(0, {size_h // slide_h})) as k) s)
    select cast(w_start_us // 1000000 as bigint) as start_s, status, count(*) as n from spans{closed} group by 1, 2"""


def _start_s(df):
    return df.select(F.unix_seconds("w_start").alias("start_s"), "status", "n")


@registered(_windows_sql(6, 6), ("pings",))
def alert_counts(spark, sf_dir):
    return _start_s(live.alert_counts(_live_pings(spark, sf_dir, False).select("ts", "status"), "6 hours"))


@registered(_windows_sql(12, 6), ("pings",))
def alert_counts_sliding(spark, sf_dir):
    return _start_s(live.alert_counts(_live_pings(spark, sf_dir, False).select("ts", "status"), "12 hours", "6 hours"))


@registered(_windows_sql(6, 6, 1), ("pings",))
def stream_alert_counts(spark, sf_dir):
    """Windows the final watermark (newest ping less one hour) has closed."""
    stream = live.alert_counts(_live_pings(spark, sf_dir, True).select("ts", "status"), "6 hours", None, "1 hour")
    return _start_s(_run(spark, stream))


SESSION_SQL = """stepped as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w >= 21600000000, true) as opens
    from pings window w as (partition by vessel_id order by ts, ping_id)),
  counted as (select *, sum(case when opens then 1 else 0 end) over (partition by vessel_id order by ts, ping_id
    rows unbounded preceding) as sid from stepped),
  sessions as (select vessel_id, cast(floor(epoch_us(min(ts)) / 1e6) as bigint) as start_s,
    cast(floor(epoch_us(max(ts)) / 1e6) as bigint) as last_s, count(*) as n_pings, max(epoch_us(ts)) as last_us
    from counted group by vessel_id, sid)"""


def _session_s(df):
    return df.select(
        "vessel_id", F.unix_seconds("s_start").alias("start_s"), F.unix_seconds("last_ts").alias("last_s"), "n_pings"
    )


@registered(f"with {SESSION_SQL} select vessel_id, start_s, last_s, n_pings from sessions", ("pings",))
def contact_sessions(spark, sf_dir):
    return _session_s(live.contact_sessions(_live_pings(spark, sf_dir, False).select("vessel_id", "ts"), "6 hours"))


@registered(
    f"""with {SESSION_SQL} select vessel_id, start_s, last_s, n_pings from sessions
    where last_us + 21600000000 <= (select max(epoch_us(ts)) from pings) - 3600000000""",
    ("pings",),
)
def stream_contact_sessions(spark, sf_dir):
    """Sessions the final watermark has closed."""
    pings = _live_pings(spark, sf_dir, True).select("vessel_id", "ts")
    return _session_s(_run(spark, live.contact_sessions(pings, "6 hours", "1 hour")))


def _cells(df):
    return df.select(
        "vessel_id", "ping_id",
        (F.col("vessel_id") % 40).cast("int").alias("cell_i"),
        (F.col("ping_id") % 10).cast("int").alias("cell_j"),
        (F.floor(F.col("t_s") / 216000.0) + 1).cast("int").alias("slot"),
    )


ENRICH_SQL = f"""with {ENV_SQL}, {COST_SQL}, placed as (select vessel_id, ping_id, {t.PING_CELL} from pings)
    select vessel_id, ping_id, {t.fx('cost', 5)} as cost from placed join priced using (cell_i, cell_j, slot)
    where profile = 'C' and cost > 5.0e0"""


def _enriched(spark, sf_dir, streaming):
    surface = _surface(spark, sf_dir).filter("profile = 'C'").select("cell_i", "cell_j", "slot", "cost")
    alerts = live.enrich_stream(_cells(_live_pings(spark, sf_dir, streaming)), surface, ["cell_i", "cell_j", "slot"], 5.0)
    return alerts.select("vessel_id", "ping_id", fixed(F.col("cost"), 5).alias("cost"))


@registered(ENRICH_SQL, ("pings", "env_cells", "berg_fixes", "profiles"))
def enrich_alerts(spark, sf_dir):
    return _enriched(spark, sf_dir, False)


@registered(ENRICH_SQL, ("pings", "env_cells", "berg_fixes", "profiles"))
def stream_enrich_alerts(spark, sf_dir):
    """The same alerts from a stream that reads the stored surface anew for every micro-batch."""
    folder = f"{ensure_checkpoint_dir(spark)}/enrich-{uuid.uuid4().hex}"
    surface = _surface(spark, sf_dir).select("profile", "slot", "cell_i", "cell_j", "cost")
    risk.store_surface(surface.withColumn("cost", F.lit(0.0)), f"{folder}/surface", 1)
    risk.store_surface(surface, f"{folder}/surface", 2)

    def keep(alerts, number):
        alerts.select("vessel_id", "ping_id", fixed(F.col("cost"), 5).alias("cost")).write.mode("overwrite").parquet(
            f"{folder}/out/batch={number}"
        )

    each = live.enrich_batches(f"{folder}/surface", ["cell_i", "cell_j", "slot"], 5.0, keep, profile="C")
    stream = _cells(_live_pings(spark, sf_dir, True))
    progress = f"{folder}/progress"
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


MATCH_SQL = """select p.ping_id, o.obs_id from pings p join feed_obs o on o.cell = p.vessel_id % 50 and o.regime = 'SIMULATION'
    and abs(epoch_us(o.ts) - epoch_us(p.ts)) <= 3600000000"""


def _matched(spark, sf_dir, streaming):
    pings = _live_pings(spark, sf_dir, streaming).select("ping_id", (F.col("vessel_id") % 50).alias("cell"), "ts")
    if streaming:
        events = live.read_stream(spark, sf_dir, _event_schema(spark, sf_dir), "events.parquet")
    else:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
    calving = events.filter("event_type not in ('click', 'view', 'purchase', 'signup')").select(
        F.col("event_id").alias("obs_id"), (F.col("user_id") % 50).alias("cell"), F.col("ts").alias("event_ts")
    )
    busy = None
    if streaming:  # cells with over a hundredth of the pings so far are dealt over several tasks
        past = _live_pings(spark, sf_dir, False).select((F.col("vessel_id") % 50).alias("cell"))
        busy = live.hot_cells(past, ["cell"], max(1, past.count() // 100))
    met = live.event_match(pings, calving, ["cell"], 3600, "1 hour", ping_id="ping_id", event_id="obs_id", hot=busy)
    return met.select("ping_id", "obs_id")


@registered(MATCH_SQL, ("pings", "feed_obs"))
def event_match(spark, sf_dir):
    """Pings within an hour of a sudden event in the same cell."""
    return _matched(spark, sf_dir, False)


@registered(MATCH_SQL, ("pings", "feed_obs"))
def stream_event_match(spark, sf_dir):
    return _run(spark, _matched(spark, sf_dir, True))
