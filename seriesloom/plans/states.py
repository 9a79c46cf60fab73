"""Queries for the particle filter, the tracker, streams and the causality audit."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import audit, folds, windows
from seriesloom.operators import joins as J
from seriesloom.operators import metrics as M
from seriesloom.operators import particle as PF
from seriesloom.operators import tracking as TR
from seriesloom.operators.assignment import assign_by_position, assign_then_gate
from seriesloom.operators.ordering import SeriesOrder
from seriesloom.plans.registry import EVENT_ORDER, query, rnd, sql_rnd
from seriesloom.plans.scores import rounded
from seriesloom.plans.sequences import SEQ, stream
from seriesloom.session import checkpoint_dir, materialize
from seriesloom.streaming import stateful as ST

SETTINGS = PF.FilterSettings(level_sd=8.78, outlier_probability=0.065, outlier_sd=59.04)


def nation_points(t) -> tuple[DataFrame, DataFrame]:
    a = t.customer.select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("x"))
    return a, t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", F.col("s_acctbal").alias("x"))


@query("j11_position_assignment")
def j11(t):
    return rounded(assign_by_position(*nation_points(t), ["c_nationkey"], "x", "c_custkey", "s_suppkey", 80.0), 4)


#: Points of a nation numbered along the line; every nation has fewer suppliers (a) than customers (b).
_LINE = """a AS (SELECT s_nationkey AS g, s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS i FROM supplier),
    b AS (SELECT c_nationkey AS g, c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS j FROM customer),
    n AS (SELECT g, count(*) AS n FROM a GROUP BY 1), m AS (SELECT g, count(*) AS m FROM b GROUP BY 1)"""


@query(
    "j11_gate_first_totals",
    f"""WITH RECURSIVE {_LINE}, p AS (SELECT g, 80.0::DOUBLE * (least(n, m) + 1) + 1 AS prize FROM n JOIN m USING (g)),
    z AS (SELECT g, 0::BIGINT AS i, unnest(range(0, m + 1)) AS j, 0.0::DOUBLE AS best FROM m JOIN p USING (g)
      UNION ALL
      SELECT g, i, j, max(v) OVER (PARTITION BY g ORDER BY j) FROM (
        SELECT q.g, q.i + 1 AS i, q.j, greatest(q.best, CASE WHEN abs(a.x - b.x) <= 80 THEN r.best + prize - abs(a.x - b.x) ELSE 0 END) AS v
        FROM z q JOIN a ON a.g = q.g AND a.i = q.i + 1 JOIN p ON p.g = q.g LEFT JOIN z r ON r.g = q.g AND r.j = q.j - 1 LEFT JOIN b ON b.g = q.g AND b.j = q.j)),
    e AS (SELECT z.g, max(best) AS best, any_value(prize) AS prize FROM z JOIN n ON n.g = z.g AND n.n = z.i JOIN p ON p.g = z.g GROUP BY 1)
    SELECT g AS c_nationkey, CAST(ceil(best / prize) AS BIGINT) AS pairs, {sql_rnd('ceil(best / prize) * prize - best', 4)} AS total FROM e WHERE best > 0""",
)
def j11_totals(t):
    """Pairs of each nation and their total distance, which all best assignments share."""
    d = assign_by_position(*nation_points(t), ["c_nationkey"], "x", "c_custkey", "s_suppkey", 80.0)
    return d.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pairs"), rnd(F.sum("distance"), 4).alias("total"))


@query(
    "j11_assign_then_gate",
    f"""WITH RECURSIVE {_LINE},
    z AS (SELECT g, 0::BIGINT AS i, unnest(range(0, m + 1)) AS j, 0.0::DOUBLE AS cost FROM m
      UNION ALL
      SELECT g, i, j, min(v) OVER (PARTITION BY g ORDER BY j) FROM (
        SELECT z.g, z.i + 1 AS i, z.j + 1 AS j, z.cost + abs(a.x - b.x) AS v FROM z JOIN a ON a.g = z.g AND a.i = z.i + 1 JOIN b ON b.g = z.g AND b.j = z.j + 1)),
    t AS MATERIALIZED (SELECT * FROM z),
    w AS (SELECT g, n AS i, m + 1 AS j FROM n JOIN m USING (g)
      UNION ALL
      SELECT g, i, j FROM (
        SELECT w.g, w.i - 1 AS i, q.j, row_number() OVER (PARTITION BY w.g ORDER BY q.j) AS first FROM (SELECT g, i + CASE WHEN j > (SELECT m FROM m WHERE m.g = w.g) THEN 1 ELSE 0 END AS i, j FROM w) w
        JOIN t e ON e.g = w.g AND e.i = w.i - 1 AND e.j = w.j - 1 JOIN t q ON q.g = w.g AND q.i = w.i - 1 AND q.j < w.j AND q.cost = e.cost AND w.i > 1) WHERE first = 1),
    k AS (SELECT w.g, w.i, w.j FROM w JOIN m USING (g) WHERE w.j <= m.m)
    SELECT k.g AS c_nationkey, b.id AS c_custkey, a.id AS s_suppkey, {sql_rnd('abs(a.x - b.x)', 4)} AS distance
    FROM k JOIN a ON a.g = k.g AND a.i = k.i JOIN b ON b.g = k.g AND b.j = k.j WHERE abs(a.x - b.x) <= 80""",
)
def j11_after(t):
    """Least total distance over all pairs first; pairs beyond 80 go afterwards."""
    return rounded(assign_then_gate(*nation_points(t), ["c_nationkey"], "x", "c_custkey", "s_suppkey", 80.0), 4)


@query(
    "w14_isotonic_fit",
    f"""WITH {SEQ}, p AS (SELECT user_id, event_id, rn, sum(value) OVER (PARTITION BY user_id ORDER BY rn) AS c FROM s),
    m AS (SELECT a.user_id, a.rn AS i, b.rn AS j, (b.c - coalesce(z.c, 0)) / (b.rn - a.rn + 1) AS mean FROM p a JOIN p b ON a.user_id = b.user_id AND a.rn <= b.rn
      LEFT JOIN p z ON z.user_id = a.user_id AND z.rn = a.rn - 1),
    lo AS (SELECT user_id, i, j, min(mean) OVER (PARTITION BY user_id, i ORDER BY j DESC) AS v FROM m),
    hi AS (SELECT user_id, j AS rn, max(v) AS isotonic FROM (SELECT user_id, i, j, v FROM lo) GROUP BY 1, 2)
    SELECT user_id, event_id, {sql_rnd('isotonic')} AS isotonic, false AS causal FROM hi JOIN p USING (user_id, rn)""",
)
def w14(t):
    d = audit.isotonic_fit(stream(t), EVENT_ORDER, "value")
    return d.select("user_id", "event_id", rnd("isotonic").alias("isotonic"), "causal")


def filtered(t, **options):
    return PF.particle_filter(stream(t), "user_id", "ts", "value", ["event_id"], SETTINGS, **options)


@query("t01_particle_filter")
def t01(t):
    return filtered(t)


@query("t02_forecast_quantile_calibration")
def t02(t):
    intervals = {50: ("predictive_q25_cm", "predictive_q75_cm"), 95: ("predictive_q025_cm", "predictive_q975_cm")}
    # Written out: the calibration reads its rows several times, and the filter must run once.
    ends = list(dict.fromkeys(c for pair in intervals.values() for c in pair))
    return M.interval_calibration(materialize(filtered(t, outputs=ends).select("value", *ends)), "value", intervals)


@query("t03_resampling_share")
def t03(t):
    thin = F.col("effective_sample_size") < SETTINGS.resample_below * SETTINGS.particles
    return filtered(t, outputs=["effective_sample_size"]).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(thin, 1).otherwise(0)).alias("resampled"),
        F.min("effective_sample_size").alias("smallest_ess"),
    )


@query("t05_growth_field_filter")
def t05(t):
    options = {
        "plain": SETTINGS,
        "reverting": replace(SETTINGS, reversion=0.8),
        "field": replace(SETTINGS, field=((0.0, 3.0), (40.0, 0.0), (100.0, -4.0)), field_retention=0.3),
    }
    rows = PF.with_settings(stream(t), list(options))
    d = PF.particle_filter(rows, "user_id", "ts", "value", ["event_id"], options, "setting", outputs=["predictive_mean_cm"])
    return M.error_metrics(d, "value", ["predictive_mean_cm"], ["setting"])


@query("t14_settings_fan_out")
def t14(t):
    options = PF.variants(SETTINGS)
    rows = PF.with_settings(stream(t), list(options))
    wanted = ["online_sequence_number", "predictive_mean_cm", "predictive_log_score", "predictive_pit"]
    d = PF.particle_filter(rows, "user_id", "ts", "value", ["event_id"], options, "setting", outputs=wanted)
    later = d.filter("online_sequence_number > 1")
    error = F.col("predictive_mean_cm") - F.col("value")
    return later.groupBy("setting").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg("predictive_log_score").alias("mean_log_score"),
        F.avg("predictive_pit").alias("mean_pit"),
    )


# --- tracker --------------------------------------------------------------------------------------

TRACK = TR.TrackSettings(expected=3)


def camera_of(user):
    return F.concat(F.lit("C-"), F.format_string("%06d", F.floor(user / 12).cast("bigint")))


_CAMERA_SQL = "'C-' || lpad(CAST(user_id // 12 AS VARCHAR), 6, '0')"


def pole_fits(t) -> DataFrame:
    """Passing fits at the times of error events: nearly linear scales of about a third of a centimetre a pixel."""
    n = F.col("event_id")
    return t.events.filter("event_type = 'error' AND event_id % 5 <> 0").select(
        camera_of(F.col("user_id")).alias("camera_id"),
        F.col("ts").cast("timestamp_ntz").alias("capture_datetime"),
        F.concat(F.lit("pole"), F.lpad(n.cast("string"), 9, "0")).alias("filename"),
        (n % 9 + 4).cast("double").alias("n_landmarks"),
        F.floor("value").cast("double").alias("span_px"),
        (F.lit(0.3) + n % 20 / 10).alias("rmse"),
        (F.lit(-38.8) - n % 7 / 10).alias("fit_a"),
        F.lit(-38.8).alias("fit_b"),
        (n % 3 / 1000).alias("fit_c"),
        F.lit(300.0).alias("fit_y_center"),
        F.lit(100.0).alias("fit_y_scale"),
        (F.lit(0.3) + n % 20 / 10).alias("fit_rmse"),
        F.lit(60.0).alias("fit_gap"),
        (n % 5 / 100).alias("fit_regularity"),
        F.lit(100.0).alias("fit_low"),
        F.lit(420.0).alias("fit_high"),
    )


def frames_and_candidates(t) -> tuple[DataFrame, DataFrame]:
    """Six-hour frames per camera of twelve users; every event of the camera in that time is a detection."""
    camera = camera_of(F.col("user_id"))
    slot = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000) * 21600)
    e = t.events.select("event_id", "user_id", "event_type", "value", camera.alias("camera_id"), slot.cast("timestamp_ntz").alias("capture_datetime"))
    e = e.withColumn("filename", F.concat_ws("_", "camera_id", F.date_format("capture_datetime", "yyyy-MM-dd-HH")))
    frames = e.select("camera_id", "capture_datetime", "filename").distinct()
    lane = F.col("user_id") % 4
    candidates = e.filter("event_type <> 'error'").select(
        "filename",
        F.col("event_id").alias("candidate_index"),
        (F.lit(0.3) + F.col("event_id") % 60 / 100).alias("confidence"),
        (F.lit(0.1) + lane * 0.25 + F.col("event_id") % 9 / 200).alias("x_root_fraction"),
        (F.lit(400.0) - F.col("value") * 3).alias("y_top"),
        (F.lit(400.0) + F.col("event_id") % 5).alias("y_root"),
        (F.col("value") * 3).alias("height_px"),
    )
    return frames, candidates


@query("t06_prior_guided_tracker")
def t06(t):
    return TR.track(*frames_and_candidates(t), TRACK)


CALIBRATED = replace(TRACK, scale=None)


def calibrated(t) -> DataFrame:
    """Batch form: every frame has its best earlier fit beside it."""
    frames, candidates = frames_and_candidates(t)
    columns = [c for c in TR.FIT if c != "fit_rmse"]
    with_fit = J.best_earlier_fit(frames, pole_fits(t), "camera_id", "capture_datetime", ["filename"], columns)
    return TR.track(with_fit, candidates, CALIBRATED)


@query("t06_calibrated_tracker")
def t06_calibrated(t):
    return calibrated(t)


@query("t06_selected_candidates")
def t06_selected(t):
    frames, candidates = frames_and_candidates(t)
    return TR.selected_candidates(candidates, TR.track(frames, candidates, TRACK, ["filename", "candidate_index", "plant_uid"]))


_CROWDED = 8


@query(
    "t07_start_warnings",
    f"""WITH f AS (SELECT {_CAMERA_SQL} AS camera_id, epoch_us(ts) // 21600000000 AS slot, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY 1, 2),
    m AS (SELECT camera_id, max(n) AS most FROM f GROUP BY 1)
    SELECT camera_id, camera_id || ': no image contained {_CROWDED * 2} distinct plant detections, so tracking could not start.' AS warning FROM m WHERE most < {_CROWDED * 2}""",
)
def t07_warnings(t):
    """Without a separation a frame with enough detections starts its camera."""
    frames, candidates = frames_and_candidates(t)
    few = PF.FilterSettings(particles=50, quantiles=False)
    settings = replace(TRACK, expected=_CROWDED * 2, separation=0.0, filter=few)
    return TR.start_warnings(frames, TR.track(frames, candidates, settings, ["camera_id"]), settings)


@query("t07_prediction_only_rows")
def t07(t):
    rows = TR.track(*frames_and_candidates(t), TRACK, ["camera_id", "status", "plant_uid", "filename"])
    return rows.groupBy("camera_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("plant_uid").alias("tracks"), F.countDistinct("filename").alias("frames")
    )


@query("j12_scored_assignment_is_one_to_one")
def j12(t):
    rows = TR.track(*frames_and_candidates(t), TRACK, ["filename", "candidate_index", "plant_uid"]).filter("candidate_index IS NOT NULL")
    return rows.groupBy("filename").agg(
        F.count(F.lit(1)).alias("assigned"),
        (F.countDistinct("candidate_index") == F.count(F.lit(1))).alias("candidates_distinct"),
        (F.countDistinct("plant_uid") == F.count(F.lit(1))).alias("tracks_distinct"),
    )


@query(
    "t08_candidate_log_score",
    f"""WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, sqrt(greatest(36 + (12 / sqrt(greatest(l_discount * 10, 0.05))) ** 2, 1e-9)) AS total, l_quantity FROM lineitem),
    y AS (SELECT *, abs(l_quantity - 25) / total AS z FROM z)
    SELECT l_orderkey, l_linenumber, l_partkey, {sql_rnd('-0.5 * z * z - ln(total) + CASE WHEN z > 1.2 THEN ln(0.05) ELSE 0 END')} AS log_score FROM y""",
)
def t08(t):
    rows = t.lineitem.withColumns(
        {
            "mean": F.lit(25.0),
            "latent": F.lit(6.0),
            "sd": F.lit(12.0) / F.sqrt(F.greatest(F.col("l_discount") * 10, F.lit(0.05))),
        }
    )
    score = TR.candidate_log_score("l_quantity", "mean", "latent", "sd", gate_z=1.2)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", rnd(score).alias("log_score"))


def lane_truth(t) -> DataFrame:
    """Measured heights: the median of a camera's error events of a day; these are never detections."""
    day = F.to_date("ts").alias("day")
    return t.events.filter("event_type = 'error'").groupBy(camera_of(F.col("user_id")).alias("camera_id"), day).agg(F.median("value").alias("truth"))


@query("t09_selection_with_and_without_prior")
def t09(t):
    """Errors of both selections against measured heights, with a local linear filter in the selection."""
    settings = replace(TRACK, linear=True)
    both = TR.compare_selection(*frames_and_candidates(t), settings, lane_truth(t), ["camera_id", "day"])
    matched = both.filter("guided_candidate IS NOT NULL AND plain_candidate IS NOT NULL")
    agree = M.selection_agreement(matched, "guided_candidate", "plain_candidate", ["camera_id"])
    errors = M.error_metrics(matched, "truth", ["guided_height", "plain_height"], ["camera_id"])
    return errors.join(agree.withColumnRenamed("n", "pairs"), "camera_id")


# --- causality ------------------------------------------------------------------------------------

_CUTS_SQL = """c AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
    k AS (SELECT make_timestamp(a + (b - a) * unnest([1, 2, 3]) // 3) AS cutoff FROM c)
    SELECT cutoff, (SELECT count(*) FROM events WHERE ts <= cutoff) AS rows_compared, 0::BIGINT AS mismatches FROM k"""


def cutoffs(t) -> list[str]:
    """A third, two thirds and the whole of the time covered, the last time stamp included."""
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    whole = (last - first) // timedelta(microseconds=1)
    return [str(first + timedelta(microseconds=whole * k // 3)) for k in (1, 2, 3)]


def _window_estimator(rows, keys):
    order = SeriesOrder.by_time(tuple(keys), "ts", ("event_id",))
    d = windows.naive_forecasts(rows, order, "value")
    return folds.scan(d, order, folds.ewma("value"), ["value"])


@query("t12_prefix_audit", f"WITH {_CUTS_SQL}")
def t12(t):
    return audit.prefix_audit(
        stream(t), _window_estimator, ["user_id"], ["event_id"], "ts", cutoffs(t),
        ["last_observation", "two_point_line", "ewma"],
    )


@query("t12_prefix_audit_particles", f"WITH {_CUTS_SQL}")
def t12_particles(t):
    cuts = cutoffs(t)
    outputs = ["posterior_mean_cm", "predictive_mean_cm", "effective_sample_size"]
    name = F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss.SSSSSS")

    def estimator(rows, keys):
        if "cutoff" not in keys:
            return PF.particle_filter(rows, "user_id", "ts", "value", ["event_id"], SETTINGS, outputs=outputs)
        options = {str(datetime.fromisoformat(c).strftime("%Y-%m-%d %H:%M:%S.%f")): SETTINGS for c in cuts}
        return PF.particle_filter(rows.withColumn("setting", name), "user_id", "ts", "value", ["event_id"], options, "setting", outputs=outputs)

    return audit.prefix_audit(stream(t), estimator, ["user_id"], ["event_id"], "ts", cuts, outputs)


# --- streams --------------------------------------------------------------------------------------

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(t) -> DataFrame:
    return ST.stream_table(t.spark, t.folder, EVENTS, "ts", "events.parquet")


def finish(t, d: DataFrame) -> DataFrame:
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return ST.run_to_end(d, f"{base}/out", f"{base}/checkpoint")


@query(
    "s08_stream_table",
    "SELECT event_id, ts, user_id, value FROM events WHERE value >= 5",
)
def s08(t):
    rows = event_stream(t).filter("value >= 5").select("event_id", "ts", "user_id", "value")
    return finish(t, rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t04_streaming_filter")
def t04(t):
    rows = event_stream(t).select("user_id", "event_id", "ts", "value")
    return finish(t, ST.stateful_filter(rows, "user_id", "ts", "value", ["event_id"], SETTINGS))


_ARRIVALS = 4


@query(
    "t11_late_rows",
    f"""WITH c AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
    e AS (SELECT user_id, ts, least({_ARRIVALS - 1}, (epoch_us(ts) - a) * {_ARRIVALS} // (b - a + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS arrives FROM events, c),
    m AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arrives RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
    SELECT user_id, CASE WHEN ts < seen THEN 'late' ELSE 'applied' END AS arrival, count(*) AS n FROM m GROUP BY 1, 2""",
)
def t11(t):
    """The events in four arrivals, each tenth one arriving later than its time; one stream run for each."""
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = t.events.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - F.lit(first)) * _ARRIVALS / F.lit(last - first + 1)) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    events = t.events.withColumn("arrives", F.least(F.lit(_ARRIVALS - 1), part))
    for k in range(_ARRIVALS):
        events.filter(F.col("arrives") == k).select(*EVENTS.names).write.mode("append").parquet(f"{base}/in")
        rows = ST.stream_table(t.spark, f"{base}/in", EVENTS, "ts").select("user_id", "event_id", "ts", "value")
        rows = ST.stateful_filter(rows, "user_id", "ts", "value", ["event_id"], SETTINGS, outputs=[])
        done = ST.run_to_end(rows, f"{base}/out", f"{base}/checkpoint")
    return done.groupBy("user_id", "arrival").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t10_streaming_best_fit",
    """WITH f AS (SELECT user_id, ts, CAST(event_id % 9 AS BIGINT) + 4 AS n_landmarks, floor(value) AS span_px, value / 20 AS rmse,
      'img' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS filename FROM events WHERE event_type = 'view'),
    r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
    c AS (SELECT r.event_id, r.user_id, f.filename, f.rmse, row_number() OVER (PARTITION BY r.event_id
      ORDER BY CASE WHEN rmse <= 1.27 THEN 0 ELSE 1 END, f.n_landmarks DESC, span_px DESC, rmse, f.ts, filename) AS i
      FROM r LEFT JOIN f ON f.user_id = r.user_id AND f.ts <= r.ts)
    SELECT event_id, user_id, filename AS fit_filename, rmse AS fit_rmse FROM c WHERE i = 1""",
)
def t10(t):
    e = event_stream(t).filter("event_type IN ('view', 'purchase')")
    fit = F.col("event_type") == "view"
    rows = e.select(
        "user_id",
        "ts",
        F.when(~fit, F.col("event_id")).alias("event_id"),
        F.when(fit, F.col("event_id") % 9 + 4).alias("n_landmarks"),
        F.when(fit, F.floor("value").cast("double")).alias("span_px"),
        F.when(fit, F.col("value") / 20).alias("rmse"),
        F.when(fit, F.concat(F.lit("img"), F.lpad(F.col("event_id").cast("string"), 8, "0"))).alias("filename"),
    )
    return finish(t, ST.stateful_best_fit(rows, "user_id", "ts", "event_id"))


@query(
    "t13_stream_static_enrichment",
    """SELECT event_id, user_id, c_mktsegment, value FROM events LEFT JOIN customer ON c_custkey = user_id""",
)
def t13(t):
    side = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = event_stream(t).select("event_id", "user_id", "value")
    return finish(t, ST.enrich_stream(rows, side, "user_id"))


def frame_stream(t, fits: DataFrame | None = None) -> DataFrame:
    """Frames with their candidates, and fits, written as files and read as a stream."""
    frames, candidates = frames_and_candidates(t)
    packed = frames.join(
        candidates.groupBy("filename").agg(F.collect_list(F.struct(*TR.CANDIDATE)).alias("candidates")), "filename", "left"
    ).withColumn("candidates", F.coalesce("candidates", F.array()))
    packed = packed if fits is None else ST.with_fits(packed, fits)
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/frames-{uuid.uuid4().hex}"
    packed.write.parquet(folder)
    return ST.stream_table(t.spark, folder, packed.schema, "capture_datetime")


@query("t06_streaming_tracker")
def t06_stream(t):
    return finish(t, ST.stateful_track(frame_stream(t), TRACK))


@query("t06_calibrated_stream")
def t06_calibrated_stream(t):
    """Heights from a stream: fits and frames arrive together, state is freed after 90 idle days."""
    rows = frame_stream(t, pole_fits(t))
    return finish(t, ST.stateful_track(rows, CALIBRATED, ST.Hygiene("30 days", "90 days")))


@query(
    "t10_calibrated_stream_equals_batch",
    f"SELECT DISTINCT {_CAMERA_SQL} AS camera_id, 0::BIGINT AS mismatches FROM events",
)
def t10_equal(t):
    """Rows of either form that the other does not have, heights to a millionth, for every camera."""
    compared = ["camera_id", "plant_uid", "capture_datetime", "status", "measurement_qc", "candidate_index", "calibration_filename"]
    figures = ["image_measurement_cm", "measurement_sd_cm", "posterior_mean_cm", "predictive_mean_before_cm", "extrapolation_bands", "days_after_first_image"]
    side = lambda d, sign: d.select(*compared, *[F.round(c, 6).alias(c) for c in figures], F.lit(sign).alias("sign"))
    both = side(calibrated(t), 1).unionByName(side(t06_calibrated_stream(t), -1))
    wrong = both.groupBy(*compared, *figures).agg(F.sum("sign").alias("left")).filter("left <> 0")
    wrong = wrong.groupBy("camera_id").agg(F.sum(F.abs("left")).cast("bigint").alias("mismatches"))
    frames, _ = frames_and_candidates(t)
    cameras = frames.select("camera_id").distinct()
    return cameras.join(wrong, "camera_id", "left").select("camera_id", F.coalesce("mismatches", F.lit(0)).cast("bigint").alias("mismatches"))


_WAVES, _DELAY_HOURS, _IDLE_HOURS = 6, 6, 12


@query(
    "t11_watermark_and_expiry",
    f"""WITH c AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
    e AS (SELECT user_id, epoch_us(ts) AS us, least({_WAVES - 1}, (epoch_us(ts) - a) * {_WAVES} // (b - a + 1) + CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 23 = 0 THEN 3 ELSE 0 END) AS wave FROM events, c),
    k AS (SELECT unnest(range(0, {_WAVES} + 1)) AS wave),
    w AS (SELECT k.wave, coalesce(max(us) // 1000 - {_DELAY_HOURS * 3_600_000}, 0) AS mark FROM k LEFT JOIN e ON e.wave < k.wave GROUP BY 1),
    s AS (SELECT e.*, w.mark, max(us) FILTER (us >= mark * 1000) OVER (PARTITION BY user_id ORDER BY wave RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e JOIN w USING (wave)),
    r AS (SELECT user_id, wave, us, CASE WHEN us < mark * 1000 THEN CASE WHEN us < seen AND seen // 1000 + {_IDLE_HOURS * 3_600_000} > mark THEN 'late' ELSE 'behind_watermark' END
        WHEN us < seen THEN 'late' ELSE 'applied' END AS arrival FROM s),
    l AS (SELECT user_id, wave, max(us) AS last, lead(wave, 1, {_WAVES}) OVER (PARTITION BY user_id ORDER BY wave) AS upto FROM r WHERE arrival = 'applied' GROUP BY 1, 2),
    x AS (SELECT user_id, 'closed' AS arrival FROM l JOIN w ON w.wave = l.upto WHERE last // 1000 + {_IDLE_HOURS * 3_600_000} <= mark),
    u AS (SELECT user_id, arrival FROM r UNION ALL SELECT * FROM x)
    SELECT user_id, arrival, count(*) AS n FROM u GROUP BY 1, 2""",
)
def t11_hygiene(t):
    """The events in waves, some late by one or three of them, under a watermark and with idle series closed."""
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/waves-{uuid.uuid4().hex}"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = t.events.agg(F.min(us), F.max(us)).first()
    n = F.col("event_id")
    behind = F.when(n % 10 == 0, 1).when(n % 23 == 0, 3).otherwise(0)
    wave = F.floor((us - F.lit(first)) * _WAVES / F.lit(last - first + 1)) + behind
    events = t.events.withColumn("wave", F.least(F.lit(_WAVES - 1), wave))
    few = replace(SETTINGS, particles=100, quantiles=False)
    hygiene = ST.Hygiene(f"{_DELAY_HOURS} hours", f"{_IDLE_HOURS} hours")
    for k in range(_WAVES):
        events.filter(F.col("wave") == k).select(*EVENTS.names).write.mode("append").parquet(f"{base}/in")
        rows = ST.stream_table(t.spark, f"{base}/in", EVENTS, "ts").select("user_id", "event_id", "ts", "value")
        done = ST.run_to_end(ST.stateful_filter(rows, "user_id", "ts", "value", ["event_id"], few, hygiene=hygiene, outputs=[]), f"{base}/out", f"{base}/checkpoint")
    return done.groupBy("user_id", "arrival").agg(F.count(F.lit(1)).alias("n"))
