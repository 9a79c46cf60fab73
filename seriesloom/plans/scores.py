"""Scoring queries: forecast errors, interval calibration, cluster summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import scoring as S
from seriesloom.operators import metrics as M
from seriesloom.operators import windows
from seriesloom.operators.ordering import SeriesOrder, number_rows
from seriesloom.operators.quantiles import weighted_quantiles
from seriesloom.plans.registry import EVENT_ORDER, query, rnd, sql_rnd
from seriesloom.plans.sequences import DAY, ELAPSED, LINE, SEQ, sql_days, stream

OUTLIER, OUTLIER_SD = 0.065, 59.04
LEVELS = tuple(S.NORMAL_Z)
INTERVALS = {level: (f"lo{level}", f"hi{level}") for level in LEVELS}


def forecasts(t):
    """Later-than-first rows with two point forecasts, a normal forecast and its scores."""
    rows = stream(t).withColumn("camera", F.col("user_id") % 12)
    d = windows.naive_forecasts(rows, EVENT_ORDER, "value").filter("last_observation IS NOT NULL")
    sd = F.sqrt(F.lit(225.0) + F.lit(8.78 * 8.78) * F.col("elapsed_days"))
    d = d.withColumn("mean", F.col("last_observation")).withColumn("sd", sd)
    bounds = {}
    for level, z in S.NORMAL_Z.items():
        lo, hi = S.central_interval(F.col("mean"), F.col("sd"), z)
        bounds |= {f"lo{level}": lo, f"hi{level}": hi}
    d = d.withColumns(bounds)
    args = (F.col("value"), F.col("mean"), F.col("sd"), F.lit(OUTLIER), F.lit(OUTLIER_SD))
    pairs = {level: (F.col(lo), F.col(hi)) for level, (lo, hi) in INTERVALS.items()}
    return d.withColumns(
        {
            "log_score": S.mixture_log_density(*args),
            "pit": S.mixture_cdf(*args),
            "wis": S.weighted_interval_score(F.col("value"), F.col("mean"), pairs),
        }
    )


def sql_phi(z: str) -> str:
    b = S.NORMAL_CDF_B
    k = f"(1 / (1 + {S.NORMAL_CDF_P}::DOUBLE * abs({z})))"
    poly = f"{b[4]}::DOUBLE"
    for c in b[3::-1]:
        poly = f"({poly} * {k} + {c}::DOUBLE)"
    tail = f"(exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) * {poly} * {k})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


_lo = {level: f"(mean - {z!r}::DOUBLE * sd)" for level, z in S.NORMAL_Z.items()}
_hi = {level: f"(mean + {z!r}::DOUBLE * sd)" for level, z in S.NORMAL_Z.items()}
_wis = "0.5 * abs(value - mean)"
for _level in LEVELS:
    _a = (100 - _level) / 100
    _wis += (
        f" + {_a / 2!r}::DOUBLE * (({_hi[_level]} - {_lo[_level]}) + {2 / _a!r}::DOUBLE *"
        f" (greatest({_lo[_level]} - value, 0) + greatest(value - {_hi[_level]}, 0)))"
    )
FC = f"""{SEQ}, fa AS (
  SELECT user_id, event_id, ts, rn, value, user_id % 12 AS camera, v1 AS last_observation,
         {LINE} AS two_point_line, {ELAPSED} AS dt FROM s WHERE rn > 1),
fb AS (SELECT *, last_observation AS mean, sqrt(225 + {8.78 * 8.78!r}::DOUBLE * dt) AS sd FROM fa),
fd AS (SELECT *, {', '.join(f'{_lo[v]} AS lo{v}, {_hi[v]} AS hi{v}' for v in LEVELS)},
         (value - mean) / sd AS zi, (value - mean) / {OUTLIER_SD}::DOUBLE AS zo FROM fb),
fc AS (SELECT *, {1 - OUTLIER!r}::DOUBLE * {sql_phi('zi')} + {OUTLIER}::DOUBLE * {sql_phi('zo')} AS pit,
         ln({1 - OUTLIER!r}::DOUBLE * exp(-0.5 * zi * zi) / sd / sqrt(2 * pi())
            + {OUTLIER}::DOUBLE * exp(-0.5 * zo * zo) / {OUTLIER_SD}::DOUBLE / sqrt(2 * pi())) AS log_score,
         ({_wis}) / 4.5 AS wis FROM fd)"""

ESTIMATORS = ("last_observation", "two_point_line")
LONG = "le AS (" + " UNION ALL ".join(
    f"SELECT user_id, event_id, camera, ts, value, '{e}' AS estimator, {e} AS estimate, {e} - value AS error FROM fc"
    for e in ESTIMATORS
) + ")"
_ERR = (
    f"count(*) AS n, {sql_rnd('avg(error)')} AS bias, {sql_rnd('avg(abs(error))')} AS mae, "
    f"{sql_rnd('sqrt(avg(error * error))')} AS rmse"
)


def rounded(df, digits=6, **special):
    """Round every double column."""
    return df.select(
        *[
            rnd(c, special.get(c, digits)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


@query("a01_error_metrics", f"WITH {FC}, {LONG} SELECT estimator, {_ERR} FROM le GROUP BY 1")
def a01(t):
    rows = windows.naive_forecasts(stream(t), EVENT_ORDER, "value")
    return rounded(M.error_metrics(rows, "value", ESTIMATORS))


@query(
    "a02_error_metrics_corr",
    f"""WITH {FC}, {LONG} SELECT camera, estimator, {_ERR}, {sql_rnd('corr(estimate, value)')} AS pearson_r
    FROM le GROUP BY 1, 2""",
)
def a02(t):
    rows = windows.naive_forecasts(
        stream(t).withColumn("camera", F.col("user_id") % 12), EVENT_ORDER, "value"
    )
    return rounded(M.error_metrics(rows, "value", ESTIMATORS, ["camera"], corr=True))


def _calibration_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {keys}{v}::BIGINT AS level_percent, value, lo{v} AS lower, hi{v} AS upper FROM fx"
        for v in LEVELS
    )
    return f"""WITH {FC}, fx AS (SELECT *, CAST(ts AS DATE) AS day FROM fc), lv AS ({parts})
    SELECT {keys}level_percent, level_percent / 100 AS nominal_coverage, count(*) AS n,
      count(*) FILTER (value >= lower AND value <= upper) AS covered,
      {sql_rnd('avg(CASE WHEN value >= lower AND value <= upper THEN 1.0 ELSE 0 END)')} AS coverage,
      count(*) FILTER (value < lower) AS below, count(*) FILTER (value > upper) AS above,
      {sql_rnd('avg(upper - lower)')} AS mean_width,
      {sql_rnd('quantile_cont(upper - lower, 0.5)')} AS median_width
    FROM lv GROUP BY ALL"""


@query("a03_interval_calibration", _calibration_sql("camera"))
def a03(t):
    d = M.interval_calibration(forecasts(t), "value", INTERVALS, ["camera"])
    return rounded(d).withColumn("nominal_coverage", F.col("level_percent") / 100.0)


@query("a21_coverage_by_date", _calibration_sql("day"))
def a21(t):
    rows = forecasts(t).withColumn("day", F.to_date("ts"))
    d = M.interval_calibration(rows, "value", INTERVALS, ["day"])
    return rounded(d).withColumn("nominal_coverage", F.col("level_percent") / 100.0)


_SUMMARY = f"""count(*) AS n, count(DISTINCT user_id) AS entities, count(DISTINCT camera) AS clusters,
  {sql_rnd('avg(mean - value)')} AS bias, {sql_rnd('avg(abs(mean - value))')} AS mae,
  {sql_rnd('sqrt(avg((mean - value) * (mean - value)))')} AS rmse,
  {sql_rnd('avg(log_score)')} AS mean_log_score, {sql_rnd('avg(wis)')} AS mean_wis,
  {sql_rnd('avg(pit)')} AS mean_pit"""


@query("a04_forecast_summary", f"WITH {FC} SELECT {_SUMMARY} FROM fc")
def a04(t):
    return rounded(M.forecast_summary(forecasts(t), "value", "mean", "user_id", "camera"))


@query(
    "a05_grouping_summary",
    f"""WITH {FC}, g AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'development' ELSE 'test' END AS split FROM fc)
    SELECT split, camera, CAST(grouping(split, camera) AS BIGINT) AS grouping_id, {_SUMMARY} FROM g
    GROUP BY GROUPING SETS ((), (split), (split, camera))""",
)
def a05(t):
    rows = forecasts(t).withColumn(
        "split", F.when(F.col("ts") < F.lit("2024-01-16"), "development").otherwise("test")
    )
    sets = [[], ["split"], ["split", "camera"]]
    d = M.grouping_summary(rows.withColumn("row_cluster", F.col("camera")), sets, "value", "mean", "user_id", "row_cluster")
    return rounded(d)


@query(
    "a06_cluster_summary",
    f"""WITH {FC}, {LONG}, c AS (SELECT estimator, camera, count(*) AS n, avg(error) AS bias,
      avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse FROM le GROUP BY 1, 2)
    SELECT estimator, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_rows, {sql_rnd('avg(bias)')} AS bias_mean,
      {sql_rnd('stddev_samp(bias)')} AS bias_sd, {sql_rnd('avg(mae)')} AS mae_mean, {sql_rnd('avg(rmse)')} AS rmse_mean
    FROM c GROUP BY 1""",
)
def a06(t):
    rows = M.long_errors(forecasts(t), "value", ESTIMATORS, ["camera"])
    return rounded(M.cluster_summary(rows, "error", "camera", ["estimator"]))


@query(
    "a07_entity_metrics",
    f"""WITH {FC}, e AS (SELECT user_id, count(*) AS rows, avg(mean - value) AS bias, avg(abs(mean - value)) AS mae,
      sqrt(avg((mean - value) ** 2)) AS rmse, avg(two_point_line - last_observation) AS rate_bias,
      sqrt(avg((two_point_line - last_observation) ** 2)) AS rate_rmse,
      avg(CASE WHEN value BETWEEN lo95 AND hi95 THEN 1.0 ELSE 0.0 END) AS coverage, avg(hi95 - lo95) AS width
      FROM fc GROUP BY 1)
    SELECT count(*) AS n_entities, CAST(sum(rows) AS BIGINT) AS n_rows,
      {', '.join(f'{sql_rnd(f"avg({c})")} AS {c}' for c in ('bias', 'mae', 'rmse', 'rate_bias', 'rate_rmse', 'coverage', 'width'))}
    FROM e""",
)
def a07(t):
    d = M.entity_metrics(
        forecasts(t), "user_id", "value", "mean", "last_observation", "two_point_line", "lo95", "hi95"
    )
    return rounded(d)


@query(
    "a08_position_metrics",
    f"""WITH {FC}, p AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM fc),
    q AS (SELECT *, (rn - 2) / greatest(total - 1, 1) AS share FROM p)
    SELECT CASE WHEN share <= 1/3 THEN 'first_third' ELSE 'last_third' END AS position, count(*) AS n,
      {sql_rnd('sqrt(avg((mean - value) ** 2))')} AS rmse,
      {sql_rnd('avg(CASE WHEN value BETWEEN lo95 AND hi95 THEN 1.0 ELSE 0.0 END)')} AS coverage
    FROM q WHERE share <= 1/3 OR share >= 2/3 GROUP BY 1""",
)
def a08(t):
    rows = number_rows(forecasts(t), EVENT_ORDER).withColumn("idx", F.col("sequence_number") - 1)
    totals = t.events.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("total"))
    rows = rows.join(totals, "user_id")
    return rounded(M.position_metrics(rows, "idx", "total", "value", "mean", "lo95", "hi95"))


@query(
    "a09_error_quantiles",
    f"""WITH {FC}, {LONG} SELECT estimator, p AS probability, count(*) OVER () * 0 + n AS n, {sql_rnd('q')} AS abs_error FROM (
      SELECT estimator, count(*) AS n, unnest([0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[]) AS p,
             unnest(quantile_cont(abs(error), [0.25, 0.5, 0.75, 0.9, 0.95])) AS q FROM le GROUP BY 1)""",
)
def a09(t):
    d = M.error_quantiles(forecasts(t), "value", ESTIMATORS, [0.25, 0.5, 0.75, 0.9, 0.95])
    return d.select("estimator", "probability", "n", rnd("abs_error").alias("abs_error"))


_LOO = f"""WITH {FC}, c AS (SELECT camera, count(*) AS n, sum(abs(last_observation - value)) AS l,
      sum(abs(two_point_line - value)) AS r FROM fc GROUP BY 1),
    o AS (SELECT a.camera AS omitted, CAST(sum(b.n) AS BIGINT) AS n_retained, sum(b.l) / sum(b.n) AS left_mae,
      sum(b.r) / sum(b.n) AS right_mae FROM c a JOIN c b ON a.camera <> b.camera GROUP BY 1)"""


@query(
    "a10_leave_one_cluster_out",
    _LOO
    + f""" SELECT omitted, n_retained, {sql_rnd('left_mae')} AS left_mae, {sql_rnd('right_mae')} AS right_mae,
      {sql_rnd('left_mae - right_mae')} AS mae_gain FROM o""",
)
def a10(t):
    return rounded(M.leave_one_out(forecasts(t), "camera", "value", *ESTIMATORS))


@query(
    "a10_influence_range",
    _LOO
    + f""", g AS (SELECT omitted, left_mae - right_mae AS mae_gain FROM o)
    SELECT count(*) AS omissions, {sql_rnd('min(mae_gain)')} AS min_gain, arg_min(omitted, mae_gain) AS min_omitted,
      {sql_rnd('max(mae_gain)')} AS max_gain, arg_max(omitted, mae_gain) AS max_omitted,
      bool_and(mae_gain > 0) AS all_positive FROM g""",
)
def a10_range(t):
    omissions = M.leave_one_out(forecasts(t), "camera", "value", *ESTIMATORS)
    return rounded(M.influence_range(omissions))


_INC = f"""WITH {SEQ}, d0 AS (SELECT *, {sql_days('ts', 't1')} AS dt, value - v1 AS dv FROM s WHERE rn > 1),
    d AS (SELECT *, dv / sqrt(dt) AS x FROM d0 WHERE dt > 0)"""


@query(
    "a11_robust_process_scale",
    _INC
    + f""" SELECT {sql_rnd('1.4826 * quantile_cont(abs(x - m), 0.5)')} AS process_scale, count(*) AS n
      FROM d, (SELECT quantile_cont(x, 0.5) AS m FROM d)""",
)
def a11(t):
    return rounded(M.robust_process_scale(stream(t), EVENT_ORDER, "value"))


@query(
    "a12_noise_calibration",
    _INC
    + f""", w AS (SELECT dv FROM d WHERE dt BETWEEN 0.25 AND 0.75),
      m AS (SELECT quantile_cont(dv, 0.5) AS m FROM w),
      r AS (SELECT 1.4826 * quantile_cont(abs(dv - m), 0.5) AS r FROM w, m),
      z AS (SELECT dv, abs((dv - m) / r) > 3 AS tail FROM w, m, r)
      SELECT CASE WHEN count(*) >= 20 THEN 'ok' ELSE 'too_few' END AS status, count(*) AS n,
        count(*) FILTER (tail) AS n_outliers,
        {sql_rnd('count(*) FILTER (tail) / count(*)')} AS outlier_share,
        {sql_rnd('stddev_samp(dv) FILTER (NOT tail) / sqrt(0.5)')} AS process_sd,
        {sql_rnd('stddev_samp(dv) FILTER (tail)')} AS outlier_sd, {sql_rnd('avg(dv)')} AS mean_change FROM z""",
)
def a12(t):
    d = M.calibrate_noise(stream(t), EVENT_ORDER, "value", nominal_days=0.5, tolerance_days=0.25)
    return rounded(d)


@query(
    "a17_repeatability",
    f"""SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS images, {sql_rnd('avg(l_quantity)')} AS mean_value,
      {sql_rnd('stddev_samp(l_quantity)')} AS sd_value, min(l_quantity) AS min_value, max(l_quantity) AS max_value,
      {sql_rnd('100 * stddev_samp(l_quantity) / avg(l_quantity)')} AS cv_percent,
      {sql_rnd('100 * (max(l_quantity) - min(l_quantity)) / avg(l_quantity)')} AS relative_range_percent
    FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2""",
)
def a17(t):
    d = M.repeatability(t.lineitem, ["l_suppkey", "l_returnflag"], "l_orderkey", "l_quantity")
    keep = ["min_value", "max_value"]
    return rounded(d.select(*[c for c in d.columns if c not in keep], *keep))


@query(
    "a18_calibration_audit",
    f"""SELECT l_suppkey, count(*) AS passing, min(l_quantity) AS min_span, max(l_quantity) AS max_span,
      count(*) FILTER (l_quantity > 40) AS exceeding, {sql_rnd('quantile_cont(l_quantity, 0.5)')} AS median_span,
      {sql_rnd('100.0 * count(*) FILTER (l_quantity > 40) / count(*)')} AS exceeding_percent
    FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1""",
)
def a18(t):
    d = M.calibration_audit(
        t.lineitem, "l_suppkey", F.col("l_returnflag") == "A", F.col("l_quantity"), 40.0
    )
    return rounded(d)


@query(
    "a19_image_summary",
    f"""WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS filename, CAST(o_custkey AS VARCHAR) AS camera_id, o_orderdate AS ts FROM orders),
    l AS (SELECT CAST(l_orderkey AS VARCHAR) AS filename, count(*) AS candidates, count(*) FILTER (l_returnflag = 'A') AS assigned,
      count(*) FILTER (l_linestatus = 'F') AS used, count(*) FILTER (l_linestatus <> 'F') AS predicted FROM lineitem GROUP BY 1),
    e AS (SELECT CAST(event_id AS VARCHAR) AS filename, CAST(floor(value) AS BIGINT) AS landmarks, value >= 20 AS calibration_pass FROM events)
    SELECT needs_fit, f.filename, camera_id, {sql_rnd("(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY camera_id))) / " + DAY)} AS days_after_first,
      coalesce(candidates, 0) AS candidates, coalesce(assigned, 0) AS assigned, coalesce(used, 0) AS measurements_used,
      coalesce(predicted, 0) AS prediction_only, coalesce(landmarks, 0) AS landmarks, coalesce(calibration_pass, NOT needs_fit) AS calibration_pass
    FROM f LEFT JOIN l USING (filename) LEFT JOIN e USING (filename), (SELECT unnest([true, false]) AS needs_fit)""",
)
def a19(t):
    text = lambda c: F.col(c).cast("string")
    frames = t.orders.select(
        text("o_orderkey").alias("filename"),
        text("o_custkey").alias("camera_id"),
        F.col("o_orderdate").alias("capture_datetime"),
    )
    lines = t.lineitem.select(
        text("l_orderkey").alias("filename"),
        (F.col("l_returnflag") == "A").alias("selected"),
        (F.col("l_linestatus") == "F").alias("measurement_used"),
    )
    fits = t.events.select(
        text("event_id").alias("filename"),
        F.floor("value").alias("n_landmarks"),
        (F.col("value") >= 20).alias("fit_pass"),
    )
    red_band, other = (
        M.image_summary(frames, lines, lines, fits, needs).withColumn("needs_fit", F.lit(needs)) for needs in (True, False)
    )
    return rounded(red_band.unionByName(other))


@query(
    "a20_by_cluster",
    f"""WITH {FC} SELECT camera, count(*) AS n, {sql_rnd('avg(abs(last_observation - value))')} AS left_mae,
      {sql_rnd('avg(abs(two_point_line - value))')} AS right_mae,
      {sql_rnd('avg(abs(last_observation - value) - abs(two_point_line - value))')} AS gain,
      {sql_rnd('avg(CASE WHEN abs(two_point_line - value) < abs(last_observation - value) THEN 1.0 ELSE 0.0 END)')} AS share_improved
    FROM fc GROUP BY 1""",
)
def a20(t):
    return rounded(M.by_cluster(forecasts(t), "camera", "value", *ESTIMATORS))


@query(
    "a22_endpoints",
    """SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
       ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def a22(t):
    return M.endpoints(stream(t), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "value")


@query(
    "a24_design_counts",
    """SELECT count(*) AS records, count(DISTINCT user_id) AS entities, count(DISTINCT user_id % 12) AS clusters,
       count(DISTINCT CAST(ts AS DATE)) AS dates FROM events""",
)
def a24(t):
    return M.design_counts(
        t.events, {"entities": "user_id", "clusters": F.col("user_id") % 12, "dates": F.to_date("ts")}
    )


@query(
    "a25_distance_trend",
    f"""SELECT l_linenumber, count(l_discount) AS n, {sql_rnd('avg(l_quantity)')} AS mean,
      {sql_rnd('stddev_samp(l_quantity)')} AS sd, {sql_rnd('quantile_cont(l_quantity, 0.5)')} AS median FROM lineitem GROUP BY 1""",
)
def a25(t):
    return rounded(M.distance_trend(t.lineitem, "l_linenumber", "l_quantity"))


@query(
    "a25_trend_line",
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      corr(l_extendedprice, l_quantity) AS r FROM lineitem)
    SELECT {sql_rnd('b', 4)} AS slope, {sql_rnd('a', 4)} AS intercept, {sql_rnd('r', 4)} AS corr, {sql_rnd('d', 4)} AS distance, {sql_rnd('a + b * d', 4)} AS implied_error
    FROM f, (SELECT unnest([1.0, 1.44, 2.0, 3.0]::DOUBLE[]) AS d)""",
)
def a25_line(t):
    d = M.trend_line(t.lineitem, "l_quantity", "l_extendedprice", [1.0, 1.44, 2.0, 3.0])
    return rounded(d, 4)


@query(
    "a26_pit_histogram",
    f"""WITH {FC}, h AS (SELECT camera, CAST(least(floor(pit * 10), 9) AS INTEGER) AS bin, count(*) AS c FROM fc GROUP BY 1, 2),
    n AS (SELECT camera, count(*) AS n FROM fc GROUP BY 1)
    SELECT camera, b.bin, coalesce(c, 0) AS count, {sql_rnd('coalesce(c, 0) / n')} AS share
    FROM n CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) b LEFT JOIN h USING (camera, bin)""",
)
def a26(t):
    return rounded(M.pit_histogram(forecasts(t), "pit", ["camera"]))


@query(
    "a27_series_pivot",
    "SELECT date_trunc('hour', ts) AS time, "
    + ", ".join(
        f"arg_max(value, epoch_us(ts)::HUGEINT * 1000000000 + event_id) FILTER (user_id % 12 = {c}) AS series_{c}"
        for c in range(12)
    )
    + " FROM events GROUP BY 1",
)
def a27(t):
    rows = stream(t).withColumn("camera", F.col("user_id") % 12)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return M.series_pivot(rows, hour, "camera", range(12), "value", ["ts", "event_id"])


_WQ = """WITH c AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber
      ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS i FROM lineitem),
    d AS (SELECT *, c / total AS s FROM c),
    q AS (SELECT unnest([0.025, 0.5, 0.975]::DOUBLE[]) AS p, unnest(['q025', 'q50', 'q975']) AS name),
    b AS (SELECT l_suppkey, name, p, max(CASE WHEN s <= p THEN i END) AS lo, min(CASE WHEN s >= p THEN i END) AS hi FROM d, q GROUP BY ALL)"""


def _weighted(t, mode):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    d = weighted_quantiles(
        rows,
        ["l_suppkey"],
        "l_extendedprice",
        "l_quantity",
        {"q025": 0.025, "q50": 0.5, "q975": 0.975},
        ["l_orderkey", "l_linenumber"],
        mode,
    )
    return rounded(d, 4)


@query(
    "a28_weighted_quantile_linear",
    _WQ
    + f""", v AS (SELECT b.l_suppkey, name, CASE WHEN lo IS NULL THEN h.v WHEN h.s > l.s THEN l.v + (h.v - l.v) * (p - l.s) / (h.s - l.s)
        ELSE l.v END AS x FROM b LEFT JOIN d l ON l.l_suppkey = b.l_suppkey AND l.i = lo LEFT JOIN d h ON h.l_suppkey = b.l_suppkey AND h.i = hi)
    SELECT l_suppkey, {', '.join(f"{sql_rnd(f'max(CASE WHEN name = {chr(39)}{q}{chr(39)} THEN x END)', 4)} AS {q}" for q in ('q025', 'q50', 'q975'))}
    FROM v GROUP BY 1""",
)
def a28_linear(t):
    return _weighted(t, "linear")


@query(
    "a28_weighted_quantile_step",
    _WQ
    + f""", v AS (SELECT b.l_suppkey, name, h.v AS x FROM b LEFT JOIN d h ON h.l_suppkey = b.l_suppkey AND h.i = hi)
    SELECT l_suppkey, {', '.join(f"{sql_rnd(f'max(CASE WHEN name = {chr(39)}{q}{chr(39)} THEN x END)', 4)} AS {q}" for q in ('q025', 'q50', 'q975'))}
    FROM v GROUP BY 1""",
)
def a28_step(t):
    return _weighted(t, "step")


@query(
    "a33_keypoint_agreement",
    f"""WITH k AS (SELECT l_orderkey, l_quantity AS truth, l_quantity * (1 + l_tax) - l_discount * 20 AS est, l_discount * 100 AS top, l_tax * 100 AS root
      FROM lineitem WHERE l_returnflag <> 'R'), n AS (SELECT count(*) AS n FROM lineitem)
    SELECT count(*) AS matched, {sql_rnd('avg(top)')} AS top_mae_px, {sql_rnd('avg(root)')} AS root_mae_px, {sql_rnd('avg(est - truth)')} AS bias_px,
      {sql_rnd('avg(abs(est - truth))')} AS mae_px, {sql_rnd('sqrt(avg((est - truth) ** 2))')} AS rmse_px, {sql_rnd('corr(est, truth)')} AS pearson_r,
      {sql_rnd('count(*) / max(n)')} AS detection_rate, {sql_rnd('avg(est - truth) * 0.33')} AS bias_cm,
      {sql_rnd('avg(abs(est - truth)) * 0.33')} AS mae_cm, {sql_rnd('sqrt(avg((est - truth) ** 2)) * 0.33')} AS rmse_cm FROM k, n""",
)
def a33(t):
    pairs = t.lineitem.filter("l_returnflag <> 'R'").select(
        F.col("l_quantity").alias("truth"),
        (F.col("l_quantity") * (1 + F.col("l_tax")) - F.col("l_discount") * 20).alias("est"),
        (F.col("l_discount") * 100).alias("top"),
        (F.col("l_tax") * 100).alias("root"),
    )
    n_truth = t.lineitem.agg(F.count(F.lit(1))).scalar()
    return rounded(M.keypoint_agreement(pairs, n_truth, 0.33, "top", "root", "truth", "est"))


@query(
    "a34_selection_agreement",
    f"""WITH c AS (SELECT l_orderkey, l_suppkey % 12 AS camera, l_linenumber, l_discount, l_quantity, l_tax FROM lineitem),
    p AS (SELECT l_orderkey, arg_max(l_linenumber, l_discount * 100 + l_linenumber * 1e-6) AS plain,
      arg_max(l_linenumber, l_discount * 100 + l_tax * 100 + l_linenumber * 1e-6) AS guided FROM c GROUP BY 1)
    SELECT plain AS first_choice, count(*) AS n, {sql_rnd('avg(CASE WHEN plain = guided THEN 1.0 ELSE 0.0 END)')} AS agreement FROM p GROUP BY 1""",
)
def a34(t):
    tie = F.col("l_linenumber") * 1e-6
    picks = t.lineitem.groupBy("l_orderkey").agg(
        F.max_by("l_linenumber", F.col("l_discount") * 100 + tie).alias("plain"),
        F.max_by("l_linenumber", F.col("l_discount") * 100 + F.col("l_tax") * 100 + tie).alias("guided"),
    )
    d = M.selection_agreement(picks, "plain", "guided", ["plain"])
    return rounded(d.withColumnRenamed("plain", "first_choice"))


@query(
    "a35_growth_field",
    _INC
    + f""", r AS (SELECT dv / dt AS rate, least(8, greatest(0, CAST(floor((v1 - 10) / 10) AS BIGINT) + 1)) AS bin FROM d)
    SELECT bin, CASE WHEN bin BETWEEN 1 AND 7 THEN (bin + 0.5) * 10 END AS level, {sql_rnd('quantile_cont(rate, 0.5)', 4)} AS rate, count(*) AS n FROM r GROUP BY 1""",
)
def a35(t):
    d = M.growth_field(stream(t), EVENT_ORDER, "value", [10.0 * i for i in range(1, 9)])
    return d.select("bin", "level", rnd("rate", 4).alias("rate"), "n")


@query(
    "a37_tracking_comparison",
    f"""WITH v AS (SELECT 'frozen' AS variant, user_id, event_id, ts, value, abs(value - 20) AS distance FROM events
      UNION ALL SELECT 'updated', user_id, event_id, ts, value, abs(value - 20) / 2 FROM events WHERE event_type <> 'error'),
    l AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY variant, user_id ORDER BY ts, event_id)) AS step FROM v)
    SELECT variant, count(*) AS matches, count(DISTINCT user_id) AS entities, {sql_rnd('avg(distance)')} AS mean_distance,
      {sql_rnd('avg(value)')} AS mean_value, {sql_rnd('avg(step)')} AS roughness FROM l GROUP BY 1""",
)
def a37(t):
    base = t.events.select("user_id", "event_id", "ts", "value", "event_type")
    gap = F.abs(F.col("value") - 20)
    rows = base.select("*", F.lit("frozen").alias("variant"), gap.alias("distance")).unionByName(
        base.filter("event_type <> 'error'").select(
            "*", F.lit("updated").alias("variant"), (gap / 2).alias("distance")
        )
    )
    order = SeriesOrder.by_time(("variant", "user_id"), "ts", ("event_id",))
    return rounded(M.tracking_comparison(rows, "variant", order, "distance", "value"))
