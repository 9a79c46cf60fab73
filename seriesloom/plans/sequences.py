"""Queries over the measurement stream: windows, folds, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import folds, windows
from seriesloom.operators.ordering import SeriesOrder, number_rows, plan_chunks, previous, running, with_halo, without_halo
from seriesloom.plans.registry import EVENT_ORDER, EVENT_WINDOW, query, rnd, sql_rnd

DAY = "86400000000::DOUBLE"

# Every row of the stream with its position and its two predecessors.
SEQ = f"""s AS (
  SELECT event_id, user_id, ts, event_type, value,
         row_number() OVER w AS rn,
         lag(ts, 1) OVER w AS t1, lag(value, 1) OVER w AS v1,
         lag(ts, 2) OVER w AS t2, lag(value, 2) OVER w AS v2
  FROM events WINDOW w AS {EVENT_WINDOW})"""


def sql_days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / {DAY})"


ELAPSED = f"(CASE WHEN rn = 1 THEN 0::DOUBLE ELSE greatest({sql_days('ts', 't1')}, 1e-6) END)"

LINE = f"""CASE WHEN v2 IS NULL THEN v1 ELSE v1 + least(greatest(
    CASE WHEN {sql_days('t1', 't2')} > 0 THEN (v1 - v2) / {sql_days('t1', 't2')} ELSE 0 END,
    -4::DOUBLE), 15::DOUBLE) * {ELAPSED} END"""


def stream(t):
    return t.events.select("user_id", "event_id", "ts", "value")


@query(
    "w01_increments",
    f"""WITH {SEQ}, d AS (SELECT *, {sql_days('ts', 't1')} AS dt FROM s WHERE rn > 1)
    SELECT user_id, event_id, {sql_rnd('dt')} AS dt_days, {sql_rnd('value - v1')} AS dv,
           {sql_rnd('(value - v1) / sqrt(dt)', 3)} AS dv_per_sqrt_day
    FROM d WHERE dt > 0""",
)
def w01(t):
    d = windows.increments(stream(t), EVENT_ORDER, "value")
    return d.select(
        "user_id",
        "event_id",
        rnd("dt_days").alias("dt_days"),
        rnd("dv").alias("dv"),
        rnd("dv_per_sqrt_day", 3).alias("dv_per_sqrt_day"),
    )


@query(
    "w02_locf_forecast",
    f"""WITH {SEQ} SELECT user_id, event_id, v1 AS last_observation,
        coalesce(v1, value) AS last_or_itself FROM s""",
)
def w02(t):
    lagged = previous(stream(t), EVENT_ORDER, {"last_observation": ("value", 1)})
    return lagged.select(
        "user_id",
        "event_id",
        "last_observation",
        F.coalesce("last_observation", "value").alias("last_or_itself"),
    )


@query(
    "w03_two_point_forecast",
    f"WITH {SEQ} SELECT user_id, event_id, {sql_rnd(LINE)} AS two_point_line FROM s",
)
def w03(t):
    d = windows.naive_forecasts(stream(t), EVENT_ORDER, "value")
    return d.select("user_id", "event_id", rnd("two_point_line").alias("two_point_line"))


@query(
    "w04_running_median",
    f"""SELECT user_id, event_id, {sql_rnd('quantile_cont(value, 0.5) OVER w')} AS running_median
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def w04(t):
    d = windows.running_median(stream(t), EVENT_ORDER, "value")
    return d.select("user_id", "event_id", rnd("running_median").alias("running_median"))


@query(
    "w05_sequence_number",
    f"WITH {SEQ} SELECT user_id, event_id, rn AS sequence_number FROM s WHERE rn > 1",
)
def w05(t):
    numbered = number_rows(t.events.select("user_id", "event_id", "ts"), EVENT_ORDER)
    return numbered.filter("sequence_number > 1").select("user_id", "event_id", "sequence_number")


@query(
    "w09_ewma",
    f"""WITH RECURSIVE {SEQ}, f AS (
      SELECT user_id, event_id, rn, value AS x FROM s WHERE rn = 1
      UNION ALL SELECT s.user_id, s.event_id, s.rn, 0.5 * s.value + 0.5 * f.x
      FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
    SELECT user_id, event_id, {sql_rnd('x')} AS ewma FROM f""",
)
def w09(t):
    d = folds.scan(stream(t), EVENT_ORDER, folds.ewma("value"), ["value"])
    return d.select("user_id", "event_id", rnd("ewma").alias("ewma"))


@query(
    "w10_holt",
    f"""WITH RECURSIVE {SEQ}, e AS (SELECT *, {ELAPSED} AS dt FROM s), f AS (
      SELECT user_id, event_id, rn, value AS l, 0::DOUBLE AS b FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, u AS l, 0.2 * ((u - l) / dt) + 0.8 * b AS b FROM (
        SELECT e.user_id, e.event_id, e.rn, e.dt, f.l, f.b,
               0.5 * e.value + 0.5 * (f.l + f.b * e.dt) AS u
        FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
    SELECT user_id, event_id, {sql_rnd('l', 3)} AS level, {sql_rnd('b', 3)} AS trend FROM f""",
)
def w10(t):
    d = folds.scan(stream(t), EVENT_ORDER, folds.holt("value"), ["value"])
    return d.select(
        "user_id", "event_id", rnd("level", 3).alias("level"), rnd("trend", 3).alias("trend")
    )


def kalman_sql(level_sd, trend_sd, g0, g0_sd, var="225::DOUBLE", first="225::DOUBLE"):
    """Recursive form; ``var`` may use columns of ``e``."""
    q0, q1 = repr(level_sd**2) + "::DOUBLE", repr(trend_sd**2) + "::DOUBLE"
    return f"""WITH RECURSIVE {SEQ}, e0 AS (
      SELECT s.*, {ELAPSED} AS dt, coalesce(l.l_discount, 0) AS conf FROM s LEFT JOIN
      (SELECT l_orderkey, max(l_discount) * 10 AS l_discount FROM lineitem GROUP BY 1) l
      ON l.l_orderkey = s.event_id),
    e AS (SELECT *, {var} AS r FROM e0),
    f AS (
      SELECT user_id, event_id, rn, value AS m, {g0}::DOUBLE AS g, {first} AS p00,
             0::DOUBLE AS p01, {g0_sd ** 2}::DOUBLE AS p11 FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, pm + a00 / (a00 + r) * (value - pm),
             g + a01 / (a00 + r) * (value - pm),
             a00 - a00 / (a00 + r) * a00, a01 - a00 / (a00 + r) * a01,
             a11 - a01 / (a00 + r) * a01 FROM (
        SELECT e.user_id, e.event_id, e.rn, e.value, e.r, f.g, f.m + e.dt * f.g AS pm,
               f.p00 + 2 * e.dt * f.p01 + e.dt * e.dt * f.p11 + {q0} * e.dt AS a00,
               f.p01 + e.dt * f.p11 AS a01, f.p11 + {q1} * e.dt AS a11
        FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))"""


@query(
    "w11_kalman_fixed_sd",
    kalman_sql(8.78, 0.35, 3.0, 2.0)
    + f""" SELECT user_id, event_id, {sql_rnd('m', 4)} AS level, {sql_rnd('g', 4)} AS trend,
           {sql_rnd('p00', 4)} AS level_variance FROM f""",
)
def w11(t):
    rows = stream(t).withColumn("r", F.lit(225.0))
    smoother = folds.kalman("value", "r", 8.78, 0.35, initial_trend=3.0, initial_trend_sd=2.0)
    d = folds.scan(rows, EVENT_ORDER, smoother, ["value", "r"])
    return d.select(
        "user_id",
        "event_id",
        rnd("level", 4).alias("level"),
        rnd("trend", 4).alias("trend"),
        rnd("p00", 4).alias("level_variance"),
    )


@query(
    "w12_confidence_kalman",
    kalman_sql(
        8.78,
        0.35,
        0.0,
        8.0,
        var="144 / greatest(conf, 0.05)",
        first="(144 - 144 / (144 + r) * 144)",
    )
    + f""" SELECT user_id, event_id, {sql_rnd('m', 4)} AS level, {sql_rnd('g', 4)} AS trend,
           {sql_rnd('p00', 4)} AS level_variance FROM f""",
)
def w12(t):
    conf = t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(
        (F.max("l_discount") * 10).alias("conf")
    )
    rows = (
        stream(t)
        .join(conf, "event_id", "left")
        .withColumn("r", F.lit(144.0) / F.greatest(F.coalesce("conf", F.lit(0.0)), F.lit(0.05)))
        .withColumn("p", F.lit(144.0))
    )
    smoother = folds.kalman("value", "r", 8.78, 0.35, start_variance="p")
    d = folds.scan(rows, EVENT_ORDER, smoother, ["value", "r", "p"])
    return d.select(
        "user_id",
        "event_id",
        rnd("level", 4).alias("level"),
        rnd("trend", 4).alias("trend"),
        rnd("p00", 4).alias("level_variance"),
    )


@query(
    "w13_days_after_first",
    f"""SELECT user_id, event_id, {sql_rnd("(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id % 12))) / " + DAY)}
        AS days_after_first FROM events""",
)
def w13(t):
    rows = t.events.select("user_id", "event_id", "ts").withColumn("camera", F.col("user_id") % 12)
    first = rows.groupBy("camera").agg(F.min("ts").alias("first_ts"))
    d = rows.join(first, "camera").withColumn(
        "days_after_first", windows.days_between("ts", "first_ts")
    )
    return d.select("user_id", "event_id", rnd("days_after_first").alias("days_after_first"))


@query(
    "w15_running_position",
    f"""WITH RECURSIVE {SEQ}, f AS (
      SELECT user_id, event_id, rn, value AS m, value AS frozen FROM s WHERE rn = 1
      UNION ALL SELECT s.user_id, s.event_id, s.rn, f.m + 0.5 * (s.value - f.m), f.frozen
      FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
    SELECT f.user_id, f.event_id, {sql_rnd('f.m')} AS position,
           {sql_rnd('abs(s.value - f.frozen)')} AS frozen_distance
    FROM f JOIN s USING (user_id, event_id)""",
)
def w15(t):
    moved = folds.scan(stream(t), EVENT_ORDER, folds.running_position("value"), ["value"])
    anchor = t.events.groupBy("user_id").agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("anchor")
    )
    return moved.join(anchor, "user_id").select(
        "user_id",
        "event_id",
        rnd("position").alias("position"),
        rnd(F.abs(F.col("value") - F.col("anchor"))).alias("frozen_distance"),
    )


_CROWD = """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS series, value,
    CASE WHEN user_id % 3 = 0 THEN date_trunc('month', ts) ELSE ts END AS moment FROM events"""


@query(
    "w05_crowded_month",
    f"""WITH e AS ({_CROWD}) SELECT event_id, series, row_number() OVER w AS number, lag(value) OVER w AS before,
    {sql_rnd('sum(value) OVER (w ROWS UNBOUNDED PRECEDING)', 3)} AS total FROM e WINDOW w AS (PARTITION BY series ORDER BY moment, event_id)""",
)
def w05_crowded(t):
    """A third of all rows in one series and at one time: only the tie-break can divide them."""
    hot = F.col("user_id") % 3 == 0
    e = t.events.select(
        "event_id",
        F.when(hot, -1).otherwise(F.col("user_id")).cast("bigint").alias("series"),
        "value",
        F.when(hot, F.date_trunc("month", "ts").cast("timestamp_ntz")).otherwise(F.col("ts").cast("timestamp_ntz")).alias("moment"),
    )
    by = plan_chunks(e, SeriesOrder.by_time(("series",), "moment", ("event_id",)), most=1_000)
    d = running(previous(e, by, {"before": ("value", 1)}), by, {"number": ("sum", F.lit(1).cast("bigint")), "total": ("sum", F.col("value"))})
    return d.select("event_id", "series", "number", "before", rnd("total", 3).alias("total"))
