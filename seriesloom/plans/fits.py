"""Queries for bootstraps, calibration fits and band sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import bootstrap as B
from seriesloom.operators import fitting as Fit
from seriesloom.operators.consensus import pole_sequences
from seriesloom.operators.ordering import number_rows, running, running_sixteens
from seriesloom.plans.registry import EVENT_ORDER, query, rnd, sql_rnd
from seriesloom.plans.scores import ESTIMATORS, FC, forecasts, rounded
from seriesloom.session import materialize

SEED = 20260909


def draws_sql(replicates: int, seed: int = SEED) -> str:
    """``dr(rep, idx)`` over the cluster table ``cl`` that has ``idx``."""
    return f"""k AS (SELECT count(*) AS k FROM cl),
    dr AS (SELECT rep, ('0x' || substr(md5('{seed}|' || rep || '|' || slot), 1, 8))::BIGINT % k AS idx
      FROM (SELECT unnest(range(1, {replicates + 1})) AS rep), (SELECT unnest(range(k)) AS slot, k FROM k))"""


_SUMMARY_SQL = f"""SELECT statistic, {sql_rnd('quantile_cont(x, 0.025)')} AS ci_low, {sql_rnd('quantile_cont(x, 0.975)')} AS ci_high,
    {sql_rnd('avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)')} AS p_positive, count(*) AS replicates FROM lg GROUP BY 1"""

_IDX = "CAST(row_number() OVER (ORDER BY CAST(camera AS VARCHAR)) - 1 AS BIGINT) AS idx"


@query(
    "a29_cluster_bootstrap",
    f"""WITH {FC}, cl AS (SELECT camera, {_IDX}, count(*) AS n, sum(abs(last_observation - value) - abs(two_point_line - value)) AS gain,
      sum(CASE WHEN value BETWEEN lo95 AND hi95 THEN 1.0 ELSE 0.0 END) AS coverage, sum(hi95 - lo95) AS width FROM fc GROUP BY 1),
    {draws_sql(20000)}, rp AS (SELECT rep, sum(gain) / sum(n) AS gain, sum(coverage) / sum(n) AS coverage, sum(width) / sum(n) AS width FROM dr JOIN cl USING (idx) GROUP BY 1),
    lg AS (UNPIVOT rp ON gain, coverage, width INTO NAME statistic VALUE x) {_SUMMARY_SQL}""",
)
def a29(t):
    v = F.col("value")
    stats = {
        "gain": F.abs(F.col("last_observation") - v) - F.abs(F.col("two_point_line") - v),
        "coverage": F.when(v.between(F.col("lo95"), F.col("hi95")), 1.0).otherwise(0.0),
        "width": F.col("hi95") - F.col("lo95"),
    }
    reps = B.ratio_replicates(forecasts(t), "camera", stats, None, 20000, SEED)
    return rounded(B.replicate_summary(reps, list(stats)))


@query(
    "a30_bootstrap_mean_of_means",
    f"""WITH {FC}, cl AS (SELECT camera, {_IDX}, avg(abs(last_observation - value)) AS m1, avg(abs(two_point_line - value)) AS m2 FROM fc GROUP BY 1),
    {draws_sql(20000)}, rp AS (SELECT rep, avg(m1) AS last_observation, avg(m2) AS two_point_line FROM dr JOIN cl USING (idx) GROUP BY 1),
    lg AS (UNPIVOT rp ON last_observation, two_point_line INTO NAME statistic VALUE x) {_SUMMARY_SQL}""",
)
def a30(t):
    stats = {e: F.abs(F.col(e) - F.col("value")) for e in ESTIMATORS}
    reps = B.mean_of_means_replicates(forecasts(t), "camera", stats, 20000, SEED)
    return rounded(B.replicate_summary(reps, list(stats)))


@query(
    "a31_bootstrap_quantiles",
    f"""WITH cl AS (SELECT camera, {_IDX} FROM (SELECT DISTINCT user_id % 12 AS camera FROM events)), {draws_sql(400)},
    x AS (SELECT rep, unnest([0.5, 0.9]::DOUBLE[]) AS probability, unnest(quantile_cont(value, [0.5, 0.9])) AS q
      FROM dr JOIN cl USING (idx) JOIN events ON user_id % 12 = camera GROUP BY rep)
    SELECT rep, probability, {sql_rnd('q')} AS quantile FROM x""",
)
def a31(t):
    rows = t.events.select((F.col("user_id") % 12).alias("camera"), "value")
    return rounded(B.quantile_replicates(rows, "camera", "value", [0.5, 0.9], 400, SEED))


@query(
    "a31_bootstrap_quantile_intervals",
    f"""WITH cl AS (SELECT camera, {_IDX} FROM (SELECT DISTINCT user_id % 12 AS camera FROM events)), {draws_sql(20000)},
    m AS (SELECT rep, camera, count(*) AS m FROM dr JOIN cl USING (idx) GROUP BY ALL),
    ct AS (SELECT user_id % 12 AS camera, value AS v, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
    nv AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) // 100 AS b FROM (SELECT DISTINCT v FROM ct)),
    cells AS (SELECT camera, b, v, c FROM ct JOIN nv USING (v)),
    bw AS (SELECT rep, b, sum(c * m)::BIGINT AS w FROM (SELECT camera, b, sum(c) AS c FROM cells GROUP BY ALL) JOIN m USING (camera) GROUP BY ALL),
    loc AS (SELECT rep, b, w, sum(w) OVER (PARTITION BY rep ORDER BY b)::BIGINT - w AS bef, sum(w) OVER (PARTITION BY rep)::BIGINT AS n FROM bw),
    ask AS (SELECT rep, b, bef, p, n, p * (n - 1) AS pos, CAST(CASE side WHEN 0 THEN floor(p * (n - 1)) ELSE ceil(p * (n - 1)) END AS BIGINT) AS k FROM loc, (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS p), (SELECT unnest([0, 1]) AS side)
      WHERE k >= bef AND k < bef + w),
    fw AS (SELECT DISTINCT rep, b, bef FROM ask),
    vw AS (SELECT rep, b, bef, v, sum(c * m)::BIGINT AS w FROM fw JOIN m USING (rep) JOIN cells USING (camera, b) GROUP BY ALL),
    ends AS (SELECT rep, b, v, bef + sum(w) OVER (PARTITION BY rep, b ORDER BY v)::BIGINT AS upto, w FROM vw),
    hit AS (SELECT a.rep, p, pos, k, v FROM ask a JOIN ends e ON a.rep = e.rep AND a.b = e.b AND k < upto AND k >= upto - w),
    rp AS (SELECT rep, p, min(v) + (max(v) - min(v)) * (any_value(pos) - floor(any_value(pos))) AS x FROM hit GROUP BY ALL)
    SELECT p AS probability, {sql_rnd('avg(x)', 4)} AS mean_quantile, {sql_rnd('quantile_cont(x, 0.025)')} AS ci_low, {sql_rnd('quantile_cont(x, 0.975)')} AS ci_high,
      count(*) AS replicates FROM rp GROUP BY 1""",
)
def a31_intervals(t):
    """Median and upper decile with their intervals over 20,000 replicates."""
    rows = t.events.select((F.col("user_id") % 12).alias("camera"), "value")
    reps = B.quantile_replicates(rows, "camera", "value", [0.5, 0.9], 20000, SEED)
    return reps.groupBy("probability").agg(
        rnd(F.avg("quantile"), 4).alias("mean_quantile"),
        rnd(F.percentile("quantile", F.lit(0.025))).alias("ci_low"),
        rnd(F.percentile("quantile", F.lit(0.975))).alias("ci_high"),
        F.count("quantile").alias("replicates"),
    )


@query(
    "a32_entity_bootstrap",
    f"""WITH {FC}, cl AS (SELECT user_id, CAST(row_number() OVER (ORDER BY CAST(user_id AS VARCHAR)) - 1 AS BIGINT) AS idx,
      avg(abs(last_observation - value)) AS left_mae, avg(abs(last_observation - value) - abs(two_point_line - value)) AS paired FROM fc GROUP BY 1),
    {draws_sql(20000)}, rp AS (SELECT rep, avg(left_mae) AS left_mae, avg(paired) AS paired FROM dr JOIN cl USING (idx) GROUP BY 1),
    lg AS (UNPIVOT rp ON left_mae, paired INTO NAME statistic VALUE x) {_SUMMARY_SQL}""",
)
def a32(t):
    left, right = (F.abs(F.col(e) - F.col("value")) for e in ESTIMATORS)
    stats = {"left_mae": left, "paired": left - right}
    reps = B.mean_of_means_replicates(forecasts(t), "user_id", stats, 20000, SEED)
    return rounded(B.replicate_summary(reps, list(stats)))


# --- projective fits ------------------------------------------------------------------------------

LANDMARKS = """lm AS (SELECT user_id, event_id, event_type, sum(value) OVER w AS y,
      count(*) OVER (PARTITION BY user_id) - row_number() OVER w AS z
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def landmarks(t):
    """Per user: y grows with every event, z counts down, so the order is monotone."""
    rows = t.events.select("user_id", "event_id", "event_type", "ts", "value")
    one = F.lit(1).cast("bigint")
    rows = running(rows, EVENT_ORDER, {"y": ("sum", F.col("value")), "rn": ("sum", one)})
    totals = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(totals, "user_id").withColumn("z", F.col("n") - F.col("rn"))


def fit_sql(source: str, keys: str, out: str = "fit") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ka = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{out}1 AS (SELECT {keys}, count(*) AS n_landmarks, count(DISTINCT z) AS dz, avg(y) AS y_center, stddev_pop(y) AS y_scale,
      min(y) AS min_y, max(y) AS max_y, min(z)::DOUBLE AS min_z, max(z)::DOUBLE AS max_z FROM {source} GROUP BY {keys}),
    {out}2 AS (SELECT {ka}, a.z::DOUBLE AS z, (a.y - y_center) / nullif(y_scale, 0) AS u FROM {source} a JOIN {out}1 b ON {on}),
    {out}3 AS (SELECT {keys}, count(*)::DOUBLE AS m, sum(u) AS u1, sum(u * u) AS u2, sum(z) AS z1, sum(u * z) AS uz, sum(u * u * z) AS uuz, sum(u * z * z) AS uzz, sum(u * u * z * z) AS uuzz FROM {out}2 GROUP BY {keys}),
    {out}4 AS (SELECT *, u2 * (m * uuzz - uz * uz) - u1 * (u1 * uuzz - uuz * uz) + uuz * (u1 * uz - m * uuz) AS det,
      uz * (m * uuzz - uz * uz) - u1 * (z1 * uuzz - uzz * uz) + uuz * (z1 * uz - m * uzz) AS da,
      u2 * (z1 * uuzz - uz * uzz) - uz * (u1 * uuzz - uuz * uz) + uuz * (u1 * uzz - z1 * uuz) AS db,
      -(u2 * (m * uzz - uz * z1) - u1 * (u1 * uzz - uuz * z1) + uz * (u1 * uz - m * uuz)) AS dc FROM {out}3),
    {out}5 AS (SELECT {keys}, CASE WHEN abs(det) > 1e-12 * u2 * m * uuzz THEN da / det END AS a, CASE WHEN abs(det) > 1e-12 * u2 * m * uuzz THEN db / det END AS b,
      CASE WHEN abs(det) > 1e-12 * u2 * m * uuzz THEN dc / det END AS c FROM {out}4),
    {out}6 AS (SELECT {ka}, min(abs(b.c * u + 1)) AS md, sqrt(avg((z - (b.a * u + b.b) / (b.c * u + 1)) ** 2)) AS rmse,
      max(abs(z - (b.a * u + b.b) / (b.c * u + 1))) AS mx FROM {out}2 a JOIN {out}5 b ON {on} GROUP BY {ka}),
    {out} AS (SELECT *, CASE WHEN n_landmarks < 4 OR dz < 4 THEN 'too_few' WHEN NOT (y_scale > 0) THEN 'no_spread' WHEN a IS NULL THEN 'singular'
      WHEN md < 0.1 THEN 'unstable' WHEN a - b * c >= 0 THEN 'not_monotone' ELSE 'ok' END AS fit_status
      FROM {out}1 JOIN {out}5 USING ({keys}) JOIN {out}6 USING ({keys}))"""


_OK = lambda e, d=6: f"CASE WHEN fit_status = 'ok' THEN {sql_rnd(e, d)} END"
_FIT_COLUMNS = f"""fit_status, n_landmarks, {_OK('a', 4)} AS a, {_OK('b', 4)} AS b, {_OK('c', 4)} AS c, {sql_rnd('y_center')} AS y_center, {sql_rnd('y_scale')} AS y_scale,
    {sql_rnd('min_y')} AS min_y, {sql_rnd('max_y')} AS max_y, {sql_rnd('min_z')} AS min_z, {sql_rnd('max_z')} AS max_z, {_OK('rmse', 4)} AS fit_rmse, {_OK('rmse * 12', 4)} AS fit_rmse_in, {_OK('mx * 12', 4)} AS fit_max_error_in,
    fit_status = 'ok' AND rmse * 12 <= 20 AS fit_pass"""
_FIT_DIGITS = {c: 4 for c in ("a", "b", "c", "fit_rmse", "fit_rmse_in", "fit_max_error_in")}


@query("a13_projective_fit", f"WITH {LANDMARKS}, {fit_sql('lm', 'user_id')} SELECT user_id, {_FIT_COLUMNS} FROM fit")
def a13(t):
    return rounded(Fit.fit_projective(landmarks(t), ["user_id"], "y", "z", max_rmse=20.0), **_FIT_DIGITS)


@query(
    "a23_calibration_table",
    f"""WITH {LANDMARKS}, {fit_sql('lm', 'user_id')}, v AS (SELECT user_id, bool_and(event_type <> 'signup') AS all_verified, quantile_cont(z, 0.5) AS d FROM lm GROUP BY 1)
    SELECT user_id, fit_status, {_OK('rmse', 4)} AS fit_rmse, all_verified, {sql_rnd('d')} AS median_depth FROM fit JOIN v USING (user_id)""",
)
def a23(t):
    marks = landmarks(t).withColumns(
        {
            "status": F.when(F.col("event_type") != "signup", "Verified").otherwise("draft"),
            "depth": F.col("z").cast("string"),
        }
    )
    d = Fit.calibration_table(marks, ["user_id"], "y", "z", "depth", "status")
    return d.select(
        "user_id",
        "fit_status",
        rnd("fit_rmse", 4).alias("fit_rmse"),
        "all_verified",
        rnd("median_depth").alias("median_depth"),
    )


@query(
    "a36_band_holdout",
    f"""WITH {LANDMARKS}, r AS (SELECT user_id, y, z::DOUBLE AS z, row_number() OVER (PARTITION BY user_id ORDER BY z, y) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM lm),
    sc AS (SELECT *, 'interpolation_alternating' AS scheme, i % 2 = 0 AS in_fit FROM r WHERE n >= 8
      UNION ALL SELECT *, 'extrapolation_lower_to_upper', i < n // 2 FROM r WHERE n >= 8
      UNION ALL SELECT *, 'extrapolation_upper_to_lower', i >= n - n // 2 FROM r WHERE n >= 8
      UNION ALL SELECT *, 'drop_lowest_1', i >= 1 FROM r WHERE n >= 5 UNION ALL SELECT *, 'drop_lowest_2', i >= 2 FROM r WHERE n >= 6
      UNION ALL SELECT *, 'drop_lowest_3', i >= 3 FROM r WHERE n >= 7),
    tr AS (SELECT user_id, scheme, y, z FROM sc WHERE in_fit), {fit_sql('tr', 'user_id, scheme')},
    p AS (SELECT user_id, scheme, y, z, n_landmarks, min_z, (a * (y - y_center) / y_scale + b) / (c * (y - y_center) / y_scale + 1) AS predicted
      FROM (SELECT * FROM sc WHERE NOT in_fit) JOIN (SELECT * FROM fit WHERE fit_status = 'ok') USING (user_id, scheme))
    SELECT user_id, scheme, {sql_rnd('y', 4)} AS y, {sql_rnd('z', 4)} AS true_height, {sql_rnd('predicted', 2)} AS predicted, {sql_rnd('predicted - z', 2)} AS error_ft,
      {sql_rnd('(predicted - z) * 12', 2)} AS error_in, {sql_rnd('(predicted - z) * 30.48', 2)} AS error_cm, {sql_rnd('min_z - z', 4)} AS below_ft, n_landmarks AS fit_n FROM p""",
)
def a36(t):
    wide = {c: 2 for c in ("predicted", "error_ft", "error_in", "error_cm")}
    return rounded(Fit.band_holdout(landmarks(t), ["user_id"], "y", "z"), 4, **wide)


_FOLDS = """g AS (SELECT l_suppkey % 12 AS cluster, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
    cs AS (SELECT DISTINCT cluster FROM g), fo AS (SELECT cs.cluster AS omitted, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
      FROM cs JOIN g ON g.cluster <> cs.cluster GROUP BY 1),
    cv AS (SELECT g.cluster, x, y, a + b * x AS p, a, b FROM g JOIN fo ON fo.omitted = g.cluster)"""


def affine_rows(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_suppkey") % 12).alias("cluster"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
    )


@query(
    "a16_affine_leave_cluster_out",
    f"""WITH {_FOLDS} SELECT cluster AS omitted, {sql_rnd('max(a)', 4)} AS intercept, {sql_rnd('max(b)', 4)} AS slope, count(*) AS cv_n, {sql_rnd('sqrt(avg((p - y) ** 2))', 4)} AS cv_rmse FROM cv GROUP BY 1
    UNION ALL SELECT NULL, {sql_rnd('(SELECT regr_intercept(y, x) FROM g)', 4)}, {sql_rnd('(SELECT regr_slope(y, x) FROM g)', 4)}, count(*), {sql_rnd('sqrt(avg((p - y) ** 2))', 4)} FROM cv""",
)
def a16(t):
    folds = Fit.fit_affine_loco(affine_rows(t), "x", "y", "cluster")
    total = folds.agg(F.struct(F.sum("cv_sse").alias("s"), F.sum("cv_n").alias("n"))).scalar()
    n = F.when(F.col("omitted").isNull(), total["n"]).otherwise(F.col("cv_n"))
    sse = F.when(F.col("omitted").isNull(), total["s"]).otherwise(F.col("cv_sse"))
    return folds.select(
        "omitted",
        rnd("intercept", 4).alias("intercept"),
        rnd("slope", 4).alias("slope"),
        n.alias("cv_n"),
        rnd(F.sqrt(sse / n), 4).alias("cv_rmse"),
    )


@query(
    "a16_cross_validated_rows",
    f"""WITH {_FOLDS} SELECT cluster, count(*) AS n, {sql_rnd('avg(p)', 4)} AS mean_prediction, {sql_rnd('avg(abs(p - y))', 4)} AS cv_mae FROM cv GROUP BY 1""",
)
def a16_rows(t):
    rows = affine_rows(t)
    folds = Fit.fit_affine_loco(rows, "x", "y", "cluster")
    d = Fit.loco_predictions(rows, folds, "x", "y", "cluster")
    return rounded(
        d.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("cv_prediction").alias("mean_prediction"),
            F.avg(F.abs("cv_error")).alias("cv_mae"),
        ),
        4,
    )


# --- band sequences -------------------------------------------------------------------------------

MARKS = """mk AS (SELECT user_id, event_id, sum(value * 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y,
      320 + event_id % 7 * 1.3::DOUBLE + user_id % 5 AS x, 50 + event_id % 13::DOUBLE AS area, 1 + event_id % 11::DOUBLE AS component_score FROM events)"""
MERGED = """mi AS (SELECT *, sum(CASE WHEN y - y1 <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY y, x) AS island
      FROM (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY y, x) AS y1 FROM mk)),
    mg AS (SELECT user_id, CAST(island AS BIGINT) AS island, sum(x * area) / sum(area) AS x, sum(y * area) / sum(area) AS y, sum(area) AS area, max(component_score) AS component_score FROM mi GROUP BY 1, 2)"""
GAPS = "gp AS (SELECT *, y - lag(y) OVER (PARTITION BY user_id ORDER BY y, x) AS gap FROM mg)"
BASE = """us AS (SELECT user_id, gap AS g FROM gp WHERE gap BETWEEN 18 AND 110),
    en AS (SELECT user_id FROM us GROUP BY 1 HAVING count(*) >= 3),
    vo AS (SELECT user_id, 18 + k * 0.5::DOUBLE AS candidate, count(*) AS votes, quantile_cont(abs(g / (18 + k * 0.5::DOUBLE) - 1), 0.5) AS med
      FROM us, (SELECT unnest(range(185)) AS k) WHERE abs(g / (18 + k * 0.5::DOUBLE) - 1) <= 0.22 GROUP BY 1, 2 HAVING count(*) >= 2),
    bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, med, candidate DESC) AS r FROM vo) WHERE r = 1 AND user_id IN (FROM en)),
    bg AS (SELECT user_id, candidate, votes, quantile_cont(g, 0.5) AS base_gap FROM bs JOIN us USING (user_id) WHERE abs(g / candidate - 1) <= 0.22 GROUP BY ALL)"""


def marks(t):
    rows = t.events.select("user_id", "event_id", "ts", "value")
    rows = running_sixteens(rows, EVENT_ORDER, "y", F.col("value") * 2)
    e = F.col("event_id")
    return rows.select(
        "user_id",
        "event_id",
        "y",
        (F.lit(320) + e % 7 * F.lit(1.3) + F.col("user_id") % 5).alias("x"),
        (F.lit(50) + e % 13).cast("double").alias("area"),
        (F.lit(1) + e % 11).cast("double").alias("component_score"),
    )


def merged(t):
    return materialize(Fit.merge_close(marks(t), ["user_id"], ties=["x"]).drop("island"))


@query(
    "w06_merge_close_marks",
    f"""WITH {MARKS}, {MERGED} SELECT user_id, island, {sql_rnd('x', 4)} AS x, {sql_rnd('y', 4)} AS y, {sql_rnd('area', 4)} AS area, {sql_rnd('component_score', 4)} AS component_score FROM mg""",
)
def w06(t):
    return rounded(Fit.merge_close(marks(t), ["user_id"], ties=["x"]), 4)


@query(
    "a14_base_gap",
    f"WITH {MARKS}, {MERGED}, {GAPS}, {BASE} SELECT user_id, {sql_rnd('candidate')} AS candidate, votes, {sql_rnd('base_gap', 4)} AS base_gap FROM bg",
)
def a14(t):
    d = Fit.base_gap(Fit.gaps(merged(t), ["user_id"]), ["user_id"])
    return rounded(d, base_gap=4)


@query(
    "w07_best_run",
    f"""WITH {MARKS}, {MERGED}, {GAPS}, {BASE}, rn AS (SELECT gp.*, base_gap, sum(CASE WHEN gap / base_gap BETWEEN 0.68 AND 1.36 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY y, x) AS run FROM gp JOIN bg USING (user_id)),
    rs AS (SELECT user_id, run, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, round(sum(component_score), 9) DESC, round(max(y) - min(y), 9) DESC, run) AS r FROM rn GROUP BY 1, 2)
    SELECT user_id, {sql_rnd('x', 4)} AS x, {sql_rnd('y', 4)} AS y, {sql_rnd('gap', 4)} AS gap FROM rn JOIN rs USING (user_id, run) WHERE r = 1""",
)
def w07(t):
    m = merged(t)
    base = Fit.base_gap(Fit.gaps(m, ["user_id"]), ["user_id"])
    return rounded(Fit.best_run(m, ["user_id"], base).select("user_id", "x", "y", "gap"), 4)


@query(
    "w08_band_levels",
    f"""WITH {MARKS}, {MERGED}, {GAPS}, {BASE}, lv AS (SELECT user_id, y, sum(CASE WHEN gap IS NULL THEN 0 ELSE greatest(1, round_even(gap / base_gap, 0)) END) OVER (PARTITION BY user_id ORDER BY y, x) AS level FROM gp JOIN bg USING (user_id))
    SELECT user_id, {sql_rnd('y', 4)} AS y, CAST(level AS BIGINT) AS level, {sql_rnd('(max(level) OVER (PARTITION BY user_id) - level) * 30.48', 4)} AS relative_height FROM lv""",
)
def w08(t):
    g = Fit.gaps(merged(t), ["user_id"])
    base = Fit.base_gap(g, ["user_id"])
    leveled = Fit.band_levels(g.join(base.select("user_id", "base_gap"), "user_id"), ["user_id"])
    return rounded(leveled.select("user_id", "y", "level", "relative_height"), 4)


@query(
    "a15_sequence_metrics",
    f"""WITH {MARKS}, {MERGED}, {GAPS}, {BASE}, j AS (SELECT gp.*, base_gap FROM gp JOIN bg USING (user_id)),
    f AS (SELECT user_id, regr_slope(x, y) AS b, regr_intercept(x, y) AS a FROM j GROUP BY 1),
    q AS (SELECT user_id, count(*) AS marks, max(base_gap) AS base_gap, quantile_cont(abs(gap / base_gap - 1), 0.5) AS regularity,
      sqrt(avg((x - a - b * y) ** 2)) AS line_rmse, max(y) - min(y) AS span FROM j JOIN f USING (user_id) GROUP BY 1)
    SELECT user_id, marks, {sql_rnd('base_gap', 4)} AS base_gap, {sql_rnd('regularity', 4)} AS regularity, {sql_rnd('line_rmse', 4)} AS line_rmse, {sql_rnd('span', 4)} AS span,
      marks >= 4 AND line_rmse <= 8 AND regularity <= 0.32 AND span >= 90 AS accepted FROM q""",
)
def a15(t):
    m = merged(t)
    base = Fit.base_gap(Fit.gaps(m, ["user_id"]), ["user_id"])
    return rounded(Fit.sequence_metrics(m, ["user_id"], base), 4)


@query("j13_pair_seeded_line")
def j13(t):
    """Bands about 24 px apart on one pole, with the error events scattered beside it."""
    rows = number_rows(t.events.select("user_id", "event_id", "event_type", "ts", "value"), EVENT_ORDER)
    beside = F.col("event_type") == "error"
    e = F.col("event_id")
    rows = rows.select(
        "user_id",
        "event_id",
        (F.col("sequence_number") * 24 + F.col("value") % 4).alias("y"),
        F.when(beside, F.lit(350) + F.col("value") * 5).otherwise(F.lit(320) + e % 7 * 0.8).alias("x"),
        (F.lit(50) + e % 13).cast("double").alias("area"),
        (F.lit(1) + e % 11).cast("double").alias("component_score"),
    )
    return rounded(pole_sequences(rows, ["user_id"], ["y", "event_id"]), 4)
