"""Error, calibration and design summaries. Every group is reduced map-side before it is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scoring import covered
from seriesloom.operators.ordering import SeriesOrder, previous
from seriesloom.operators.quantiles import exact_quantiles, quantile_columns
from seriesloom.operators.windows import days_between, increments


def long_errors(
    df: DataFrame, truth: str, estimates: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per (row, estimator) with ``error`` = estimate - truth; complete pairs only."""
    pairs = ", ".join(f"'{e}', CAST(`{e}` AS double)" for e in estimates)
    kept = list(dict.fromkeys([*keep, truth]))
    return (
        df.selectExpr(
            *[f"`{c}`" for c in kept], f"stack({len(estimates)}, {pairs}) AS (estimator, estimate)"
        )
        .filter(F.col(truth).isNotNull() & F.col("estimate").isNotNull())
        .withColumn("error", F.col("estimate") - F.col(truth))
    )


def _error_aggs(error: Column) -> list[Column]:
    return [
        F.count(error).alias("n"),
        F.avg(error).alias("bias"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    ]


def error_metrics(
    df: DataFrame,
    truth: str,
    estimates: Sequence[str],
    by: Sequence[str] = (),
    corr: bool = False,
) -> DataFrame:
    """n, bias, MAE, RMSE (and Pearson r) per estimator and optional group."""
    rows = long_errors(df, truth, estimates, by)
    aggs = _error_aggs(F.col("error"))
    if corr:
        aggs.append(F.corr("estimate", F.col(truth).cast("double")).alias("pearson_r"))
    return rows.groupBy(*by, "estimator").agg(*aggs)


def interval_calibration(
    df: DataFrame,
    truth: str,
    intervals: Mapping[int, tuple[str, str]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Coverage and width of central intervals given as ``{percent: (lower, upper)}``."""
    by = list(by)
    parts = ", ".join(f"{level}L, `{lo}`, `{hi}`" for level, (lo, hi) in intervals.items())
    rows = df.selectExpr(
        *[f"`{c}`" for c in dict.fromkeys([*by, truth])],
        f"stack({len(intervals)}, {parts}) AS (level_percent, lower, upper)",
    ).filter(f"`{truth}` IS NOT NULL AND lower IS NOT NULL AND upper IS NOT NULL")
    y, lower, upper = F.col(truth), F.col("lower"), F.col("upper")
    rows = rows.withColumn("width", upper - lower)
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    summary = rows.groupBy(*by, "level_percent").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(one(covered(y, lower, upper))).alias("covered"),
        F.sum(one(y < lower)).alias("below"),
        F.sum(one(y > upper)).alias("above"),
        F.avg("width").alias("mean_width"),
    )
    medians = quantile_columns(rows, [*by, "level_percent"], "width", {"median_width": 0.5})
    keys = [*by, "level_percent"]
    return summary.join(medians, keys).select(
        *keys,
        (F.col("level_percent") / 100.0).alias("nominal_coverage"),
        "n",
        "covered",
        (F.col("covered") / F.col("n")).alias("coverage"),
        "below",
        "above",
        "mean_width",
        "median_width",
    )


_FORECAST_AGGS = lambda error, entity, cluster: [
    F.count(F.lit(1)).alias("n"),
    F.countDistinct(entity).alias("entities"),
    F.countDistinct(cluster).alias("clusters"),
    F.avg(error).alias("bias"),
    F.avg(F.abs(error)).alias("mae"),
    F.sqrt(F.avg(error * error)).alias("rmse"),
    F.avg("log_score").alias("mean_log_score"),
    F.avg("wis").alias("mean_wis"),
    F.avg("pit").alias("mean_pit"),
]


def forecast_summary(
    df: DataFrame, truth: str, mean: str, entity: str, cluster: str, by: Sequence[str] = ()
) -> DataFrame:
    """Probabilistic summary of rows that carry ``log_score``, ``wis`` and ``pit``."""
    return df.groupBy(*by).agg(*_FORECAST_AGGS(F.col(mean) - F.col(truth), entity, cluster))


def grouping_summary(
    df: DataFrame, sets: Sequence[Sequence[str]], truth: str, mean: str, entity: str, cluster: str
) -> DataFrame:
    """The same summary for several overlapping groupings in one pass; absent keys are NULL."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    error = F.col(mean) - F.col(truth)
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.grouping_id(*keys).alias("grouping_id"), *_FORECAST_AGGS(error, entity, cluster)
    )


def cluster_summary(df: DataFrame, error: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Average within clusters first, then across clusters with equal weight."""
    within = df.groupBy(*by, cluster).agg(*_error_aggs(F.col(error)))
    return within.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum("n").alias("n_rows"),
        F.avg("bias").alias("bias_mean"),
        F.stddev_samp("bias").alias("bias_sd"),
        F.avg("mae").alias("mae_mean"),
        F.avg("rmse").alias("rmse_mean"),
    )


def entity_metrics(
    df: DataFrame,
    entity: str,
    truth: str,
    estimate: str,
    rate_truth: str,
    rate: str,
    lower: str,
    upper: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Recovery of a known truth: per entity, then the mean over entities."""
    e, r = F.col(estimate) - F.col(truth), F.col(rate) - F.col(rate_truth)
    inside = F.when(covered(F.col(truth), F.col(lower), F.col(upper)), 1.0).otherwise(0.0)
    each = df.groupBy(*by, entity).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(e).alias("bias"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(r).alias("rate_bias"),
        F.sqrt(F.avg(r * r)).alias("rate_rmse"),
        F.avg(inside).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("width"),
    )
    names = ["bias", "mae", "rmse", "rate_bias", "rate_rmse", "coverage", "width"]
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("rows").alias("n_rows"),
        *[F.avg(c).alias(c) for c in names],
    )


def position_metrics(
    df: DataFrame, index: str, count: str, truth: str, estimate: str, lower: str, upper: str
) -> DataFrame:
    """RMSE and coverage in the first and last third of each series (index starts at 0)."""
    share = F.col(index) / F.greatest(F.col(count) - 1, F.lit(1))
    part = F.when(share <= F.lit(1 / 3), "first_third").when(share >= F.lit(2 / 3), "last_third")
    e = F.col(estimate) - F.col(truth)
    return (
        df.withColumn("position", part)
        .filter(F.col("position").isNotNull())
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(
                F.when(covered(F.col(truth), F.col(lower), F.col(upper)), 1.0).otherwise(0.0)
            ).alias("coverage"),
        )
    )


def error_quantiles(
    df: DataFrame, truth: str, estimates: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles of the absolute error per estimator."""
    rows = long_errors(df, truth, estimates).withColumn("abs_error", F.abs("error"))
    return exact_quantiles(rows, ["estimator"], "abs_error", probabilities).withColumnRenamed(
        "quantile", "abs_error"
    )


def leave_one_out(df: DataFrame, cluster: str, truth: str, left: str, right: str) -> DataFrame:
    """MAE of two estimators with each cluster omitted, from cluster sums (no second scan)."""
    sums = df.groupBy(F.col(cluster).alias("omitted")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(F.col(left) - F.col(truth))).alias("l"),
        F.sum(F.abs(F.col(right) - F.col(truth))).alias("r"),
    )
    total = sums.agg(
        F.struct(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("r").alias("r"))
    ).scalar()
    kept = total["n"] - F.col("n")
    return sums.select(
        "omitted",
        kept.alias("n_retained"),
        ((total["l"] - F.col("l")) / kept).alias("left_mae"),
        ((total["r"] - F.col("r")) / kept).alias("right_mae"),
    ).withColumn("mae_gain", F.col("left_mae") - F.col("right_mae"))


def influence_range(omissions: DataFrame) -> DataFrame:
    return omissions.agg(
        F.count(F.lit(1)).alias("omissions"),
        F.min("mae_gain").alias("min_gain"),
        F.min_by("omitted", F.struct("mae_gain", "omitted")).alias("min_omitted"),
        F.max("mae_gain").alias("max_gain"),
        F.max_by("omitted", F.struct("mae_gain", -F.col("omitted"))).alias("max_omitted"),
        F.bool_and(F.col("mae_gain") > 0).alias("all_positive"),
    )


def _median(df: DataFrame, value: str | Column) -> Column:
    return exact_quantiles(df, [], value, [0.5]).select("quantile").scalar()


MAD_TO_SD = 1.4826


def robust_process_scale(df: DataFrame, by: SeriesOrder, value: str) -> DataFrame:
    """1.4826 times the median absolute deviation of changes scaled by the root of their spacing."""
    steps = increments(df, by, value)
    centre = _median(steps, "dv_per_sqrt_day")
    spread = exact_quantiles(steps, [], F.abs(F.col("dv_per_sqrt_day") - centre), [0.5])
    return spread.select((MAD_TO_SD * F.col("quantile")).alias("process_scale"), "n")


def calibrate_noise(
    df: DataFrame,
    by: SeriesOrder,
    value: str,
    nominal_days: float = 7.0,
    tolerance_days: float = 1.0,
    z_limit: float = 3.0,
    minimum: int = 20,
) -> DataFrame:
    """Core/tail split of changes at the nominal spacing; status ``too_few`` below ``minimum``."""
    steps = increments(df, by, value).filter(
        F.col("dt_days").between(nominal_days - tolerance_days, nominal_days + tolerance_days)
    )
    centre = _median(steps, "dv")
    spread = F.lit(MAD_TO_SD) * _median(steps, F.abs(F.col("dv") - centre))
    tail = F.abs((F.col("dv") - centre) / spread) > z_limit
    out = F.when(tail, F.col("dv"))
    summary = steps.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(out).alias("n_outliers"),
        (F.stddev_samp(F.when(~tail, F.col("dv"))) / F.sqrt(F.lit(nominal_days))).alias("process_sd"),
        F.stddev_samp(out).alias("__tail_sd"),
        F.avg(F.abs(out)).alias("__tail_abs"),
        F.avg("dv").alias("mean_change"),
    )
    enough = F.col("n") >= minimum
    keep = lambda c: F.when(enough, c)
    return summary.select(
        F.when(enough, "ok").otherwise("too_few").alias("status"),
        "n",
        keep(F.col("n_outliers")).alias("n_outliers"),
        keep(F.col("n_outliers") / F.col("n")).alias("outlier_share"),
        keep(F.col("process_sd")).alias("process_sd"),
        keep(F.when(F.col("n_outliers") > 1, F.col("__tail_sd")).otherwise(F.col("__tail_abs"))).alias("outlier_sd"),
        keep(F.col("mean_change")).alias("mean_change"),
    )


def repeatability(df: DataFrame, keys: Sequence[str], image: str, value: str) -> DataFrame:
    """Coefficient of variation and relative range of repeated measurements (two images at least)."""
    return (
        df.groupBy(*keys)
        .agg(
            F.countDistinct(image).alias("images"),
            F.avg(value).alias("mean_value"),
            F.stddev_samp(value).alias("sd_value"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
        )
        .filter("images >= 2")
        .withColumn("cv_percent", 100 * F.col("sd_value") / F.col("mean_value"))
        .withColumn(
            "relative_range_percent",
            100 * (F.col("max_value") - F.col("min_value")) / F.col("mean_value"),
        )
    )


def calibration_audit(
    df: DataFrame, by: str, passed: Column, span: Column, limit: float
) -> DataFrame:
    """Spans of passing fits per camera, and how many exceed the documented limit."""
    rows = df.filter(passed).select(by, span.alias("span"))
    counts = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("passing"),
        F.min("span").alias("min_span"),
        F.max("span").alias("max_span"),
        F.sum(F.when(F.col("span") > limit, 1).otherwise(0).cast("bigint")).alias("exceeding"),
    )
    medians = quantile_columns(rows, [by], "span", {"median_span": 0.5})
    return counts.join(medians, by).withColumn(
        "exceeding_percent", 100.0 * F.col("exceeding") / F.col("passing")
    )


def image_summary(
    frames: DataFrame, candidates: DataFrame, estimates: DataFrame, calibrations: DataFrame, needs_fit: bool = True
) -> DataFrame:
    """Counts per image over three tables; images without rows get zeros.

    An image without a fit passes the calibration only where the mode of calibration needs none.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("bigint"))
    per_candidate = candidates.groupBy("filename").agg(
        F.count(F.lit(1)).alias("candidates"), one(F.col("selected")).alias("assigned")
    )
    per_estimate = estimates.groupBy("filename").agg(
        one(F.col("measurement_used")).alias("measurements_used"),
        one(~F.col("measurement_used")).alias("prediction_only"),
    )
    per_fit = calibrations.groupBy("filename").agg(
        F.max("n_landmarks").cast("bigint").alias("landmarks"),
        F.bool_or("fit_pass").alias("calibration_pass"),
    )
    first = frames.groupBy("camera_id").agg(F.min("capture_datetime").alias("__first"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return (
        frames.join(first, "camera_id")
        .join(per_candidate, "filename", "left")
        .join(per_estimate, "filename", "left")
        .join(per_fit, "filename", "left")
        .select(
            "filename",
            "camera_id",
            F.round(days_between("capture_datetime", "__first"), 6).alias("days_after_first"),
            *[zero(c) for c in ("candidates", "assigned", "measurements_used", "prediction_only", "landmarks")],
            F.coalesce("calibration_pass", F.lit(not needs_fit)).alias("calibration_pass"),
        )
    )


def by_cluster(df: DataFrame, cluster: str, truth: str, left: str, right: str) -> DataFrame:
    """Paired comparison of two estimators per cluster."""
    l, r = F.abs(F.col(left) - F.col(truth)), F.abs(F.col(right) - F.col(truth))
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(l).alias("left_mae"),
        F.avg(r).alias("right_mae"),
        F.avg(l - r).alias("gain"),
        F.avg(F.when(r < l, 1.0).otherwise(0.0)).alias("share_improved"),
    )


def endpoints(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per entity; the limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def design_counts(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Row count and exact distinct counts, e.g. entities, clusters, dates."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.countDistinct(c).alias(name) for name, c in columns.items()],
    )


def distance_trend(df: DataFrame, distance: str, error: str) -> DataFrame:
    """Signed error by distance outside the fitted range."""
    rows = df.select(distance, error)
    stats = rows.groupBy(distance).agg(
        F.count(error).alias("n"), F.avg(error).alias("mean"), F.stddev_samp(error).alias("sd")
    )
    return stats.join(quantile_columns(rows, [distance], error, {"median": 0.5}), distance)


def trend_line(df: DataFrame, distance: str, error: str, at: Sequence[float]) -> DataFrame:
    """Straight-line trend of the error and the error it implies at given distances."""
    fit = df.agg(
        F.regr_slope(error, distance).alias("slope"),
        F.regr_intercept(error, distance).alias("intercept"),
        F.corr(error, distance).alias("corr"),
    )
    return fit.select("*", F.explode(F.array(*[F.lit(float(a)) for a in at])).alias("distance")).withColumn(
        "implied_error", F.col("intercept") + F.col("slope") * F.col("distance")
    )


def pit_histogram(df: DataFrame, pit: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Counts on equal bins of [0, 1]; 1.0 belongs to the last bin and empty bins are kept."""
    bucket = F.least(F.floor(F.col(pit) * bins), F.lit(bins - 1)).cast("int")
    sums = df.filter(F.col(pit).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(bucket == b, 1).otherwise(0).cast("bigint")).alias(f"__{b}") for b in range(bins)],
    )
    cells = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"__{b}").alias("count")) for b in range(bins)])
    return sums.select(*by, "n", F.explode(cells).alias("c")).select(
        *by, "c.bin", "c.count", (F.col("c.count") / F.col("n")).alias("share")
    )


def series_pivot(
    df: DataFrame, time: str | Column, name: str, series: Sequence, value: str, order: Sequence[str]
) -> DataFrame:
    """Time by series table of last values; the series are named, so nothing is collected."""
    last = lambda s: F.max_by(F.when(F.col(name) == s, F.col(value)), F.when(F.col(name) == s, F.struct(*order)))
    t = (F.col(time) if isinstance(time, str) else time).alias("time")
    return df.groupBy(t).agg(*[last(s).alias(f"series_{s}") for s in series])


def growth_field(df: DataFrame, by: SeriesOrder, value: str, edges: Sequence[float]) -> DataFrame:
    """Median rate of change per bin of the starting value: knots of a rate-by-level curve.

    The first and the last bin are open (values below the first edge, and from the last edge on) and
    have no ``level``, so no step is lost.
    """
    steps = increments(df, by, value).withColumn("rate", F.col("dv") / F.col("dt_days"))
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    steps = steps.withColumn("bin", F.width_bucket("prev_value", F.lit(float(edges[0])), F.lit(float(edges[-1])), F.lit(len(edges) - 1)))
    bin_ = F.col("bin").cast("int")
    centre = F.when(bin_.between(1, len(edges) - 1), (F.element_at(bounds, F.greatest(bin_, F.lit(1))) + F.try_element_at(bounds, bin_ + 1)) / 2)
    return exact_quantiles(steps.filter("bin IS NOT NULL"), ["bin"], "rate", [0.5]).select(
        F.col("bin").cast("bigint").alias("bin"), centre.alias("level"), F.col("quantile").alias("rate"), "n"
    )


def keypoint_agreement(
    df: DataFrame, n_truth: Column, scale: float, top: str, root: str, truth: str, estimate: str
) -> DataFrame:
    """Detection rate, end-point errors and extent agreement in pixels and scaled units."""
    e = F.col(estimate) - F.col(truth)
    return df.agg(
        F.count(F.lit(1)).alias("matched"),
        F.avg(top).alias("top_mae_px"),
        F.avg(root).alias("root_mae_px"),
        F.avg(e).alias("bias_px"),
        F.avg(F.abs(e)).alias("mae_px"),
        F.sqrt(F.avg(e * e)).alias("rmse_px"),
        F.corr(estimate, truth).alias("pearson_r"),
    ).select(
        "*",
        (F.col("matched") / n_truth).alias("detection_rate"),
        (F.col("bias_px") * scale).alias("bias_cm"),
        (F.col("mae_px") * scale).alias("mae_cm"),
        (F.col("rmse_px") * scale).alias("rmse_cm"),
    )


def selection_agreement(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    same = F.avg(F.when(F.col(left) == F.col(right), 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), same.alias("agreement"))


def tracking_comparison(
    df: DataFrame, variant: str, by: SeriesOrder, distance: str, value: str
) -> DataFrame:
    """Matches, entities, mean match distance, mean value and mean absolute step per variant."""
    entity = [k for k in by.keys if k != variant]
    lagged = previous(df, by, {"__before": (value, 1)})
    return lagged.groupBy(variant).agg(
        F.count(F.lit(1)).alias("matches"),
        F.countDistinct(*entity).alias("entities"),
        F.avg(distance).alias("mean_distance"),
        F.avg(value).alias("mean_value"),
        F.avg(F.abs(F.col(value) - F.col("__before"))).alias("roughness"),
    )
