"""Causal window forecasts and increments over keyed, irregularly spaced series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import SeriesOrder, micros, previous, with_halo, without_halo

US_PER_DAY = 86_400_000_000
MIN_ELAPSED_DAYS = 1e-6


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(US_PER_DAY))


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed days with the floor used by every sequential estimator; 0 on the first row."""
    raw = days_between(later, earlier)
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(MIN_ELAPSED_DAYS))).otherwise(F.lit(0.0))


def increments(df: DataFrame, by: SeriesOrder, value: str) -> DataFrame:
    """Consecutive changes with positive spacing: ``dt_days``, ``dv``, ``dv_per_sqrt_day``."""
    time = by.order[0]
    return (
        previous(df, by, {"prev_time": (time, 1), "prev_value": (value, 1)})
        .withColumn("dt_days", days_between(time, "prev_time"))
        .filter(F.col("dt_days") > 0)
        .withColumn("dv", F.col(value) - F.col("prev_value"))
        .withColumn("dv_per_sqrt_day", F.col("dv") / F.sqrt("dt_days"))
    )


def naive_forecasts(
    df: DataFrame,
    by: SeriesOrder,
    value: str,
    min_slope: float = -4.0,
    max_slope: float = 15.0,
    first_is_itself: bool = False,
) -> DataFrame:
    """Last observation carried forward, and the clipped two-point line, for every row.

    The line needs two earlier rows and otherwise repeats the last observation; a pair without
    positive spacing has slope 0.
    """
    time = by.order[0]
    lagged = previous(
        df,
        by,
        {
            "__t1": (time, 1),
            "__v1": (value, 1),
            "__t2": (time, 2),
            "__v2": (value, 2),
        },
    )
    spacing = days_between("__t1", "__t2")
    slope = F.when(spacing > 0, (F.col("__v1") - F.col("__v2")) / spacing).otherwise(F.lit(0.0))
    slope = F.least(F.greatest(slope, F.lit(min_slope)), F.lit(max_slope))
    line = F.col("__v1") + slope * elapsed_days(time, "__t1")
    last = F.coalesce("__v1", value) if first_is_itself else F.col("__v1")
    return (
        lagged.withColumn("last_observation", last)
        .withColumn(
            "two_point_line", F.when(F.col("__v2").isNotNull(), line).otherwise(F.col("__v1"))
        )
        .withColumn("elapsed_days", elapsed_days(time, "__t1"))
        .drop("__t1", "__v1", "__t2", "__v2")
    )


def running_median(df: DataFrame, by: SeriesOrder, value: str, size: int = 3) -> DataFrame:
    """Median of the current and the ``size - 1`` preceding values."""
    wide = with_halo(df, by, [value], size - 1)
    frame = by.window().rowsBetween(1 - size, 0)
    return without_halo(
        wide.withColumn("running_median", F.percentile(F.col(value), F.lit(0.5)).over(frame))
    )
