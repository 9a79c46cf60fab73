"""Plan-time and run-time contracts, coercions and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import FALLBACK_CAMERA, basename, truthy


class ContractError(ValueError):
    """A table does not have the promised shape."""


def require_columns(df: DataFrame, required: Sequence[str], label: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{label} is missing columns: {', '.join(missing)}")
    return df


def coerce_numeric(df: DataFrame, columns: Sequence[str], fail: bool = False) -> DataFrame:
    """Bad text becomes NULL, or an error when ``fail``. NaN becomes NULL as well."""
    out = {}
    for c in columns:
        cast = F.col(c).try_cast("double")
        cast = F.when(~F.isnan(cast), cast)
        if fail:
            ok = F.col(c).isNull() | cast.isNotNull()
            cast = F.when(ok, cast).otherwise(
                F.raise_error(F.concat(F.lit(f"not a number in {c}: "), F.col(c).cast("string"))).cast("double")
            )
        out[c] = cast
    return df.withColumns(out)


def coerce_timestamp(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in columns})


def eligible(df: DataFrame, keys: Sequence[str], measurement: str, quality: str | None = None) -> DataFrame:
    """Rows with complete keys, a measurement and, where named, a true quality flag."""
    keep = F.col(measurement).isNotNull()
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    if quality:
        keep = keep & truthy(F.col(quality))
    return df.filter(keep)


def composite_key(columns: Sequence[str]) -> Column:
    """``a::b``, NULL where a part is missing."""
    parts = [F.col(c).cast("string") for c in columns]
    expr = parts[0]
    for p in parts[1:]:
        expr = F.concat(expr, F.lit("::"), p)
    return expr


# Accepted spellings of the date-table columns.
DATE_ALIASES = {
    "image": "filename",
    "file": "filename",
    "date": "capture_datetime",
    "datetime": "capture_datetime",
    "camera": "camera_id",
    "plot": "camera_id",
}


def normalize_dates(supplied: DataFrame, base: DataFrame) -> DataFrame:
    """Dates for the files of ``base`` from a table with any accepted column spelling."""
    names = {c: DATE_ALIASES.get(c.strip().lower(), c) for c in supplied.columns}
    table = supplied.withColumnsRenamed(names)
    require_columns(table, ["filename", "capture_datetime"], "date table")
    if "camera_id" not in table.columns:
        table = table.withColumn("camera_id", F.lit(FALLBACK_CAMERA))
    table = table.select(
        basename(F.col("filename").cast("string")).alias("filename"),
        F.col("capture_datetime").cast("string").alias("capture_datetime"),
        F.col("camera_id").cast("string").alias("camera_id"),
    )
    return base.select("filename").join(table, "filename", "left").select(
        "filename",
        F.coalesce("capture_datetime", F.lit("")).alias("capture_datetime"),
        F.coalesce("camera_id", F.lit(FALLBACK_CAMERA)).alias("camera_id"),
    )


def clean_candidates(
    df: DataFrame,
    min_height: float = 20.0,
    min_root_fraction: float = 0.35,
    min_width: float = 5.0,
    aspect: tuple[float, float] = (0.4, 25.0),
) -> DataFrame:
    """Clip boxes to the image and key points to boxes, then drop implausible detections."""
    corners = ["box_x1", "box_y1", "box_x2", "box_y2", "x_top", "y_top", "x_root", "y_root"]
    # A sum that is NULL, NaN or infinite has such a part; finite pixels cannot overflow it.
    finite = sum((F.col(c) for c in corners[1:]), F.col(corners[0])) * 0.0 == 0.0
    clip = lambda c, lo, hi: F.least(F.greatest(F.col(c), lo), hi)
    right, bottom = F.col("image_width") - 1.0, F.col("image_height") - 1.0
    zero = F.lit(0.0)
    boxed = df.filter(finite).withColumns(
        {
            "box_x1": clip("box_x1", zero, right),
            "box_x2": clip("box_x2", zero, right),
            "box_y1": clip("box_y1", zero, bottom),
            "box_y2": clip("box_y2", zero, bottom),
        }
    )
    x1, x2, y1, y2 = (F.col(c) for c in ("box_x1", "box_x2", "box_y1", "box_y2"))
    points = boxed.withColumns(
        {
            "x_top": clip("x_top", x1, x2),
            "x_root": clip("x_root", x1, x2),
            "y_top": clip("y_top", y1, y2),
            "y_root": clip("y_root", y1, y2),
        }
    )
    width, ratio = x2 - x1, (y2 - y1) / F.greatest(x2 - x1, F.lit(1.0))
    return points.withColumn(
        "height_px", F.greatest(F.col("y_root") - F.col("y_top"), zero)
    ).filter(
        (width > 0)
        & (y2 > y1)
        & (F.col("height_px") >= min_height)
        & (F.col("y_root") >= min_root_fraction * F.col("image_height"))
        & (width >= min_width)
        & ratio.between(*aspect)
    )


def primary_quality(
    fit_pass: Column, all_verified: Column, depth: Column, endpoint: Column, bands: Column
) -> Column:
    """All five conditions of a primary measurement; a missing one counts as failed."""
    word = lambda c: F.lower(F.trim(c))
    return F.coalesce(
        fit_pass & all_verified & (word(depth) == "same") & (word(endpoint) == "verified") & (bands <= 0),
        F.lit(False),
    )


def split_by_year(df: DataFrame, time: str, development: int, locked: int) -> DataFrame:
    """One row per named split a row belongs to: ``all`` and, by year, one more."""
    year = F.year(time)
    names = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(year == development, "development").when(year == locked, "locked_test"),
        )
    )
    return df.withColumn("split", F.explode(names))


def exclude_known(df: DataFrame, exclusions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and a log of the keys that were dropped."""
    kept = df.join(exclusions.select(key), key, "left_anti")
    log = exclusions.join(df.select(key), key, "left_semi")
    return kept, log


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise ContractError(f"keys {list(keys)} occur more than once, e.g. {bad[0].asDict()}")
    return df


def count_contract(df: DataFrame, expected: Mapping[str, int], counts: Mapping[str, Column]) -> DataFrame:
    """Observed against expected cardinalities, one row per named count."""
    observed = df.agg(*[counts[k].cast("bigint").alias(k) for k in expected])
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("what"),
                F.lit(v).cast("bigint").alias("expected"),
                F.col(k).alias("observed"),
            )
            for k, v in expected.items()
        ]
    )
    return observed.select(F.explode(cells).alias("c")).select(
        "c.*", (F.col("c.expected") == F.col("c.observed")).alias("ok")
    )


def assert_counts(df: DataFrame, expected: Mapping[str, int], counts: Mapping[str, Column]) -> DataFrame:
    bad = count_contract(df, expected, counts).filter("NOT ok").collect()
    if bad:
        raise ContractError("; ".join(f"{r.what}: {r.observed} instead of {r.expected}" for r in bad))
    return df
