"""Scalar column functions: names, dates, geometry, measurement budgets, text rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.operators.ordering import micros

# Formats of capture times in file names, and defaults of their missing parts.
DASHED_TIME = r"(20\d{2})[-_](\d{2})[-_](\d{2})(?:[-_](\d{2})[-_](\d{2})(?:[-_](\d{2}))?)?"
COMPACT_DATE = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
DEFAULT_HOUR = 12
HEADER_TIME = r"(\d{1,2})/(\d{1,2})\s*;\s*(\d{1,2}):(\d{2})\s*([APap][Mm])?"
HEADER_ZONE = "America/Chicago"
TRUE_WORDS = ("true", "1", "yes")
FT_TO_CM = 30.48
FALLBACK_CAMERA = "camera_1"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def safe_id(text: Column) -> Column:
    """Runs of characters outside ``[A-Za-z0-9._-]`` become one underscore; ``.`` and ``_`` are
    stripped from the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def capture_time(path: Column) -> Column:
    """Acquisition time from a file name; an impossible date falls through to the next format."""
    name = basename(path)
    d = [_part(name, DASHED_TIME, g) for g in range(1, 7)]
    c = [_part(name, COMPACT_DATE, g) for g in range(1, 4)]
    zero = F.lit(0)
    dashed = F.try_make_timestamp_ntz(
        d[0], d[1], d[2],
        F.coalesce(d[3], F.lit(DEFAULT_HOUR)), F.coalesce(d[4], zero), F.coalesce(d[5], zero),
    )
    compact = F.try_make_timestamp_ntz(c[0], c[1], c[2], F.lit(DEFAULT_HOUR), zero, zero)
    return F.coalesce(dashed, compact)


def header_time(text: Column, year: int) -> Column:
    """``M/D ; H:MM [am/pm]`` in the fixed zone, as an instant."""
    month, day, hour, minute = [_part(text, HEADER_TIME, g) for g in range(1, 5)]
    half = F.lower(F.regexp_extract(text, HEADER_TIME, 5))
    hour = (
        F.when((half == "pm") & (hour != 12), hour + 12)
        .when((half == "am") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    return F.try_make_timestamp(
        F.lit(year), month, day, hour, minute, F.lit(0), F.lit(HEADER_ZONE)
    )


def image_keys(name: Column, year: int) -> dict[str, Column]:
    """Camera, day and role of an image from its name."""
    camera = F.nullif(F.regexp_extract(name, r"(?i)C-(\d{3})", 1), F.lit(""))
    month = F.nullif(F.regexp_extract(name, rf"{year}-(\d{{2}})-(\d{{2}})", 1), F.lit(""))
    day = F.nullif(F.regexp_extract(name, rf"{year}-(\d{{2}})-(\d{{2}})", 2), F.lit(""))
    role = F.when(name.rlike(r"^C-\d{3}_"), "field_date_image").otherwise("installation_reference")
    return {
        "camera": F.concat(F.lit("C_"), camera),
        "day": F.concat(month, F.lit("_"), day),
        "image_role": role,
    }


def pad_camera(name: Column) -> Column:
    """``C_4`` becomes ``C_004``."""
    parts = F.split(name, "_")
    return F.concat_ws("_", parts[0], F.lpad(parts[1].cast("int").cast("string"), 3, "0"))


def stable_seed(label: Column, base_seed: int) -> Column:
    """First eight bytes of SHA-256(``seed|label``), little-endian, modulo 2^32 - 1."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(base_seed)), label.cast("string")), 256)
    total = F.lit(0).cast("decimal(38,0)")
    for byte in range(8):
        value = F.conv(F.substring(digest, 2 * byte + 1, 2), 16, 10).cast("decimal(38,0)")
        total = (total + value * F.lit(256**byte).cast("decimal(20,0)")).cast("decimal(38,0)")
    return (total % F.lit(2**32 - 1).cast("decimal(20,0)")).cast("bigint")


def polyline_points(text: Column) -> Column:
    """``"x,y;x,y"`` to ``array<struct<x,y>>``."""
    return F.transform(
        F.split(text, ";"),
        lambda p: F.struct(
            F.try_element_at(F.split(p, ","), F.lit(1)).cast("double").alias("x"),
            F.try_element_at(F.split(p, ","), F.lit(2)).cast("double").alias("y"),
        ),
    )


def polyline_length(points: Column) -> Column:
    steps = F.zip_with(
        F.slice(points, 1, F.size(points) - 1),
        F.slice(points, 2, F.size(points) - 1),
        lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]),
    )
    return F.when(
        F.size(points) >= 2, F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)
    )


def polyline_end(points: Column, lowest_y: bool = True) -> Column:
    """Point with the smallest (or largest) y; the first one wins a tie."""
    sign = 1.0 if lowest_y else -1.0
    ranked = F.transform(
        points, lambda p, i: F.struct((p["y"] * sign).alias("k"), i.alias("i"), p.alias("p"))
    )
    return F.array_min(ranked)["p"]


def elapsed_from_first(time: Column, first: Column) -> Column:
    return F.round((micros(time) - micros(first)) / F.lit(86_400_000_000.0), 6)


def pinhole_scale(distance: Column, focal_px: Column) -> Column:
    """Length per pixel at a distance, from the focal length in pixels."""
    return distance / focal_px


def fixed_scale_extent(top: Column, root: Column, scale: Column | float) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    extent = root - top
    return F.when(extent.isNotNull(), F.greatest(extent, F.lit(0.0)) * scale)


def projective_height(y: Column, a, b, c, y_center, y_scale) -> Column:
    u = (y - y_center) / y_scale
    return (a * u + b) / (c * u + F.lit(1.0))


def depth_correction(height: Column, sd: Column, factor: Column) -> dict[str, Column]:
    return {
        "corrected_height": height * factor,
        "correction_shift": height * factor - height,
        "corrected_sd": sd * factor,
    }


def extrapolation_bands(top: Column, root: Column, low: Column, high: Column, gap: Column) -> Column:
    """How far the end points lie outside the landmark rows, in band widths."""
    return F.greatest(low - top, top - high, low - root, root - high, F.lit(0.0)) / gap


def measurement_sd(
    confidence: Column, fit_rmse: Column, factor: Column, bands: Column, height: Column,
    regularity: Column, base_sd: float = 12.0, per_band: float = 1.5,
) -> Column:
    """Root sum of squares of pose, fit, extrapolation and spacing-regularity parts."""
    parts = [
        F.lit(base_sd) / F.sqrt(F.greatest(confidence, F.lit(0.05))),
        F.lit(2.0**0.5) * fit_rmse * factor,
        bands * F.lit(per_band),
        F.abs(height) * regularity,
    ]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def measurement_qc(height: Column, bands: Column, has_fit: Column) -> Column:
    """Quality label of one measurement."""
    return (
        F.when(~has_fit, "no_past_passing_pole_calibration")
        .when(~((height > 0) & (height <= 450)), "height_out_of_range")
        .when(bands > 3, "pole_extrapolation_over_three_bands")
        .otherwise("pass")
    )


def affine_transfer(extent: Column, intercept, slope, scale: float, ratio: float) -> Column:
    """Fitted affine map of a pixel extent seen from another distance."""
    return intercept + slope * extent * F.lit(scale) * F.lit(ratio)


def piecewise_linear(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation between knots, flat outside them."""
    expr = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        line = F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0))
        expr = expr.when(x <= x1, line)
    return expr.when(x.isNotNull(), F.lit(float(knots[-1][1])))


def global_number(local: Column, side: Column, per_side: int = 6) -> Column:
    """Local number counted from the right: right side first, left side after it."""
    return F.when(side == "R", local).otherwise(local + per_side)


def global_label(side: Column, per_side: int = 6) -> Column:
    return F.when(side == "R", f"1-{per_side}").otherwise(f"{per_side + 1}-{2 * per_side}")


def truthy(value: Column) -> Column:
    """True for ``true``/``1``/``yes`` in any case and spacing; NULL is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def with_override(value: Column, default: float, valid: Column, floor: float | None = None) -> Column:
    """Per-row value where valid, else the global one, with an optional floor."""
    out = F.coalesce(F.when(valid, value), F.lit(default))
    return out if floor is None else F.greatest(out, F.lit(floor))


def replace_all(text: Column, replacements: Mapping[str, str]) -> Column:
    """Literal replacements applied one after the other."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def blank_elements(text: Column, names: Sequence[str], filler: Mapping[str, str] | None = None) -> Column:
    """Empty the content of the named markup elements, or put a fixed filler in its place."""
    for name in names:
        inner = (filler or {}).get(name, "")
        text = F.regexp_replace(text, rf"(?s)<{name}>.*?</{name}>", f"<{name}>{inner}</{name}>")
    return text


def forbidden_matches(text: Column, patterns: Mapping[str, str]) -> Column:
    """``array<struct<label, match>>`` with the first match, not an empty one, of every pattern that occurs."""
    found = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.nullif(F.regexp_extract(text, p, 0), F.lit("")).alias("match"),
            )
            for label, p in patterns.items()
        ]
    )
    return F.filter(found, lambda m: m["match"].isNotNull())
