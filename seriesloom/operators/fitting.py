"""Calibration fits from moments: projective maps, affine maps, band spacing, hold-out residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import FT_TO_CM, projective_height
from seriesloom.operators.ordering import SeriesOrder, number_rows, previous, running
from seriesloom.operators.quantiles import exact_quantiles, quantile_columns
from seriesloom.session import materialize, sorted_by_key


def fit_projective(
    df: DataFrame, keys: Sequence[str], y: str, z: str, max_rmse: float = 0.5, inches: float = 12.0
) -> DataFrame:
    """Per group the map z = (a u + b) / (c u + 1) with u the standardised row position.

    Least squares of z = a u + b - c z u on moments of (u, z), solved by Cramer's rule in columns.
    ``fit_status`` is ``ok``, ``too_few``, ``no_spread``, ``singular``, ``unstable`` or
    ``not_monotone``; the coefficients are NULL unless it is ``ok``.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(y).cast("double").alias("__y"), F.col(z).cast("double").alias("__z"))
    rows = rows.filter("__y IS NOT NULL AND __z IS NOT NULL AND NOT isnan(__y) AND NOT isnan(__z)")
    shape = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_landmarks"),
        F.countDistinct("__z").alias("__distinct"),
        F.avg("__y").alias("y_center"),
        F.stddev_pop("__y").alias("y_scale"),
        F.min("__y").alias("min_y"),
        F.max("__y").alias("max_y"),
        F.min("__z").alias("min_z"),
        F.max("__z").alias("max_z"),
    )
    scale = F.when(F.col("y_scale") > 0, (F.col("__y") - F.col("y_center")) / F.col("y_scale"))
    scaled = rows.join(shape.select(*keys, "y_center", "y_scale"), keys).withColumn("__u", scale)
    u, v = F.col("__u"), F.col("__z")
    moments = scaled.groupBy(*keys).agg(
        F.sum(u).alias("u1"),
        F.sum(u * u).alias("u2"),
        F.sum(v).alias("z1"),
        F.sum(u * v).alias("uz"),
        F.sum(u * u * v).alias("uuz"),
        F.sum(u * v * v).alias("uzz"),
        F.sum(u * u * v * v).alias("uuzz"),
        F.count(F.lit(1)).alias("m"),
    )
    # Normal equations for (a, b, c) with design columns u, 1, -z u. The determinant is compared with the
    # product of the diagonal, so whether a fit is singular does not depend on the unit of z.
    solve = """
        named_struct(
          'det', u2 * (m * uuzz - uz * uz) - u1 * (u1 * uuzz - uuz * uz) + uuz * (u1 * uz - m * uuz),
          'a',   uz * (m * uuzz - uz * uz) - u1 * (z1 * uuzz - uzz * uz) + uuz * (z1 * uz - m * uzz),
          'b',   u2 * (z1 * uuzz - uz * uzz) - uz * (u1 * uuzz - uuz * uz) + uuz * (u1 * uzz - z1 * uuz),
          'c',   - (u2 * (m * uzz - uz * z1) - u1 * (u1 * uzz - uuz * z1) + uz * (u1 * uz - m * uuz)))
    """
    solved = moments.withColumn("s", F.expr(solve)).select(
        *keys,
        *[F.when(F.abs(F.col("s.det")) > 1e-12 * F.col("u2") * F.col("m") * F.col("uuzz"), F.col(f"s.{k}") / F.col("s.det")).alias(k) for k in "abc"],
    )
    # Written out (one row a group): the rows then meet them in a stage of their own, with one sort.
    fits = materialize(shape.join(solved, keys))
    fitted = rows.join(fits.select(*keys, "y_center", "y_scale", "a", "b", "c"), keys).withColumn("__u", scale)
    den = F.col("c") * u + 1.0
    residual = v - (F.col("a") * u + F.col("b")) / den
    quality = fitted.groupBy(*keys).agg(
        F.min(F.abs(den)).alias("__min_den"),
        F.sqrt(F.avg(residual * residual)).alias("__rmse"),
        F.max(F.abs(residual)).alias("__max"),
    )
    status = (
        F.when((F.col("n_landmarks") < 4) | (F.col("__distinct") < 4), "too_few")
        .when(~(F.col("y_scale") > 0), "no_spread")
        .when(F.col("a").isNull(), "singular")
        .when(F.col("__min_den") < 0.1, "unstable")
        .when(F.col("a") - F.col("b") * F.col("c") >= 0, "not_monotone")
        .otherwise("ok")
    )
    ok = F.col("fit_status") == "ok"
    keep = lambda c: F.when(ok, c)
    return (
        fits.join(quality, keys)
        .withColumn("fit_status", status)
        .select(
            *keys,
            "fit_status",
            "n_landmarks",
            *[keep(F.col(c)).alias(c) for c in ("a", "b", "c")],
            "y_center",
            "y_scale",
            "min_y",
            "max_y",
            "min_z",
            "max_z",
            keep(F.col("__rmse")).alias("fit_rmse"),
            keep(F.col("__rmse") * inches).alias("fit_rmse_in"),
            keep(F.col("__max") * inches).alias("fit_max_error_in"),
            (ok & (F.col("__rmse") * inches <= max_rmse)).alias("fit_pass"),
        )
    )


def calibration_table(
    landmarks: DataFrame, keys: Sequence[str], y: str, z: str, depth: str, status: str, max_rmse: float = 0.5
) -> DataFrame:
    """Fits with the median depth and whether every landmark was verified."""
    keys = list(keys)
    good = F.coalesce(F.lower(F.col(status).cast("string")) == "verified", F.lit(False))
    # Written out: the fit and the depths read the landmarks several times.
    rows = materialize(
        landmarks.select(
            *keys,
            F.col(y).cast("double").alias("__y"),
            F.col(z).cast("double").alias("__z"),
            F.col(depth).try_cast("double").alias("__depth"),
            good.alias("__good"),
        )
    )
    fits = fit_projective(rows, keys, "__y", "__z", max_rmse)
    verified = rows.groupBy(*keys).agg(F.bool_and("__good").alias("all_verified"))
    depths = quantile_columns(rows, keys, "__depth", {"median_depth": 0.5}, at_once=4096)
    return fits.join(verified, keys).join(depths, keys, "left")


def band_holdout(
    df: DataFrame, keys: Sequence[str], y: str, z: str, max_dropped: int = 3, minimum: int = 8, fit_minimum: int = 4
) -> DataFrame:
    """Residuals of landmarks predicted by a fit that did not see them.

    Only whole-number heights count. Schemes: every second landmark, upper half from lower half,
    lower half from upper half (``minimum`` landmarks needed), and the lowest k landmarks from the
    rest. Each row is copied once per scheme with its role; then fits run per (group, scheme).
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    rows = rows.filter("y IS NOT NULL AND z IS NOT NULL AND z = rint(z)")
    order = SeriesOrder.by_value(tuple(keys), "z", ("y",), per_unit=8)
    rows = number_rows(rows, order, "i").withColumn("i", F.col("i") - 1)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(totals, keys)
    i, n = F.col("i"), F.col("n")
    half = F.floor(n / 2)
    cell = lambda name, use, fit: F.when(use, F.struct(F.lit(name).alias("scheme"), fit.alias("in_fit")))
    schemes = [
        cell("interpolation_alternating", n >= minimum, i % 2 == 0),
        cell("extrapolation_lower_to_upper", n >= minimum, i < half),
        cell("extrapolation_upper_to_lower", n >= minimum, i >= n - half),
    ]
    for k in range(1, max_dropped + 1):
        schemes.append(cell(f"drop_lowest_{k}", n >= fit_minimum + k, i >= k))
    rows = rows.withColumn("s", F.explode(F.array_compact(F.array(*schemes)))).select("*", "s.*").drop("s")
    by = [*keys, "scheme"]
    fits = fit_projective(rows.filter("in_fit"), by, "y", "z").filter("fit_status = 'ok'")
    held = rows.filter("NOT in_fit").join(fits.select(*by, "a", "b", "c", "y_center", "y_scale", "min_z", "n_landmarks"), by)
    predicted = projective_height(F.col("y"), *[F.col(c) for c in ("a", "b", "c", "y_center", "y_scale")])
    return held.withColumn("predicted", predicted).select(
        *by,
        "y",
        F.col("z").alias("true_height"),
        "predicted",
        (F.col("predicted") - F.col("z")).alias("error_ft"),
        ((F.col("predicted") - F.col("z")) * 12.0).alias("error_in"),
        ((F.col("predicted") - F.col("z")) * FT_TO_CM).alias("error_cm"),
        (F.col("min_z") - F.col("z")).alias("below_ft"),
        F.col("n_landmarks").alias("fit_n"),
    )


def fit_affine_loco(df: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """Straight line y = intercept + slope x per omitted cluster, and for no omission (NULL).

    A fold is the total moments minus those of the cluster. ``cv_sse`` and ``cv_n`` are the squared
    error and count of the omitted cluster under the line that did not see it.
    """
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.filter(X.isNotNull() & Y.isNotNull()).groupBy(F.col(cluster).alias("omitted")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(X).alias("x"),
        F.sum(Y).alias("y"),
        F.sum(X * X).alias("xx"),
        F.sum(X * Y).alias("xy"),
        F.sum(Y * Y).alias("yy"),
    )
    names = ("n", "x", "y", "xx", "xy", "yy")
    total = sums.agg(F.struct(*[F.sum(c).alias(c) for c in names])).scalar()
    none = {c: F.lit(0.0).alias(c) for c in names}
    folds = sums.withColumn("__t", total)
    whole = folds.limit(1).select(F.lit(None).cast(dict(df.dtypes)[cluster]).alias("omitted"), *none.values(), "__t")
    folds = folds.unionByName(whole)
    f = {c: F.col(f"__t.{c}") - F.col(c) for c in names}
    den = f["n"] * f["xx"] - f["x"] * f["x"]
    slope = (f["n"] * f["xy"] - f["x"] * f["y"]) / den
    lines = folds.withColumn("slope", slope).withColumn("intercept", (f["y"] - F.col("slope") * f["x"]) / f["n"])
    a, b = F.col("intercept"), F.col("slope")
    sse = (
        F.col("yy") + F.col("n") * a * a + b * b * F.col("xx")
        - 2 * a * F.col("y") - 2 * b * F.col("xy") + 2 * a * b * F.col("x")
    )
    return lines.select(
        "omitted", "intercept", "slope", F.col("n").cast("bigint").alias("cv_n"), F.greatest(sse, F.lit(0.0)).alias("cv_sse")
    )


def loco_predictions(df: DataFrame, folds: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """Every row predicted by the line fitted without its cluster."""
    lines = folds.filter("omitted IS NOT NULL").select(F.col("omitted").alias(cluster), "intercept", "slope")
    return df.join(lines, cluster).withColumn(
        "cv_prediction", F.col("intercept") + F.col("slope") * F.col(x)
    ).withColumn("cv_error", F.col("cv_prediction") - F.col(y))


# --- band sequences -------------------------------------------------------------------------------


def merge_close(df: DataFrame, keys: Sequence[str], limit: float = 8.0, ties: Sequence[str] = ("x",)) -> DataFrame:
    """Chain marks whose rows are at most ``limit`` apart into one area-weighted mark.

    Marks of a chain are added in their order, so that the last bits of the mark are the same in each run.
    """
    keys = list(keys)
    order = SeriesOrder.by_value(tuple(keys), "y", tuple(ties))
    marks = previous(df, order, {"__y1": ("y", 1)})
    starts = F.when(F.col("y") - F.col("__y1") <= limit, 0).otherwise(1).cast("bigint")
    marks = running(marks, order, {"island": ("sum", starts)})
    area = F.col("area")
    # The sort is by task and spills; sums then need no further exchange and see a chain's marks from top to bottom.
    marks = sorted_by_key(marks, [*keys, "island"], ["y", *ties])
    return marks.groupBy(*keys, "island").agg(
        (F.sum(F.col("x") * area) / F.sum(area)).alias("x"),
        (F.sum(F.col("y") * area) / F.sum(area)).alias("y"),
        F.sum(area).alias("area"),
        F.max("component_score").alias("component_score"),
    )


def gaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance of each mark to the previous one of its group."""
    order = SeriesOrder.by_value(tuple(keys), "y", ("x",))
    return previous(df, order, {"__y1": ("y", 1)}).withColumn("gap", F.col("y") - F.col("__y1"))


# The search grid of spacings and the relative match.
GRID_FROM, GRID_TO, GRID_SIZE, GRID_MATCH = 18.0, 110.0, 185, 0.22


def base_gap(df: DataFrame, keys: Sequence[str], gap: str = "gap") -> DataFrame:
    """Spacing that explains most gaps: best grid value by (matches, smallest median relative
    error, value), refined to the median of its matching gaps.

    Each gap is copied only to the grid values it matches, and copies are counted map-side. Medians are
    taken only for grid values with the most matches of their group. What several later steps read is
    written out.
    """
    keys = list(keys)
    useful = materialize(
        df.select(*keys, F.col(gap).cast("double").alias("g")).filter(
            F.col("g").between(GRID_FROM, GRID_TO)
        )
    )
    step = (GRID_TO - GRID_FROM) / (GRID_SIZE - 1)
    g = F.col("g")
    rel = F.abs(g / F.col("candidate") - 1)
    low = F.greatest(F.floor((g / (1 + GRID_MATCH) - GRID_FROM) / step) - 1, F.lit(0))
    high = F.least(F.ceil((g / (1 - GRID_MATCH) - GRID_FROM) / step) + 1, F.lit(GRID_SIZE - 1))
    matched = (
        useful.withColumn("__k", F.explode(F.sequence(low, high)))
        .withColumn("candidate", F.lit(GRID_FROM) + F.col("__k") * F.lit(step))
        .filter(rel <= GRID_MATCH)
    )
    enough = useful.groupBy(*keys).agg(F.count(F.lit(1)).alias("useful")).filter("useful >= 3")
    votes = matched.groupBy(*keys, "candidate").agg(F.count(F.lit(1)).alias("votes")).filter("votes >= 2")
    # A list holds at most the grid.
    most = votes.groupBy(*keys).agg(F.collect_list(F.struct("votes", "candidate")).alias("all"))
    top = materialize(
        most.join(enough, keys, "left_semi")
        .select(*keys, F.explode(F.expr("filter(all, x -> x.votes = array_max(all).votes)")).alias("t"))
        .select(*keys, "t.*")
    )
    near = useful.join(top, keys).filter(rel <= GRID_MATCH)
    medians = exact_quantiles(near, [*keys, "candidate", "votes"], rel, [0.5])
    best = materialize(
        medians.groupBy(*keys)
        .agg(F.max(F.struct((-F.col("quantile")).alias("q"), "candidate", "votes")).alias("b"))
        .select(*keys, F.col("b.candidate").alias("candidate"), F.col("b.votes").alias("votes"))
    )
    final = useful.join(best, keys).filter(F.abs(g / F.col("candidate") - 1) <= GRID_MATCH)
    return materialize(best.join(quantile_columns(final, keys, "g", {"base_gap": 0.5}), keys))


# Accepted ratio of a gap to the base spacing inside a run.
RUN_LOW, RUN_HIGH = 0.68, 1.36


def best_run(df: DataFrame, keys: Sequence[str], base: DataFrame) -> DataFrame:
    """Marks of the best unbroken run per group, by (length, summed score, span, lowest start)."""
    keys = list(keys)
    order = SeriesOrder.by_value(tuple(keys), "y", ("x",))
    marks = materialize(gaps(df, keys).join(base.select(*keys, "base_gap"), keys))
    ratio = F.col("gap") / F.col("base_gap")
    breaks = F.when(ratio.between(RUN_LOW, RUN_HIGH), 0).otherwise(1).cast("bigint")
    marks = materialize(running(marks, order, {"run": ("sum", breaks)}))
    runs = marks.groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("len"),
        F.sum("component_score").alias("score"),
        (F.max("y") - F.min("y")).alias("span"),
    )
    best = runs.groupBy(*keys).agg(
        F.max(F.struct("len", F.round("score", 9).alias("score"), F.round("span", 9).alias("span"), (-F.col("run")).alias("r"))).alias("b")
    )
    chosen = best.select(*keys, (-F.col("b.r")).alias("run"))
    return marks.join(chosen, [*keys, "run"], "left_semi").drop("run", "__y1")


def band_levels(df: DataFrame, keys: Sequence[str], interval: float = FT_TO_CM) -> DataFrame:
    """Integer level of each mark counted from the top, and its height above the lowest mark.

    A gap of about two spacings advances two levels. Ties of the rounding go to the even number.
    """
    keys = list(keys)
    order = SeriesOrder.by_value(tuple(keys), "y", ("x",))
    step = F.when(F.col("gap").isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(1.0), F.rint(F.col("gap") / F.col("base_gap")))
    )
    levels = materialize(running(materialize(df), order, {"level": ("sum", step.cast("bigint"))}))
    deepest = levels.groupBy(*keys).agg(F.max("level").alias("__max"))
    return (
        levels.join(deepest, keys)
        .withColumn("relative_height", (F.col("__max") - F.col("level")) * F.lit(interval))
        .drop("__max")
    )


def sequence_metrics(df: DataFrame, keys: Sequence[str], base: DataFrame) -> DataFrame:
    """Straightness, spacing regularity and span of a mark sequence, with the accept rule."""
    keys = list(keys)
    marks = materialize(gaps(df, keys).join(base.select(*keys, "base_gap"), keys))
    line = marks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("marks"),
        F.first("base_gap").alias("base_gap"),
        F.regr_sxx("x", "y").alias("sxx"),
        F.regr_sxy("x", "y").alias("sxy"),
        F.regr_syy("x", "y").alias("syy"),
        (F.max("y") - F.min("y")).alias("span"),
    )
    residual = F.abs(F.col("gap") / F.col("base_gap") - 1)
    regular = quantile_columns(marks, keys, residual, {"regularity": 0.5})
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    return (
        line.join(regular, keys)
        .withColumn("line_rmse", F.sqrt(sse / F.col("marks")))
        .select(
            *keys,
            "marks",
            "base_gap",
            "regularity",
            "line_rmse",
            "span",
            (
                (F.col("marks") >= 4) & (F.col("line_rmse") <= 8) & (F.col("regularity") <= 0.32) & (F.col("span") >= 90)
            ).alias("accepted"),
        )
    )
