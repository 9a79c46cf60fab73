"""Enrichment, validated, as-of and pair joins.

No side is broadcast by hint: the optimizer (and adaptive execution, from measured sizes) broadcasts
a side that is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, splitting
skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordering import SeriesOrder, number_rows, previous, running
from seriesloom.session import materialize


def enrich(
    df: DataFrame,
    dimension: DataFrame,
    key: str,
    columns: Sequence[str],
    dimension_key: str | None = None,
) -> DataFrame:
    """Left join that keeps unmatched rows and replaces stale columns of the same name."""
    side = dimension.select(
        F.col(dimension_key or key).alias(key), *[F.col(c) for c in columns]
    )
    return df.drop(*columns).join(side, key, "left")


def unmatched_keys(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(dimension.select(key), key, "left_anti")


def enrich_or_fail(
    df: DataFrame,
    dimension: DataFrame,
    key: str,
    columns: Sequence[str],
    dimension_key: str | None = None,
) -> DataFrame:
    """As :func:`enrich`, but any row without a match fails the job and names its key."""
    need = columns[0]
    joined = enrich(df, dimension, key, columns, dimension_key)
    message = F.concat(F.lit(f"no {need} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    # In a filter, so that the check stays whichever columns are read later.
    return joined.filter(F.when(F.col(need).isNotNull(), True).otherwise(F.raise_error(message).cast("boolean")))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Inner join whose keys must be unique on both sides; a repeated key fails the job."""
    if check:
        left, right = _unique(left, keys), _unique(right, keys)
    return left.join(right, list(keys), "inner")


def _unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; the count per key is part of the plan and raises an error where it is above one."""
    others = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others])
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    repeated = F.raise_error(F.concat(F.lit("repeated key "), name)).cast("boolean")
    return rows.filter(F.when(F.col("__n") == 1, True).otherwise(repeated)).select(*df.columns)


def same_day(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str) -> DataFrame:
    """Inner join on keys and calendar date; both sides unique per key and day."""
    a = left.withColumn("match_date", F.to_date(left_time))
    b = right.withColumn("match_date", F.to_date(right_time))
    return a.join(b, [*keys, "match_date"], "inner")


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side they are missing from."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("missing_from", F.lit("right")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("missing_from", F.lit("left"))
    )


# Fixed value: the tighter residual limit that is preferred when any earlier fit meets it.
PREFERRED_RMSE = 1.27


def best_earlier_fit(
    rows: DataFrame,
    fits: DataFrame,
    key: str,
    time: str,
    row_id: Sequence[str],
    fit_columns: Sequence[str] = (),
    cap: float = PREFERRED_RMSE,
    width: str = "7 days",
) -> DataFrame:
    """For each row the best passing fit of the same key not later than the row.

    ``fits`` has ``key``, ``time``, ``n_landmarks``, ``span_px``, ``rmse``, ``filename`` and the
    wanted ``fit_columns``. Better means: residual within the cap, then more landmarks, wider span,
    smaller residual, earlier, smaller name. Both sides are stacked in time order and the best fit
    so far is a running minimum, so the row count never multiplies.
    """
    rank = F.struct(
        (F.col("rmse") > cap).alias("over_cap"),
        (-F.col("n_landmarks")).alias("k_landmarks"),
        (-F.col("span_px")).alias("k_span"),
        F.col("rmse").alias("k_rmse"),
        F.col(time).alias("k_time"),
        F.col("filename").alias("k_name"),
        *[F.col(c) for c in fit_columns],
    )
    side = fits.select(key, time, rank.alias("__fit"), F.lit(0).alias("__side"))
    base = rows.withColumn("__side", F.lit(1))
    stacked = base.unionByName(side, allowMissingColumns=True)
    # At equal times fits come first, so they count for the rows of that moment.
    order = SeriesOrder.by_time((key,), time, ("__side", *row_id), width)
    best = running(stacked, order, {"__best": ("min", F.col("__fit"))}).filter("__side = 1")
    return best.select(
        *rows.columns,
        F.col("__best.k_name").alias("fit_filename"),
        F.col("__best.k_time").alias("fit_time"),
        F.col("__best.k_rmse").alias("fit_rmse"),
        *[F.col(f"__best.{c}").alias(c) for c in fit_columns],
    )


def token_match(names: DataFrame, ids: DataFrame, name: str, key: str) -> DataFrame:
    """Ids that occur in a name as ``.id.`` or ``.id_``.

    The candidates of a name are its stretches between a dot and a later dot or underscore; they
    are joined by equality, instead of testing each id against each name.
    """
    spots = f"filter(sequence(1, greatest(length(`{name}`), 1)), i -> substring(`{name}`, i, 1) IN ('.', '_'))"
    stretches = (
        f"array_distinct(flatten(transform(filter({spots}, d -> substring(`{name}`, d, 1) = '.'), "
        f"d -> transform(filter({spots}, e -> e > d), e -> substring(`{name}`, d + 1, e - d - 1)))))"
    )
    tokens = names.select("*", F.explode(F.expr(stretches)).alias(key))
    return tokens.join(ids, key, "inner")


def pair_length_errors(
    df: DataFrame, keys: Sequence[str], truth: str, prediction: str, ties: Sequence[str], at_once: int = 64
) -> DataFrame:
    """Errors |p_i - p_j| - |t_i - t_j| over all unordered pairs of a group.

    Groups of up to ``at_once`` rows are paired inside one row that holds their points. Larger ones are
    rated from ranks, without forming their pairs (:func:`_pair_errors_by_rank`). Rows without a truth or a
    prediction count in ``pairs`` only; rows without a key are in no group.
    """
    keys = list(keys)
    rows = df.select(
        *keys, *ties, F.col(truth).cast("double").alias("__t"), F.col(prediction).cast("double").alias("__p")
    ).dropna(subset=keys)
    both = F.col("__t").isNotNull() & F.col("__p").isNotNull()
    large = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.avg(F.when(both, F.col("__t"))).alias("__mt"),
        F.avg(F.when(both, F.col("__p"))).alias("__mp"),
    )
    large = materialize(large.filter(F.col("__rows") > at_once))
    points = F.collect_list(F.struct("__t", "__p")).alias("__a")
    small = rows.join(large.select(*keys), keys, "left_anti").groupBy(*keys).agg(points).filter("size(__a) >= 2")
    errors = (
        "filter(flatten(transform(__a, (x, i) -> transform(slice(__a, i + 2, size(__a)), "
        "y -> abs(y.__p - x.__p) - abs(y.__t - x.__t)))), e -> e IS NOT NULL)"
    )
    total = lambda term: F.expr(f"aggregate(__e, 0D, (s, e) -> s + {term})") / F.expr("nullif(size(__e), 0)")
    n = F.size("__a").cast("bigint")
    paired = small.withColumn("__e", F.expr(errors)).select(
        *keys,
        (n * (n - 1) / 2).cast("bigint").alias("pairs"),
        total("e").alias("bias"),
        total("abs(e)").alias("mae"),
        F.sqrt(total("e * e")).alias("rmse"),
    )
    if large.isEmpty():
        return paired
    # Centred, so that the sums lose no digits to an offset that all rows of a group share.
    centred = rows.filter(both).join(large, keys).withColumns({"__t": F.col("__t") - F.col("__mt"), "__p": F.col("__p") - F.col("__mp")})
    ranked = _pair_errors_by_rank(centred.drop("__rows", "__mt", "__mp"), keys, ties)
    m = F.col("__rows")
    ranked = large.join(ranked, keys, "left").select(*keys, (m * (m - 1) / 2).cast("bigint").alias("pairs"), "bias", "mae", "rmse")
    return paired.unionByName(ranked)


def _pair_errors_by_rank(rows: DataFrame, keys: list[str], ties: Sequence[str]) -> DataFrame:
    """The sum of absolute differences of a column follows from its ranks, and the absolute error of a
    pair is a sum of such differences: ||dp| - |dt|| = |d(p+t)| + |d(p-t)| - |dp| - |dt|. The squares sum
    to those of the differences of e = p - t, but for pairs whose order p and t disagree on: there
    4 |dp dt| is too much. That is found by halving the ranks of t level by level: of two rows whose
    ranks part at a level, the lower one counts where its p is larger, and running sums in the order of
    p give all of these at once. Rows are copied once for each level, never to each other.
    """
    rows = rows.withColumns({"__e": F.col("__p") - F.col("__t"), "__a": F.col("__p") + F.col("__t")})
    rank = lambda d, column, name: number_rows(d, SeriesOrder.by_value(tuple(keys), column, tuple(ties)), name)
    by_truth = SeriesOrder.by_value(tuple(keys), "__t", tuple(ties))
    ranked = previous(rows, by_truth, {"__p1": ("__p", 1)})
    for column in ("__t", "__p", "__e", "__a"):
        ranked = rank(ranked, column, f"__r{column}")
    ranked = materialize(ranked)
    product = lambda c: F.sum(F.col(f"__r{c}") * F.col(c)).alias(f"__w{c}")
    total = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(c).alias(f"__s{c}") for c in ("__t", "__p", "__e", "__a")],
        F.sum(F.col("__e") * F.col("__e")).alias("__s2"),
        *[product(c) for c in ("__t", "__p", "__e", "__a")],
        F.sum(F.when(F.col("__p") < F.col("__p1"), 1).otherwise(0)).alias("__swaps"),
    )
    mixed = total.filter("__swaps > 0").select(*keys, F.ceil(F.log2("__n")).cast("int").alias("__levels"))
    halves = ranked.join(mixed, keys).select(
        *keys,
        *ties,
        "__t",
        "__p",
        (-F.col("__p")).alias("__q"),
        (F.col("__r__t") - 1).alias("__r"),
        F.explode(F.sequence(F.lit(0), F.col("__levels") - 1)).alias("__level"),
    )
    halves = halves.withColumns(
        {"__node": F.expr("shiftright(__r, __level + 1)"), "__upper": F.expr("shiftright(__r, __level) & 1") == 1}
    )
    lower = lambda c: F.when(F.col("__upper"), 0.0).otherwise(c)
    order = SeriesOrder.by_value((*keys, "__level", "__node"), "__q", tuple(ties))
    t, p = F.col("__t"), F.col("__p")
    sums = running(
        halves, order, {"__c": ("sum", lower(F.lit(1.0))), "__cp": ("sum", lower(p)), "__ct": ("sum", lower(t)), "__cpt": ("sum", lower(p * t))}
    ).filter("__upper")
    swapped = t * F.col("__cp") - t * p * F.col("__c") - F.col("__cpt") + p * F.col("__ct")
    fixes = sums.groupBy(*keys).agg(F.sum(4 * swapped).alias("__sq_fix"))
    n = F.col("__n")
    pairs = n * (n - 1) / 2
    spread = lambda c: 2 * F.col(f"__w{c}") - (n + 1) * F.col(f"__s{c}")
    fix = lambda c: F.coalesce(c, F.lit(0.0))
    squared = n * F.col("__s2") - F.col("__s__e") * F.col("__s__e") - fix("__sq_fix")
    return (
        total.filter("__n >= 2")
        .join(fixes, keys, "left")
        .select(
            *keys,
            ((spread("__p") - spread("__t")) / pairs).alias("bias"),
            ((spread("__a") + spread("__e") - spread("__p") - spread("__t")) / pairs).alias("mae"),
            F.sqrt(F.greatest(squared, F.lit(0.0)) / pairs).alias("rmse"),
        )
    )
