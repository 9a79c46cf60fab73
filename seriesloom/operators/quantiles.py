"""Exact quantiles for groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here values are
first counted per ``(group, value)``, the counts are located in value buckets, the buckets that hold a
wanted rank are narrowed by counting again in even parts of their range, and only the parts that still
hold one are ordered. Linear interpolation between closest ranks throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.ordering import SeriesOrder, running, value_bucket
from seriesloom.session import materialize

_GROUP = "__g"


PARTS = 4096  # of a bucket in a narrowing round


def _holding(buckets: DataFrame) -> DataFrame:
    """Buckets that hold a wanted rank, with the ranks: __before, __n, __min, __max, __want."""
    last = F.col("__before") + F.col("__bc") - 1
    return (
        buckets.filter(F.col("__lo").between(F.col("__before"), last) | F.col("__hi").between(F.col("__before"), last))
        .groupBy(_GROUP, "__b")
        .agg(
            *[F.first(c).alias(c) for c in ("__before", "__n", "__min", "__max")],
            F.collect_list(F.struct("__p", "__lo", "__hi")).alias("__want"),
        )
    )


def _narrowed(counts: DataFrame, targets: DataFrame, sizes: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Each wanted bucket cut into even parts of its range, and those parts that hold a wanted rank."""
    low, high = F.col("__min"), F.col("__max")
    part = F.when(high > low, F.floor((F.col("__v") - low) / (high - low) * (PARTS - 0.5))).otherwise(F.lit(0).cast("bigint"))
    held = targets.select(_GROUP, "__b", "__min", "__max")
    counts = counts.join(held, [_GROUP, "__b"]).withColumn("__b", F.concat("__b", F.array(part))).drop("__min", "__max")
    parts = counts.groupBy(_GROUP, "__b").agg(*sizes).withColumn("__of", F.slice("__b", 1, F.size("__b") - 1))
    # At most PARTS rows for each bucket.
    earlier = Window.partitionBy(_GROUP, "__of").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__upto", F.coalesce(F.sum("__bc").over(earlier), F.lit(0)))
    above = targets.select(_GROUP, F.col("__b").alias("__of"), F.col("__before").alias("__start"), "__n", "__want")
    parts = parts.join(above, [_GROUP, "__of"]).withColumn("__before", F.col("__start") + F.col("__upto"))
    return counts, _holding(parts.select("*", F.explode("__want").alias("__w")).select("*", "__w.*"))


def _sorted_quantiles(keyed: DataFrame, wanted: Column, out: Sequence[Column]) -> DataFrame:
    """Quantiles of groups that are small enough to be sorted in one row."""
    lists = keyed.groupBy(_GROUP).agg(F.sort_array(F.collect_list("__v")).alias("__a"))
    ranks = lists.select(_GROUP, "__a", F.size("__a").cast("bigint").alias("__n"), wanted.alias("__p"))
    position = F.col("__p") * (F.col("__n") - 1)
    at = lambda rank: F.get("__a", rank.cast("int"))
    low, high = at(F.floor(position)), at(F.ceil(position))
    return ranks.select(
        *out, F.col("__p").alias("probability"), F.col("__n").alias("n"), (low + (high - low) * (position - F.floor(position))).alias("quantile")
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    probabilities: Sequence[float],
    freq: str | Column | None = None,
    rounds: int = 1,
    at_once: int = 0,
) -> DataFrame:
    """Long result: ``by``, ``probability``, ``n``, ``quantile`` (NULL values are ignored).

    ``freq`` gives whole-number multiplicities. Grouping treats NULL keys as one group. Each of ``rounds``
    narrows the wanted buckets ``PARTS`` times before what is left of them is ordered; more of them suit
    values that crowd far closer than a bucket is wide. Without ``freq``, groups of up to ``at_once`` values
    are sorted in one row each, so that many short series do not go through all those joins.
    """
    by = list(by)
    col = F.col(value) if isinstance(value, str) else value
    weight = F.lit(1).cast("bigint") if freq is None else (
        F.col(freq) if isinstance(freq, str) else freq
    ).cast("bigint")
    keyed = df.select(
        (F.struct(*by) if by else F.lit(0)).alias(_GROUP),
        (col.cast("double") + 0.0).alias("__v"),
        weight.alias("__f"),
    ).filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.col("__f") > 0))
    out = [F.col(f"{_GROUP}.{c}").alias(c) for c in by]
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    sorted_ = None
    if at_once and freq is None:
        sizes = keyed.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("__n"))
        large = materialize(sizes.filter(F.col("__n") > at_once).select(_GROUP))
        sorted_ = _sorted_quantiles(keyed.join(large, _GROUP, "left_anti"), wanted, out)
        if large.isEmpty():
            return sorted_
        keyed = keyed.join(large, _GROUP, "left_semi")
    counts = (
        keyed.groupBy(_GROUP, "__v")
        .agg(F.sum("__f").alias("__c"))
        .withColumn("__b", F.array(value_bucket(F.col("__v"))))
    )
    sizes = [F.sum("__c").alias("__bc"), F.min("__v").alias("__min"), F.max("__v").alias("__max")]
    earlier = Window.partitionBy(_GROUP).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(_GROUP)
    buckets = (
        counts.groupBy(_GROUP, "__b")
        .agg(*sizes)
        .withColumn("__before", F.coalesce(F.sum("__bc").over(earlier), F.lit(0)))
        .withColumn("__n", F.sum("__bc").over(whole))
    )
    position = F.col("__p") * (F.col("__n") - 1)
    targets = _holding(buckets.withColumn("__p", wanted).withColumn("__lo", F.floor(position)).withColumn("__hi", F.ceil(position)))
    for _ in range(rounds):
        counts, targets = _narrowed(counts, targets, sizes)
    inside = Window.partitionBy(_GROUP, "__b").orderBy("__v")
    ranked = (
        counts.join(targets, [_GROUP, "__b"])
        .withColumn("__last", F.col("__before") + F.sum("__c").over(inside) - 1)
        .withColumn("__first", F.col("__last") - F.col("__c") + 1)
    )
    hit = lambda rank: F.col(rank).between(F.col("__first"), F.col("__last"))
    picked = (
        ranked.select("*", F.explode("__want").alias("__w"))
        .select("*", "__w.*")
        .filter(hit("__lo") | hit("__hi"))
        .groupBy(_GROUP, "__p", "__lo", "__n")
        .agg(
            F.max(F.when(hit("__lo"), F.col("__v"))).alias("__vl"),
            F.max(F.when(hit("__hi"), F.col("__v"))).alias("__vh"),
        )
    )
    part = F.col("__p") * (F.col("__n") - 1) - F.col("__lo")
    located = picked.select(
        *out,
        F.col("__p").alias("probability"),
        F.col("__n").alias("n"),
        (F.col("__vl") + (F.col("__vh") - F.col("__vl")) * part).alias("quantile"),
    )
    return located if sorted_ is None else located.unionByName(sorted_)


def quantile_columns(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    columns: dict[str, float],
    freq: str | Column | None = None,
    at_once: int = 0,
) -> DataFrame:
    """Wide form of :func:`exact_quantiles`: one row per group, one column per probability."""
    long = exact_quantiles(df, by, value, sorted(set(columns.values())), freq, at_once=at_once)
    return long.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
            for name, p in columns.items()
        ]
    )


def weighted_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str,
    columns: dict[str, float],
    ties: Sequence[str] = (),
    mode: str = "linear",
) -> DataFrame:
    """Weighted quantiles on the normalised cumulative weight of the ordered values.

    ``linear`` interpolates between the points (cumulative share, value) and is flat outside them;
    ``step`` takes the first value whose cumulative share reaches the probability.
    """
    order = SeriesOrder.by_value(tuple(by), value, ties)
    cum = running(df, order, {"__cum": ("sum", F.col(weight))})
    totals = df.groupBy(*by).agg(F.sum(weight).alias("__total"))
    cum = cum.join(totals, list(by)).withColumn("__share", F.col("__cum") / F.col("__total"))
    aggs = []
    for name, p in columns.items():
        point = F.struct("__share", value)
        aggs.append(F.max(F.when(F.col("__share") <= p, point)).alias(f"__lo_{name}"))
        aggs.append(F.min(F.when(F.col("__share") >= p, point)).alias(f"__hi_{name}"))
    aggs.append(F.max(value).alias("__top"))
    wide = cum.groupBy(*by).agg(*aggs)
    outs = []
    for name, p in columns.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        lo_s, lo_v = lo["__share"], lo[value]
        hi_s, hi_v = F.coalesce(hi["__share"], F.lit(1.0)), F.coalesce(hi[value], F.col("__top"))
        if mode == "step":
            outs.append(hi_v.alias(name))
            continue
        part = F.when(hi_s > lo_s, (F.lit(p) - lo_s) / (hi_s - lo_s)).otherwise(F.lit(0.0))
        outs.append(F.coalesce(lo_v + (hi_v - lo_v) * part, hi_v).alias(name))
    return wide.select(*by, *outs)
