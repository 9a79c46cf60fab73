"""Deterministic picks: top-k, spaced picks, nearest to a quantile, first entities, key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.session import materialize


def stable_order(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """Total order over a whole table; every tie-break column is named."""
    return df.orderBy(*columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group. The limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spaced_top_k(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    order: Sequence[Column],
    carry: Sequence[str],
    k: int,
    separation: float,
    complete: bool = True,
) -> DataFrame:
    """Greedy picks by rank that keep ``separation`` from every earlier pick.

    At most one pick can lie in a cell of width ``separation``, and the best-ranked row of a cell
    beats the others of that cell unless an earlier pick blocks it. Picks are found in ``k`` rounds:
    each takes the best remaining row per group and drops what it blocks, so a group is only ever
    reduced, never gathered. The picks of a round are written, one row per group, so the plan of a round
    does not hold those before it; jobs run when called. With ``complete`` a group that cannot fill ``k`` picks yields none.
    """
    keys = list(keys)
    rank = F.struct(*order)
    pool = df.select(*keys, F.col(position).alias("__x"), rank.alias("__rank"), F.struct(*carry).alias("__row"))
    best = lambda d: d.groupBy(*keys).agg(F.min(F.struct("__rank", "__x", "__row")).alias("b"))
    pool = materialize(pool)
    chosen = materialize(best(pool).select(*keys, F.array("b").alias("__picks")))
    for _ in range(k - 1):
        free = pool.join(chosen, keys).filter(
            F.forall("__picks", lambda p: F.abs(p["__x"] - F.col("__x")) >= separation)
        )
        nxt = best(free)
        longer = F.when(F.col("b").isNotNull(), F.concat("__picks", F.array("b"))).otherwise(F.col("__picks"))
        chosen = materialize(chosen.join(nxt, keys, "left").select(*keys, longer.alias("__picks")))
    if complete:
        chosen = chosen.filter(F.size("__picks") == k)
    return chosen.select(*keys, F.posexplode("__picks").alias("i", "p")).select(
        *keys, (F.col("i") + 1).alias("pick"), F.col("p.__x").alias(position), "p.__row.*"
    )


def pick_by_confidence(df: DataFrame, keys: Sequence[str], value: str, confidence: str, mean: str, sd: str, tie: str) -> DataFrame:
    """Per frame the most confident value, and the best by confidence times predictive density."""
    z = (F.col(value) - F.col(mean)) / F.col(sd)
    weight = F.col(confidence) * F.exp(z * z * F.lit(-0.5)) / F.col(sd)
    return df.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col(confidence), -F.col(tie))).alias("most_confident"),
        F.max_by(value, F.struct(weight, -F.col(tie))).alias("prior_weighted"),
    )


def nearest_to_quantiles(df: DataFrame, entity: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """For each quantile in turn the nearest entity (smallest id on ties) not used before."""
    picked = None
    for p in probabilities:
        target = exact_quantiles(df, [], value, [p]).select("quantile").scalar()
        rest = df if picked is None else df.join(picked.select(entity), entity, "left_anti")
        best = rest.withColumn("target", target).withColumn("distance", F.abs(F.col(value) - F.col("target")))
        row = best.agg(F.min(F.struct("distance", entity, value, "target")).alias("b")).select(
            F.lit(float(p)).alias("probability"), f"b.{entity}", f"b.{value}", "b.target", "b.distance"
        )
        picked = row if picked is None else picked.unionByName(row)
    return picked


def first_entities(df: DataFrame, entity: str, n: int) -> DataFrame:
    """All rows of the ``n`` smallest entity ids."""
    ids = df.select(entity).distinct().orderBy(entity).limit(n)
    return df.join(ids, entity, "left_semi")


def common_keys(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that occur in every table."""
    out = tables[0].select(*keys).distinct()
    for other in tables[1:]:
        out = out.join(other.select(*keys), list(keys), "left_semi")
    return out


def shared_entities(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Entities on both sides; a disjointness contract holds when this is empty."""
    return left.select(key).intersect(right.select(key))


def keys_minus(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).subtract(right.select(*keys))


def keys_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).union(right.select(*keys)).distinct()
