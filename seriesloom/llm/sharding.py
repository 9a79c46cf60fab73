"""Minimax contiguous partition of atomic groups into shards, in DataFrame functions only.

Rows with equal keys form an atomic group that is never split. Groups stand in the order of their
weight's power of two, heaviest first, and then of their digest (an order that mixes sources, and
leaves light groups to even out the last shards). They are cut into at most ``shards`` contiguous
runs so that the heaviest run is as light as possible: the smallest feasible capacity is searched, each candidate
being checked greedily (extend the shard while it fits), and the groups are then cut at that
capacity. A round checks many candidates in one pass over the prefix sums, so the search takes a few
rounds rather than one for each bit.

Defined cases: a null text weighs 1 and shares the group of the empty text; repeated rows share a
group and each get a slot of their own; an empty table gives an empty table; a group heavier than
the mean shard decides the capacity, and fewer shards may then be filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, utf8

SALTS = 256  # sub-groups of one group: a key with a third of all rows is counted in that many tasks
BUCKETS = 1024  # digest ranges of one power of two, for prefix sums without one global window
CANDIDATES = 48


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, digest, shard, slot.

    ``size`` is the text's UTF-8 length plus one. Slots number the rows of a shard without gaps, by
    group and then by identifier within a group's sub-groups.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    body = utf8(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = scratch.write(rows)
    parts = rows.groupBy("digest", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    within = W.partitionBy("digest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("n_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    parts = scratch.write(parts)
    groups = scratch.write(_prefixes(parts.groupBy("digest").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))))
    starts = smallest_cuts(groups, shards)
    number = F.lit(0)
    for begin in starts[1:]:
        number = number + F.when(F.col("bytes_before") >= F.lit(begin), 1).otherwise(0)
    placed = groups.withColumn("shard", number.cast("int"))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("n_before").alias("first")).collect()}
    base = F.lit(0).cast("long")
    for k, at in first.items():
        base = F.when(F.col("shard") == k, F.lit(at).cast("long")).otherwise(base)
    placed = placed.select("digest", "shard", (F.col("n_before") - base).alias("group_slot"))
    placed = parts.select("digest", "salt", "n_before").join(placed, "digest")
    place = F.row_number().over(W.partitionBy("digest", "salt").orderBy("id"))
    return (
        rows.withColumn("place", place)
        .join(placed, ["digest", "salt"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lower(F.hex("digest")).alias("digest"),
            "shard",
            (F.col("group_slot") + F.col("n_before") + F.col("place") - 1).cast("long").alias("slot"),
        )
    )


def _bucket(digest: Column, weight: Column) -> Column:
    """Number of a group's place in the order: more binary digits first, then ranges of the digest."""
    spread = F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int")
    return (F.lit(64) - F.length(F.bin(weight))) * BUCKETS + F.floor(spread * BUCKETS / 65536).cast("int")


def _prefixes(groups: DataFrame) -> DataFrame:
    """Bytes and rows before each group: sums inside a bucket plus the totals of earlier buckets."""
    groups = groups.withColumn("bucket", _bucket(F.col("digest"), F.col("bytes")))
    inside = W.partitionBy("bucket").orderBy("digest").rowsBetween(W.unboundedPreceding, -1)
    # At most 64 * BUCKETS rows, whatever the table's size, meet in this one window.
    ahead = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("n").alias("m"))
    totals = totals.select(
        "bucket",
        F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("n_ahead"),
    )
    zero = F.lit(0)
    return (
        groups.withColumn("b", F.coalesce(F.sum("bytes").over(inside), zero))
        .withColumn("m", F.coalesce(F.sum("n").over(inside), zero))
        .join(totals, "bucket")
        .select(
            "digest",
            "bytes",
            (F.col("b") + F.col("bytes_ahead")).alias("bytes_before"),
            (F.col("m") + F.col("n_ahead")).alias("n_before"),
        )
    )


def smallest_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First byte of each shard at the smallest feasible capacity.

    ``groups`` has ``bytes`` and ``bytes_before``. The capacity lies between the larger of mean and
    heaviest group, and mean plus heaviest group. Each round spreads candidates over what is left.
    """
    total, heaviest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if not total:
        return [0]
    low, high = max(-(-total // shards), heaviest), -(-total // shards) + heaviest
    ends = F.col("bytes_before") + F.col("bytes")
    best: list[int] | None = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // CANDIDATES))
        capacities = sorted({*range(low, high, step), high})
        reached = [0] * len(capacities)
        cuts: list[list[int]] = [[0] for _ in capacities]
        for _ in range(shards):
            wanted = [F.max(F.when(ends <= at + cap, ends)).alias(f"c{k}") for k, (at, cap) in enumerate(zip(reached, capacities))]
            nearest = min(r for r in reached)
            farthest = max(r + c for r, c in zip(reached, capacities))
            row = groups.filter((ends > nearest) & (ends <= farthest)).agg(*wanted).first()
            reached = [max(at, row[k] or 0) for k, at in enumerate(reached)]
            for k, at in enumerate(reached):
                if cuts[k][-1] < at < total:
                    cuts[k].append(at)
            if min(reached) == total:
                break
        feasible = next(k for k, at in enumerate(reached) if at == total)
        best, high = cuts[feasible], capacities[feasible]
        low = capacities[feasible - 1] + 1 if feasible else high
    return best


def balanced_digest(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard`` under the law that sizes are near equal, in the columns of the shard manifest."""
    return shard(docs, shards, id_col, text_col).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "digest",
    )
