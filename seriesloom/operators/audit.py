"""Retrospective comparison fit, user estimators, and the audit that outputs are causal."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.ordering import CHUNK, SeriesOrder, with_halo, without_halo
from seriesloom.session import materialize, sorted_by_key


def _pool_adjacent(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Pool neighbouring entries (``total``, ``n``) until block means increase.

    Streams through partitions sorted by (keys, ordinal) and keeps only the open blocks of one key.
    Result: one row per block with its ``first`` and ``last`` ordinal, ``total`` and ``n``.
    """
    names = [*keys, "first", "last", "total", "n"]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]
        + [T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, open_blocks = None, []
        columns = [*keys, ordinal, "total", "n"]
        for batch in batches:
            done: list[tuple] = []
            for *key, at, total, n in batch[columns].itertuples(index=False, name=None):
                if tuple(key) != current:
                    done += [(*current, *b) for b in open_blocks] if current else []
                    current, open_blocks = tuple(key), []
                block = [at, at, total, n]
                while open_blocks and open_blocks[-1][2] * block[3] >= block[2] * open_blocks[-1][3]:
                    left = open_blocks.pop()
                    block = [left[0], block[1], left[2] + block[2], left[3] + block[3]]
                open_blocks.append(block)
            if done:
                yield pd.DataFrame(done, columns=names)
        if open_blocks:
            yield pd.DataFrame([(*current, *b) for b in open_blocks], columns=names)

    return sorted_by_key(df, list(keys), [ordinal]).mapInPandas(run, schema)


def isotonic_fit(df: DataFrame, by: SeriesOrder, value: str) -> DataFrame:
    """Whole-series non-decreasing least-squares fit, for comparison only: it looks ahead and is
    flagged non-causal.

    Pooling pooled blocks gives the same fit as pooling rows, so chunks are pooled in parallel and
    only their blocks are pooled per series.
    """
    keys = list(by.keys)
    rows = by.chunked(df).withColumn("__at", F.row_number().over(by.window()).cast("bigint"))
    entries = rows.select(*keys, CHUNK, "__at", F.col(value).cast("double").alias("total"), F.lit(1).cast("bigint").alias("n"))
    pieces = materialize(_pool_adjacent(entries, [*keys, CHUNK], "__at"))
    in_series = Window.partitionBy(*keys).orderBy(CHUNK, "first")
    pieces = pieces.withColumn("__piece", F.row_number().over(in_series).cast("bigint"))
    final = _pool_adjacent(pieces.select(*keys, "__piece", "total", "n"), keys, "__piece")
    levels = final.select(
        *keys, F.explode(F.sequence("first", "last")).alias("__piece"), (F.col("total") / F.col("n")).alias("isotonic")
    )
    fitted = pieces.join(levels, [*keys, "__piece"]).select(
        *keys, CHUNK, F.explode(F.sequence("first", "last")).alias("__at"), "isotonic"
    )
    return rows.join(fitted, [*keys, CHUNK, "__at"]).select(*df.columns, "isotonic", F.lit(False).alias("causal"))


def estimate_with(
    df: DataFrame,
    by: SeriesOrder,
    columns: Sequence[str],
    estimator: Callable[[pd.DataFrame], pd.Series],
    output: str,
    lookback: int,
    causal: bool = True,
) -> DataFrame:
    """A user's own estimator with a bounded memory of ``lookback`` rows, and its declared causality.

    It runs once per (entity, chunk) on the chunk's rows in order, preceded by the rows it may look
    back to, and returns one value per row.
    """
    wide = with_halo(df, by, columns, lookback)
    order = list(by.order)
    schema = T.StructType([*wide.schema.fields, T.StructField(output, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="mergesort")
        return rows.assign(**{output: np.asarray(estimator(rows), float)})

    done = wide.groupBy(*by.keys, CHUNK).applyInPandas(run, schema)
    return without_halo(done).withColumn("causal", F.lit(causal))


def prefix_audit(
    df: DataFrame,
    estimator: Callable[[DataFrame, Sequence[str]], DataFrame],
    keys: Sequence[str],
    row_id: Sequence[str],
    time: str,
    cutoffs: Sequence[str],
    outputs: Sequence[str],
    tolerance: float = 0.0,
) -> DataFrame:
    """Re-run an estimator on prefixes and compare with what the whole run emitted.

    ``estimator(rows, keys)`` must append ``outputs``. Rows are copied to each cut-off they precede
    and the estimator runs keyed (cut-off, entity), so the cost is one copy per cut-off.
    """
    points = F.array(*[F.lit(c).cast("timestamp_ntz") for c in cutoffs])
    copies = df.withColumn("cutoff", F.explode(F.filter(points, lambda c: c >= F.col(time))))
    again = estimator(copies, ["cutoff", *keys]).select(
        "cutoff", *row_id, *[F.col(o).alias(f"__again_{o}") for o in outputs]
    )
    whole = estimator(df, list(keys)).select(*row_id, time, *outputs)
    expected = whole.withColumn("cutoff", F.explode(F.filter(points, lambda c: c >= F.col(time))))
    both = expected.withColumn("__e", F.lit(True)).join(again.withColumn("__a", F.lit(True)), ["cutoff", *row_id], "full_outer")
    differs = F.col("__e").isNull() | F.col("__a").isNull()
    for o in outputs:
        a, b = F.col(o), F.col(f"__again_{o}")
        far = F.abs(a - b) > tolerance if tolerance else ~a.eqNullSafe(b)
        differs = differs | F.coalesce(far, a.isNull() != b.isNull())
    return both.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.sum(F.when(differs, 1).otherwise(0).cast("bigint")).alias("mismatches"),
    )
