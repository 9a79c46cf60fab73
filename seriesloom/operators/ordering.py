"""Ordered computation over keyed series, split so that no key has to fit one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a series is cut
into *chunks* by a fixed function of its order column (time bucket or value bucket), windows run
per ``(key, chunk)``, and the little that has to cross a chunk border travels as extra rows:

* ``with_halo``  - the last ``n`` rows before the chunk, for lag and short ROWS frames;
* ``running``    - one row holding the aggregate of all earlier chunks, for cumulative frames;
* ``running_sixteens`` - a running sum of doubles added in a fixed order, whatever the chunks.

The extra rows come from a map-side reduced pass, so the full rows are shuffled once. These borders
do not depend on the data, so a later row never changes the chunk of an earlier one.

Where a chunk may hold too much (a third of all rows in one hour, or with one value), :func:`plan_chunks`
counts the rows of every chunk and divides the heavy ones further, by the same order columns: evenly between
the least and greatest value of the first column that varies in them, again and again until each part is
small. Rows of equal time or value are thus divided by the tie-breaks. Results are the same whatever
the borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.session import materialize, sorted_by_key

CHUNK = "__chunk"
HALO = "__halo"

_UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def micros(col: str | Column) -> Column:
    """Microseconds since the epoch (the session zone is pinned to UTC)."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def width_us(width: str) -> int:
    number, unit = width.split()
    return int(float(number) * _UNIT_US[unit.rstrip("s")])


@dataclass(frozen=True)
class SeriesOrder:
    """Entity keys, a total order inside an entity, and the chunk function."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: Callable[[], Column]  # built late: columns need a running session
    heavy: tuple[DataFrame, ...] = ()  # of each round of plan_chunks: chunks to divide, and how

    @classmethod
    def by_time(
        cls, keys: Sequence[str], time: str, ties: Sequence[str] = (), width: str = "7 days"
    ) -> SeriesOrder:
        step = width_us(width)
        return cls(tuple(keys), (time, *ties), lambda: F.floor(micros(time) / F.lit(step)))

    @classmethod
    def by_value(
        cls, keys: Sequence[str], value: str, ties: Sequence[str] = (), per_unit: int = 64
    ) -> SeriesOrder:
        return cls(tuple(keys), (value, *ties), lambda: value_bucket(F.col(value), per_unit))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)

    def chunked(self, df: DataFrame) -> DataFrame:
        """``df`` with its chunk: a number, or after planning an array that grows where chunks were divided."""
        if not self.heavy:
            return df.withColumn(CHUNK, self.chunk())
        out = df.withColumn(CHUNK, F.array(self.chunk().cast("bigint")))
        for table in self.heavy:
            out = _divided(out, self, table)
        return out


PARTS = 64  # of a heavy chunk in each round
_MEASURABLE = ("timestamp", "timestamp_ntz", "date", "double", "float", "bigint", "int", "smallint", "tinyint", "decimal")


def _measure(column: str, kind: str) -> Column:
    """An order column as a number that grows with it."""
    return micros(column).cast("double") if kind.startswith(("timestamp", "date")) else F.col(column).cast("double")


def _part(value: Column, low: Column, high: Column) -> Column:
    return F.floor((value - low) / (high - low) * (PARTS - 0.5))


def _divided(df: DataFrame, by: SeriesOrder, table: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    same = F.col(CHUNK) == F.col("__of")
    for k in by.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    part = F.lit(None).cast("bigint")
    for i, c in enumerate(by.order):
        if kinds[c].startswith(_MEASURABLE):
            part = F.when(F.col("__by") == i, _part(_measure(c, kinds[c]), F.col("__low"), F.col("__high"))).otherwise(part)
    finer = F.when(F.col("__of").isNull(), F.col(CHUNK)).otherwise(F.concat(CHUNK, F.array(part)))
    # The table has one row for each heavy chunk, at most the number of rows divided by their size.
    return df.join(table, same, "left").withColumn(CHUNK, finer).drop(*table.columns)


def plan_chunks(df: DataFrame, by: SeriesOrder, most: int = 1_000_000, rounds: int = 24) -> SeriesOrder:
    """``by`` with chunks of ``df`` above ``most`` rows divided, in as many counting passes as that takes.

    A pass reads keys and order columns only; usually the first finds nothing heavy and is the last. What
    cannot be told apart by a number (rows equal in all order columns, or up to a text) stays together.
    """
    kinds = dict(df.dtypes)
    slim = df.select(*by.keys, *by.order)
    planned = SeriesOrder(by.keys, by.order, by.chunk)
    for _ in range(rounds):
        cells = planned.chunked(slim)
        if not planned.heavy:
            cells = cells.withColumn(CHUNK, F.array(F.col(CHUNK).cast("bigint")))
        ends = []
        for i, c in enumerate(by.order):
            if not kinds[c].startswith(_MEASURABLE):
                break  # what follows a text cannot divide before it
            v = _measure(c, kinds[c])
            ends += [F.min(v).alias(f"__low{i}"), F.max(v).alias(f"__high{i}")]
        counted = cells.groupBy(*[F.col(k).alias(f"__k_{k}") for k in by.keys], F.col(CHUNK).alias("__of")).agg(F.count(F.lit(1)).alias("__rows"), *ends)
        pick = F.lit(None).cast("struct<i:int,low:double,high:double>")
        for i in reversed(range(len(ends) // 2)):
            low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
            pick = F.when(high > low, F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"))).otherwise(pick)
        heavy = counted.filter(F.col("__rows") > most).withColumn("__pick", pick).filter("__pick IS NOT NULL")
        heavy = materialize(
            heavy.select(*[f"__k_{k}" for k in by.keys], "__of", F.col("__pick.i").alias("__by"), F.col("__pick.low").alias("__low"), F.col("__pick.high").alias("__high"))
        )
        if heavy.isEmpty():
            break
        planned = SeriesOrder(by.keys, by.order, by.chunk, (*planned.heavy, heavy))
    return planned


def value_bucket(value: Column, per_unit: int = 64) -> Column:
    """Monotone bucket number that needs no knowledge of the range: even steps in asinh(1000 v)."""
    return F.floor(F.asinh(value.cast("double") * 1000.0) * per_unit)


def with_halo(df: DataFrame, by: SeriesOrder, columns: Sequence[str], n: int = 1) -> DataFrame:
    """Add to each chunk the ``n`` rows that precede it (flagged ``__halo``).

    Window functions over ``by.window()`` that look back at most ``n`` rows are then exact; drop
    the flagged rows with :func:`without_halo` afterwards.
    """
    base = by.chunked(df)
    payload = list(dict.fromkeys([*by.order, *[c for c in columns if c not in by.keys]]))
    newest_first = Window.partitionBy(*by.keys, CHUNK).orderBy(*[F.desc(c) for c in by.order])
    tails = (
        base.select(*by.keys, CHUNK, *payload)
        .withColumn("__rn", F.row_number().over(newest_first))
        .filter(F.col("__rn") <= n)
        .groupBy(*by.keys, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("__tail"))
    )
    before = Window.partitionBy(*by.keys).orderBy(CHUNK).rowsBetween(-n, -1)
    halo = (
        tails.withColumn("__prev", F.flatten(F.collect_list("__tail").over(before)))
        .withColumn("__prev", F.slice("__prev", F.greatest(F.size("__prev") - n, F.lit(0)) + 1, n))
        .select(*by.keys, CHUNK, F.explode("__prev").alias("__row"))
        .select(*by.keys, CHUNK, "__row.*", F.lit(True).alias(HALO))
    )
    return base.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, CHUNK)


def previous(
    df: DataFrame, by: SeriesOrder, outputs: Mapping[str, tuple[str, int]], keep_chunk: bool = False
) -> DataFrame:
    """Lagged columns ``{new: (column, steps)}``, exact across chunk borders."""
    depth = max(steps for _, steps in outputs.values())
    wide = with_halo(df, by, [c for c, _ in outputs.values()], depth)
    w = by.window()
    wide = wide.select("*", *[F.lag(c, k).over(w).alias(o) for o, (c, k) in outputs.items()])
    wide = wide.filter(~F.col(HALO)).drop(HALO)
    return wide if keep_chunk else wide.drop(CHUNK)


_RUN = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    by: SeriesOrder,
    outputs: Mapping[str, tuple[str, Column]],
    keep_chunk: bool = False,
) -> DataFrame:
    """Cumulative ``sum`` / ``min`` / ``max`` up to and including the current row."""
    base = by.chunked(df).select(
        "*", *[expr.alias(f"__in_{o}") for o, (_, expr) in outputs.items()]
    )
    totals = base.groupBy(*by.keys, CHUNK).agg(
        *[_RUN[kind](f"__in_{o}").alias(f"__in_{o}") for o, (kind, _) in outputs.items()]
    )
    before = Window.partitionBy(*by.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*by.keys).orderBy(CHUNK)).alias("__n")
    carry = totals.select(
        *by.keys,
        CHUNK,
        first,
        *[_RUN[k](f"__in_{o}").over(before).alias(f"__in_{o}") for o, (k, _) in outputs.items()],
    ).filter(F.col("__n") > 1).drop("__n").withColumn(HALO, F.lit(True))
    wide = base.withColumn(HALO, F.lit(False)).unionByName(carry, allowMissingColumns=True)
    # Carry rows have NULL order columns and so sort first.
    w = (
        Window.partitionBy(*by.keys, CHUNK)
        .orderBy(F.desc(HALO), *by.order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    wide = wide.select(
        "*", *[_RUN[k](f"__in_{o}").over(w).alias(o) for o, (k, _) in outputs.items()]
    )
    wide = wide.filter(~F.col(HALO)).drop(HALO, *[f"__in_{o}" for o in outputs])
    return wide if keep_chunk else wide.drop(CHUNK)


def number_rows(df: DataFrame, by: SeriesOrder, output: str = "sequence_number") -> DataFrame:
    """1-based position of each row in its series."""
    return running(df, by, {output: ("sum", F.lit(1).cast("bigint"))})


SIXTEEN = 16
CELL = SIXTEEN**4  # rows of a series that one task adds at once


def sums_by_sixteens(values: np.ndarray, lengths: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Running sums of consecutive stretches: rows are added to whole blocks of 16 rows, those to whole blocks of
    256, and so on, each from left to right. ``carry`` is what stands before each stretch."""
    held = -(-lengths // SIXTEEN)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    block = np.repeat(np.cumsum(held) - held, lengths) + at // SIXTEEN
    grid = np.zeros((int(held.sum()), SIXTEEN))
    grid[block, at % SIXTEEN] = values
    full = lengths // SIXTEEN
    number = np.arange(len(grid)) - np.repeat(np.cumsum(held) - held, held)
    whole = number < np.repeat(full, held)
    before = np.repeat(carry, held)
    after = np.zeros(len(grid))
    if whole.any():
        total = np.zeros(len(grid))
        for column in grid.T:
            total = total + column
        after[whole] = sums_by_sixteens(total[whole], full, carry)
        before[1:] = np.where(number[1:] > 0, after[:-1], before[1:])
    sums = np.empty_like(grid)
    for k in range(SIXTEEN):
        before = before + grid[:, k]
        sums[:, k] = before
    sums[whole, -1] = after[whole]
    return sums[block, at % SIXTEEN]


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places where another key begins, with 0."""
    new = np.zeros(max(len(table) - 1, 0), dtype=bool)
    for k in keys:
        a, b = table[k].slice(1), table[k].slice(0, len(table) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
        new |= differs.astype(bool)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _added(df: DataFrame, keys: Sequence[str], order: Sequence[str], output: str) -> DataFrame:
    """``df`` with the sum of ``__v`` so far, in the order of each key; ``__carry`` stands before its first row and
    ``__after`` is the sum at its last, where there are such columns."""
    keys, kept = list(keys), [f for f in df.schema.fields if f.name not in ("__v", "__carry", "__after")]
    names = [f.name for f in kept]

    def done(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(np.append(starts, len(table)))
        present = pc.is_valid(table["__v"]).to_numpy().astype(bool)
        carry, known = np.zeros(len(starts)), np.zeros(len(starts), dtype=bool)
        if "__carry" in table.column_names:
            first = table["__carry"].take(pa.array(starts))
            carry, known = pc.fill_null(first, 0.0).to_numpy().astype(float), pc.is_valid(first).to_numpy().astype(bool)
        sums = sums_by_sixteens(pc.fill_null(table["__v"], 0.0).to_numpy().astype(float), lengths, carry)
        if "__after" in table.column_names:
            last = starts + lengths - 1
            after = table["__after"].take(pa.array(last))
            given = pc.is_valid(after).to_numpy().astype(bool)
            sums[last[given]] = pc.fill_null(after, 0.0).to_numpy()[given]
        many = np.cumsum(present)
        before = np.repeat(many[starts] - present[starts], lengths)
        empty = (many == before) & ~np.repeat(known, lengths)
        yield from table.select(names).append_column(output, pa.array(sums, mask=empty)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the key that may go on
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held and len(_changes(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), table.slice(0, 1)]), keys)) < 2 and len(_changes(table, keys)) < 2:
                held.append(table)
                continue
            table = pa.concat_tables([*held, table])
            starts = _changes(table, keys)
            if len(starts) > 1:
                yield from done(table.slice(0, starts[-1]), starts[:-1])
            held = [table.slice(starts[-1])]
        if held:
            yield from done(pa.concat_tables(held), np.zeros(1, dtype=np.int64))

    return sorted_by_key(df, keys, list(order)).mapInArrow(run, T.StructType([*kept, T.StructField(output, T.DoubleType())]))


def running_sixteens(df: DataFrame, by: SeriesOrder, output: str, value: Column) -> DataFrame:
    """Running sum of doubles, each rounded as in an engine that keeps the sums of blocks of 16, 256, ... rows.

    The order of addition is fixed by the rows' places in their series, so the last bits do not depend on chunks
    or partitions. Series above ``CELL`` rows are added in cells of as many rows, each in a task of its own.
    """
    keys = list(by.keys)
    rows = df.withColumn("__v", value.cast("double"))
    large = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > CELL).select(*keys))
    if large.isEmpty():
        return _added(rows, keys, by.order, output)
    numbered = number_rows(rows.join(large, keys, "left_semi"), by, "__n")
    cells = materialize(numbered.withColumn("__cell", F.floor((F.col("__n") - 1) / CELL)))
    whole = _added(cells.select(*keys, "__cell", "__n", "__v"), [*keys, "__cell"], ["__n"], "__total").filter(F.col("__n") % CELL == 0)
    ends = materialize(_added(whole.select(*keys, "__cell", F.col("__total").alias("__v")), keys, ["__cell"], "__sum"))
    cells = cells.join(ends.withColumnRenamed("__sum", "__after"), [*keys, "__cell"], "left")
    cells = cells.join(ends.select(*keys, (F.col("__cell") + 1).alias("__cell"), F.col("__sum").alias("__carry")), [*keys, "__cell"], "left")
    heavy = _added(cells, [*keys, "__cell"], ["__n"], output).select(*df.columns, output)
    return _added(rows.join(large, keys, "left_anti"), keys, by.order, output).select(*df.columns, output).unionByName(heavy)
