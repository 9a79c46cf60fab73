"""Find the mark sequence of a pole: the best line through pairs of marks.

All marks of an image are looked at; a caller who wants only the best ones applies ``top_k`` before.
Pairs only seed lines inside a task, one mark's partners at a time; none is emitted. Seeds of one image
are spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.fitting import GRID_FROM, GRID_MATCH, GRID_SIZE, GRID_TO, RUN_HIGH, RUN_LOW
from seriesloom.operators.ordering import SeriesOrder, number_rows
from seriesloom.session import spread_by_key

# Limits of seeds, alignment and accepted sequences, and the score weights.
MIN_RISE, MAX_SLOPE, ALIGN_PX, MERGE_PX, MIN_BANDS = 70.0, 0.35, 7.0, 8.0, 5
MAX_LINE_RMSE, MAX_IRREGULAR, MIN_SPAN = 8.0, 0.32, 90.0
PER_BAND, PER_SPAN, PER_AREA, PER_RMSE, PER_IRREGULAR = 25.0, 0.08, 0.05, -8.0, -35.0
BLOCK = 512  # seed marks of one task
RATED = 64 << 20  # bytes of names of rated sets a task keeps
GRID = np.linspace(GRID_FROM, GRID_TO, GRID_SIZE)


def merged_marks(marks: np.ndarray) -> np.ndarray:
    """Columns x, y, area, score; rows closer than the merge limit become one."""
    return _merged(marks[np.argsort(marks[:, 1], kind="stable")])


def _merged(marks: np.ndarray) -> np.ndarray:
    """As :func:`merged_marks`, of marks already in the order of their rows."""
    y = marks[:, 1]
    group = np.concatenate([[0], np.cumsum(y[1:] - y[:-1] > MERGE_PX)])
    area = np.bincount(group, marks[:, 2])
    mean = lambda c: np.bincount(group, marks[:, c] * marks[:, 2]) / area
    score = np.full(len(area), -np.inf)
    np.maximum.at(score, group, marks[:, 3])
    return np.column_stack([mean(0), mean(1), area, score])


def _median(values: np.ndarray) -> float:
    """``np.median`` without its checks, which cost more than a few values."""
    n = len(values)
    ordered = np.sort(values)
    return float((ordered[(n - 1) // 2] + ordered[n // 2]) / 2)


def spacing(gaps: np.ndarray) -> float | None:
    useful = gaps[(gaps >= GRID_FROM) & (gaps <= GRID_TO)]
    if len(useful) < 3:
        return None
    rel = useful[:, None] / GRID  # one gap a row, so that votes add up whole rows
    rel -= 1
    np.abs(rel, out=rel)
    near = rel <= GRID_MATCH
    votes = np.add.reduce(near.view(np.uint8), axis=0, dtype=np.int32)
    most = int(votes.max())
    if most < 2:
        return None
    top = np.flatnonzero(votes == most)
    best = top[0]
    if len(top) > 1:
        ranked = np.sort(np.where(near[:, top], rel[:, top], np.inf), axis=0)
        middle = (ranked[(most - 1) // 2] + ranked[most // 2]) / 2
        best = top[np.flatnonzero(middle == middle.min())[-1]]
    return _median(useful[near[:, best]])


def longest_run(marks: np.ndarray, base: float) -> np.ndarray:
    y = marks[:, 1]
    ratio = (y[1:] - y[:-1]) / base
    breaks = (np.flatnonzero((ratio < RUN_LOW) | (ratio > RUN_HIGH)) + 1).tolist()
    if not breaks:
        return marks
    ends = list(zip([0, *breaks], [*breaks, len(marks)]))
    most = max(stop - first for first, stop in ends)
    runs = [marks[first:stop] for first, stop in ends if stop - first == most]
    return max(runs, key=lambda r: (r[:, 3].sum(), r[-1, 1] - r[0, 1])) if len(runs) > 1 else runs[0]


def rate(marks: np.ndarray) -> tuple[float, np.ndarray, dict] | None:
    """Score of the sequence among some aligned marks, or nothing when it is not acceptable."""
    return _rate(marks[np.argsort(marks[:, 1], kind="stable")], -math.inf)


def _rate(marks: np.ndarray, least: float) -> tuple[float, np.ndarray, dict] | None:
    """As :func:`rate`, of marks in the order of their rows; nothing also where ``least`` is out of reach."""
    marks = _merged(marks)
    if len(marks) < MIN_BANDS:
        return None
    y = marks[:, 1]
    gaps = y[1:] - y[:-1]
    base = spacing(gaps)
    if base is None:
        return None
    run = longest_run(marks, base)
    x, y = run[:, 0], run[:, 1]
    span = float(y[-1] - y[0])
    if len(run) < MIN_BANDS or span < MIN_SPAN:
        return None
    # What is left takes points off.
    reach = PER_BAND * len(run) + PER_SPAN * span + PER_AREA * run[:, 2].mean()
    if reach < least:
        return None
    dx, dy = x - x.mean(), y - y.mean()
    rmse = float(np.sqrt(np.mean((dx - (dx @ dy) / (dy @ dy) * dy) ** 2)))
    if rmse > MAX_LINE_RMSE or reach + PER_RMSE * rmse < least:
        return None
    if len(run) < len(marks):
        gaps = y[1:] - y[:-1]
        base = spacing(gaps)
        if base is None:
            return None
    irregular = _median(np.abs(gaps / base - 1))
    if irregular > MAX_IRREGULAR:
        return None
    score = reach + PER_RMSE * rmse + PER_IRREGULAR * irregular
    return float(score), run, {"base_gap": base, "regularity": irregular, "line_rmse": rmse, "span": span}


@dataclass
class Line:
    """A rated sequence, and the earliest pair of marks whose line finds it."""

    score: float
    seed: tuple[int, int]
    marks: np.ndarray
    info: dict


def aligned(marks: np.ndarray, i: int, slope: float) -> np.ndarray:
    x, y = marks[:, 0], marks[:, 1]
    return np.abs(x - (slope * y + (x[i] - slope * y[i]))) <= ALIGN_PX


def promises(marks: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partners of mark ``i`` whose line may hold a sequence, their slopes, and a score none can exceed.

    Each mark lies near the lines through ``i`` of an interval of slopes. With the ends of all intervals
    in order, the number and area of the marks near every partner's line are differences of running
    sums, so one mark costs a sort and not a comparison of all partners with all marks.
    """
    x, y, area = marks[:, 0], marks[:, 1], marks[:, 2]
    dx, dy = x - x[i], y - y[i]
    j = np.flatnonzero((np.abs(dy) >= MIN_RISE) & (np.arange(len(marks)) > i))
    slope = dx[j] / dy[j]
    j, slope = j[np.abs(slope) <= MAX_SLOPE], slope[np.abs(slope) <= MAX_SLOPE]
    level = dy == 0
    ends = np.sort((dx[~level, None] + [-ALIGN_PX, ALIGN_PX]) / dy[~level, None], axis=1)
    ends += np.array([-1e-9, 1e-9]) * (1 + np.abs(ends))  # never too few
    always = level & (np.abs(dx) <= ALIGN_PX)
    found = []
    for amount in (np.ones(len(x)), area):
        total = np.full(len(j), amount[always].sum())
        for side, sign, where in ((0, 1, "right"), (1, -1, "left")):
            order = np.argsort(ends[:, side], kind="stable")
            before = np.concatenate([[0.0], np.cumsum(amount[~level][order])])
            total += sign * before[np.searchsorted(ends[order, side], slope, side=where)]
        found.append(total)
    many = found[0] > MIN_BANDS - 0.5
    bound = PER_BAND * found[0] + PER_SPAN * np.ptp(y) + PER_AREA * found[1] * (1 + 1e-9) / MIN_BANDS
    return j[many], slope[many], bound[many]


def best_of(marks: np.ndarray, seeds: Iterable[int]) -> Line | None:
    """Best sequence over the lines through one of ``seeds`` and a later mark; equal sets of marks are rated once."""
    best: Line | None = None
    level: dict[bytes, Line] = {}  # sets that share the best score so far
    rated: set[bytes] = set()  # emptied now and then, so that it stays small
    order = np.argsort(marks[:, 1], kind="stable")
    rows = marks[order]
    y, area = rows[:, 1], rows[:, 2]
    for i in seeds:
        partners, slopes, bounds = promises(marks, i)
        if len(rated) * len(marks) > RATED:
            rated.clear()
        for at in np.argsort(-bounds, kind="stable"):
            if best is not None and bounds[at] < best.score:
                break
            inside = aligned(marks, i, slopes[at])[order]
            many = int(np.count_nonzero(inside))
            if many < MIN_BANDS:
                continue
            name, seed = inside.tobytes(), (int(i), int(partners[at]))
            if name in level:
                level[name].seed = min(level[name].seed, seed)
                continue
            if name in rated:
                continue
            if best is not None:
                held = y[inside]
                bound = PER_BAND * many + PER_SPAN * (held[-1] - held[0]) + PER_AREA * area[inside].sum() * (1 + 1e-9) / MIN_BANDS
                if bound < best.score:
                    continue
            rated.add(name)
            got = _rate(rows[inside], best.score if best is not None else -math.inf)
            if got is None or (best is not None and got[0] < best.score):
                continue
            line = Line(got[0], seed, *got[1:])
            if best is not None and line.score > best.score:
                level.clear()
            level[name] = line
            best = min(level.values(), key=lambda s: s.seed)
    return min(level.values(), key=lambda s: s.seed) if level else None


def best_line(marks: np.ndarray) -> tuple[float, np.ndarray, dict] | None:
    """Best sequence over all lines through two marks."""
    found = best_of(marks, range(len(marks)))
    return (found.score, found.marks, found.info) if found else None


FIGURES = ("base_gap", "regularity", "line_rmse", "span")


def pole_sequences(df: DataFrame, keys: Sequence[str], ties: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Marks (x, y, area) of the best sequence per image, with its figures; images without one are
    absent. Input columns: ``x``, ``y``, ``area``, ``component_score``.

    Marks are numbered by score, and seeds dealt in blocks of ``block`` marks: a task gets an image's
    marks and one block, and returns the best line of these seeds. The best of the blocks is the image's.
    An image of many marks is thus many tasks, each with work of block x marks x log(marks).
    """
    keys = list(keys)
    columns = ("x", "y", "area", "component_score")
    rows = df.select(*keys, *[c for c in ties if c not in columns], *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("__down", -F.col("component_score"))
    rows = number_rows(rows, SeriesOrder.by_value(tuple(keys), "__down", tuple(ties)), "__n")
    last = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("__n").alias("__count"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__count") - 1) / block))
    dealt = rows.join(last, same).select(*keys, *columns, "__n", F.explode(blocks).alias("__block"))
    parts = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("score", T.DoubleType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in FIGURES]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xs", "ys", "areas")]
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", kind="stable")
        first = int(key[-1]) * block
        found = best_of(pdf[list(columns)].to_numpy(float), range(first, min(first + block, len(pdf))))
        if found is None:
            return pd.DataFrame(columns=parts.names)
        out = {k: [v] for k, v in zip(keys, key)} | {"score": [found.score], "i": [found.seed[0]], "j": [found.seed[1]]}
        out |= {n: [found.info[n]] for n in FIGURES}
        out |= {name: [found.marks[:, c].tolist()] for c, name in enumerate(("xs", "ys", "areas"))}
        return pd.DataFrame(out)

    found = spread_by_key(dealt, [*keys, "__block"]).groupBy(*keys, "__block").applyInPandas(run, parts)
    # One row for each block of an image.
    rank = F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))
    best = found.groupBy(*keys).agg(F.max_by(F.struct("score", *FIGURES, "xs", "ys", "areas"), rank).alias("best"))
    each = best.select(*keys, "best", F.explode(F.arrays_zip("best.xs", "best.ys", "best.areas")).alias("mark"))
    return each.select(
        *keys, "best.score", F.col("mark.xs").alias("x"), F.col("mark.ys").alias("y"), F.col("mark.areas").alias("area"), *[f"best.{n}" for n in FIGURES]
    )
