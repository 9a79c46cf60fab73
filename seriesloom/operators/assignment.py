"""Optimal one-to-one assignment, by position with a gate before or after it, or by a small score table."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.ordering import SeriesOrder, previous, running
from seriesloom.session import materialize, sorted_by_key, spread_by_key


CELLS = 1 << 22  # cells of the alignment table whose marks are held at once, unless rows are very wide


def match_on_line(left: np.ndarray, right: np.ndarray, gate: float) -> list[tuple[int, int]]:
    """Most pairs within the gate, and among those the least total distance, of sorted positions.

    On a line some best matching keeps both orders, so an alignment table finds it. A row of the table differs
    from the one before only where ``right`` is within the gate, and is level beyond; only these cells are
    computed, in one running row. The way back needs two marks for each cell: rows are taken in blocks, the
    running row is kept at the start of each, and a block's marks are made again when the way back gets there.
    """
    n, m = len(left), len(right)
    if not n or not m:
        return []
    prize = gate * (min(n, m) + 1) + 1.0
    slack = 1e-9 * (np.abs(left) + gate)  # never too narrow; the gate itself is applied to the distances
    low = np.searchsorted(right, left - gate - slack, side="left")
    high = np.maximum.accumulate(np.searchsorted(right, left + gate + slack, side="right"))
    width = high - low
    most = max(CELLS, int(math.sqrt(4.0 * width.sum() * width.max())))
    block = np.cumsum(width) // most
    starts = np.flatnonzero(np.diff(block, prepend=-1))

    best = np.zeros(m + 1)
    known = 0  # the running row is level from here on

    def step(i: int, known: int, marks: list | None = None) -> int:
        lo, hi = low[i], high[i]
        if hi > known:
            best[known + 1 : hi + 1] = best[known]
            known = hi
        if lo == hi:
            if marks is not None:
                marks.append(None)
            return known
        gain = np.abs(left[i] - right[lo:hi])
        gain = np.where(gain <= gate, prize - gain, -np.inf)
        row = np.maximum.accumulate(np.maximum(best[lo + 1 : hi + 1], best[lo:hi] + gain))
        if marks is not None:
            above = row == best[lo + 1 : hi + 1]
            beside = np.empty(hi - lo, bool)
            beside[0], beside[1:] = row[0] == best[lo], row[1:] == row[:-1]
            marks.append((above, beside))
        best[lo + 1 : hi + 1] = row
        return known

    kept = []
    for first, last in zip(starts, [*starts[1:], n]):
        at = min(low[first], known)
        kept.append((known, at, best[at : known + 1].copy()))
        for i in range(first, last):
            known = step(i, known)
    pairs, j = [], m
    for first, last, (known, at, row) in zip(starts[::-1], [n, *starts[:0:-1]], kept[::-1]):
        best[at : known + 1] = row
        marks: list = []
        for i in range(first, last):
            known = step(i, known, marks)
        for i in range(last - 1, first - 1, -1):
            if marks[i - first] is None:
                continue
            lo, (above, beside) = low[i], marks[i - first]
            if j > high[i] and not above[-1]:
                j = int(high[i])
            while lo < j <= high[i] and not above[j - 1 - lo]:
                j -= 1
                if not beside[j - lo]:
                    pairs.append((i, j))
                    break
    return pairs[::-1]


def assign_by_position(
    candidates: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    position: str,
    candidate_id: str,
    anchor_id: str,
    gate: float,
) -> DataFrame:
    """Gated assignment per group.

    Both sides are stacked in position order and cut where neighbours are more than the gate apart:
    no pair can span such a cut, so the pieces are independent and exact. Pieces are solved in
    parallel, also those of one large group; pieces without both sides are dropped beforehand.
    """
    keys = list(keys)
    side = lambda d, name, i: d.select(
        *keys, F.col(position).cast("double").alias("x"), F.col(name).alias("id"), F.lit(i).alias("side")
    ).filter("x IS NOT NULL")
    both = side(candidates, candidate_id, 0).unionByName(side(anchors, anchor_id, 1))
    order = SeriesOrder.by_value(tuple(keys), "x", ("side", "id"))
    steps = previous(both, order, {"x1": ("x", 1)})
    cut = F.when(F.col("x") - F.col("x1") <= gate, 0).otherwise(1).cast("bigint")
    pieces = materialize(running(steps, order, {"piece": ("sum", cut)}).drop("x1"))
    mixed = pieces.groupBy(*keys, "piece").agg(F.countDistinct("side").alias("s")).filter("s = 2")
    pieces = pieces.join(mixed, [*keys, "piece"], "left_semi")
    kinds = {f.name: f.dataType for f in candidates.schema.fields}
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [
            T.StructField(candidate_id, candidates.schema[candidate_id].dataType),
            T.StructField(anchor_id, anchors.schema[anchor_id].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "id"])
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        pairs = match_on_line(a["x"].to_numpy(), b["x"].to_numpy(), gate)
        i, j = [p[0] for p in pairs], [p[1] for p in pairs]
        out = {k: a[k].to_numpy()[i] for k in keys}
        out |= {candidate_id: a["id"].to_numpy()[i], anchor_id: b["id"].to_numpy()[j]}
        return pd.DataFrame({**out, "distance": np.abs(a["x"].to_numpy()[i] - b["x"].to_numpy()[j])})

    return spread_by_key(pieces, [*keys, "piece"]).groupBy(*keys, "piece").applyInPandas(solve, schema)


class LineMatcher:
    """Least total distance on a line when every point of one side must be matched, point by point from the left.

    Let d be the points so far that must be matched, less the chosen points of the other side. Crossing a
    gap costs its length times abs(d), so the least cost of everything to the left is a convex function of
    d, held as its slopes: ``left`` those below d = 0, ``right`` those above, each in order with the ones next
    to 0 at the end. A gap adds to the right and takes from the left, which both hold by reference to the
    current position; a point of the must side shifts the function, one of the other side puts in a slope of
    zero. Whether that point is chosen depends on d alone, through one threshold, so a later pass from the
    right needs a number for each point and no table. Slopes that the points still to come cannot use are
    dropped: there are never more of them than points on the must side.
    """

    def __init__(self, must: int):
        self.remaining = must
        self.low = 0  # least d that can occur
        self.left: list[float] = []  # slope + position
        self.right: list[float] = []  # position - slope, so that it also ascends towards 0

    def must(self) -> None:
        self.remaining -= 1
        if self.low < 0 and self.left:
            self.right.append(self._at - (self.left.pop() - self._at))
        self.low += 1

    def other(self) -> int:
        """The threshold: the point is chosen if d after it is smaller."""
        x = self._at
        negative = bisect.bisect_left(self.left, x)
        below = len(self.right) - bisect.bisect_right(self.right, x)  # slopes under zero on the right
        threshold = self.low + negative + below
        self.low -= 1
        if below:
            self.right.insert(len(self.right) - below, x)
            if self.low < 0:
                self.left.append(2 * x - self.right.pop())
        elif self.low < 0:
            self.left.append(x)
        else:
            self.right.append(x)
        # Choosing more ahead than there are points left to match is of no use.
        if -self.low > self.remaining:
            self.left.pop(0)
            self.low += 1
        return threshold

    def move(self, x: float) -> None:
        self._at = x


def _keyed_batches(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[tuple]]]:
    for pdf in batches:
        columns = [[None if pd.isna(v) else v for v in pdf[k]] for k in keys]
        yield pdf, list(zip(*columns)) if keys else [()] * len(pdf)


def assign_then_gate(
    candidates: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    position: str,
    candidate_id: str,
    anchor_id: str,
    gate: float | None,
) -> DataFrame:
    """Assignment of least total distance over all pairs of a group; pairs beyond the gate go afterwards.

    All points of the smaller side are matched (the candidates, where both are equal in number). Both
    sides stream through one sorted partition, left to right and back; what is kept is one slope for each
    point that waits. On a line some best assignment keeps both orders, so the k-th matched point of one
    side belongs to the k-th of the other.
    """
    keys = list(keys)
    side = lambda d, name, i: d.select(
        *keys, F.col(position).cast("double").alias("x"), F.col(name).alias("id"), F.lit(i).alias("side")
    ).filter("x IS NOT NULL")
    both = side(candidates, candidate_id, 0).unionByName(side(anchors, anchor_id, 1))
    groups = [F.col(k).alias(f"__{k}") for k in keys]
    sizes = both.groupBy(*groups).agg(*[F.sum(F.when(F.col("side") == i, 1).otherwise(0)).alias(f"n{i}") for i in (0, 1)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = both.join(sizes.filter("n0 > 0 AND n1 > 0"), same).select(
        *keys, "x", "id", "side", F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("must"), F.least("n0", "n1").alias("n")
    )
    kinds = {f.name: f.dataType for f in both.schema.fields}
    base = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, "x", "id", "side", "must", "n")])
    forward_schema = T.StructType([*base.fields, T.StructField("threshold", T.LongType())])
    backward_schema = T.StructType([*base.fields, T.StructField("rank", T.LongType())])

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, matcher = None, None
        for pdf, names in _keyed_batches(batches, keys):
            out = []
            for key, x, own, must, n in zip(names, pdf["x"].tolist(), pdf["side"].tolist(), pdf["must"].tolist(), pdf["n"].tolist()):
                if matcher is None or key != now:
                    now, matcher = key, LineMatcher(n)
                matcher.move(x)
                if own == must:
                    matcher.must()
                    out.append(0)
                else:
                    out.append(matcher.other())
            yield pdf.assign(threshold=out)

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, d, ranks = None, 0, [0, 0]
        for pdf, names in _keyed_batches(batches, keys):
            out = []
            for key, own, must, threshold in zip(names, pdf["side"].tolist(), pdf["must"].tolist(), pdf["threshold"].tolist()):
                if now is None or key != now:
                    now, d, ranks = key, 0, [0, 0]
                if own == must:
                    d -= 1
                elif d < threshold:
                    d += 1
                else:
                    out.append(-1)
                    continue
                out.append(ranks[own])
                ranks[own] += 1
            yield pdf.assign(rank=out)[backward_schema.names]

    order = ["x", "side", "id"]
    passed = sorted_by_key(both, keys, order).mapInPandas(forward, forward_schema)
    # Rows of a key are still in one partition, so the way back needs no shuffle.
    back = passed.sortWithinPartitions(*keys, *[F.desc(c) for c in order]).mapInPandas(backward, backward_schema)
    pick = lambda c, i: F.max(F.when(F.col("side") == i, F.col(c)))
    pairs = back.filter("rank >= 0").groupBy(*keys, "rank").agg(
        pick("id", 0).alias(candidate_id), pick("id", 1).alias(anchor_id), F.abs(pick("x", 0) - pick("x", 1)).alias("distance")
    )
    pairs = pairs.drop("rank")
    return pairs if gate is None else pairs.filter(F.col("distance") <= gate)


def _first_choices(cost: np.ndarray) -> dict[int, int] | None:
    """The one best assignment where every row with an allowed column can have its own least one, else nothing."""
    out: dict[int, int] = {}
    taken = set()
    for i, row in enumerate(cost.tolist()):
        least = min(row)
        if least == math.inf:
            continue
        j = row.index(least)
        if j in taken or row.count(least) > 1:
            return None
        taken.add(j)
        out[i] = j
    return out


def solve_scores(cost: np.ndarray) -> dict[int, int]:
    """Least-cost row to column assignment of a small table (inf = not allowed).

    Shortest augmenting paths, one row at a time; every row may also stay unmatched at a price above
    any allowed total, so the number of matches is maximal.
    """
    n, m = cost.shape
    allowed = np.isfinite(cost)
    if not allowed.any():
        return {}
    first = _first_choices(cost)
    if first is not None:
        return first
    floor = cost[allowed].min()
    price = (cost[allowed].max() - floor + 1.0) * (n + 1)
    table = np.full((n, m + n), price)
    table[:, :m] = np.where(allowed, cost - floor, 2 * price * (n + 1))
    owner = np.full(m + n, -1)
    row_pot, col_pot = np.zeros(n), np.zeros(m + n)
    for row in range(n):
        dist = table[row] - row_pot[row] - col_pot
        came, done = np.full(m + n, row), np.zeros(m + n, bool)
        while True:
            col = int(np.argmin(np.where(done, np.inf, dist)))
            done[col] = True
            reach = dist[col]
            if owner[col] < 0:
                break
            through = reach + table[owner[col]] - row_pot[owner[col]] - col_pot
            better = ~done & (through < dist)
            dist[better], came[better] = through[better], owner[col]
        settled = done.copy()
        settled[col] = False
        for c in np.flatnonzero(settled):
            row_pot[owner[c]] += reach - dist[c]
            col_pot[c] -= reach - dist[c]
        row_pot[row] += reach
        while True:
            r = came[col]
            owner[col], col = r, int(np.flatnonzero(owner == r)[0]) if (owner == r).any() else -1
            if r == row:
                break
    return {int(r): int(c) for c, r in enumerate(owner[:m]) if r >= 0 and allowed[r, c]}
