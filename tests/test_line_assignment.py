"""Assignment on a line: all pairs first, gate afterwards."""

import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from seriesloom.operators import assignment
from seriesloom.operators.assignment import LineMatcher, assign_by_position, assign_then_gate, match_on_line


def least(a, b):
    """Least total distance when every point of the smaller side is matched, by trying everything."""
    small, large = sorted((list(a), list(b)), key=len)
    return min(sum(abs(x - y) for x, y in zip(small, pick)) for pick in itertools.permutations(large, len(small)))


def chosen(must, other):
    """Indexes of ``other`` that the two passes choose."""
    points = sorted([(x, 0, i) for i, x in enumerate(must)] + [(x, 1, i) for i, x in enumerate(other)])
    matcher, thresholds = LineMatcher(len(must)), []
    for x, side, _ in points:
        matcher.move(x)
        thresholds.append(matcher.other() if side else matcher.must())
        assert len(matcher.left) <= len(must) + 1
    d, out = 0, []
    for (x, side, i), threshold in zip(reversed(points), reversed(thresholds)):
        if not side:
            d -= 1
        elif d < threshold:
            d += 1
            out.append(i)
    assert d == 0
    return out


def test_matcher_against_all_assignments():
    rng = np.random.default_rng(3)
    for k in range(1500):
        n, m = sorted(rng.integers(1, 7, 2))
        draw = (lambda size: rng.integers(0, 12, size).astype(float)) if k % 2 else (lambda size: rng.random(size) * 100)
        a, b = draw(n), draw(m)
        picked = np.sort(b[chosen(a, b)])
        assert len(picked) == n and np.abs(np.sort(a) - picked).sum() == pytest.approx(least(a, b))


def frames(spark, groups):
    a = [(g, i, float(x)) for g, (xs, _) in groups.items() for i, x in enumerate(xs)]
    b = [(g, i, float(x)) for g, (_, xs) in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(a, "g string, cid long, x double"), spark.createDataFrame(b, "g string, aid long, x double")


def test_both_gate_orders_on_the_known_case(spark):
    a, b = frames(spark, {"u": ([0, 100], [90, 175])})
    after = assign_then_gate(a, b, ["g"], "x", "cid", "aid", 80.0).collect()
    before = assign_by_position(a, b, ["g"], "x", "cid", "aid", 80.0).collect()
    assert [(r.cid, r.aid, r.distance) for r in after] == [(1, 1, 75.0)]
    assert [(r.cid, r.aid, r.distance) for r in before] == [(1, 0, 10.0)]


def test_groups_null_keys_null_positions_and_either_side_smaller(spark):
    rng = np.random.default_rng(5)
    groups = {g: (rng.random(n) * 300, rng.random(m) * 300) for g, n, m in (("p", 5, 6), ("q", 6, 3), (None, 4, 4), ("r", 0, 3))}
    a, b = frames(spark, groups)
    a = a.unionByName(spark.createDataFrame([("p", 99, None)], a.schema))
    got = assign_then_gate(a, b, ["g"], "x", "cid", "aid", None).toPandas()
    for g, (x, y) in groups.items():
        own = got[got.g.isna()] if g is None else got[got.g == g]
        k = min(len(x), len(y))
        assert (len(own), own.cid.nunique(), own.aid.nunique()) == (k, k, k)
        if k:
            assert own.distance.sum() == pytest.approx(least(x, y))
            np.testing.assert_allclose(own.distance, np.abs(x[own.cid] - y[own.aid]))


def test_one_group_with_many_points_streams(spark):
    rng = np.random.default_rng(9)
    x, y = np.sort(rng.random(4_000) * 1e6), np.sort(rng.random(30_000) * 1e6)
    a, b = frames(spark, {"hot": (x, y)})
    got = assign_then_gate(a, b, ["g"], "x", "cid", "aid", None).toPandas()
    cost = np.zeros(len(y) + 1)  # the quadratic table
    for v in x:
        cost = np.append(np.inf, np.minimum.accumulate(cost[:-1] + np.abs(v - y)))
    assert got.distance.sum() == pytest.approx(cost[-1]) and got.aid.is_unique and len(got) == len(x)


def whole_table(left, right, gate):
    """The alignment table with all its cells."""
    prize = gate * (min(len(left), len(right)) + 1) + 1.0
    gain = np.abs(left[:, None] - right[None, :])
    gain = np.where(gain <= gate, prize - gain, -np.inf)
    best = np.zeros((len(left) + 1, len(right) + 1))
    for i in range(len(left)):
        row = np.maximum(best[i, 1:], best[i, :-1] + gain[i])
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(row, 0.0))
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


@pytest.mark.parametrize("cells", [1, 50, 1 << 22])
def test_gated_match_equals_the_whole_table(monkeypatch, cells):
    monkeypatch.setattr(assignment, "CELLS", cells)
    rng = np.random.default_rng(11)
    for k in range(1500):
        n, m = rng.integers(0, 40, 2)
        span = float(rng.choice([5, 60, 400]))
        draw = (lambda size: rng.integers(0, span, size).astype(float)) if k % 2 else (lambda size: np.round(rng.random(size) * span, 2))
        a, b = np.sort(draw(n)), np.sort(draw(m))
        gate = float(rng.choice([0.0, 1.0, 7.0, 80.0]))
        assert match_on_line(a, b, gate) == whole_table(a, b, gate)


def test_memory_of_a_large_piece_follows_its_points():
    """Its whole table has 180 million cells, more than 2.8 GB with the distances."""
    rng = np.random.default_rng(12)
    a, b = np.sort(rng.random(4_000) * 11_000), np.sort(rng.random(45_000) * 11_000)
    tracemalloc.start()
    pairs = match_on_line(a, b, 80.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == len(a) and peak < 64 << 20
