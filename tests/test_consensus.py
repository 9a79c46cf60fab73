"""Line consensus: spread seeds against every pair looked at in turn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import consensus as C


def brute(marks):
    """All pairs in order; equal sets of marks rated once; the first of the best."""
    x, y = marks[:, 0], marks[:, 1]
    seen, best = set(), None
    for i in range(len(marks)):
        for j in range(i + 1, len(marks)):
            rise = y[j] - y[i]
            if abs(rise) < C.MIN_RISE or abs((x[j] - x[i]) / rise) > C.MAX_SLOPE:
                continue
            s = (x[j] - x[i]) / rise
            inside = np.abs(x - (s * y + (x[i] - s * y[i]))) <= C.ALIGN_PX
            if inside.sum() < C.MIN_BANDS or inside.tobytes() in seen:
                continue
            seen.add(inside.tobytes())
            got = C.rate(marks[inside])
            if got and (best is None or got[0] > best[0]):
                best = got
    return best


def image(rng, poles, clutter):
    parts = []
    for _ in range(poles):
        n, gap, lean = rng.integers(4, 12), rng.uniform(24, 70), rng.uniform(-0.2, 0.2)
        y = rng.uniform(0, 200) + gap * np.arange(n)
        parts.append(np.column_stack([rng.uniform(50, 600) + lean * y + rng.normal(0, 2, n), y, rng.uniform(20, 90, n), rng.integers(1, 6, n)]))
    parts.append(np.column_stack([rng.uniform(0, 640, clutter), rng.integers(0, 60, clutter) * 10.0, rng.uniform(5, 60, clutter), rng.integers(1, 6, clutter)]))
    return np.vstack(parts)


@pytest.mark.parametrize("seed", range(25))
def test_best_line_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    marks = image(rng, rng.integers(0, 4), rng.integers(0, 60))
    marks = marks[np.argsort(-marks[:, 3], kind="stable")]
    a, b = C.best_line(marks), brute(marks)
    assert (a is None) == (b is None)
    if a:
        assert a[0] == b[0] and a[2] == b[2]
        np.testing.assert_array_equal(a[1], b[1])


def table(spark, images):
    rows = [(k, i, *map(float, m)) for k, marks in images.items() for i, m in enumerate(marks)]
    return spark.createDataFrame(rows, "image string, nr long, x double, y double, area double, component_score double")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image"], []).append((r["score"], r["x"], r["y"], r["area"], r["base_gap"], r["regularity"], r["line_rmse"], r["span"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [1, 7, 512])
def test_blocks_of_seeds_change_nothing(spark, block):
    images = {f"i{s}": image(np.random.default_rng(100 + s), s % 3, 25) for s in range(6)} | {None: image(np.random.default_rng(7), 2, 10)}
    want = {}
    for k, marks in images.items():
        order = np.lexsort((np.arange(len(marks)), -marks[:, 3]))
        best = brute(marks[order])
        if best:
            score, own, info = best
            want[k] = sorted((score, *m[:3], *[info[n] for n in C.FIGURES]) for m in own)
    got = found(C.pole_sequences(table(spark, images), ["image"], ["nr"], block))
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12)


def test_one_image_with_most_marks_is_many_tasks(spark):
    rng = np.random.default_rng(11)
    hot = image(rng, 3, 900)
    df = table(spark, {"hot": hot, **{f"c{s}": image(np.random.default_rng(s), 1, 8) for s in range(5)}})
    seen = spark.sparkContext.accumulator(0)
    original = C.best_of

    def counted(marks, seeds):
        seen.add(1 if len(marks) > 500 else 0)
        assert len(list(seeds)) <= 100
        return original(marks, seeds)

    C.best_of = counted
    try:
        got = found(C.pole_sequences(df, ["image"], ["nr"], 100))
    finally:
        C.best_of = original
    assert seen.value == -(-len(hot) // 100)
    score, own, _ = C.best_line(hot[np.lexsort((np.arange(len(hot)), -hot[:, 3]))])
    assert got["hot"][0][0] == score and len(got["hot"]) == len(own)
    assert df.filter(F.col("image") == "hot").count() > df.count() / 3


def test_a_set_of_marks_is_rated_once_whatever_seeds_find_it(monkeypatch):
    """Bands of even rows hold many pairs, and most pairs of a pole find the same marks."""
    rng = np.random.default_rng(4)
    n = 40
    marks = np.column_stack([320 + np.arange(n) % 7 * 0.8, np.arange(n) * 24 + rng.integers(0, 4, n), 50.0 + np.arange(n) % 13, 1.0 + np.arange(n) % 11])
    seen = []
    own = C._rate
    monkeypatch.setattr(C, "_rate", lambda rows, least: seen.append(rows.tobytes()) or own(rows, least))
    found = C.best_of(marks, range(n))
    assert len(seen) == len(set(seen)) > 0
    got = own(marks[np.argsort(marks[:, 1], kind="stable")], -np.inf)
    assert found.score >= got[0]


def test_a_rating_out_of_reach_is_given_up_and_others_are_whole():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(5, 40))
        marks = np.column_stack([320 + rng.random(n) * 6, np.cumsum(rng.choice([4.0, 24.0, 25.0, 27.0, 60.0], n)), rng.random(n) * 50 + 1, rng.random(n)])
        whole = C.rate(marks)
        if whole is None:
            continue
        assert C._rate(marks, whole[0])[0] == whole[0]
        short = C._rate(marks, whole[0] + 1e-6)
        assert short is None or short[0] == whole[0]
