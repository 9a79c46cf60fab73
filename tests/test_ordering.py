"""Chunked windows, quantiles and scans equal plain per-series computation, also with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import audit, folds, windows
from seriesloom.operators.ordering import SeriesOrder, number_rows, plan_chunks, previous, running
from seriesloom.operators.quantiles import exact_quantiles, quantile_columns, weighted_quantiles


@pytest.fixture(scope="module")
def base():
    """A hot key with a third of the rows, gaps of many chunks, equal times, and a one-row key."""
    rng = np.random.default_rng(5)
    parts = []
    for key, n in (("hot", 300), ("a", 200), ("b", 150), ("c", 149), ("one", 1)):
        hours = np.sort(rng.integers(0, 24 * 90, n)) * (1 if key != "b" else 3)
        parts.append(pd.DataFrame({"k": key, "h": hours, "v": np.round(rng.gamma(2, 15, n), 2)}))
    d = pd.concat(parts, ignore_index=True)
    d["i"] = np.arange(len(d))
    d["t"] = pd.Timestamp("2021-03-01") + pd.to_timedelta(d["h"], unit="h")
    return d.sort_values(["k", "t", "i"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def df(spark, base):
    shuffled = base.sample(frac=1, random_state=3)
    return spark.createDataFrame(shuffled[["k", "i", "t", "v"]]).withColumn("t", F.col("t").cast("timestamp_ntz")).repartition(5)


BY = SeriesOrder.by_time(("k",), "t", ("i",))


def pull(d):
    return d.toPandas().sort_values(["k", "t", "i"]).reset_index(drop=True)


def test_previous(df, base):
    got = pull(previous(df, BY, {"p1": ("v", 1), "p3": ("v", 3)}))
    g = base.groupby("k").v
    pd.testing.assert_series_equal(got.p1, g.shift(1), check_names=False)
    pd.testing.assert_series_equal(got.p3, g.shift(3), check_names=False)


def test_running(df, base):
    got = pull(running(df, BY, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v"))}))
    g = base.groupby("k").v
    np.testing.assert_allclose(got.s, g.cumsum())
    np.testing.assert_allclose(got.m, g.cummax())
    np.testing.assert_allclose(got.n, g.cummin())
    assert (pull(number_rows(df, BY)).sequence_number == base.groupby("k").cumcount() + 1).all()


@pytest.mark.parametrize("width", ["6 hours", "2 days", "400 days"])
def test_chunk_width_does_not_matter(df, base, width):
    by = SeriesOrder.by_time(("k",), "t", ("i",), width)
    got = pull(windows.running_median(df, by, "v"))
    want = base.groupby("k").v.rolling(3, min_periods=1).median().to_numpy()
    np.testing.assert_allclose(got.running_median, want)


def test_exact_quantiles(df, base):
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["k"], "v", ps).toPandas().pivot(index="k", columns="probability", values="quantile")
    want = base.groupby("k").v.quantile(ps).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy())
    whole = exact_quantiles(df, [], F.col("v") - 20, [0.25]).first()["quantile"]
    np.testing.assert_allclose(whole, np.quantile(base.v - 20, 0.25))


def test_quantiles_with_multiplicity(df, base):
    got = quantile_columns(df, ["k"], "v", {"m": 0.5}, freq=(F.col("i") % 3)).toPandas().set_index("k").m
    for key, g in base.groupby("k"):
        copies = np.repeat(g.v, g.i % 3)
        if len(copies):
            np.testing.assert_allclose(got[key], np.median(copies))


def test_weighted_quantiles(df, base):
    rows = df.withColumn("w", F.lit(1.0) + F.col("i") % 5)
    got = weighted_quantiles(rows, ["k"], "v", "w", {"a": 0.025, "b": 0.6}, ["i"]).toPandas().set_index("k")
    for key, g in base.groupby("k"):
        g = g.sort_values(["v", "i"])
        w = np.cumsum(1.0 + g.i % 5)
        np.testing.assert_allclose(got.loc[key, ["a", "b"]].astype(float), np.interp([0.025, 0.6], w / w.iloc[-1], g.v))


def sequential(base, step):
    out = []
    for _, g in base.groupby("k"):
        state = before = None
        for t, v in zip(g.t, g.v):
            dt = 0.0 if before is None else max((t - before).total_seconds() / 86400, 1e-6)
            state, before = step(state, v, dt), t
            out.append(state)
    return out


def kalman_step(r, first_again=False):
    def step(s, v, dt):
        if s is None:
            x, p = np.array([v, 0.0]), np.diag([144.0, 64.0])
            if not first_again:
                return x, p
        else:
            f = np.array([[1, dt], [0, 1.0]])
            x, p = f @ s[0], f @ s[1] @ f.T + np.diag([8.78**2 * dt, 0.35**2 * dt])
        gain = p[:, 0] / (p[0, 0] + r)
        return x + gain * (v - x[0]), p - np.outer(gain, p[0])

    return step


@pytest.mark.parametrize("block", [3, 256])
def test_scans_equal_sequential(df, base, block):
    rows = df.withColumns({"r": F.lit(200.0), "p": F.lit(144.0)})
    ewma = pull(folds.scan(df, BY, folds.ewma("v"), ["v"], block))
    want = sequential(base, lambda s, v, dt: v if s is None else 0.5 * v + 0.5 * s)
    np.testing.assert_allclose(ewma.ewma, want, rtol=1e-12)

    def holt(s, v, dt):
        if s is None:
            return v, 0.0
        level = 0.5 * v + 0.5 * (s[0] + s[1] * dt)
        return level, 0.2 * (level - s[0]) / dt + 0.8 * s[1]

    got = pull(folds.scan(df, BY, folds.holt("v"), ["v"], block))
    np.testing.assert_allclose(got[["level", "trend"]], np.array(sequential(base, holt)), rtol=1e-7, atol=1e-6)
    smoother = folds.kalman("v", "r", 8.78, 0.35, start_variance="p")
    got = pull(folds.scan(rows, BY, smoother, ["v", "r", "p"], block))
    want = np.array([s[0] for s in sequential(base, kalman_step(200.0, True))])
    np.testing.assert_allclose(got[["level", "trend"]], want, rtol=1e-9, atol=1e-9)


def test_isotonic_equals_min_max_formula(df, base):
    got = pull(audit.isotonic_fit(df, BY, "v"))
    for key, g in got.groupby("k"):
        v = g.v.to_numpy()
        c = np.concatenate([[0], np.cumsum(v)])
        n = len(v)
        mean = lambda i, j: (c[j + 1] - c[i]) / (j + 1 - i)
        pick = range(0, n, max(1, n // 12))
        want = [max(min(mean(i, j) for j in range(t, n)) for i in range(t + 1)) for t in pick]
        np.testing.assert_allclose(g.isotonic.to_numpy()[list(pick)], want)
    assert not got.causal.any()


def test_user_estimator_with_lookback(df, base):
    got = pull(audit.estimate_with(df, BY, ["v"], lambda d: d.v.rolling(4, min_periods=1).max(), "m4", 3))
    np.testing.assert_allclose(got.m4, base.groupby("k").v.rolling(4, min_periods=1).max().to_numpy())


def test_first_row_has_no_elapsed_time(df):
    d = windows.naive_forecasts(df, BY, "v").filter("last_observation IS NULL").toPandas()
    assert (d.elapsed_days == 0).all() and len(d) == 5


def crowded(spark, kind):
    """A third of all rows lie in one hour (or have one time and one value) of one key; ties are told apart by i."""
    rng = np.random.default_rng(8)
    n = 6_000
    d = pd.DataFrame({"k": np.where(np.arange(n) < n // 3, "hot", rng.choice(list("abcdefgh"), n)), "i": rng.permutation(n)})
    late = pd.Timestamp("2021-03-01") + pd.to_timedelta(rng.integers(0, 90 * 86_400, n), unit="s")
    near = pd.Timestamp("2021-04-01 12:00") + pd.to_timedelta(rng.integers(0, 3_600_000_000, n), unit="us")
    hot = d.k == "hot"
    d["t"] = np.where(hot, near if kind == "hour" else near.floor("h"), late)
    d["v"] = np.where(hot & (kind == "value"), 7.0, np.round(rng.gamma(2, 15, n), 2))
    rows = spark.createDataFrame(d.assign(t=d.t.astype("datetime64[us]"))).withColumn("t", F.col("t").cast("timestamp_ntz"))
    return rows.repartition(9), d


def most_in_a_task(df):
    """All columns are read, so that no window is pruned away."""
    rows = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns)).alias("h"))
    return rows.agg(F.max("n"), F.max("h")).first()[0]


@pytest.mark.parametrize("kind", ["hour", "value"])
def test_crowded_hours_and_values_are_divided_between_tasks(spark, kind):
    df, d = crowded(spark, kind)
    by = SeriesOrder.by_time(("k",), "t", ("i",)) if kind == "hour" else SeriesOrder.by_value(("k",), "v", ("i",))
    first = "t" if kind == "hour" else "v"
    planned = plan_chunks(df, by, most=100)
    assert planned.heavy and not by.heavy
    assert planned.chunked(df).groupBy("k", "__chunk").count().agg(F.max("count")).first()[0] <= 100
    assert by.chunked(df).groupBy("k", "__chunk").count().agg(F.max("count")).first()[0] >= 2_000
    want = d.sort_values(["k", first, "i"]).reset_index(drop=True)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        lagged = previous(df, planned, {"p": ("i", 2)})
        summed = running(df, planned, {"s": ("sum", F.col("i"))})
        assert most_in_a_task(lagged) < 700 and most_in_a_task(summed) < 700
        assert most_in_a_task(previous(df, by, {"p": ("i", 2)})) >= 2_000
        order = lambda x: x.toPandas().sort_values(["k", first, "i"]).reset_index(drop=True)
        np.testing.assert_array_equal(order(lagged).p, want.groupby("k").i.shift(2))
        np.testing.assert_array_equal(order(summed).s, want.groupby("k").i.cumsum())
        numbers = order(number_rows(df, planned)).sequence_number
        np.testing.assert_array_equal(numbers, want.groupby("k").cumcount() + 1)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)


def test_planning_without_heavy_chunks_changes_nothing(df):
    planned = plan_chunks(df, BY)
    assert planned.heavy == () and "__chunk" not in number_rows(df, planned).columns


def test_rows_equal_in_all_order_columns_stay_together(spark):
    same = spark.range(500).select(F.lit("x").alias("k"), F.lit(3.0).alias("v"), F.lit(1).alias("i"))
    planned = plan_chunks(same, SeriesOrder.by_value(("k",), "v", ("i",)), most=10)
    assert planned.heavy == ()


@pytest.mark.parametrize("block", [4, 256])
def test_scans_over_planned_chunks(df, base, block):
    planned = plan_chunks(df, BY, most=9)
    assert planned.heavy
    got = pull(folds.scan(df, planned, folds.ewma("v"), ["v"], block))
    want = sequential(base, lambda s, v, dt: v if s is None else 0.5 * v + 0.5 * s)
    np.testing.assert_allclose(got.ewma, want, rtol=1e-12)


def test_crowded_values_are_narrowed_before_they_are_ordered(spark):
    """A third of all rows within a millionth, in one bucket; the last window sees few of them."""
    rng = np.random.default_rng(4)
    v = np.concatenate([5 + rng.random(20_000) * 1e-6, rng.gamma(2, 15, 40_000)])
    d = pd.DataFrame({"k": np.where(rng.random(len(v)) < 0.8, "hot", "b"), "v": v})
    df = spark.createDataFrame(d).repartition(6)
    wanted = [0.0, 0.11, 0.25, 0.5, 0.9, 1.0]
    for rounds in (0, 1, 2):
        got = {(r.k, r.probability): r["quantile"] for r in exact_quantiles(df, ["k"], "v", wanted, rounds=rounds).collect()}
        for key, g in d.groupby("k"):
            np.testing.assert_allclose([got[key, p] for p in wanted], np.quantile(g.v, wanted), rtol=1e-12)

    from seriesloom.operators import quantiles

    seen = []
    original = quantiles._narrowed

    def watched(counts, targets, sizes):
        out = original(counts, targets, sizes)
        seen.append(out[0].join(out[1].select("__g", "__b"), ["__g", "__b"]).groupBy("__g", "__b").count().agg(F.max("count")).first()[0])
        return out

    quantiles._narrowed = watched
    try:
        exact_quantiles(df, ["k"], "v", wanted, rounds=2)
    finally:
        quantiles._narrowed = original
    assert seen[1] <= 100 and seen[1] <= seen[0]
