"""Particle filter, tracker, assignment and streams: behaviour, differential and metamorphic tests."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import particle as PF
from seriesloom.operators import tracking as TR
from seriesloom.operators.assignment import assign_by_position, match_on_line, solve_scores
from seriesloom.operators.consensus import best_line
from seriesloom.plans.states import TRACK, event_stream, finish, frames_and_candidates
from seriesloom.plans.registry import Tables
from seriesloom.streaming import stateful as ST

SMALL = PF.FilterSettings(particles=300)


def series(spark, extra=()):
    rows = [
        ("p1", "2021-07-01", 50.0, 14.0), ("p1", "2021-07-03", 72.0, 15.0), ("p1", "2021-07-07", 118.0, 18.0),
        ("p1", "2021-07-08", 125.0, 13.0), ("p2", "2021-07-02", 90.0, None), ("p2", "2021-07-05", 300.0, 10.0),
        *extra,
    ]
    d = pd.DataFrame(rows, columns=["plant_uid", "date", "height", "sd"]).astype({"date": "datetime64[ns]"})
    return spark.createDataFrame(d).withColumn("date", F.col("date").cast("timestamp_ntz"))


def run(spark, d, s=SMALL, **options):
    out = PF.particle_filter(d, "plant_uid", "date", "height", settings=s, columns={"sd": "sd"}, **options)
    return out.toPandas().sort_values(["plant_uid", "date"]).reset_index(drop=True)


def test_normal_cdf():
    x = np.linspace(-12, 12, 4001)
    np.testing.assert_allclose(PF.normal_cdf(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], atol=1e-15)


def test_quantiles_invert_the_mixture():
    p = PF.Particles("x", SMALL)
    p.start(40.0, 10.0, 0, 3.0, 2.0)
    for p_out in (0.0, 0.08, 0.4):
        q = p.mixture_quantiles(12.0, p_out)
        np.testing.assert_allclose(p.mixture(q, 12.0, p_out)[0], PF.PREDICTIVE_P, atol=1e-7)


def test_first_row_and_columns(spark):
    got = run(spark, series(spark))
    first = got.groupby("plant_uid").head(1)
    assert first.predictive_mean_cm.isna().all() and (first.effective_sample_size == 300).all()
    assert list(got.columns) == ["plant_uid", "date", "height", "sd", *PF.OUTPUTS] and len(PF.OUTPUTS) == 28
    assert list(got.online_sequence_number) == [1, 2, 3, 4, 1, 2]
    assert got.loc[5, "outlier_posterior_probability"] > 0.5
    assert got.loc[2, "linear_extrapolation_prediction_cm"] == pytest.approx(72 + 11 * 4)


def test_future_rows_change_nothing(spark):
    short = run(spark, series(spark))
    long = run(spark, series(spark, [("p1", "2021-07-20", 10.0, 5.0), ("p3", "2021-06-01", 1.0, 5.0)]))
    both = long.merge(short, on=["plant_uid", "date"], suffixes=("", "_s"))
    assert len(both) == len(short)
    for c in PF.OUTPUTS:
        pd.testing.assert_series_equal(both[c], both[f"{c}_s"], check_names=False, check_exact=True)


def test_partitioning_and_row_order_change_nothing(spark):
    a = run(spark, series(spark))
    b = run(spark, series(spark).orderBy(F.desc("height")).repartition(7))
    pd.testing.assert_frame_equal(a, b)


def test_slices_equal_one_run(spark):
    d = series(spark)
    whole = run(spark, d)
    parts = PF.filter_in_slices(
        d, "plant_uid", "date", "height", ["2021-07-03 12:00:00", "2021-07-07 12:00:00"], settings=SMALL, columns={"sd": "sd"}
    ).toPandas()
    parts = parts.sort_values(["plant_uid", "date"]).reset_index(drop=True)[whole.columns]
    pd.testing.assert_frame_equal(whole, parts)


def test_zero_outlier_probability_is_legal(spark):
    got = run(spark, series(spark), replace(SMALL, outlier_probability=0.0))
    assert np.isfinite(got.predictive_log_score.dropna()).all() and got.outlier_posterior_probability.max() == 0


def brute(cost):
    n, m = cost.shape
    for k in range(min(n, m), 0, -1):
        totals = [
            sum(cost[r, c] for r, c in zip(rows, cols))
            for rows in itertools.combinations(range(n), k)
            for cols in itertools.permutations(range(m), k)
        ]
        if np.isfinite(min(totals)):
            return k, min(totals)
    return 0, 0.0


def test_assignment_solvers_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = rng.integers(1, 5), rng.integers(1, 6)
        cost = rng.normal(0, 3, (n, m))
        cost[rng.random((n, m)) < 0.4] = np.inf
        got, (k, total) = solve_scores(cost), brute(cost)
        assert len(got) == k == len(set(got.values()))
        assert sum(cost[r, c] for r, c in got.items()) == pytest.approx(total)
        a, b = np.sort(rng.random(n) * 10), np.sort(rng.random(m) * 10)
        d = np.abs(a[:, None] - b)
        d[d > 2] = np.inf
        pairs, (k, total) = match_on_line(a, b, 2.0), brute(d)
        assert len(pairs) == k and sum(d[i, j] for i, j in pairs) == pytest.approx(total)


def test_position_assignment_per_group(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"g": np.repeat(["u", "v"], 5), "cid": range(10), "x": rng.random(10) * 400})
    b = pd.DataFrame({"g": np.repeat(["u", "v"], 4), "aid": range(8), "x": rng.random(8) * 400})
    got = assign_by_position(spark.createDataFrame(a), spark.createDataFrame(b), ["g"], "x", "cid", "aid", 80.0).toPandas()
    for g in "uv":
        d = np.abs(a[a.g == g].x.to_numpy()[:, None] - b[b.g == g].x.to_numpy())
        d[d > 80] = np.inf
        k, total = brute(d)
        mine = got[got.g == g]
        assert (len(mine), mine.cid.nunique(), mine.aid.nunique()) == (k, k, k)
        assert mine.distance.sum() == pytest.approx(total)


def frame_tables(spark, shots):
    """shots: (day, [(height_px, confidence, x)])"""
    frames = [("cam", (pd.Timestamp("2021-07-01") + pd.Timedelta(days=day)).to_pydatetime(), f"f{day}") for day, _ in shots]
    found = [
        (f"f{day}", i, conf, x, 400.0 - h, 400.0, float(h))
        for day, items in shots
        for i, (h, conf, x) in enumerate(items)
    ]
    f = spark.createDataFrame(frames, "camera_id string, capture_datetime timestamp_ntz, filename string")
    c = spark.createDataFrame(found, "filename string, candidate_index bigint, confidence double, x_root_fraction double, y_top double, y_root double, height_px double")
    return f, c


ONE = TR.TrackSettings(expected=1, filter=replace(TR.APP_FILTER, particles=400))


def test_prior_beats_confidence(spark):
    shots = [(0, [(120, 0.9, 0.5)]), (1, [(130, 0.60, 0.5), (350, 0.95, 0.5)])]
    got = TR.track(*frame_tables(spark, shots), ONE).toPandas().sort_values("capture_datetime")
    assert list(got.candidate_index) == [0, 0]
    plain = TR.track(*frame_tables(spark, shots), replace(ONE, use_prior=False)).toPandas()
    assert plain.sort_values("capture_datetime").candidate_index.iloc[1] == 1


def test_missed_frame_still_gets_a_row(spark):
    shots = [(0, [(120, 0.9, 0.5)]), (2, []), (5, [(170, 0.9, 0.9)])]
    got = TR.track(*frame_tables(spark, shots), ONE).toPandas().sort_values("capture_datetime")
    assert list(got.status) == ["measured", *["prediction_only_no_matched_detection"] * 2]
    assert got.posterior_sd_cm.is_monotonic_increasing and got.candidate_index.isna().sum() == 2


def test_tracker_is_causal(spark):
    shots = [(1, [(120, 0.9, 0.5)]), (3, [(170, 0.9, 0.5)]), (6, [(250, 0.9, 0.5)])]
    short = TR.track(*frame_tables(spark, shots[:2]), ONE).toPandas().sort_values("filename").reset_index(drop=True)
    long = TR.track(*frame_tables(spark, shots), ONE).toPandas().sort_values("filename").reset_index(drop=True)
    pd.testing.assert_frame_equal(short, long.iloc[:2])


def test_streaming_filter_equals_batch(spark, folder):
    t = Tables(spark, folder)
    s = PF.FilterSettings(particles=60, quantiles=False)
    rows = event_stream(t).select("user_id", "event_id", "ts", "value")
    a = finish(t, ST.stateful_filter(rows, "user_id", "ts", "value", ["event_id"], s)).toPandas().sort_values("event_id")
    b = PF.particle_filter(t.events, "user_id", "ts", "value", ["event_id"], s).toPandas().sort_values("event_id")
    assert (a.arrival == "applied").all()
    np.testing.assert_array_equal(a[list(PF.OUTPUTS)].astype(float), b[list(PF.OUTPUTS)].astype(float))


def test_micro_batches_equal_batch_and_late_rows_are_set_aside(spark, folder, tmp_path):
    t = Tables(spark, folder)
    e = t.events.select("user_id", "event_id", "ts", "value")
    cuts = ["2024-01-08", "2024-01-19"]
    parts = [e.filter(f"ts < '{cuts[0]}'"), e.filter(f"ts >= '{cuts[0]}' AND ts < '{cuts[1]}'"), e.filter(f"ts >= '{cuts[1]}'")]
    source = str(tmp_path / "in")
    s = PF.FilterSettings(particles=60, quantiles=False)

    def arrive(d):
        d.coalesce(1).write.mode("append").parquet(source)
        rows = ST.stream_table(spark, source, e.schema, "ts")
        flow = ST.stateful_filter(rows, "user_id", "ts", "value", ["event_id"], s)
        return ST.run_to_end(flow, str(tmp_path / "out"), str(tmp_path / "ckpt"))

    for d in parts:
        got = arrive(d)
    a = got.toPandas().sort_values("event_id")
    b = PF.particle_filter(e, "user_id", "ts", "value", ["event_id"], s).toPandas().sort_values("event_id")
    np.testing.assert_array_equal(a[list(PF.OUTPUTS)].astype(float), b[list(PF.OUTPUTS)].astype(float))
    late = e.limit(1).withColumns({"event_id": F.lit(10**9).cast("bigint"), "ts": F.lit("2023-01-01").cast("timestamp_ntz")})
    after = arrive(late).filter("event_id = 1000000000").toPandas()
    assert list(after.arrival) == ["late"] and after.posterior_mean_cm.isna().all()


def test_streaming_tracker_equals_batch(spark, folder):
    from seriesloom.plans.catalog import QUERIES

    order = ["camera_id", "plant_number", "capture_datetime"]
    a = QUERIES["t06_streaming_tracker"](spark, folder).toPandas().sort_values(order).reset_index(drop=True)
    b = TR.track(*frames_and_candidates(Tables(spark, folder)), TRACK).toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False)


def test_line_consensus_finds_seven_bands():
    bands = np.column_stack([np.full(7, 320.0), np.arange(150, 451, 50.0), np.full(7, 60.0), np.full(7, 5.0)])
    clutter = np.column_stack([[100.0, 500, 610], [90.0, 260, 430], [20.0] * 3, [1.0] * 3])
    score, marks, info = best_line(np.vstack([bands, clutter]))
    np.testing.assert_allclose(marks[:, 1], bands[:, 1])
    assert info["base_gap"] == pytest.approx(50) and info["regularity"] < 1e-9


def test_calibration_reads_filtered_rows_that_were_written_once(spark, folder):
    from seriesloom.plans import catalog

    d = catalog.QUERIES["t02_forecast_quantile_calibration"](spark, folder)
    assert "InPandas" not in d._jdf.queryExecution().toString()
    assert [r["level_percent"] for r in d.orderBy("level_percent").collect()] == [50, 95]


def test_forecast_quantiles_are_exact_with_few_evaluations(monkeypatch):
    """Against the whole mixture, and with less than half the 57,468 evaluations a row of equal cells and Newton steps."""
    s = PF.FilterSettings(level_sd=8.78, outlier_probability=0.065, outlier_sd=59.04)
    state, calls, rows = PF.Particles("7", s), [], 0
    values = np.random.default_rng(1).gamma(2, 30, 60)
    inner = PF.normal_cdf_and_bell
    for i, v in enumerate(values):
        if state.started:
            ahead = PF.Particles.load(state.dump(), "7", s)
            ahead.advance(0.5)
            with monkeypatch.context() as m:
                m.setattr(PF, "normal_cdf_and_bell", lambda x: calls.append(x.size) or inner(x))
                x = ahead.mixture_quantiles(5.0, 0.065)
            mass, slope = ahead.mixture(x, 5.0, 0.065)
            assert np.abs((mass - np.asarray(PF.PREDICTIVE_P)) / slope).max() < 1e-6
            rows += 1
        state.observe(float(v), 5.0, i * 43_200_000_000, 0.065, s.initial_rate, s.initial_rate_sd)
    assert sum(calls) / rows < 28_000


@pytest.mark.parametrize("value,sd,p_out", [(80.0, 15.0, 0.065), (300.0, 2.0, 0.065), (80.0, 15.0, 0.0), (5000.0, 3.0, 0.0), (9000.0, 3.0, 0.08)])
def test_reweighting_by_plain_densities_equals_logarithms(value, sd, p_out):
    """Also where every density is too small for a plain number."""
    a, b = (PF.Particles("u", PF.FilterSettings(particles=500)) for _ in range(2))
    for p in (a, b):
        p.start(80.0, 12.0, 0, 3.0, 2.0)
    got, want = a.reweight(value, sd, p_out), b._reweight_far(value, sd, p_out)
    np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-12)
    np.testing.assert_allclose(a.weight, b.weight, rtol=1e-9, atol=1e-15)
    assert a.ess == pytest.approx(b.ess)


def test_states_are_summed_up_only_for_outputs_that_need_it(spark, folder, monkeypatch):
    frames, candidates = frames_and_candidates(Tables(spark, folder))
    names = ["filename", "plant_uid", "candidate_index", "status"]
    whole = TR.track(frames, candidates, TRACK).select(*names)
    few = TR.track(frames, candidates, TRACK, names).select(*names)
    assert few.count() == whole.count() > 0
    assert few.exceptAll(whole).isEmpty()

    def refuse(self):
        raise AssertionError("nobody asked for a summary")

    monkeypatch.setattr(PF.Particles, "posterior", refuse)
    c = {"candidate_index": 1, "confidence": 0.9, "x_root_fraction": 0.5, "y_top": 100.0, "y_root": 400.0, "height_px": 300.0}
    tracker = TR.CameraTracker("c", replace(TRACK, expected=1), summaries=False)
    assert [r["status"] for at in (0, 86_400_000_000) for r in tracker.frame(at, "f", [c], None)] == ["measured", "measured"]


def test_resampling_by_counts_equals_a_search_for_each_tooth():
    rng = np.random.default_rng(5)
    for power in (1, 6, 40):
        for n in (1, 2, 37, 400):
            weight = rng.random(n) ** power * (rng.random(n) < 0.7)
            weight[rng.integers(n)] = 1.0
            cumulative = np.cumsum(weight / weight.sum())
            for start in (0.0, rng.random(), 1 - 2**-53):
                comb = (start + np.arange(n)) / n
                want = np.minimum(np.searchsorted(cumulative, comb, side="right"), n - 1)
                assert np.repeat(np.arange(n), PF.comb_counts(cumulative, comb)).tolist() == want.tolist()


def test_order_by_one_sort_of_whole_numbers():
    values = np.clip(np.random.default_rng(6).normal(3, 5, 5000).round(2), 0, 12)
    assert PF.ascending(values).tolist() == np.argsort(values, kind="stable").tolist()


def test_linear_state_equals_its_matrix_form():
    s = replace(TRACK, linear=True)
    state = TR.LinearState(s)
    state.start(80.0, 0)
    x, p = np.array([80.0, 0.0]), np.diag([s.base_sd**2, s.filter.initial_rate_sd**2])
    for days, value in ((0.25, 84.0), (3.0, 79.0), (0.5, 91.0)):
        move = np.array([[1.0, days], [0.0, 1.0]])
        x, p = move @ x, move @ p @ move.T + np.diag([s.filter.level_sd**2, s.filter.rate_sd**2]) * days
        gain = p[:, 0] / (p[0, 0] + 9.0)
        x, p = x + gain * (value - x[0]), p - np.outer(gain, p[0])
        state.advance(days)
        state.reweight(value, 3.0)
        got = state.posterior()
        assert (got["posterior_mean_cm"], got["posterior_growth_mean_cm_day"]) == pytest.approx(tuple(x))
        assert (got["posterior_sd_cm"], got["posterior_growth_sd_cm_day"]) == pytest.approx(tuple(np.sqrt(np.diag(p))))
