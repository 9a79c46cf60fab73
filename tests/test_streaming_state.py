"""Processors with named state: calibrated tracking from a stream, late rows, expiry."""

import datetime as dt
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import joins as J
from seriesloom.operators import particle as PF
from seriesloom.operators import tracking as TR
from seriesloom.plans import states
from seriesloom.plans.registry import Tables
from seriesloom.streaming import stateful as ST
from seriesloom.streaming.processors import US, FilterProcessor

FEW = PF.FilterSettings(particles=60, quantiles=False)
SETTINGS = replace(TR.TrackSettings(expected=2), scale=None, filter=replace(TR.APP_FILTER, particles=80))


def day(n):
    return dt.datetime(2021, 7, 1) + dt.timedelta(days=n)


def fit(name, at, a=-38.8, landmarks=6.0):
    values = {"fit_a": a, "fit_b": -38.8, "fit_c": 0.0, "fit_y_center": 300.0, "fit_y_scale": 100.0, "fit_rmse": 0.5, "fit_gap": 60.0, "fit_regularity": 0.0, "fit_low": 100.0, "fit_high": 420.0}
    return {"camera_id": "cam", "capture_datetime": day(at), "filename": name, "n_landmarks": landmarks, "span_px": 300.0, "rmse": 0.5} | values


def frame(name, at, heights):
    found = [{"candidate_index": i, "confidence": 0.9, "x_root_fraction": 0.2 + 0.5 * i, "y_top": 400.0 - h, "y_root": 400.0, "height_px": float(h)} for i, h in enumerate(heights)]
    return {"camera_id": "cam", "capture_datetime": day(at), "filename": name, "candidates": found}


FRAMES = [frame("f1", 1, (120, 100)), frame("f2", 2, (130, 110)), frame("f3", 3, (140, 120)), frame("f4", 5, ()), frame("f5", 6, (160, 900)), frame("f6", 8, (170, 150))]
FITS = [fit("p2", 1.5), fit("p3", 3, a=-40.0, landmarks=7.0), fit("p9", 9, a=-99.0, landmarks=9.0)]


def tables(spark):
    candidate = ", ".join(f"{c}: {'bigint' if c == 'candidate_index' else 'double'}" for c in TR.CANDIDATE)
    frames = spark.createDataFrame(FRAMES, f"camera_id string, capture_datetime timestamp_ntz, filename string, candidates array<struct<{candidate}>>")
    doubles = ", ".join(f"{c} double" for c in dict.fromkeys(ST.FIT_COLUMNS))
    fits = spark.createDataFrame(FITS, f"camera_id string, capture_datetime timestamp_ntz, filename string, {doubles}")
    return frames, fits


def batch_rows(frames, fits):
    columns = [c for c in TR.FIT if c != "fit_rmse"]
    best = J.best_earlier_fit(frames.drop("candidates"), fits, "camera_id", "capture_datetime", ["filename"], columns)
    candidates = frames.select("filename", F.explode("candidates").alias("c")).select("filename", "c.*")
    return TR.track(best, candidates, SETTINGS)


def compared(df):
    return df.toPandas().sort_values(["plant_number", "capture_datetime"]).reset_index(drop=True)


@pytest.mark.parametrize("parts", [1, 3])
def test_calibrated_stream_equals_batch(spark, tmp_path, parts):
    frames, fits = tables(spark)
    rows = ST.with_fits(frames, fits)
    for k in range(parts):  # all fits come in the first part, ahead of most frames
        number = F.substring("filename", 2, 1).cast("int") - 1
        own = F.when(F.col(ST.SIDE) == 0, F.lit(k == 0)).otherwise(F.floor(number * parts / 6) == k)
        rows.filter(own).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = ST.stream_table(spark, str(tmp_path / "in"), rows.schema, "capture_datetime")
        got = ST.run_to_end(ST.stateful_track(source, SETTINGS), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    a, b = compared(got), compared(batch_rows(frames, fits))
    pd.testing.assert_frame_equal(a, b)
    first = a[a.plant_number == 1]
    assert list(first.status) == ["calibration_unavailable", "measured", "measured", "prediction_only_no_matched_detection", "measured", "measured"]
    used = [None if pd.isna(x) else x for x in first.calibration_filename]
    assert used == [None, "p2", "p3", None, "p3", "p3"] and "p9" not in used
    assert a[a.filename == "f5"].measurement_qc.tolist() == ["pass", "pole_extrapolation_over_three_bands"]
    assert list(first.days_after_first_image) == [0.0, 1.0, 2.0, 4.0, 5.0, 7.0]


def test_selected_candidates_and_start_warnings(spark):
    frames, fits = tables(spark)
    candidates = frames.select("filename", F.explode("candidates").alias("c")).select("filename", "c.*")
    rows = batch_rows(frames, fits)
    marked = TR.selected_candidates(candidates, rows).collect()
    assert len(marked) == candidates.count() and all(r.selected == (r.selected_plant_uid is not None) for r in marked)
    assert {r.selected_plant_uid for r in marked if r.selected} == {"cam_P1", "cam_P2"}
    plain = frames.drop("candidates")
    assert TR.start_warnings(plain, rows, SETTINGS).collect() == []
    many = replace(SETTINGS, scale=0.33, expected_by_camera={"cam": 7})
    (only,) = TR.start_warnings(plain, TR.track(plain, candidates, many), many).collect()
    assert only.warning == "cam: no image contained 7 distinct plant detections, so tracking could not start."


def test_idle_series_are_closed_and_their_state_freed(spark, tmp_path):
    def arrive(rows, number):
        d = spark.createDataFrame([(u, i, day(at), float(i)) for i, (u, at) in enumerate(rows)], "user_id long, event_id long, ts timestamp_ntz, value double")
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ST.stream_table(spark, str(tmp_path / "in"), d.schema, "ts")
        flow = ST.stateful_filter(stream, "user_id", "ts", "value", ["event_id"], FEW, hygiene=ST.Hygiene("2 days", "5 days"))
        sizes = []
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
        query = flow.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        done = spark.read.parquet(str(tmp_path / "out")).toPandas()
        return sizes[-1], done.groupby(["user_id", "arrival"]).size().to_dict()

    size, _ = arrive([(u, 1) for u in range(6)], 0)
    freed, seen = arrive([(0, 20), (1, 3), (2, 0.5)], 1)  # the watermark is still of the first arrival
    assert seen[(0, "applied")] == 2 and seen[(1, "applied")] == 2 and seen[(2, "late")] == 1
    assert [k for k in seen if k[1] == "closed"] == [(u, "closed") for u in range(1, 6)] and freed < size
    _, seen = arrive([(3, 10), (3, 25), (0, 19)], 2)  # behind day 18, and after it: a new series
    assert seen[(3, "behind_watermark")] == 1 and seen[(3, "applied")] == 2 and seen[(0, "late")] == 1


def test_rows_without_a_time_change_nothing(spark, tmp_path):
    rows = [(1, 1, day(1), 3.0), (1, 2, None, 9.0), (1, 3, day(2), 4.0)]
    d = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.stream_table(spark, str(tmp_path / "in"), d.schema, "ts")
    done = ST.run_to_end(ST.stateful_filter(stream, "user_id", "ts", "value", ["event_id"], FEW), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    applied, aside = ST.rows_by_arrival(done)
    assert {r.event_id: r.arrival for r in aside.collect()} == {2: "no_time"}
    assert [r.online_sequence_number for r in applied.orderBy("event_id").collect()] == [1, 2]


def test_every_kind_of_arrival_is_met(spark, folder):
    kinds = {r.arrival for r in states.t11_hygiene(Tables(spark, folder)).collect()}
    assert kinds == {"applied", "late", "behind_watermark", "closed"}


def test_linear_filter_in_the_selection_and_truth_of_its_own(spark):
    """Two detections at one place: the likelier height wins over confidence; errors are taken against a third table."""
    found = lambda h, c: {"candidate_index": int(h), "confidence": c, "x_root_fraction": 0.5, "y_top": 400.0 - h / 0.33, "y_root": 400.0, "height_px": h / 0.33}
    shots = [(1, [(100, 0.9)]), (3, [(110, 0.6), (300, 0.95)]), (4, [(115, 0.9)])]
    rows = [("cam", day(at), f"g{at}", [found(float(h), c) for h, c in items]) for at, items in shots]
    kind = ", ".join(f"{c}: {'bigint' if c == 'candidate_index' else 'double'}" for c in TR.CANDIDATE)
    frames = spark.createDataFrame(rows, f"camera_id string, capture_datetime timestamp_ntz, filename string, candidates array<struct<{kind}>>")
    candidates = frames.select("filename", F.explode("candidates").alias("c")).select("filename", "c.*")
    settings = TR.TrackSettings(expected=1, linear=True)
    truth = spark.createDataFrame([("cam", day(3).date(), 111.0), ("cam", day(4).date(), 116.0)], "camera_id string, day date, truth double")
    got = TR.compare_selection(frames.drop("candidates"), candidates, settings, truth, ["camera_id", "day"]).toPandas().sort_values("day")
    assert got.truth.tolist() == [111.0, 116.0]
    assert got.guided_candidate.tolist() == [110, 115] and got.plain_candidate.tolist() == [300, 115]
    # The plain two-step recursion.
    state, cov = np.array([100.0, 0.0]), np.diag([settings.base_sd**2, 8.0**2])
    for days, value, confidence in ((2.0, 110.0, 0.6), (1.0, 115.0, 0.9)):
        move = np.array([[1, days], [0, 1]])
        state, cov = move @ state, move @ cov @ move.T + np.diag([8.78**2 * days, 0.35**2 * days])
        gain = cov[:, 0] / (cov[0, 0] + settings.base_sd**2 / confidence)
        state, cov = state + gain * (value - state[0]), cov - np.outer(gain, cov[0])
    assert got.guided_height.iloc[-1] == pytest.approx(state[0])


class Box:
    """A state variable of one key that counts what is asked of it."""

    def __init__(self, calls, name):
        self.calls, self.name, self.value = calls, name, None

    def get(self):
        self.calls.append(("get", self.name))
        return self.value

    def exists(self):
        self.calls.append(("exists", self.name))
        return self.value is not None

    def update(self, value):
        self.calls.append(("update", self.name))
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, name, schema):
        return Box(self.calls, name)

    def registerTimer(self, at):
        self.calls.append(("timer", at))
        self.timers.append(at)

    def listTimers(self):
        self.calls.append(("list", None))
        return iter(self.timers)

    def deleteTimer(self, at):
        self.calls.append(("delete", at))
        self.timers.remove(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_key_asks_its_state_once_a_batch_and_keeps_one_timer():
    schema = T.StructType(
        [T.StructField("u", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.DoubleType()), *PF.output_fields(), T.StructField("arrival", T.StringType())]
    )
    plain = asdict(PF.FilterSettings(particles=50, quantiles=False))
    step, handle = FilterProcessor(plain, ["u", "ts", "v"], "ts", "v", "u", [], {}, schema, "12 hours"), Handle()
    step.init(handle)
    hour = 3_600_000

    def batch(*hours):
        us = [h * hour * 1000 for h in hours]
        return iter([pd.DataFrame({"u": 1, "ts": pd.to_datetime(us, unit="us", utc=True), "v": 10.0, US: us})])

    for hours in ((2, 1), (9, 5)):
        handle.calls.clear()
        (out,) = step.handleInputRows((1,), batch(*hours), Mark(0))
        assert out.arrival.tolist() == ["applied"] * 2 and out.predictive_mean_cm.dtype == "float64"
        assert sum(kind != "timer" for kind, _ in handle.calls) == 4
    assert handle.timers == [14 * hour]  # of the first batch's last time
    # Rows came after it was set: it is set again for the last time, and closes the key only then.
    assert list(step.handleExpiredTimer((1,), Mark(15 * hour), None)) == [] and handle.timers[-1] == 21 * hour
    (last,) = step.handleExpiredTimer((1,), Mark(21 * hour), None)
    assert last.arrival.tolist() == ["closed"] and last.ts[0] == pd.Timestamp(9 * hour, unit="ms", tz="UTC")
    assert step.now() == (None, None)
