"""Prior-guided tracking of detections: link candidates to plants and filter their heights.

Per camera, frames are taken in time order. The first frame with enough separated detections starts
the tracks; afterwards every candidate near a track is scored by confidence, position and how well its
height fits the track's prediction, and the best one-to-one assignment is taken. Every live track gets
a row for every frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.assignment import solve_scores
from seriesloom.operators.particle import POSTERIOR_NAMES, FilterSettings, Particles
from seriesloom.session import sorted_by_key

# Defaults of the tracker and of the filter inside it.
APP_FILTER = FilterSettings(
    seed=20260724, initial_rate=0.0, initial_rate_sd=8.0, level_sd=8.78, rate_sd=0.35,
    outlier_probability=0.065, outlier_sd=59.04, quantiles=False,
)
GATE_PENALTY = math.log(0.05)


@dataclass(frozen=True)
class TrackSettings:
    expected: int = 6
    expected_by_camera: Mapping[str, int] = field(default_factory=dict)
    left_to_right: bool = True
    scale: float | None = 0.33
    depth_factor: float = 0.85
    max_distance: float = 0.16
    position_sd: float = 0.05
    gain: float = 0.5
    separation: float = 0.035
    gate_z: float = 3.0
    base_sd: float = 12.0
    band_sd: float = 1.5
    use_prior: bool = True
    linear: bool = False  # a local linear filter in place of the particles
    filter: FilterSettings = APP_FILTER


CANDIDATE = ("candidate_index", "confidence", "x_root_fraction", "y_top", "y_root", "height_px")
FIT = ("fit_a", "fit_b", "fit_c", "fit_y_center", "fit_y_scale", "fit_rmse", "fit_gap", "fit_regularity", "fit_low", "fit_high")

ROW_FIELDS = (
    [("camera_id", "string"), ("plant_number", "bigint"), ("plant_uid", "string"), ("capture_datetime", "timestamp_ntz")]
    + [("filename", "string"), ("status", "string"), ("measurement_used", "boolean"), ("measurement_qc", "string")]
    + [(c, "double") for c in ("image_measurement_cm", "measurement_sd_cm", "posterior_mean_cm", "posterior_sd_cm")]
    + [(c, "double") for c in POSTERIOR_NAMES]
    + [(c, "double") for c in ("posterior_growth_mean_cm_day", "posterior_growth_sd_cm_day", "predictive_mean_before_cm", "predictive_sd_before_cm")]
    + [(c, "double") for c in ("outlier_posterior_probability", "effective_sample_size", "x_fraction", "root_y")]
    + [("candidate_index", "bigint"), ("detection_confidence", "double")]
    + [("calibration_filename", "string"), ("extrapolation_bands", "double"), ("days_after_first_image", "double")]
)
ROW_SCHEMA = ", ".join(f"{n} {k}" for n, k in ROW_FIELDS)


def measure(c: Mapping, root_y: float, fit: Mapping | None, s: TrackSettings) -> tuple[float, float, str, float]:
    """Height, its standard deviation, the quality label and the bands beyond the marks of one candidate."""
    pose = s.base_sd / math.sqrt(max(c["confidence"], 0.05))
    if s.scale is not None:
        height = max(root_y - c["y_top"], 0.0) * s.scale
        return height, pose, "pass" if 0 < height <= 450 else "height_out_of_range", 0.0
    if fit is None or not math.isfinite(fit["fit_a"]):
        return math.nan, math.nan, "no_past_passing_pole_calibration", math.nan

    def level(y):
        u = (y - fit["fit_y_center"]) / fit["fit_y_scale"]
        return (fit["fit_a"] * u + fit["fit_b"]) / (fit["fit_c"] * u + 1)

    height = (level(c["y_top"]) - level(root_y)) * s.depth_factor
    low, high = fit["fit_low"], fit["fit_high"]
    bands = max(low - c["y_top"], c["y_top"] - high, low - root_y, root_y - high, 0.0) / fit["fit_gap"]
    sd = math.hypot(pose, math.sqrt(2) * fit["fit_rmse"] * s.depth_factor, bands * s.band_sd, height * fit["fit_regularity"])
    if not 0 < height <= 450:
        return height, sd, "height_out_of_range", bands
    return height, sd, "pole_extrapolation_over_three_bands" if bands > 3 else "pass", bands


class LinearState:
    """Height and growth as a two-dimensional Gaussian: the local linear filter of the selection.

    ``level_sd`` and ``rate_sd`` of the settings are process spreads per square root of a day, ``base_sd`` the
    measurement's at full confidence. It answers to the same calls as the particle state.
    """

    def __init__(self, s: TrackSettings):
        self.s = s
        self.now_us = 0
        self.state = (0.0, 0.0)
        self.cov = (0.0, 0.0, 0.0)  # of height, of both, of growth
        self.before = (math.nan, math.nan)
        self.ess = math.nan

    def start(self, value: float, when_us: int) -> None:
        self.state = (value, 0.0)
        self.cov = (self.s.base_sd**2, 0.0, self.s.filter.initial_rate_sd**2)
        self.now_us = when_us

    def resample_if_thin(self) -> None:
        """Nothing to resample."""

    def advance(self, days: float) -> None:
        f, (height, rate), (a, b, d) = self.s.filter, self.state, self.cov
        self.state = (height + days * rate, rate)
        both = b + days * d
        self.cov = (a + days * b + both * days + f.level_sd**2 * days, both, d + f.rate_sd**2 * days)

    @property
    def level(self) -> tuple[float, float]:
        return self.state[0], self.cov[0]

    def moments(self, level: tuple[float, float]) -> tuple[float, float]:
        return level

    def reweight(self, value: float, sd: float, *_) -> tuple[float, float]:
        (height, rate), (a, b, d) = self.state, self.cov
        gain, rate_gain = a / (a + sd**2), b / (a + sd**2)
        self.state = (height + gain * (value - height), rate + rate_gain * (value - height))
        self.cov = (a - gain * a, b - gain * b, d - rate_gain * b)
        return math.nan, math.nan

    def posterior(self) -> dict:
        mean, var = self.level
        growth = {"posterior_growth_mean_cm_day": self.state[1], "posterior_growth_sd_cm_day": math.sqrt(max(self.cov[2], 0.0))}
        return {"posterior_mean_cm": mean, "posterior_sd_cm": math.sqrt(max(var, 0.0))} | growth


@dataclass
class Track:
    number: int
    uid: str
    x: float
    root_y: float
    particles: Particles | LinearState | None = None
    outlier: float = math.nan

    def predict(self, when_us: int) -> None:
        """Carry the state to the frame's time; equal times carry nothing, earlier ones are errors."""
        p = self.particles
        if p is None:
            return
        if when_us < p.now_us:
            raise ValueError("frames must arrive in time order")
        p.resample_if_thin()
        if when_us > p.now_us:
            p.advance((when_us - p.now_us) / 86_400_000_000)
            p.now_us = when_us
        mean, var = p.moments(p.level)
        p.before = (mean, math.sqrt(max(var, 0.0)))

    def take(self, height: float, sd: float, when_us: int, s: TrackSettings) -> None:
        f = s.filter
        if self.particles is None and s.linear:
            self.particles = LinearState(s)
            self.particles.start(height, when_us)
        elif self.particles is None:
            self.particles = Particles(self.uid, f)
            self.particles.start(height, max(sd, 1.0), when_us, f.initial_rate, f.initial_rate_sd)
        else:
            _, self.outlier = self.particles.reweight(height, max(sd, 1.0), f.outlier_probability)


def start_picks(frame: Sequence[Mapping], s: TrackSettings, expected: int) -> list[Mapping]:
    """Most confident separated candidates; none unless all expected plants are found."""
    chosen: list[Mapping] = []
    for c in sorted(frame, key=lambda c: (-c["confidence"], -c["height_px"], c["candidate_index"])):
        if all(abs(c["x_root_fraction"] - o["x_root_fraction"]) >= s.separation for o in chosen):
            chosen.append(c)
        if len(chosen) == expected:
            return sorted(chosen, key=lambda c: c["x_root_fraction"], reverse=not s.left_to_right)
    return []


class CameraTracker:
    """Tracks of one camera."""

    def __init__(self, camera: str, s: TrackSettings, summaries: bool = True):
        self.camera, self.s, self.summaries = camera, s, summaries
        self.tracks: list[Track] = []
        self.now_us: int | None = None
        self.first_us: int | None = None

    def log_score(self, track: Track, c: Mapping, m: tuple[float, float, str, float], distance: float) -> float:
        s = self.s
        score = math.log(max(c["confidence"], 1e-12)) - 0.5 * (distance / s.position_sd) ** 2
        if s.use_prior and track.particles is not None and m[2] == "pass":
            mean, latent = track.particles.before
            sd = math.sqrt(max(latent**2 + m[1] ** 2, 1e-9))
            z = abs(m[0] - mean) / sd
            score += -0.5 * z * z - math.log(sd) + (GATE_PENALTY if z > s.gate_z else 0.0)
        return score

    def frame(self, when_us: int, filename: str, candidates: Sequence[Mapping], fit: Mapping | None) -> list[dict]:
        s = self.s
        self.now_us = when_us
        if self.first_us is None:
            self.first_us = when_us
        if not self.tracks:
            picks = start_picks(candidates, s, int(s.expected_by_camera.get(self.camera, s.expected)))
            rows = []
            for number, c in enumerate(picks, start=1):
                track = Track(number, f"{self.camera}_P{number}", c["x_root_fraction"], c["y_root"])
                m = measure(c, track.root_y, fit, s)
                if m[2] == "pass":
                    track.take(m[0], m[1], when_us, s)
                self.tracks.append(track)
                status = "measured" if m[2] == "pass" else "calibration_unavailable"
                rows.append(self.row(when_us, filename, track, c, m, status, fit))
            return rows
        for track in self.tracks:
            track.predict(when_us)
        cost = np.full((len(self.tracks), len(candidates)), np.inf)
        seen = {}
        for i, track in enumerate(self.tracks):
            for j, c in enumerate(candidates):
                distance = abs(c["x_root_fraction"] - track.x)
                if distance <= s.max_distance:
                    root = track.root_y + s.gain * (c["y_root"] - track.root_y)
                    seen[i, j] = measure(c, root, fit, s)
                    cost[i, j] = -self.log_score(track, c, seen[i, j], distance)
        chosen = solve_scores(cost) if len(candidates) else {}
        rows = []
        for i, track in enumerate(self.tracks):
            if i not in chosen:
                waiting = track.particles is None
                status = "waiting_for_first_measurement" if waiting else "prediction_only_no_matched_detection"
                rows.append(self.row(when_us, filename, track, None, None, status, fit))
                continue
            c, m = candidates[chosen[i]], seen[i, chosen[i]]
            track.x += s.gain * (c["x_root_fraction"] - track.x)
            track.root_y += s.gain * (c["y_root"] - track.root_y)
            if m[2] == "pass":
                track.take(m[0], m[1], when_us, s)
                status = "measured"
            else:
                status = "calibration_unavailable" if track.particles is None else "prediction_only_measurement_failed_qc"
            rows.append(self.row(when_us, filename, track, c, m, status, fit))
        return rows

    def row(self, when_us, filename, track, c, m, status, fit) -> dict:
        p = track.particles
        reference = "fixed_scale" if self.s.scale is not None else fit and fit.get("filename")
        out = {
            "camera_id": self.camera, "plant_number": track.number, "plant_uid": track.uid,
            "capture_datetime": pd.Timestamp(when_us, unit="us"), "filename": filename,
            "status": status, "measurement_used": status == "measured",
            "measurement_qc": m[2] if m else "no_detection",
            "image_measurement_cm": m[0] if m else None, "measurement_sd_cm": m[1] if m else None,
            "x_fraction": track.x, "root_y": track.root_y,
            "candidate_index": c["candidate_index"] if c else None,
            "detection_confidence": c["confidence"] if c else None,
            "calibration_filename": reference if m else None, "extrapolation_bands": m[3] if m else None,
            "days_after_first_image": round((when_us - self.first_us) / 86_400_000_000, 6),
        }
        if p is not None:
            out |= (p.posterior() if self.summaries else {}) | {
                "predictive_mean_before_cm": p.before[0], "predictive_sd_before_cm": p.before[1],
                "outlier_posterior_probability": track.outlier, "effective_sample_size": p.ess,
            }
        return out


SUMMARIES = ("posterior_mean_cm", "posterior_sd_cm", *POSTERIOR_NAMES, "posterior_growth_mean_cm_day", "posterior_growth_sd_cm_day")


def rows_to_pandas(rows: Sequence[dict], columns: Sequence[str] = ()) -> pd.DataFrame:
    fields = [(n, k) for n, k in ROW_FIELDS if not columns or n in columns]
    out = pd.DataFrame(rows, columns=[n for n, _ in fields])
    if "candidate_index" in out:
        out["candidate_index"] = out["candidate_index"].astype("Int64")
    doubles = [n for n, k in fields if k == "double"]
    out[doubles] = out[doubles].astype("float64")
    return out


def settings_from(plain: dict) -> TrackSettings:
    f = dict(plain["filter"])
    f["field"] = tuple(map(tuple, f["field"]))
    return TrackSettings(**{**plain, "filter": FilterSettings(**f)})


def frame_rows(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every frame with its candidates; a frame without any keeps one row without a candidate."""
    return frames.join(candidates.select("filename", *CANDIDATE), "filename", "left")


def track(
    frames: DataFrame, candidates: DataFrame, settings: TrackSettings = TrackSettings(), columns: Sequence[str] = ()
) -> DataFrame:
    """Batch tracker. ``frames`` has camera_id, capture_datetime, filename and, for calibrated heights,
    the ``fit_*`` columns of its best earlier fit (``fit_filename`` names it). ``columns`` names the outputs that
    are wanted, all without it; states are summed up only for outputs that need it."""
    plain = asdict(settings)
    plain["expected_by_camera"] = dict(settings.expected_by_camera)
    with_fit = settings.scale is None
    columns = tuple(columns)
    summaries = not columns or any(c in SUMMARIES for c in columns)
    rows = frame_rows(frames, candidates).withColumn(
        "__us", F.unix_micros(F.col("capture_datetime").cast("timestamp"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = settings_from(plain)
        tracker, open_frame, found, fit = None, None, [], None

        def close():
            return tracker.frame(open_frame[1], open_frame[2], found, fit) if open_frame else []

        for batch in batches:
            out: list[dict] = []
            keys = zip(*[batch[c].tolist() for c in ("camera_id", "__us", "filename")])
            values = zip(*[batch[c].tolist() for c in CANDIDATE])
            fits = {c: batch[c].tolist() for c in (*FIT, "fit_filename") if with_fit and c in batch}
            for at, (key, (index, *rest)) in enumerate(zip(keys, values)):
                if key != open_frame:
                    out += close()
                    if tracker is None or tracker.camera != key[0]:
                        tracker = CameraTracker(key[0], s, summaries)
                    open_frame, found = key, []
                    if with_fit:
                        fit = {c: float(fits[c][at]) if fits[c][at] is not None else math.nan for c in FIT}
                        fit["filename"] = fits["fit_filename"][at] if "fit_filename" in fits else None
                if index is not None and index == index:
                    found.append({"candidate_index": int(index)} | {c: float(v) for c, v in zip(CANDIDATE[1:], rest)})
            if out:
                yield rows_to_pandas(out, columns)
        tail = close()
        if tail:
            yield rows_to_pandas(tail, columns)

    schema = ", ".join(f"{n} {k}" for n, k in ROW_FIELDS if not columns or n in columns)
    order = ["__us", "filename", "candidate_index"]
    rows = rows.drop("capture_datetime")
    return sorted_by_key(rows, ["camera_id"], order).mapInPandas(run, schema)


def candidate_log_score(value: str, mean: str, latent_sd: str, sd: str, gate_z: float = 3.0):
    """The height part of a candidate's score as a native column."""
    total = F.sqrt(F.greatest(F.col(latent_sd) * F.col(latent_sd) + F.col(sd) * F.col(sd), F.lit(1e-9)))
    z = F.abs(F.col(value) - F.col(mean)) / total
    return z * z * F.lit(-0.5) - F.ln(total) + F.when(z > gate_z, F.lit(GATE_PENALTY)).otherwise(F.lit(0.0))


def selected_candidates(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates with ``selected`` and the plant that took them."""
    taken = rows.filter("candidate_index IS NOT NULL").select("filename", "candidate_index", F.col("plant_uid").alias("selected_plant_uid"))
    marked = candidates.join(taken, ["filename", "candidate_index"], "left")
    return marked.withColumn("selected", F.col("selected_plant_uid").isNotNull())


def start_warnings(frames: DataFrame, rows: DataFrame, settings: TrackSettings) -> DataFrame:
    """Cameras whose tracking could not start, with the reason."""
    idle = frames.select("camera_id").distinct().join(rows.select("camera_id").distinct(), "camera_id", "left_anti")
    number = F.lit(settings.expected)
    for camera, expected in settings.expected_by_camera.items():
        number = F.when(F.col("camera_id") == camera, expected).otherwise(number)
    text = F.format_string("%s: no image contained %d distinct plant detections, so tracking could not start.", "camera_id", number)
    return idle.select("camera_id", text.alias("warning"))


def compare_selection(
    frames: DataFrame, candidates: DataFrame, settings: TrackSettings, truth: DataFrame | None = None, truth_keys: Sequence[str] = ()
) -> DataFrame:
    """The same candidates tracked with and without the height prior in the selection.

    ``truth`` (``truth_keys``, truth) comes from neither: measured heights of a plant and time, joined by
    equality; frames without one are left out.
    """
    keys = ["camera_id", "plant_uid", "capture_datetime", "filename"]
    wanted = [*keys, "candidate_index", "posterior_mean_cm", "image_measurement_cm"]
    side = lambda use, name: track(frames, candidates, replace(settings, use_prior=use), wanted).select(
        *keys,
        F.col("candidate_index").alias(f"{name}_candidate"),
        F.col("posterior_mean_cm").alias(f"{name}_height"),
        F.col("image_measurement_cm").alias(f"{name}_measurement"),
    )
    both = side(True, "guided").join(side(False, "plain"), keys)
    if truth is None:
        return both
    return both.withColumn("day", F.to_date("capture_datetime")).join(truth, list(truth_keys))
