"""Robust particle filter for keyed series: level and rate with an inlier/outlier likelihood.

Spark shuffles rows by entity and sorts them by time; a task then streams through its rows batch by
batch and holds the particles of one entity at a time, so a long series never sits in memory whole.
Random numbers are seeded per entity and do not depend on the partitioning. The filter is sequential
within an entity; :func:`filter_in_slices` cuts a run into time slices that hand the particle state
on through a table, which bounds what one task reads and lets a run be resumed.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.session import materialize, sorted_by_key

# Default settings, value limits and the reported probabilities.
LEVEL_MIN, LEVEL_MAX = 0.0, 450.0
SD_FLOOR, ELAPSED_FLOOR = 1.0, 1e-6
PREDICTIVE_P = (0.025, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.975)
POSTERIOR_P = (0.025, 0.10, 0.50, 0.90, 0.975)
# Names of the appended columns.
PREDICTIVE_NAMES = (
    "predictive_q025_cm", "predictive_q05_cm", "predictive_q10_cm", "predictive_q25_cm",
    "predictive_median_cm", "predictive_q75_cm", "predictive_q90_cm", "predictive_q95_cm",
    "predictive_q975_cm",
)
POSTERIOR_NAMES = (
    "posterior_q025_cm", "posterior_q10_cm", "posterior_median_cm", "posterior_q90_cm",
    "posterior_q975_cm",
)
OUTPUTS = (
    "online_sequence_number", "elapsed_days", "predictive_mean_cm", "predictive_sd_cm",
    *PREDICTIVE_NAMES, "predictive_log_score", "predictive_pit", "last_observation_prediction_cm",
    "linear_extrapolation_prediction_cm", "posterior_mean_cm", "posterior_sd_cm", *POSTERIOR_NAMES,
    "posterior_growth_mean_cm_day", "posterior_growth_sd_cm_day", "outlier_posterior_probability",
    "effective_sample_size",
)


CELL = 1 / 40  # width, in deviations, of the cells that forecast quantiles merge particles in
ROUGH = 8  # of them make a cell that the quantiles are first looked for with


@dataclass(frozen=True)
class FilterSettings:
    particles: int = 5000
    seed: int = 20260723
    default_sd: float = 15.0
    sd_multiplier: float = 1.0
    initial_rate: float = 3.0
    initial_rate_sd: float = 2.0
    level_sd: float = 1.5
    rate_sd: float = 0.35
    min_rate: float = -4.0
    max_rate: float = 15.0
    outlier_probability: float = 0.08
    outlier_sd: float = 60.0
    resample_below: float = 0.5
    reversion: float = 1.0
    field: tuple[tuple[float, float], ...] = ()
    field_retention: float = 0.0
    quantiles: bool = True


def entity_seed(label: object, base: int) -> int:
    digest = hashlib.sha256(f"{base}|{label}".encode()).digest()
    return int.from_bytes(digest[:8], "little") % (2**32 - 1)


SHORT = 40  # particles for each row of a series that is stored as its rows: those take a twentieth of the bytes

ROOT = 1 / math.sqrt(2 * math.pi)

# Coefficients of West (2005), and normal quantiles to start the inversion from.
WEST_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
WEST_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
               296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PREDICTIVE_Z = (-1.95996, -1.64485, -1.28155, -0.67449, 0.0, 0.67449, 1.28155, 1.64485, 1.95996)


def normal_cdf_and_bell(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-precision normal distribution function, and exp(-x^2 / 2)."""
    z = np.abs(x)
    np.minimum(z, 37.0, out=z)
    bell = z * z
    bell *= -0.5
    np.exp(bell, out=bell)
    tail, bottom = z * WEST_TOP[0], z * WEST_BOTTOM[0]
    tail += WEST_TOP[1]
    bottom += WEST_BOTTOM[1]
    for c in WEST_TOP[2:]:
        tail *= z
        tail += c
    for c in WEST_BOTTOM[2:]:
        bottom *= z
        bottom += c
    tail *= bell
    tail /= bottom
    if z.size and z.max() > 7.07106781186547:
        far = z > 7.07106781186547
        w = z[far]
        b = w + 1.0 / (w + 2.0 / (w + 3.0 / (w + 4.0 / (w + 0.65))))
        tail[far] = bell[far] / (b * 2.506628274631)
    np.subtract(1.0, tail, out=tail, where=x > 0)
    return tail, bell


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return normal_cdf_and_bell(x)[0]


def ascending(values: np.ndarray) -> np.ndarray:
    """Order of values that are not negative, ties by place; values that differ in their last bits only count as ties.

    Such doubles are ordered as their bits are, so their places ride in the last bits and one plain sort of whole
    numbers does.
    """
    n = len(values)
    places = (1 << n.bit_length()) - 1
    keys = (values.view(np.int64) & ~places) | np.arange(n)
    keys.sort()
    return keys & places


def comb_counts(cumulative: np.ndarray, comb: np.ndarray) -> np.ndarray:
    """How many teeth of an even, ascending comb fall to each particle; what is left goes to the last one.

    A tooth belongs to the first particle whose cumulative weight is above it. The teeth below a weight are
    guessed from the even spacing; the guess is at most one off and compared with the teeth themselves.
    """
    n = len(comb)
    below = np.ceil((cumulative - comb[0]) * n).clip(0, n).astype(np.int64)
    edges = np.concatenate([[-np.inf], comb, [np.inf]])
    below -= edges[below] >= cumulative
    below += edges[below + 1] < cumulative
    below[-1] = n
    return np.diff(below, prepend=0)


def _coarser(bottom: float, width: float, sums: np.ndarray) -> tuple[float, float, np.ndarray]:
    """The same for cells ``ROUGH`` times as wide."""
    wide = np.zeros((3, -(-sums.shape[1] // ROUGH) * ROUGH))
    wide[:, : sums.shape[1]] = sums
    weight, first, second = wide.reshape(3, -1, ROUGH)
    shift = np.arange(ROUGH)
    moments = [weight.sum(1), (first + shift * weight).sum(1) / ROUGH, (second + 2 * shift * first + shift**2 * weight).sum(1) / ROUGH**2]
    return bottom, width * ROUGH, np.array(moments)


def _summaries(bottom: float, width: float, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of the cells that hold any weight."""
    held = np.flatnonzero(sums[0] > 0)
    weight, first, second = sums[:, held]
    first, second = first / weight, second / weight
    return weight, bottom + (held + first) * width, np.maximum(second - first * first, 0.0) * width**2


def _merged_mixture(points: np.ndarray, parts: np.ndarray, weight: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distribution function, density and about the slope of the density, which only steers steps. ``parts`` has the
    shares and widths of the mixture."""
    share, width = parts
    z = (points[:, None] - mean) / width[:, None, None]
    cdf, bell = normal_cdf_and_bell(z)
    weighted = weight * spread
    half = share * 0.5 / width**2
    tilted = z * bell
    mass = share @ (cdf @ weight) - (half * ROOT) @ (tilted @ weighted)
    bend = (share * -ROOT / width**2) @ (tilted @ weight)
    z *= tilted
    z -= bell
    slope = (share * ROOT / width) @ (bell @ weight) + (half * ROOT / width) @ (z @ weighted)
    return mass, slope, bend


class Particles:
    """State of one entity. Small, and storable as bytes between slices or micro-batches."""

    def __init__(self, label: str, s: FilterSettings):
        self.s = s
        self.rng = np.random.default_rng(entity_seed(label, s.seed))
        self.level = self.rate = self.weight = None
        self.now_us = None
        self.ess = float(s.particles)
        self.seen = 0
        self.history: list[tuple[int, float]] = []
        self.before = (math.nan, math.nan)
        self.inputs: list[tuple] | None = None  # of all rows so far, where they are kept

    # -- storage --
    def keep_inputs(self) -> None:
        """From a new series on, remember what :meth:`observe` gets, as long as that is much less than the particles."""
        self.inputs = []

    def dump_short(self) -> bytes:
        """The inputs of a short series, which lead to the very same state again; else the state."""
        if self.inputs is None:
            return self.dump()
        text = json.dumps({"inputs": len(self.inputs)}).encode()
        return len(text).to_bytes(4, "little") + text + np.array(self.inputs, float).tobytes()

    def dump(self) -> bytes:
        head = {
            "rng": self.rng.bit_generator.state, "now": self.now_us, "ess": self.ess,
            "seen": self.seen, "history": self.history, "before": self.before,
            "set": self.level is not None,
        }
        text = json.dumps(head).encode()
        body = b"" if self.level is None else np.concatenate([self.level, self.rate, self.weight]).tobytes()
        return len(text).to_bytes(4, "little") + text + body

    @classmethod
    def load(cls, blob: bytes, label: str, s: FilterSettings) -> Particles:
        out = cls(label, s)
        size = int.from_bytes(blob[:4], "little")
        head = json.loads(blob[4 : 4 + size])
        if "inputs" in head:
            out.keep_inputs()
            for value, sd, when_us, *rest in np.frombuffer(blob[4 + size :]).reshape(-1, 6).tolist():
                out.observe(value, sd, int(when_us), *rest, wanted=())
            return out
        out.rng.bit_generator.state = head["rng"]
        out.now_us, out.ess, out.seen = head["now"], head["ess"], head["seen"]
        out.history = [tuple(h) for h in head["history"]]
        out.before = tuple(head["before"])
        if head["set"]:
            out.level, out.rate, out.weight = np.frombuffer(blob[4 + size :]).copy().reshape(3, -1)
        return out

    # -- filter steps --
    @property
    def started(self) -> bool:
        return self.level is not None

    def start(self, value: float, sd: float, when_us: int, rate: float, rate_sd: float) -> None:
        s = self.s
        self.level = np.clip(self.rng.normal(value, sd, s.particles), LEVEL_MIN, LEVEL_MAX)
        self.rate = np.clip(self.rng.normal(rate, rate_sd, s.particles), s.min_rate, s.max_rate)
        self.weight = np.full(s.particles, 1 / s.particles)
        self.now_us = when_us

    def resample_if_thin(self) -> None:
        if self.ess >= self.s.resample_below * self.s.particles:
            return
        n = len(self.weight)
        comb = (self.rng.random() + np.arange(n)) / n
        take = np.repeat(np.arange(n), comb_counts(np.cumsum(self.weight), comb))
        self.level, self.rate = self.level[take], self.rate[take]
        self.weight = np.full(n, 1 / n)
        self.ess = float(n)

    def advance(self, days: float) -> None:
        """Move levels with the old rates, then the rates."""
        s, root = self.s, math.sqrt(days)
        n = len(self.level)
        moves = self.rng.standard_normal((2, n))  # in the order of two single draws
        moves *= [[s.level_sd * root], [s.rate_sd * root]]
        level = self.rate * days
        level += self.level
        level += moves[0]
        self.level = np.clip(level, LEVEL_MIN, LEVEL_MAX, out=level)
        if s.field:
            knots = np.asarray(s.field, float)
            pull = np.interp(self.level, knots[:, 0], knots[:, 1])
            keep = s.field_retention**days if s.field_retention > 0 else 0.0
            self.rate = pull + (self.rate - pull) * keep if keep else pull
        elif s.reversion != 1.0:
            self.rate = self.rate * s.reversion**days
        rate = self.rate + moves[1]
        self.rate = np.clip(rate, s.min_rate, s.max_rate, out=rate)

    def moments(self, values: np.ndarray) -> tuple[float, float]:
        mean = float(self.weight @ values)
        return mean, float(self.weight @ (values - mean) ** 2)

    def mixture(self, points: np.ndarray, sd: float, p_out: float) -> tuple[np.ndarray, np.ndarray]:
        """Distribution function and density of the next observation at some points."""
        gap = points[:, None] - self.level[None, :]
        widths = np.array([sd, self.s.outlier_sd]) if p_out > 0 else np.array([sd])
        share = np.array([1 - p_out, p_out])[: len(widths)]
        cdf, bell = normal_cdf_and_bell(gap[None] / widths[:, None, None])
        density = (share / widths) @ (bell @ self.weight) / math.sqrt(2 * math.pi)
        return share @ (cdf @ self.weight), density

    def _parts(self, sd: float, p_out: float) -> np.ndarray:
        return np.array([[1 - p_out, p_out], [sd, self.s.outlier_sd]])[:, : 2 if p_out > 0 else 1]

    def below(self, value: float, sd: float, p_out: float) -> float:
        """Distribution function of the next observation at one value."""
        gap = value - self.level
        mass = (1 - p_out) * float(normal_cdf(gap / sd) @ self.weight)
        return mass + p_out * float(normal_cdf(gap / self.s.outlier_sd) @ self.weight) if p_out > 0 else mass

    def mixture_quantiles(self, sd: float, p_out: float, wanted: Sequence[int] | slice = slice(None)) -> np.ndarray:
        """Invert the mixture at the reported probabilities: Halley steps kept inside brackets.

        Particles are first merged in cells of ``CELL`` deviations, each kept as its weight, mean and variance: the
        expansion to second order differs by less than the steps' tolerance. Points converge on cells of ``ROUGH``
        times that width, and take what steps are left on the fine ones, which is mostly one. A point that has
        converged is not evaluated again. ``wanted`` picks some of the probabilities.
        """
        s, target = self.s, np.asarray(PREDICTIVE_P)[wanted]
        bottom, top = float(self.level.min()), float(self.level.max())
        reach = 10 * max(sd, s.outlier_sd)
        mean, var = self.moments(self.level)
        ends = bottom - reach, top + reach
        x = np.clip(mean + math.sqrt(var + sd * sd) * np.asarray(PREDICTIVE_Z)[wanted], *ends)
        narrow = min(sd, s.outlier_sd if p_out > 0 else sd)
        width = CELL * narrow
        if (top - bottom) / width >= len(self.level) / 2:
            return self._inverted(x, target, ends, 1e-7, lambda at: (*self.mixture(at, sd, p_out), 0.0))
        parts = self._parts(sd, p_out)
        fine = self._cells(bottom, width)
        # A Halley step leaves an error of about its cube: what the rough cells leave, one short step on the fine ones mends.
        for near, cells in ((0.03, _coarser(*fine)), (1e-3, fine)):
            cells = _summaries(*cells)
            x = self._inverted(x, target, ends, near * narrow, lambda at: _merged_mixture(at, parts, *cells))  # noqa: B023
        return x

    @staticmethod
    def _inverted(x: np.ndarray, target: np.ndarray, ends: tuple[float, float], near: float, mixture: Callable) -> np.ndarray:
        """Points where the distribution function has the wanted values, from ``x`` on."""
        low, high = np.full(len(x), ends[0]), np.full(len(x), ends[1])
        found, open_ = x.copy(), np.arange(len(x))
        for _ in range(100):
            mass, slope, bend = mixture(x)
            miss = mass - target[open_]
            high, low = np.where(miss > 0, x, high), np.where(miss > 0, low, x)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = miss / slope
                new = x - step / np.maximum(1 - 0.5 * step * bend / slope, 0.5)
            new = np.where((new >= low) & (new <= high), new, 0.5 * (low + high))
            found[open_] = new
            far = np.abs(new - x) >= near
            if not far.any():
                break
            open_, x, low, high = open_[far], new[far], low[far], high[far]
        return found

    def _cells(self, bottom: float, width: float) -> tuple[float, float, np.ndarray]:
        """Weights of the particles of each cell, and their first and second moments from its left end in widths."""
        at = (self.level - bottom) * (1 / width)
        cell = at.astype(np.int64)
        at -= cell
        first = self.weight * at
        return bottom, width, np.array([np.bincount(cell, self.weight), np.bincount(cell, first), np.bincount(cell, first * at)])

    def reweight(self, value: float, sd: float, p_out: float) -> tuple[float, float]:
        """Bayes step; returns the log score of the value and the outlier probability after it."""
        gap = self.level - value
        gap *= gap
        core = np.exp(gap * (-0.5 / (sd * sd)))
        core *= (1 - p_out) / sd
        gap *= -0.5 / self.s.outlier_sd**2
        tail = np.exp(gap, out=gap)
        tail *= p_out / self.s.outlier_sd
        core += tail
        core *= self.weight
        total = float(core.sum())
        if not total > 1e-200:  # too far from every particle for plain densities
            return self._reweight_far(value, sd, p_out)
        outlier = float(self.weight @ tail) / total
        core /= total
        self.weight = core
        self.ess = 1 / float(core @ core)
        return math.log(total) - 0.5 * math.log(2 * math.pi), outlier

    def _reweight_far(self, value: float, sd: float, p_out: float) -> tuple[float, float]:
        s = self.s
        const = -0.5 * math.log(2 * math.pi)
        core = math.log1p(-p_out) - 0.5 * ((value - self.level) / sd) ** 2 - math.log(sd) + const
        with np.errstate(divide="ignore"):
            tail = np.log(p_out) - 0.5 * ((value - self.level) / s.outlier_sd) ** 2 - math.log(s.outlier_sd) + const
            both = np.logaddexp(core, tail)
            joint = np.log(self.weight) + both
        peak = joint.max()
        score = float(peak + np.log(np.exp(joint - peak).sum()))
        self.weight = np.exp(joint - score)
        self.ess = float(1 / np.sum(self.weight**2))
        return score, float(self.weight @ np.exp(tail - both))

    def posterior(self, wanted: Collection[str] = OUTPUTS) -> dict[str, float]:
        """The wanted figures of the particles; nothing else is computed."""
        out = {}
        for values, mean, sd in ((self.level, "posterior_mean_cm", "posterior_sd_cm"), (self.rate, "posterior_growth_mean_cm_day", "posterior_growth_sd_cm_day")):
            if mean in wanted or sd in wanted:
                out[mean], var = self.moments(values)
                out[sd] = math.sqrt(max(var, 0.0))
        if any(name in wanted for name in POSTERIOR_NAMES):
            order = ascending(self.level)
            share = np.cumsum(self.weight[order])
            out |= dict(zip(POSTERIOR_NAMES, np.interp(np.multiply(POSTERIOR_P, share[-1]), share, self.level[order])))
        return out

    def observe(
        self, value: float, sd: float, when_us: int, p_out: float, rate: float, rate_sd: float, wanted: Collection[str] = OUTPUTS
    ) -> dict:
        """One row of the batch form: predict, score, update, summarise, resample if thin.

        The state takes the same course whatever is ``wanted``; costly figures that are not wanted are left out or NaN.
        """
        s = self.s
        if self.inputs is not None:
            # Microseconds are whole numbers below 2^53 until the year 2255, so exact as doubles.
            if len(self.inputs) < s.particles // SHORT and abs(when_us) < 2**53:
                self.inputs.append((value, sd, when_us, p_out, rate, rate_sd))
            else:
                self.inputs = None
        row: dict[str, float] = dict.fromkeys(OUTPUTS, math.nan)
        row["elapsed_days"] = 0.0
        if not self.started:
            self.start(value, sd, when_us, rate, rate_sd)
        else:
            days = max((when_us - self.now_us) / 86_400_000_000, ELAPSED_FLOOR)
            self.advance(days)
            row["elapsed_days"] = days
            if "predictive_mean_cm" in wanted or "predictive_sd_cm" in wanted:
                mean, var = self.moments(self.level)
                noise = (1 - p_out) * sd**2 + p_out * s.outlier_sd**2
                row |= {"predictive_mean_cm": mean, "predictive_sd_cm": math.sqrt(var + noise)}
            places = [k for k, name in enumerate(PREDICTIVE_NAMES) if name in wanted] if s.quantiles else []
            if places:
                row |= dict(zip([PREDICTIVE_NAMES[k] for k in places], self.mixture_quantiles(sd, p_out, places)))
            if "predictive_pit" in wanted:
                row["predictive_pit"] = self.below(value, sd, p_out)
            row["predictive_log_score"], row["outlier_posterior_probability"] = self.reweight(value, sd, p_out)
        row |= self.posterior(wanted)
        row["effective_sample_size"] = self.ess
        if self.history:
            (t1, v1), line = self.history[-1], self.history[-1][1]
            if len(self.history) == 2:
                t0, v0 = self.history[0]
                slope = (v1 - v0) / ((t1 - t0) / 86_400_000_000) if t1 > t0 else 0.0
                line = v1 + min(max(slope, s.min_rate), s.max_rate) * row["elapsed_days"]
            row["last_observation_prediction_cm"], row["linear_extrapolation_prediction_cm"] = v1, line
        self.seen += 1
        row["online_sequence_number"] = self.seen
        self.history = [*self.history[-1:], (when_us, value)]
        self.now_us = when_us
        self.resample_if_thin()
        return row


def valid_or(value, default: float, ok=lambda v: True) -> float:
    return float(value) if value is not None and math.isfinite(value) and ok(value) else default


def row_inputs(r: Mapping, s: FilterSettings, columns: Mapping[str, str | None], first: bool) -> dict:
    """Per-row overrides with the global settings behind them."""
    get = lambda name: r.get(columns[name]) if columns.get(name) else None
    # A first measurement needs a positive SD; later ones only a present one.
    sd = valid_or(get("sd"), s.default_sd, (lambda v: v > 0) if first else (lambda v: True))
    return {
        "sd": max(SD_FLOOR, sd * s.sd_multiplier),
        "p_out": valid_or(get("outlier"), s.outlier_probability, lambda v: 0 <= v < 1),
        "rate": valid_or(get("rate"), s.initial_rate),
        "rate_sd": valid_or(get("rate_sd"), s.initial_rate_sd, lambda v: v > 0),
    }


def observed(
    state: Particles, r: Mapping, value: float | None, columns: Mapping[str, str | None], wanted: Collection[str] = OUTPUTS
) -> dict:
    """Outputs of one row. A row without a finite measurement or a time gets NULLs and changes nothing."""
    if value is None or not math.isfinite(value) or r["__us"] is None or r["__us"] != r["__us"]:
        return dict.fromkeys(wanted)
    got = row_inputs(r, state.s, columns, not state.started)
    row = state.observe(float(value), got["sd"], int(r["__us"]), got["p_out"], got["rate"], got["rate_sd"], wanted)
    return {c: row[c] for c in wanted}


def output_fields(wanted: Sequence[str] = OUTPUTS) -> list[T.StructField]:
    kind = {"online_sequence_number": T.LongType()}
    return [T.StructField(c, kind.get(c, T.DoubleType())) for c in wanted]


STATE = "__state"


def particle_filter(
    df: DataFrame,
    entity: str,
    time: str,
    value: str,
    ties: Sequence[str] = (),
    settings: FilterSettings | Mapping[str, FilterSettings] = FilterSettings(),
    setting: str | None = None,
    columns: Mapping[str, str | None] | None = None,
    resume: DataFrame | None = None,
    keep_state: bool = False,
    outputs: Sequence[str] = OUTPUTS,
) -> DataFrame:
    """Append the 28 forecast and posterior columns, or only the ``outputs`` among them, to every row.

    The filter takes the same course either way; figures that are not asked for are not computed.
    ``columns`` may name per-row ``sd``, ``outlier``, ``rate`` and ``rate_sd``. With ``setting`` the
    rows carry the name of one of several settings and each (setting, entity) is filtered apart.
    A row without a finite measurement gets NULL outputs and leaves the state as it is.
    ``resume`` is a table of (setting, entity, state) from an earlier slice; with ``keep_state`` the
    last row of every entity also carries its state in ``__state``.
    """
    columns = dict(columns or {})
    many = dict(settings) if setting else {"": settings}
    outputs = tuple(outputs)
    plain = {k: asdict(v) for k, v in many.items()}
    keys = [setting, entity] if setting else [entity]
    names = list(df.columns)
    schema = T.StructType(
        [*df.schema.fields, *output_fields(outputs), *([T.StructField(STATE, T.BinaryType())] if keep_state else [])]
    )
    rows = df.withColumn("__us", F.unix_micros(F.col(time).cast("timestamp")))
    if resume is None:
        rows = rows.withColumn(STATE, F.lit(None).cast("binary"))
    else:
        rows = rows.unionByName(resume.select(*keys, STATE), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = {k: FilterSettings(**{**v, "field": tuple(map(tuple, v["field"]))}) for k, v in plain.items()}
        current, state, last = None, None, None

        def flush(out):
            # The previous entity is complete: attach its state to its last row.
            if last is not None:
                last[STATE] = state.dump()
                out.append(last)

        for batch in batches:
            out: list[dict] = []
            for r in batch.to_dict("records"):
                key = tuple(r[k] for k in keys)
                if key != current:
                    if keep_state:
                        flush(out)
                    current, last = key, None
                    state = Particles(str(key[-1]), rules[key[0] if setting else ""])
                if r[STATE] is not None:
                    state = Particles.load(r[STATE], str(key[-1]), state.s)
                    continue
                fresh = {n: r[n] for n in names} | observed(state, r, r[value], columns, outputs)
                if not keep_state:
                    out.append(fresh)
                    continue
                if last is not None:
                    last[STATE] = None
                    out.append(last)
                last = fresh
            if out:
                yield _columns(out, schema)
        if keep_state and last is not None:
            out = []
            flush(out)
            yield _columns(out, schema)

    # State rows have a NULL time and so come first in their entity.
    return sorted_by_key(rows, keys, [time, *ties]).mapInPandas(run, schema)


def _columns(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    """Rows as a frame whose numbers may be missing."""
    out = pd.DataFrame(rows, columns=schema.names)
    for name in [c for c in OUTPUTS if c in schema.names]:
        out[name] = out[name].astype("Int64" if name == "online_sequence_number" else "float64")
    return out


def filter_in_slices(
    df: DataFrame, entity: str, time: str, value: str, edges: Sequence[str], ties: Sequence[str] = (), **options
) -> DataFrame:
    """The same result from consecutive time slices, each written out with its end state.

    Results equal one whole run: particles, generator state and history are handed on exactly.
    """
    bounds = [None, *edges, None]
    done, state = None, None
    keys = [options["setting"], entity] if options.get("setting") else [entity]
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(time) >= F.lit(low))
        if high is not None:
            part = part.filter(F.col(time) < F.lit(high))
        rows = materialize(
            particle_filter(part, entity, time, value, ties, resume=state, keep_state=True, **options)
        )
        fresh = rows.filter(F.col(STATE).isNotNull()).select(*keys, STATE)
        # Entities without rows in this slice keep the state they had.
        state = fresh if state is None else fresh.unionByName(state.join(fresh.select(*keys), keys, "left_anti"))
        rows = rows.drop(STATE)
        done = rows if done is None else done.unionByName(rows)
    return done


def with_settings(df: DataFrame, names: Sequence[str], column: str = "setting") -> DataFrame:
    """One copy of every row per named setting."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(n) for n in names])))


def variants(base: FilterSettings) -> dict[str, FilterSettings]:
    """Guessed and calibrated noise, and three ablations, as one fan-out."""
    return {
        "calibrated": base,
        "guessed": replace(base, level_sd=1.5, outlier_probability=0.08, outlier_sd=60.0),
        "no_outliers": replace(base, outlier_probability=0.0),
        "free_rate": replace(base, min_rate=-50.0, max_rate=50.0),
        "no_growth": replace(base, initial_rate=0.0, initial_rate_sd=1e-9, rate_sd=0.0),
    }
