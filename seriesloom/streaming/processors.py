"""Stateful processors with named state variables, event-time clocks and expiry.

State lives in the RocksDB store, one variable for each thing kept: particles (of a short series its rows, which lead
to the same particles again) and clock of a series; tracks, best fit, fits still ahead and clock of a camera. Nothing is serialised as a whole, and a micro-batch
reads and writes only the keys it holds.

The watermark runs on tick rows that are made beside every row and dropped again above it, so Spark never
removes a late row: the processor compares its time with the watermark and the key's own clock, and
returns it with the reason instead. A key that is idle for some event time is closed by a timer, which frees
its state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seriesloom.operators.ordering import width_us
from seriesloom.operators.particle import OUTPUTS, FilterSettings, Particles, observed
from seriesloom.operators.tracking import CANDIDATE, FIT, CameraTracker, Track, rows_to_pandas, settings_from

#: Helper columns; names that begin with an underscore are lost on the way to a processor.
US, SIDE, CLOCK = "row_us", "row_side", "row_clock"


@dataclass(frozen=True)
class Hygiene:
    """How long rows may be late against the newest row of all keys, and a key idle, before it is closed."""

    delay: str = "7 days"
    idle: str = "60 days"


def with_clock(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """``stream`` with its time in microseconds, under a watermark that drops none of its rows."""
    when = F.col(time).cast("timestamp")
    ticks = F.explode(F.array(F.lit(None).cast("timestamp"), when)).alias(CLOCK)
    both = stream.withColumn(US, F.unix_micros(when)).select("*", ticks)
    # The condition names the clock, so it stays above the watermark and every tick counts.
    return both.withWatermark(CLOCK, delay).filter(F.col(CLOCK).isNull())


class Keyed(StatefulProcessor):
    """A key's clock and its timer; rows are handed on in event order.

    A key has one timer, set by its first row and not moved by later ones: when it goes off too early, it is set
    again for the key's last time. Every call to the state is a trip to the JVM, so each thing is read and
    written once for a key and micro-batch.
    """

    def __init__(self, order: Sequence[str], idle: str | None):
        self.order = list(order)
        self.idle_ms = width_us(idle) // 1000 if idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "us long, timer long")

    def close(self) -> None:
        pass

    def now(self) -> tuple[int | None, int | None]:
        """The key's last time and the time its timer is set for."""
        return self.clock.get() or (None, None)

    def sorted_rows(self, frames: Iterator[pd.DataFrame]) -> list[dict]:
        """One key's rows of a micro-batch, whose size the source's admission limits."""
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if len(rows) > 1:
            columns = [rows[c].to_numpy() for c in reversed(self.order)]
            if any(c.dtype == object for c in columns):
                rows = rows.sort_values(self.order, kind="mergesort")
            else:
                rows = rows.take(np.lexsort(columns))
        return rows.to_dict("records")

    def reason(self, us: int, now: int | None, timer_values) -> str | None:
        """Why a row cannot be applied any more, if so."""
        if now is not None and us < now:
            return "late"
        if self.idle_ms is not None and us < 1000 * timer_values.getCurrentWatermarkInMs():
            return "behind_watermark"
        return None

    def arm(self, now: int | None, timer: int | None) -> None:
        if now is None:
            return
        if self.idle_ms is not None and timer is None:
            timer = now // 1000 + self.idle_ms
            self.handle.registerTimer(timer)
        self.clock.update((now, timer))

    def still_busy(self, now: int, timer_values) -> bool:
        """Whether rows came after the timer was set, so that it is set again."""
        due = now // 1000 + self.idle_ms
        if due <= timer_values.getCurrentWatermarkInMs():
            return False
        self.arm(now, None)
        return True


def typed(rows: list[dict], schema: T.StructType) -> pd.DataFrame:
    """Rows by the columns of a schema, made column by column, as keys with few rows are many."""
    out = {}
    for f in schema.fields:
        values = [r.get(f.name) for r in rows]
        if isinstance(f.dataType, T.DoubleType):
            out[f.name] = np.array(values, "float64")
        elif isinstance(f.dataType, T.LongType):
            out[f.name] = pd.array(values, "Int64")
        else:
            out[f.name] = values
    return pd.DataFrame(out, columns=schema.names, copy=False)


class FilterProcessor(Keyed):
    """The particle filter of one series."""

    def __init__(self, plain: dict, names: Sequence[str], time: str, value: str, entity: str, ties: Sequence[str], columns: Mapping, schema: T.StructType, idle: str | None, outputs: Sequence[str] = OUTPUTS):
        super().__init__([US, *ties], idle)
        self.outputs = tuple(outputs)
        self.plain, self.names, self.time, self.value, self.entity = plain, list(names), time, value, entity
        self.columns, self.schema = dict(columns), schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.particles = handle.getValueState("particles", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = FilterSettings(**{**self.plain, "field": tuple(map(tuple, self.plain["field"]))})
        label = str(key[0])
        held = self.particles.get()
        p = Particles.load(bytes(held[0]), label, s) if held else Particles(label, s)
        if not held:
            p.keep_inputs()
        (now, timer), out = self.now(), []
        for r in self.sorted_rows(rows):
            row = {n: r[n] for n in self.names}
            if pd.isna(r[US]):
                out.append(row | dict.fromkeys(self.outputs) | {"arrival": "no_time"})
                continue
            us = int(r[US])
            why = self.reason(us, now, timerValues)
            if why:
                out.append(row | dict.fromkeys(self.outputs) | {"arrival": why})
                continue
            out.append(row | observed(p, r | {"__us": us}, r[self.value], self.columns, self.outputs) | {"arrival": "applied"})
            now = us
        if now is not None:
            self.particles.update((p.dump_short(),))
        self.arm(now, timer)
        yield typed(out, self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The last word on a series: its key and last time, estimates NULL."""
        now, _ = self.now()
        if self.still_busy(now, timerValues):
            return
        last = pd.Timestamp(now, unit="us", tz="UTC")
        self.particles.clear()
        self.clock.clear()
        row = dict.fromkeys(self.schema.names) | {self.entity: key[0], self.time: last, "arrival": "closed"}
        yield typed([row], self.schema)


RANK = ("over_cap", "minus_landmarks", "minus_span", "rmse", "us")
_FIT_STATE = ", ".join([*[f"{c} double" for c in RANK[:-1]], "us long", "filename string", *[f"{c} double" for c in FIT]])
_TRACK_STATE = "uid string, x double, root_y double, outlier double, particles binary"


class TrackProcessor(Keyed):
    """The tracker of one camera, and the best of its fits up to the current frame.

    A fit counts for frames of its own time and later ones; fits that arrive ahead of the frames wait.
    """

    def __init__(self, plain: dict, idle: str | None):
        super().__init__([US, SIDE, "filename"], idle)
        self.plain = plain

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", "us long")
        self.best = handle.getValueState("best_fit", _FIT_STATE)
        self.ahead = handle.getListState("fits_ahead", _FIT_STATE)
        self.tracks = handle.getMapState("tracks", "number int", _TRACK_STATE)

    @staticmethod
    def fit_of(r: dict) -> tuple:
        rank = (float(r["rmse"] > 1.27), -float(r["n_landmarks"]), -float(r["span_px"]), float(r["rmse"]))
        return (*rank, int(r[US]), r["filename"], *[float(r[c]) if r[c] is not None else math.nan for c in FIT])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = settings_from(self.plain)
        t = CameraTracker(key[0], s)
        t.now_us, timer = self.now()
        t.first_us = (self.first.get() or (None,))[0]
        for (number,), (uid, x, root_y, outlier, state) in self.tracks.iterator():
            particles = Particles.load(bytes(state), uid, s.filter) if state else None
            t.tracks.append(Track(number, uid, x, root_y, particles, outlier))
        t.tracks.sort(key=lambda track: track.number)
        best = self.best.get()
        waiting = [tuple(f) for f in self.ahead.get()] if self.ahead.exists() else []
        out: list[dict] = []
        for r in self.sorted_rows(rows):
            us = int(r[US])
            if r[SIDE] == 0:
                waiting.append(self.fit_of(r))
                continue
            why = self.reason(us, t.now_us, timerValues)
            if why:
                out.append({"camera_id": key[0], "capture_datetime": pd.Timestamp(us, unit="us"), "filename": r["filename"], "status": f"{why}_frame", "measurement_used": False})
                continue
            # Better: fewer of each in turn; the name decides last.
            best = min([f for f in waiting if f[4] <= us] + ([best] if best else []), key=lambda f: f[:6], default=None)
            waiting = [f for f in waiting if f[4] > us]
            found = [{c: float(x[c]) for c in CANDIDATE} | {"candidate_index": int(x["candidate_index"])} for x in r["candidates"]]
            fit = None
            if s.scale is None:
                fit = dict(zip(FIT, best[6:])) | {"filename": best[5]} if best else dict.fromkeys(FIT, math.nan) | {"filename": None}
            out += t.frame(us, r["filename"], sorted(found, key=lambda c: c["candidate_index"]), fit)
        if best:
            self.best.update(best)
        if waiting:
            self.ahead.put(waiting)
        elif self.ahead.exists():
            self.ahead.clear()
        for track in t.tracks:
            state = track.particles.dump() if track.particles else b""
            self.tracks.updateValue((track.number,), (track.uid, track.x, track.root_y, track.outlier, state))
        if t.first_us is not None:
            self.first.update((t.first_us,))
        # A camera that has sent only fits has no frame clock; its fits wait until a frame comes.
        self.arm(t.now_us, timer)
        yield rows_to_pandas(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.still_busy(self.now()[0], timerValues):
            return
        for state in (self.clock, self.first, self.best, self.ahead, self.tracks):
            state.clear()
        yield rows_to_pandas([])
