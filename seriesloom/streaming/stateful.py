"""Structured Streaming forms: filter, tracker and calibration choice with state per key.

Rows of a key inside one micro-batch are sorted before use; a row older than what the key has already
seen is not applied but returned with a reason, because an emitted row never changes. Filter and tracker
are stateful processors (:mod:`seriesloom.streaming.processors`) on the RocksDB store.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesloom.operators.particle import OUTPUTS, FilterSettings, output_fields
from seriesloom.operators.tracking import FIT, ROW_SCHEMA, TrackSettings
from seriesloom.streaming.processors import SIDE, US, FilterProcessor, Hygiene, Keyed, TrackProcessor, with_clock

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_table(
    spark: SparkSession, folder: str, schema: T.StructType, time: str | None = None, pattern: str | None = None, files: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream. A naive ``time`` becomes a zoned one, as watermarks need."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp")) if time else rows


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append everything available to a parquet table and return it."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, ROCKSDB)  # read when the query starts
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def enrich_stream(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Static lookup on a stream, unmatched rows kept."""
    return stream.join(table, key, "left")


def _batch(frames: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(list(order), kind="mergesort")


def stateful_filter(
    stream: DataFrame,
    entity: str,
    time: str,
    value: str,
    ties: Sequence[str] = (),
    settings: FilterSettings = FilterSettings(),
    columns: Mapping[str, str | None] | None = None,
    hygiene: Hygiene | None = None,
    outputs: Sequence[str] = OUTPUTS,
) -> DataFrame:
    """The particle filter on arrival. ``arrival`` is ``applied`` or ``late`` (estimates NULL). Every applied row moves
    the state; only the ``outputs`` are computed and appended.

    With ``hygiene`` there is a watermark: rows behind it are returned as ``behind_watermark``, and a series
    that stays idle is ``closed`` by a row with its last time and forgotten.
    """
    schema = T.StructType([*stream.schema.fields, *output_fields(outputs), T.StructField("arrival", T.StringType())])
    idle = hygiene.idle if hygiene else None
    step = FilterProcessor(asdict(settings), stream.columns, time, value, entity, ties, columns or {}, schema, idle, outputs)
    return _keyed(stream, entity, time, step, schema, hygiene)


def _keyed(stream: DataFrame, key: str, time: str, step: Keyed, schema: T.StructType | str, hygiene: Hygiene | None) -> DataFrame:
    if hygiene:
        return with_clock(stream, time, hygiene.delay).groupBy(key).transformWithStateInPandas(step, schema, "append", "eventtime")
    rows = stream.withColumn(US, F.unix_micros(F.col(time).cast("timestamp")))
    return rows.groupBy(key).transformWithStateInPandas(step, schema, "append", "none")


def rows_by_arrival(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The applied rows, and the side table of those that came too late or closed a series."""
    applied = F.col("arrival") == "applied"
    return done.filter(applied).drop("arrival"), done.filter(~applied)


FIT_RANK = ("over_cap", "neg_landmarks", "neg_span", "rmse", "us", "filename")


def stateful_best_fit(stream: DataFrame, key: str, time: str, row_id: str) -> DataFrame:
    """Best earlier fit on arrival: fits update the state of their camera, rows read it.

    The stream stacks both kinds: fits have ``n_landmarks``, ``span_px``, ``rmse``, ``filename``; rows
    have ``row_id``. A fit counts for rows of the same time.
    """
    schema = T.StructType(
        [stream.schema[key], stream.schema[row_id], T.StructField("fit_filename", T.StringType()), T.StructField("fit_rmse", T.DoubleType())]
    )
    state_schema = T.StructType([T.StructField("rank", T.ArrayType(T.DoubleType())), T.StructField("name", T.StringType())])

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = (tuple(state.get[0]), state.get[1]) if state.exists else None
        out = []
        for r in _batch(frames, ["__us", "__side"]).to_dict("records"):
            if r["__side"] == 0:
                rank = (float(r["rmse"] > 1.27), -float(r["n_landmarks"]), -float(r["span_px"]), float(r["rmse"]), float(r["__us"]))
                best = min(best, (rank, r["filename"])) if best else (rank, r["filename"])
            else:
                out.append((k[0], r[row_id], best[1] if best else None, best[0][3] if best else None))
        if best:
            state.update((list(best[0]), best[1]))
        yield pd.DataFrame(out, columns=schema.names).astype({"fit_rmse": "float64"})

    rows = stream.withColumn("__us", F.unix_micros(F.col(time).cast("timestamp"))).withColumn(
        "__side", F.when(F.col(row_id).isNull(), 0).otherwise(1)
    )
    return rows.groupBy(key).applyInPandasWithState(
        run, schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )


#: Columns of a fit in the tracker's stream, besides camera, time and file name.
FIT_COLUMNS = ("n_landmarks", "span_px", "rmse", *FIT)


def with_fits(frames: DataFrame, fits: DataFrame) -> DataFrame:
    """Frames and passing fits of the same cameras as one stream (or table) for :func:`stateful_track`."""
    side = fits.select("camera_id", "capture_datetime", "filename", *[F.col(c).cast("double").alias(c) for c in FIT_COLUMNS], F.lit(0).alias(SIDE))
    return frames.withColumn(SIDE, F.lit(1)).unionByName(side, allowMissingColumns=True)


def stateful_track(stream: DataFrame, settings: TrackSettings = TrackSettings(), hygiene: Hygiene | None = None) -> DataFrame:
    """The tracker on arrival. A stream row is one frame: camera_id, capture_datetime, filename and
    ``candidates``, an array of candidate structs that may be empty; or, with :func:`with_fits`, a fit. Where
    ``settings.scale`` is None heights are measured by the best fit up to the frame's time.
    """
    plain = asdict(settings)
    plain["expected_by_camera"] = dict(settings.expected_by_camera)
    if SIDE not in stream.columns:
        stream = stream.withColumn(SIDE, F.lit(1))
    missing = [c for c in FIT_COLUMNS if c not in stream.columns]
    stream = stream.withColumns({c: F.lit(None).cast("double") for c in missing})
    step = TrackProcessor(plain, hygiene.idle if hygiene else None)
    return _keyed(stream, "camera_id", "capture_datetime", step, ROW_SCHEMA, hygiene)
