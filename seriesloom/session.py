"""Session settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import seriesloom

# Functions sent to tasks carry the package's own code, so workers need no installed copy.
cloudpickle.register_pickle_by_value(seriesloom)


def build_session(app: str = "seriesloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the zone pinned to UTC.

    Cluster deployments bring their own master and sizing; nothing here overrides them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Pin the zone on a session somebody else built; naive and zoned times then agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names.

    Where none is named, a session on one machine gets a fresh folder; on a cluster that is an
    error, since executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))


def materialize(df: DataFrame) -> DataFrame:
    """Write a many-times-read intermediate to the shared checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/seriesloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows by key into the configured number of partitions.

    The number is given, so adaptive execution does not merge partitions that are small but costly
    to process.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sorted_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and in order, for a function that streams through its partition."""
    return spread_by_key(df, keys).sortWithinPartitions(*keys, *order)
