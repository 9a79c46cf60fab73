"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.ordering import SeriesOrder
from seriesloom.session import pin_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under an inventory id plus verb."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(pin_session(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# Rounding shared by both sides. The offset moves values off decimal ties, which Spark and the
# checking engine break differently; adding 0.0 turns a negative zero into zero.
_OFFSET = {6: 2.3e-9, 4: 2.3e-7, 3: 2.3e-6, 2: 2.3e-5}


def rnd(value: Column | str, digits: int = 6) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast("double") + F.lit(_OFFSET[digits]), digits) + F.lit(0.0)


def sql_rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + {_OFFSET[digits]!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"


# The measurement stream stand-in: one series per user, ties broken by event id.
EVENT_ORDER = SeriesOrder.by_time(("user_id",), "ts", ("event_id",))
EVENT_WINDOW = "(PARTITION BY user_id ORDER BY ts, event_id)"
US_PER_DAY = 86_400_000_000
