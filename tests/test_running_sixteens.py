"""Running sums and merged marks have the very bits that the SQL gives a series on its own, so equal medians and limits
decide alike. (On many series at once the engine's blocks begin wherever the series before it ended.)"""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import fitting as Fit
from seriesloom.operators import ordering
from seriesloom.operators.ordering import SeriesOrder, running_sixteens
from seriesloom.plans.fits import MARKS, MERGED, marks
from seriesloom.plans.registry import Tables

BY = SeriesOrder.by_time(("k",), "ts", ("id",))
SQL = "SELECT id, sum(v) OVER (PARTITION BY k ORDER BY ts, id) AS y FROM read_parquet('{}/*.parquet') WHERE k IS NOT DISTINCT FROM {}"


def rows(spark, path, lengths, missing=0.0):
    rng = np.random.default_rng(7)
    k = np.repeat(np.arange(len(lengths)), lengths)
    v = [None if rng.random() < missing else float(x) for x in np.round(rng.gamma(1, 90, len(k)), 2)]
    d = [(int(i), int(a), int(s), b) for i, (a, s, b) in enumerate(zip(k, rng.integers(0, 10**7, len(k)), v))]
    d += [(10**6 + i, None, i, 0.1) for i in range(40)]
    df = spark.createDataFrame(d, "id long, k long, s long, v double").select("id", "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v")
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("cell", "missing"), [(ordering.CELL, 0.0), (ordering.CELL, 0.3), (256, 0.0), (256, 0.3)])
def test_sums_equal_the_engines_in_every_bit(spark, tmp_path, monkeypatch, cell, missing):
    monkeypatch.setattr(ordering, "CELL", cell)
    lengths = [1, 15, 16, 17, 255, 256, 257, 300, 4095, 4096, 4097, 9000]
    df = rows(spark, str(tmp_path / "t"), lengths, missing)
    got = running_sixteens(df, BY, "y", F.col("v"))
    assert got.columns == [*df.columns, "y"]
    want = {}
    for k in [*range(len(lengths)), "NULL"]:
        want |= dict(duckdb.sql(SQL.format(tmp_path / "t", k)).fetchall())
    assert {r["id"]: r["y"] for r in got.collect()} == want


def test_no_order_of_partitions_changes_a_bit(spark, tmp_path):
    df = rows(spark, str(tmp_path / "t"), [900, 40])
    sums = [sorted((r["id"], r["y"]) for r in running_sixteens(d, BY, "y", F.col("v")).collect()) for d in (df, df.orderBy("v"), df.repartition(31))]
    assert sums[0] == sums[1] == sums[2]


def test_merged_marks_equal_the_engines_in_every_bit(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE everything AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    want = []
    for (user,) in con.execute("SELECT DISTINCT user_id FROM everything ORDER BY 1").fetchall():
        con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM everything WHERE user_id = {user}")
        want += con.execute(f"WITH {MARKS}, {MERGED} SELECT user_id, island, x, y FROM mg ORDER BY 1, 2").fetchall()
    got = Fit.merge_close(marks(Tables(spark, folder)), ["user_id"], ties=["x"]).select("user_id", "island", "x", "y")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_chain_is_added_from_top_to_bottom(spark):
    d = [(1, i, 20 + i * 0.1 + i * 1e-7, 320 + i % 7 * 1.3, 50.0 + i % 13, 1.0) for i in range(500)]
    df = spark.createDataFrame(d, "k long, id long, y double, x double, area double, component_score double")
    total = weight = 0.0
    for _, _, y, _, area, _ in d:
        total, weight = total + y * area, weight + area
    for way in (df, df.orderBy(F.desc("y")), df.repartition(13)):
        assert [r["y"] for r in Fit.merge_close(way, ["k"]).collect()] == [total / weight]
