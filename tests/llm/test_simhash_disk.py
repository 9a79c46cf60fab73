"""Cells of near-duplicate comparison are dealt some at a time, and shuffles end with the table they were made for."""

from pathlib import Path

from pyspark.sql import functions as F

from seriesloom.llm import simhash
from seriesloom.llm.common import Scratch


def test_stripes_hold_every_cell_once_and_few_copies():
    for bands in (1, 2, 5, 33, 92):
        stripes = simhash._stripes(bands)
        assert [low for a, b in stripes for low in range(a, b)] == list(range(bands))
        assert all(sum(2 * (bands - low) - 1 for low in range(a, b)) <= (simhash.COPIES + 2) * bands for a, b in stripes)


def test_cells_are_dealt_some_at_a_time_and_leave_no_shuffle(spark, monkeypatch):
    """All cells were shuffled at once: every row once for each band, 40 times here."""
    monkeypatch.setattr(simhash, "BAND", 50)
    rows = spark.range(2000).select(F.col("id").alias("node"), F.array("id").alias("fp"))
    seen, tables = [], 0
    for cells in simhash._cells(rows):
        found = cells.select("low", "high", "band", "node").collect()
        assert len(found) <= (simhash.COPIES + 2.5) * 2000
        seen += found
        tables += 1
    assert tables > 5 and len(seen) == 2000 * 40
    pairs = {}
    for low, high, band, node in seen:
        pairs.setdefault((low, high), []).append(node)
        assert band in (low, high)
    assert len(pairs) == 40 * 41 // 2 and all(len(v) == len(set(v)) for v in pairs.values())
    scratch = Scratch(spark, "test")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.name for d in disk.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before = files()
    found = simhash._of_cells(rows, lambda pdf: pdf[["node"]].head(1), "node long", scratch)
    assert files() <= before
    assert found.count() == 40 * 41 // 2
