"""Figures that are not asked for are not computed, and those that are do not change by it."""

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import particle as PF
from seriesloom.plans import states
from seriesloom.plans.catalog import QUERIES
from seriesloom.plans.registry import Tables

SMALL = PF.FilterSettings(particles=300)


@pytest.mark.parametrize("outputs", [["effective_sample_size"], ["predictive_q25_cm", "predictive_q975_cm"], ["predictive_pit", "posterior_mean_cm"], ["posterior_q10_cm"], []])
def test_some_outputs_equal_those_of_all(spark, folder, outputs):
    rows = states.stream(Tables(spark, folder)).filter("user_id < 3")
    run = lambda **o: PF.particle_filter(rows, "user_id", "ts", "value", ["event_id"], SMALL, **o)
    some = run(outputs=outputs)
    assert some.columns == [*rows.columns, *outputs]
    whole = {r["event_id"]: r for r in run().collect()}
    for r in some.collect():
        for c in outputs:
            assert r[c] is None and whole[r["event_id"]][c] is None or r[c] == pytest.approx(whole[r["event_id"]][c], abs=1e-9), c


@pytest.mark.parametrize("name", ["t03_resampling_share", "t05_growth_field_filter", "t12_prefix_audit_particles"])
def test_queries_that_need_no_quantile_compute_none(spark, folder, monkeypatch, name):
    def unwanted(*a, **b):
        raise AssertionError("not asked for")

    monkeypatch.setattr(states, "SETTINGS", SMALL)
    want = {tuple(r) for r in rounded(QUERIES[name](spark, folder)).collect()}
    for step in ("mixture_quantiles", "below", "mixture"):
        monkeypatch.setattr(PF.Particles, step, unwanted)
    monkeypatch.setattr(PF, "ascending", unwanted)
    assert {tuple(r) for r in rounded(QUERIES[name](spark, folder)).collect()} == want


def rounded(d):
    return d.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in d.dtypes])


def test_a_short_series_is_stored_as_its_rows_and_gives_the_same_state():
    s = PF.FilterSettings()
    one = PF.Particles("a", s)
    one.keep_inputs()
    for i in range(s.particles // PF.SHORT + 3):
        short = one.dump_short()
        again = PF.Particles.load(short, "a", s)
        if i in (0, 1, 40, 125, 126, 127):
            assert again.dump() == one.dump()
            assert len(short) < (7_000 if i <= 125 else 125_000)
        one.observe(40.0 + i % 7 * 9, 15.0, 1_704_067_200_123_457 + i * 10_000_000_001, 0.08, 3.0, 2.0, ())


def test_a_stream_of_short_series_keeps_little_state(spark, folder, tmp_path, monkeypatch):
    """Particles of 5000 by 24 bytes were written for each user and arrival."""
    rows = states.stream(Tables(spark, folder)).filter("user_id < 6")
    for k in range(2):
        rows.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(str(tmp_path / "in"))
        stream = states.ST.stream_table(spark, str(tmp_path / "in"), rows.schema, "ts")
        done = states.ST.stateful_filter(stream, "user_id", "ts", "value", ["event_id"], states.SETTINGS, outputs=["effective_sample_size"])
        done = states.ST.run_to_end(done, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert done.count() == rows.count()
    assert done.columns == ["user_id", "event_id", "ts", "value", "effective_sample_size", "arrival"]
    assert sum(p.stat().st_size for p in (tmp_path / "checkpoint").rglob("*.sst")) < 6 * 2 * 20_000
