"""Base spacing: same answer as trying every grid value, with medians taken of the leading ones only."""

import random
import statistics

from seriesloom.operators import fitting as Fit


def brute(gaps):
    useful = [g for g in gaps if Fit.GRID_FROM <= g <= Fit.GRID_TO]
    if len(useful) < 3:
        return None
    found = []
    for k in range(Fit.GRID_SIZE):
        c = Fit.GRID_FROM + k * 0.5
        rel = [abs(g / c - 1) for g in useful if abs(g / c - 1) <= Fit.GRID_MATCH]
        if len(rel) >= 2:
            found.append((len(rel), -statistics.median(rel), c))
    if not found:
        return None
    votes, _, c = max(found)
    return c, votes, statistics.median(g for g in useful if abs(g / c - 1) <= Fit.GRID_MATCH)


def rows(spark):
    rng = random.Random(5)
    groups = {k: [rng.uniform(5, 130) for _ in range(k)] for k in range(2, 30)}
    groups[100] = [50.0, 50.0]
    groups[101] = [20.0, 50.0, 100.0]  # no value matches two gaps
    df = spark.createDataFrame([(k, g) for k, gs in groups.items() for g in gs], "k long, gap double")
    return groups, df


def test_base_gap_is_the_best_grid_value(spark):
    groups, df = rows(spark)
    got = {r["k"]: (r["candidate"], r["votes"], r["base_gap"]) for r in Fit.base_gap(df, ["k"]).collect()}
    want = {k: b for k, gs in groups.items() if (b := brute(gs))}
    assert got.keys() == want.keys()
    for k, (candidate, votes, gap) in want.items():
        assert got[k][:2] == (candidate, votes) and abs(got[k][2] - gap) < 1e-9


def test_base_gap_takes_medians_of_leading_grid_values_only(spark, monkeypatch):
    groups, df = rows(spark)
    seen = []
    inner = Fit.exact_quantiles

    def counted(d, *args, **options):
        seen.append(d.count())
        return inner(d, *args, **options)

    monkeypatch.setattr(Fit, "exact_quantiles", counted)
    Fit.base_gap(df, ["k"])
    allowed = 0
    for gs in groups.values():
        useful = [g for g in gs if Fit.GRID_FROM <= g <= Fit.GRID_TO]
        votes = [sum(abs(g / (Fit.GRID_FROM + k * 0.5) - 1) <= Fit.GRID_MATCH for g in useful) for k in range(Fit.GRID_SIZE)]
        if len(useful) >= 3 and max(votes) >= 2:
            allowed += sum(v for v in votes if v == max(votes))
    assert seen == [allowed]
