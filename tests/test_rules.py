"""Contracts, fits, joins and text rules on small cases."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import scalars as C
from seriesloom.functions import scoring as S
from seriesloom.operators import bootstrap as B
from seriesloom.operators import contracts as P
from seriesloom.operators import fitting as Fit
from seriesloom.operators import joins as J
from seriesloom.operators import select as K
from seriesloom.sources import tables as IO


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, want",
    [
        ("C-004_2021-07-05-08-30-10.jpg", dt.datetime(2021, 7, 5, 8, 30, 10)),
        ("x/2021_07_05_08_30.png", dt.datetime(2021, 7, 5, 8, 30)),
        ("plot 2021-07-05.jpg", dt.datetime(2021, 7, 5, 12)),
        ("IMG20210705.jpg", dt.datetime(2021, 7, 5, 12)),
        ("a-2021-13-40_20210705_b.jpg", dt.datetime(2021, 7, 5, 12)),
        ("120210705.jpg", None),
        ("2021-02-30.jpg", None),
    ],
)
def test_capture_time(spark, name, want):
    assert one(spark, C.capture_time(F.lit(name))) == want


def test_header_time_and_keys(spark):
    at = one(spark, C.header_time(F.lit("7/5 ; 9:30 pm"), 2024).cast("string"))
    assert at == "2024-07-06 02:30:00"
    assert one(spark, C.header_time(F.lit("notes"), 2024)) is None
    assert one(spark, C.pad_camera(F.lit("C_4"))) == "C_004"


def test_student_t_constants():
    for p, want in ((0.75, 0.7266868438), (0.9, 1.4758840488), (0.95, 2.0150483727), (0.975, 2.5705818356)):
        assert S.student_t_quantile(p, 5) == pytest.approx(want, abs=1e-8)
    assert S.student_t_quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-5)


def test_required_columns(spark):
    with pytest.raises(P.ContractError, match="b, c"):
        P.require_columns(spark.range(1).toDF("a"), ["a", "b", "c"], "table")


def test_contracts_raise(spark):
    d = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(P.ContractError):
        P.assert_unique(d, ["k"])
    with pytest.raises(P.ContractError, match="3 instead of 4"):
        P.assert_counts(d, {"rows": 4}, {"rows": F.count(F.lit(1))})
    side = spark.createDataFrame([(1, 0.5)], "k int, f double")
    with pytest.raises(Exception, match="no f for k 2"):
        J.enrich_or_fail(d, side, "k", ["f"]).collect()


def landmarks(spark, items):
    return spark.createDataFrame([("i", float(y), float(z)) for y, z in items], "image string, y double, z double")


def fit(spark, items):
    return Fit.fit_projective(landmarks(spark, items), ["image"], "y", "z").first()


def test_projective_fit(spark):
    line = [(100 + 40 * k, 120 - 12 * k) for k in range(11)]
    got = fit(spark, line)
    assert got.fit_status == "ok" and got.fit_rmse < 1e-8 and got.fit_pass
    a, b, c = -30.0, 60.0, 0.15
    u = np.linspace(-1.7, 1.7, 9)
    u = (u - u.mean()) / u.std()
    curved = fit(spark, list(zip(300 + 50 * u, (a * u + b) / (c * u + 1))))
    assert (curved.a, curved.b, curved.c) == pytest.approx((a, b, c))
    assert fit(spark, line[:3]).fit_status == "too_few"
    assert fit(spark, [(5, z) for _, z in line]).fit_status == "no_spread"
    assert fit(spark, [(y, -z) for y, z in line]).fit_status == "not_monotone"


def test_bootstrap_quantiles_equal_resampling(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"c": rng.integers(0, 7, 200), "v": np.round(rng.normal(0, 30, 200), 1)})
    df = spark.createDataFrame(d)
    got = B.quantile_replicates(df, "c", "v", [0.5, 0.9], 40, 11).toPandas()
    indexed = B.index_clusters(df.select("c").distinct(), "c")
    drawn = B.draws(indexed, 40, 11).join(indexed, "idx").toPandas()
    for rep, g in drawn.groupby("rep"):
        v = np.concatenate([d[d.c == c].v for c in g.c])
        mine = got[got.rep == rep].set_index("probability")["quantile"]
        np.testing.assert_allclose([mine[0.5], mine[0.9]], np.quantile(v, [0.5, 0.9]))


def test_bootstrap_quantiles_over_levels_and_blocks(spark, monkeypatch):
    for name, size in (("REPLICATES", 8), ("CLUSTERS", 4), ("FANOUT", 3)):
        monkeypatch.setattr(B, name, size)
    rng = np.random.default_rng(5)
    n = 900
    d = pd.DataFrame({"c": np.where(np.arange(n) < 300, "c0", [f"c{i}" for i in rng.integers(0, 14, n)])})
    d["v"] = np.where(np.arange(n) % 3 == 0, 1.5, np.round(rng.normal(0, 30, n), 1))  # a third of the rows is one value
    d.loc[:4, "v"] = [np.nan, -0.0, 0.0, np.inf, -np.inf]
    d = pd.concat([d, pd.DataFrame({"c": ["empty", None], "v": [np.nan, 7.0]})])
    df = spark.createDataFrame(d)
    got = B.quantile_replicates(df, "c", "v", [0.0, 0.37, 0.5, 1.0], 30, 11).toPandas()
    assert len(got) == 30 * 4
    indexed = B.index_clusters(df.select("c").distinct(), "c")
    drawn = B.draws(indexed, 30, 11).join(indexed, "idx").toPandas()
    for rep, g in drawn.groupby("rep"):
        v = np.sort(np.concatenate([d[(d.c == c) & d.v.notna()].v for c in g.c.dropna()]))
        mine = got[got.rep == rep].set_index("probability")["quantile"]
        assert (mine[0.0], mine[1.0]) == (v[0], v[-1])
        np.testing.assert_allclose([mine[0.37], mine[0.5]], np.quantile(v, [0.37, 0.5]))


def test_bootstrap_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "c string, v double")
    assert B.quantile_replicates(df, "c", "v", [0.5], 5, 1).count() == 0
    assert B.quantile_replicates(df.filter("false"), "c", "v", [0.5], 5, 1).count() == 0


def test_cluster_numbers_with_a_common_prefix(spark):
    names = [f"device-{i:05d}" for i in range(3000)] + ["d", "device-", "é", "z"]
    df = spark.createDataFrame([(x,) for x in names], "c string")
    length = B.prefix_length(df, "c", 120)
    assert df.groupBy(F.substring("c", 1, length)).count().agg(F.max("count")).first()[0] == 100
    assert B.prefix_length(df, "c", len(names)) == 3 and B.prefix_length(df, "c", 0) == 128
    got = B.index_clusters(df, "c", most=120).toPandas().sort_values("idx")
    assert got.c.tolist() == sorted(names, key=lambda x: x.encode()) and got.idx.tolist() == list(range(len(names)))


@pytest.mark.parametrize("noise", [0.4, 3.0, 60.0])
def test_pair_errors_need_no_pairs(spark, noise):
    rng = np.random.default_rng(4)
    d = pd.DataFrame({"g": 1, "t": np.arange(30) // 2 - 4.0, "i": np.arange(30)})
    d["p"] = d.t + rng.uniform(-noise, noise, 30)
    got = J.pair_length_errors(spark.createDataFrame(d), ["g"], "t", "p", ["i"]).first()
    i, j = np.triu_indices(30, 1)
    e = np.abs(d.p.to_numpy()[j] - d.p.to_numpy()[i]) - np.abs(d.t.to_numpy()[j] - d.t.to_numpy()[i])
    assert got.pairs == len(e)
    assert (got.bias, got.mae, got.rmse) == pytest.approx((e.mean(), np.abs(e).mean(), np.sqrt((e * e).mean())))


def test_pair_errors_with_an_outlier_in_a_hot_group(spark):
    rng = np.random.default_rng(12)
    n = 700
    d = pd.DataFrame({"g": np.where(np.arange(n) < 600, 1, 2), "i": range(n), "t": rng.integers(0, 40, n) / 2.0 + 1000})
    d["p"] = d.t + rng.normal(0, 3, n)
    d.loc[17, "p"] += 1e5
    got = J.pair_length_errors(spark.createDataFrame(d), ["g"], "t", "p", ["i"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__b" not in plan.replace("__before", "")  # no join by buckets of rows
    for row in got.collect():
        own = d[d.g == row.g]
        i, j = np.triu_indices(len(own), 1)
        e = np.abs(own.p.to_numpy()[j] - own.p.to_numpy()[i]) - np.abs(own.t.to_numpy()[j] - own.t.to_numpy()[i])
        assert (row.pairs, row.bias, row.mae, row.rmse) == pytest.approx((len(e), e.mean(), np.abs(e).mean(), np.sqrt((e * e).mean())), rel=1e-6)


@pytest.mark.parametrize("at_once", [0, 64])
@pytest.mark.parametrize("noise", [0.2, 30.0])
def test_pair_errors_under_a_common_offset(spark, at_once, noise):
    """Offsets of a group must not cost digits, by pairs or by ranks."""
    rng = np.random.default_rng(8)
    d = pd.DataFrame({"g": 1, "t": np.arange(30) // 2 - 4.0, "i": np.arange(30)})
    d["p"] = d.t + rng.uniform(-noise, noise, 30).round(3) + 2.0**30
    got = J.pair_length_errors(spark.createDataFrame(d), ["g"], "t", "p", ["i"], at_once).first()
    i, j = np.triu_indices(30, 1)
    e = np.abs(d.p.to_numpy()[j] - d.p.to_numpy()[i]) - np.abs(d.t.to_numpy()[j] - d.t.to_numpy()[i])
    want = (e.mean(), np.abs(e).mean(), np.sqrt((e * e).mean()))
    assert (got.bias, got.mae, got.rmse) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("at_once", [0, 64])
def test_pair_errors_with_missing_values_and_keys(spark, at_once):
    """As in SQL: a pair without an error counts as a pair, and a row without a key is in none."""
    rows = [(1, 1.0, 2.0, 0), (1, None, 3.0, 1), (1, 4.0, 9.0, 2), (2, 1.0, None, 3), (2, 1.0, 1.0, 4), (None, 1.0, 1.0, 5), (None, 2.0, 1.0, 6)]
    d = spark.createDataFrame(rows, "g long, t double, p double, i long")
    got = {tuple(r) for r in J.pair_length_errors(d, ["g"], "t", "p", ["i"], at_once).collect()}
    assert got == {(1, 3, 4.0, 4.0, 4.0), (2, 1, None, None, None)}


def test_quantiles_of_short_series_are_sorted_in_one_row(spark):
    """Equal to the way by buckets, bit for bit, and without its windows where no group is large."""
    from seriesloom.operators.quantiles import quantile_columns

    rng = np.random.default_rng(21)
    g = [None, *[int(v) for v in rng.integers(0, 6, 299)]]
    rows = [(k, float(v)) for k, v in zip(g, rng.normal(0, 40, 300))] + [(7, None), (2, float("nan")), (0, None)]
    d = spark.createDataFrame(rows, "g long, v double")
    wide = lambda n: quantile_columns(d, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}, at_once=n)
    want = {tuple(r) for r in wide(0).collect()}
    assert len(want) == 7
    for at_once in (50, 1000):
        assert {tuple(r) for r in wide(at_once).collect()} == want
    assert "Window" not in wide(1000)._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_and_missing_keys_fail_whatever_is_read(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "u")], "k long, w string")
    with pytest.raises(Exception, match="repeated key"):
        J.one_to_one(b, a, ["k"]).count()
    with pytest.raises(Exception, match="no w for k"):
        J.enrich_or_fail(a, b, "k", ["w"]).count()


def test_rows_without_a_measurement_leave_the_filter_as_it_is(spark):
    from seriesloom.operators import particle as PF

    at = lambda days: (pd.Timestamp("2024-01-01") + pd.Timedelta(days=days)).to_pydatetime()
    rows = [(1, at(k), float(20 + 3 * k), k) for k in range(8)]
    gaps = [(1, at(3.5), None, 90), (1, at(5.5), float("nan"), 91)]
    schema = "u long, ts timestamp, v double, i long"
    run = lambda r: {x.i: x for x in PF.particle_filter(spark.createDataFrame(r, schema), "u", "ts", "v", ["i"]).collect()}
    plain, holes = run(rows), run(rows + gaps)
    assert all(holes[k].posterior_mean_cm is None for k in (90, 91))
    assert all(holes[k].posterior_mean_cm == plain[k].posterior_mean_cm for k in range(8))


def test_merged_quantiles_equal_the_whole_mixture():
    from seriesloom.operators import particle as PF

    state = PF.Particles("a", PF.FilterSettings())
    state.start(80.0, 14.0, 0, 3.0, 2.0)
    state.advance(2.0)
    state.reweight(95.0, 12.0, 0.08)
    for sd in (1.0, 9.0, 40.0):
        got = state.mixture_quantiles(sd, 0.08)
        assert state.mixture(got, sd, 0.08)[0] == pytest.approx(PF.PREDICTIVE_P, abs=2e-8)


def test_spaced_picks_are_greedy(spark):
    rng = np.random.default_rng(8)
    d = pd.DataFrame({"g": np.repeat([1, 2], 40), "x": rng.random(80), "c": rng.random(80), "i": range(80)})
    order = [(-F.col("c")).alias("o1"), F.col("i").alias("o2")]
    got = K.spaced_top_k(spark.createDataFrame(d), ["g"], "x", order, ["i"], 5, 0.12).toPandas()
    for g, rows in d.sort_values("c", ascending=False).groupby("g"):
        want = []
        for r in rows.itertuples():
            if len(want) < 5 and all(abs(r.x - w.x) >= 0.12 for w in want):
                want.append(r)
        assert list(got[got.g == g].sort_values("pick").i) == [w.i for w in want]


def test_token_match(spark):
    names = spark.createDataFrame([("a.cam1.x",), ("b.cam1_x",), ("c.cam1",), ("d.cam_2.z",)], "n string")
    ids = spark.createDataFrame([("cam1",), ("cam_2",), ("cam",)], "k string")
    got = {tuple(r) for r in J.token_match(names, ids, "n", "k").select("n", "k").collect()}
    assert got == {("a.cam1.x", "cam1"), ("b.cam1_x", "cam1"), ("d.cam_2.z", "cam_2"), ("d.cam_2.z", "cam")}


def test_redaction_and_patterns(spark):
    text = F.lit("see file://x and C:\\Users\\me <owner>\nme\n</owner>")
    found = one(spark, C.forbidden_matches(text, {"path": r"[A-Z]:\\Users\\", "file": "file://", "none": "zzz"}))
    assert [(f.label, f.match) for f in found] == [("path", "C:\\Users\\"), ("file", "file://")]
    assert one(spark, C.blank_elements(text, ["owner"])).endswith("<owner></owner>")


def test_results_round_trip(spark, tmp_path):
    path = str(tmp_path / "run")
    IO.write_results({"t": spark.range(3)}, path, {"a": 1}, {"in": "digest"}, ["w"], causal=True)
    meta = spark.read.parquet(f"{path}/run_metadata").first()
    assert meta.settings == '{"a": 1}' and meta.tables == ["t"] and meta.causal and meta.warnings == ["w"]


def test_manifest_streams_long_files(spark, tmp_path):
    bodies = {"empty.bin": b"", "a/short.bin": b"x" * 99, "a/edge.bin": b"y" * 100, "b c/long %41.bin": bytes(range(256)) * 70_000, "b c/other.txt": b"z"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    counts = spark.createDataFrame([("short.bin",), ("short.bin",)], "filename string")
    got = IO.file_manifest(spark, str(tmp_path), [".bin"], counts, whole=100).collect()
    want = {n.split("/")[-1]: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items() if b and n.endswith(".bin")}
    assert {r.filename: (r.length, r.sha256) for r in got} == want
    assert {r.filename: r.candidates for r in got} == {n: 2 * (n == "short.bin") for n in want}
    assert IO.file_manifest(spark, str(tmp_path), ["none"]).count() == 0


def test_manifest_of_a_file_above_two_gigabytes(spark, tmp_path):
    size, tail = (3 << 30) + 5, b"end"
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size - len(tail))
        f.seek(size - len(tail))
        f.write(tail)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for at in range(0, size - len(tail), len(zeros)):
        digest.update(zeros[: min(len(zeros), size - len(tail) - at)])
    digest.update(tail)
    row = IO.file_manifest(spark, str(tmp_path)).first()
    assert (row.filename, row.length, row.sha256) == ("sparse.bin", size, digest.hexdigest())


def test_annotations_are_compressed_and_divided_and_read_back(spark, tmp_path, monkeypatch):
    """Files of a limited number of images, small beside their text; names without the whole ending."""
    from seriesloom.sources import tables as S

    monkeypatch.setattr(S, "IMAGES_PER_FILE", 500)
    line = "struct('pole 1' AS _label, concat(id, ',1;', id, ',5') AS _points, CAST(NULL AS ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>) AS attribute)"
    images = spark.range(0, 2000, 1, 2).selectExpr("concat('i', id) AS _name", "640L AS _width", "480L AS _height", f"array({line}) AS polyline")
    S.write_annotations(images, str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("part-*"))
    assert len(files) == 4 and sum(f.stat().st_size for f in files) < 2000 * 30
    back = S.read_polylines(spark, str(tmp_path / "a")).toPandas()
    assert len(back) == 2000 and back.image_name.is_unique and set(back.polyline_length_px) == {4.0}
    assert {r + ".xml.gz" for r in back.row_id} == set(back.source_xml) == {f.name for f in files}
