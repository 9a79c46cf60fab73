import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, k):
    good = [
        (i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int))
        for i, v in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q is None or q % 20:
            continue
        scored = []
        for i, b in good:
            if i != q:
                n = min(len(a), len(b))
                scored.append((-int(a[:n] @ b[:n]), i is not None, i or 0, i))
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def fast(df, k):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k).collect()), key=repr)


def table(seed, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 12))
    v = centres[rng.integers(0, 9, n)] + 0.15 * rng.normal(size=(n, 12))
    v[::17] = v[3]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (2080, [1.0, 2.0]), (None, [1.0] * 12), (2100, [])]
    return rows


@pytest.mark.parametrize("blocks", [(4096, 1024), (100, 13)])
def test_search_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "DATA_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rows = table(1)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for name in ("id", "asks", "vector", "block", "score"):
        df = df.withColumn(name, F.lit("own"))
    assert fast(df, 20) == slow(rows, 20)


def test_few_rows_and_empty(spark):
    rows = table(2, 9)
    assert fast(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), 20) == slow(rows, 20)
    assert fast(spark.createDataFrame([], SCHEMA), 20) == []


def test_trees_cover_and_prune():
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)] * 300 + rng.normal(size=(3000, 8)) * 4).round()
    root = topk.cover_tree(data, np.arange(3000), 0)

    def members(node):
        own = list(node.points)
        for c in node.children:
            own += members(c)
        far = np.sqrt(((data[own] - node.centre) ** 2).sum(axis=1)).max()
        assert far <= node.radius + 1e-9
        centres = [c.centre for c in node.children]
        for i, a in enumerate(centres):
            for b in centres[:i]:
                assert np.sqrt(((a - b) ** 2).sum()) > node.radius / 2
        return own

    assert sorted(members(root)) == list(range(3000)) and root.children
    search = topk.Search(data[:200], np.arange(200), data, np.arange(3000), 5)
    compared = []
    base = search.base
    search.base = lambda rows, cols: (compared.append(len(rows) * len(cols)), base(rows, cols))
    search.run()
    assert sum(compared) < 0.5 * 200 * 3000
