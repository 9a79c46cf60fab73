import math
import random
import re

import numpy as np
from cases import awkward, clashing, documents
from pyspark.sql import functions as F

from seriesloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    """Every document scored for every item."""
    split = [(r["doc_id"], TERM.findall((r["text"] or "").translate(UPPER))) for r in docs]
    wanted = {}
    for r in items:
        wanted.setdefault(r["item_id"], set()).update(TERM.findall((r["text"] or "").translate(UPPER)))
    count, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = {}
    for _, terms in split:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, terms in wanted.items():
        rows = []
        for doc_id, own in split:
            if not own:
                continue
            m = 50 + (50 * len(own) * count) // length
            score = 0
            for t in terms & set(own):
                tf = own.count(t)
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, n, r[3], -r[0]) for n, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [" ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60, 400]))) for _ in range(n)]


def benchmark(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_equals_brute_force_over_many_shards(spark):
    rng = random.Random(2)
    texts = corpus(rng, 500) + ["Same words w250 W7"] * 120  # ties across the border of the best
    docs = documents(spark, texts).repartition(7)
    items = benchmark(spark, [" ".join(rng.choices(texts[:400], k=1)) for _ in range(12)] + ["w250 w7", "unknown", "", None])
    assert got(ranked_search.digest(docs, items, 20)) == brute(docs.collect(), items.collect(), 20)


def test_lists_are_read_only_as_far_as_needed():
    rng = np.random.default_rng(3)
    count = 20_000
    postings = {t: (np.sort(rng.choice(count, 8_000, replace=False)), np.ones(8_000, np.int64)) for t in range(3)}
    for t in range(3):  # five documents stand out in all lists
        for p in range(5):
            at, tf = postings[t]
            if p not in at:
                at[p] = p
            tf[np.searchsorted(np.sort(at), p)] = 500
            postings[t] = np.sort(at), tf
    lists = ranked_search.Lists.sort(postings, np.array([900, 800, 700]), np.full(count, 100))
    places, scores, read = lists.best(np.arange(3), 5, 0)
    whole = np.zeros(count, np.int64)
    for t in range(3):
        whole[lists.places[t]] += lists.impacts[t]
    assert sorted(places.tolist()) == [0, 1, 2, 3, 4] and (whole[places] == scores).all()
    assert read < 3 * 8_000 / 10


def test_ties_with_the_last_place_are_all_returned_by_a_shard():
    postings = {0: (np.arange(3_000), np.ones(3_000, np.int64))}
    lists = ranked_search.Lists.sort(postings, np.array([1000]), np.full(3_000, 100))
    places, _, _ = lists.best(np.array([0]), 50, 0)
    assert len(places) == 3_000


def test_several_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    texts = corpus(rng, 80)
    docs, items = documents(spark, texts), benchmark(spark, rng.choices(texts, k=9))
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)
    assert got(ranked_search.digest(docs, items, 5)) == brute(docs.collect(), items.collect(), 5)


def test_awkward_rows_clashing_columns_and_repeated_items(spark):
    docs = clashing(awkward(spark), "shard", "term", "at", "ids", "number", "score")
    rows = [(1, "one two solo"), (1, "seven ALPHA"), (None, "negative 漢字 1234"), (3, None), (4, "b end"), (5, "alpha beta gamma delta")]
    items = clashing(spark.createDataFrame(rows, "item_id long, text string"), "item", "rank")
    assert got(ranked_search.digest(docs, items, 4)) == brute(docs.collect(), [dict(item_id=a, text=b) for a, b in rows], 4)


def test_hot_identifier(spark):
    docs = documents(spark, [f"common w{i % 9}" for i in range(300)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id")))
    items = benchmark(spark, ["w3 common", "w0"])
    assert got(ranked_search.digest(docs, items, 30)) == brute(docs.collect(), items.collect(), 30)


def test_empty_tables(spark):
    docs, items = documents(spark, ["a b"]), benchmark(spark, ["a"])
    none = ranked_search.digest(docs.filter("false"), items)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.collect() == []
    assert ranked_search.digest(docs, items.filter("false")).collect() == []
