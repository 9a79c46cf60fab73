import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, awkward, clashing, documents, plain
from seriesloom.llm import language_model as lm
from seriesloom.llm.common import Scratch, utf8

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(200)]
    follow = {w: rng.sample(vocab, 4) for w in vocab}
    texts = []
    for _ in range(n):
        w, out = rng.choice(vocab), []
        for _ in range(rng.randrange(0, 120)):
            out.append(w if rng.random() > 0.05 else "R%d" % rng.randrange(3000))
            w = rng.choice(follow[w])
        texts.append(" ".join(out))
    return texts


@pytest.mark.parametrize("block", [24 << 20, 3000])
def test_counts_and_base_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    df = clashing(documents(spark, corpus(120)).unionByName(awkward(spark).filter("doc_id is null or doc_id < 0 or doc_id > 300")), "body", "block", "score")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (repr(i), held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x)), 6))
        for i, x in rows
    )
    got = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in plain(lm.digest(df)))
    assert got == want


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    texts = corpus()
    df = documents(spark, texts)
    scratch = Scratch(spark, "t")
    slim = df.select("doc_id", utf8("text").alias("body"))
    model, words, pairs = lm.fit(slim, scratch)
    size = model.symbols.size
    seen = {(r.u, r.w): r.p for r in pairs.collect()}
    everything = np.arange(size)
    for u in (lm.START, lm.RARE, 5, 17):
        p = model.unseen(np.full(size, u), everything)
        for w in range(size):
            p[w] = seen.get((u, w), p[w])
        assert abs(p.sum() - 1) < 1e-9
    rare = [r["count"] for r in words.collect() if r.key != lm.END_HASH and model.symbols.of(np.array([r.key]))[0] == lm.RARE]
    assert abs(model.rare(np.array(rare)).sum() + model.rare(np.array([0]))[0] - 1) < 1e-9
    out = [r for r in plain(lm.digest(df)) if r["held_out"]]
    assert np.mean([r["score"] for r in out]) > 0.8 * np.mean([r["base_score"] for r in out])


def test_scores_equal_a_plain_loop(spark):
    texts = corpus(60, 4)
    df = documents(spark, texts).select("doc_id", utf8("text").alias("body"))
    model, words, pairs = lm.fit(df, Scratch(spark, "t"))
    seen = {(r.u, r.w): r.p for r in pairs.collect()}
    count = {r.key: r["count"] for r in words.collect()}
    for row in lm.score(df, model, words, pairs).collect():
        total, before = 0.0, lm.START
        for t in tokens(texts[row.doc_id]):
            key = int(lm.word_hashes([t.encode()])[0]) if t is not None else None
            symbol = lm.END if t is None else int(model.symbols.of(np.array([key]))[0])
            total += math.log10(seen.get((before, symbol), model.unseen(np.array([before]), np.array([symbol]))[0]))
            if symbol == lm.RARE:
                total += math.log10(model.rare(np.array([count.get(key, 0)]))[0])
            before = symbol
        assert abs(total - row.score) < 1e-6


def test_seating_follows_the_restaurant():
    n = 4000
    got = lm.seat(np.full(n, 30), np.full(n, 0.1), np.full(n, 10), 1.0, 0.5, np.arange(n), 1)
    rng, slow = np.random.default_rng(1), []
    for _ in range(n):
        t = 1
        for present in range(1, 30):
            new = (1 + 0.5 * (10 + t)) * 0.1
            t += rng.random() < new / (new + present - 0.5 * t)
        slow.append(t)
    assert abs(got.mean() - np.mean(slow)) < 0.1 and abs(got.std() - np.std(slow)) < 0.1
    assert (lm.seat(np.array([0, 1, 2]), np.full(3, 0.1), np.zeros(3), 1.0, 0.5, np.arange(3), 1)[:2] == [0, 1]).all()


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.digest(empty).count() == 0
    only_held = documents(spark, ["a b"] * 40).filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
    got = plain(lm.digest(only_held))
    assert got and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)


def test_every_word_has_its_context_however_large_the_corpus(spark):
    # "key" is seen 40 times in 1.2 million tokens, 3e-5 of them, and always followed by "lock".
    rng = random.Random(8)
    common = ["c%d" % i for i in range(50)]
    texts = [" ".join(rng.choice(common) for _ in range(600)) for _ in range(2000)]
    texts = [t + f" key lock n{i} n{i}" if i % 50 == 0 else t for i, t in enumerate(texts)]
    df = documents(spark, texts).select("doc_id", utf8("text").alias("body"))
    model, words, pairs = lm.train(df, Scratch(spark, "t"))
    probes = documents(spark, ["key lock", "lock key"], 5000).select("doc_id", utf8("text").alias("body"))
    got = {r.doc_id: r.score for r in lm.score(probes, model, words, pairs).collect()}
    assert got[5000] > got[5001] + 2
    seen = {(r.before, r.after) for r in pairs.collect()}
    key, lock, n0 = (int(h) for h in lm.word_hashes([b"key", b"lock", b"n0"]))
    assert {(key, lock), (lock, n0), (n0, n0), (n0, lm.END_HASH)} <= seen and words.count() == 50 + 2 + 40 + 1


def test_hashes_of_stretches_are_those_of_words():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ABCabcxyz \t\n\x0b\x1f\xc3\xa4") for _ in range(rng.randrange(200))) for _ in range(500)]
    texts += [b"", b" ", b"a" * 31, b"b" * 32, b"c" * 100 + b" d", b"x", b"", b"A"]
    for of in (pa.array(texts, pa.binary()), pa.array([b"other", *texts, b"rest"], pa.binary()).slice(1, len(texts))):
        found, first = lm.encode(of)
        want, places = [], []
        for t in texts:
            places.append(len(want))
            want += [*lm.word_hashes(t.lower().split()), lm.END_HASH]
        assert found.tolist() == want and first.tolist() == places


@pytest.mark.parametrize("block", [24 << 20, 3000])
def test_digest_equals_scores_from_the_tables_of_words_and_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    df = documents(spark, [*corpus(100, 6), "", "only here", "only here too"])
    slim = df.select("doc_id", utf8("text").alias("body"))
    model, words, pairs = lm.train(slim.filter(F.pmod(lm.crc_of_id("doc_id"), F.lit(7)) != 2), Scratch(spark, "t"))
    want = {r.doc_id: r.score for r in lm.score(slim, model, words, pairs).collect()}
    got = {r.doc_id: r.score for r in lm.digest(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)


def test_pairs_do_not_travel_row_by_row(spark, monkeypatch):
    rows, write = [], Scratch.write

    def counted(self, df):
        out = write(self, df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    assert lm.digest(documents(spark, corpus(200, 7))).count() == 200
    assert rows and max(rows) < 100  # some thousand pairs, held by one part
    assert spark.conf.get("spark.sql.parquet.compression.codec") == before
