import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from cases import SCHEMA, awkward, clashing, documents, plain
from seriesloom.llm import simhash
from seriesloom.llm.common import Scratch
from seriesloom.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def slow_fingerprint(text, words=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not tokens:
        return 0
    runs = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    key = lambda i: (ids[i] is not None, ids[i] or 0)
    best = {}
    for i, c in enumerate(label):
        if c not in best or key(i) < key(best[c]):
            best[c] = i
    return [ids[best[c]] for c in label]


def near_copies(n, seed=1):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 4)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("band", [32_768, 50])
def test_digest_equals_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(simhash, "BAND", band)
    df = documents(spark, near_copies(120)).unionByName(awkward(spark).filter("doc_id is null or doc_id < 0 or doc_id > 3"))
    df = clashing(df, "fp", "node", "row", "band", "component_id")
    rows = df.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    labels = slow_components([r.doc_id for r in rows], fps, 2)
    want = sorted((repr(r.doc_id), f"{f:016x}", repr(c)) for r, f, c in zip(rows, fps, labels))
    got = sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in plain(simhash.digest(df)))
    assert got == want


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (900, 4), dtype=np.uint64)
    other = base[rng.integers(0, 900, 3000)].copy()
    for _ in range(20):
        other[np.arange(3000), rng.integers(0, 4, 3000)] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    for words, radius in ((1, 2), (1, 9), (4, 15), (4, 44)):
        got = {(int(a), int(b)) for x, y in simhash.close_pairs(base[:, :words], other[:, :words], radius) for a, b in zip(x, y)}
        dist = np.bitwise_count(base[:, None, :words] ^ other[None, :, :words]).sum(axis=2)
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(dist <= radius))}


def test_screened_pairs_are_those_close_on_both():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, (300, 8), dtype=np.uint64)
    b = a[rng.integers(0, 300, 900)].copy()
    for _ in range(60):
        b[np.arange(900), rng.integers(0, 8, 900)] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    got = {(int(x), int(y)) for i, j in simhash.close_pairs(a, b, 52, (4, 27)) for x, y in zip(i, j)}
    dist = np.bitwise_count(a[:, None] ^ b[None]).astype(int)
    want = (dist[..., :4].sum(axis=2) <= 27) & (dist.sum(axis=2) <= 52)
    assert got == {(int(x), int(y)) for x, y in zip(*np.nonzero(want))} and got


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    nodes = rng.sample(range(-(10**9), 10**9), 400)
    edges = [(nodes[i], nodes[i + 1]) for i in range(0, 150)] + [(nodes[200], nodes[i]) for i in range(201, 300)] + [(nodes[5], nodes[5])]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    chain, star = min(nodes[:151]), min(nodes[200:300])
    assert got == {**{n: chain for n in nodes[:151]}, **{n: star for n in nodes[200:300]}}


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(6)
    vocab = ["v%d" % i for i in range(3000)]
    texts, copies = [], set()
    for k in range(150):
        words = [rng.choice(vocab) for _ in range(300)]
        texts.append(" ".join(words))
        if k % 3 == 0:
            for _ in range(3):
                changed = list(words)
                changed[rng.randrange(300)] = "changed"
                changed[rng.randrange(300)] = "again"
                copies.add(len(texts))
                texts.append(" ".join(changed))
    df = clashing(documents(spark, texts), "row", "gone", "doc", "text_hash")
    got = simhash.distinct_rows(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == set(range(len(texts))) - copies


def test_empty_and_awkward(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.digest(empty).count() == 0 and simhash.distinct_rows(empty).count() == 0
    kept = {r.doc_id for r in simhash.distinct_rows(awkward(spark)).collect()}
    assert {1, 4, 5, 8, None, -4, 9} == kept


def shingles(text, words=5):
    tokens = text.split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def kept(spark, texts):
    return {r.doc_id for r in simhash.distinct_rows(documents(spark, texts)).collect()}


def test_repeated_lines_neither_link_nor_part(spark):
    rng = random.Random(11)
    vocab = ["v%d" % i for i in range(5000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    line = say(14)
    own = [say(300) + (" " + line) * 20 for _ in range(6)]
    x, y = say(200), say(200)
    assert jaccard(own[0], own[1]) < 0.1 and jaccard(x + " " + y, " ".join([x] * 5 + [y])) > 0.9
    texts = [*own, x + " " + y, " ".join([x] * 5 + [y])]
    assert kept(spark, texts) == set(range(7))


def test_pairs_around_the_similarity_are_decided_exactly(spark):
    rng = random.Random(12)
    vocab = ["v%d" % i for i in range(5000)]
    texts, gone, near = [], set(), []
    # 200 shingles; n new words at one end of the copy take n out of either set, so (200 - n) / (200 + n) are common.
    for new in [24, 23, 22, 20] * 40:
        base = [rng.choice(vocab) for _ in range(204)]
        texts += [" ".join(base), " ".join(base[:-new] + [rng.choice(vocab) for _ in range(new)])]
        near.append(round(jaccard(*texts[-2:]), 3))
        if jaccard(*texts[-2:]) >= 0.8:
            gone.add(len(texts) - 1)
    # Exactly 0.8, on four shingles of five and on 80 of 100.
    for size in [8] * 30 + [84] * 30:
        base = [rng.choice(vocab) for _ in range(size + size // 80 * 20 + (size == 8))]
        texts += [" ".join(base), " ".join(base[:size])]
        assert jaccard(*texts[-2:]) == 0.8
        gone.add(len(texts) - 1)
    assert min(near) < 0.79 and 0.8 <= max(near) < 0.83
    assert kept(spark, texts) == set(range(len(texts))) - gone


def test_pieces_decide_pairs_as_their_sets_do():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(120)]
    pdf = pd.DataFrame({"node": rng.permutation(120), "tree": 0, "low": 0, "high": 1, "band": rng.integers(0, 2, 120)})
    # Fingerprints are all close, so that the sets alone decide; labels of the last ten are one.
    pdf = pdf.assign(label=np.minimum(np.arange(120), 110), fp=[np.zeros(1, np.int64)] * 120, shingles=sets)
    found = simhash.links_of_piece(pdf, 0, None, 0.6)
    forest = simhash.Forest(120)
    forest.link(found["a"].to_numpy(), found["b"].to_numpy())
    plain = simhash.Forest(120)
    node = pdf["node"].to_numpy()
    for i in range(120):
        for j in range(i):
            one, two = set(sets[i]), set(sets[j])
            linked = pdf["band"][i] != pdf["band"][j] and len(one & two) >= 0.6 * len(one | two) - 1e-9
            if linked or min(i, j) >= 110:
                plain.link(node[[i]], node[[j]])
    everyone = np.arange(120)
    assert np.array_equal(forest.roots(everyone), plain.roots(everyone))
    assert 20 < len(set(plain.roots(everyone).tolist())) < 110


@pytest.mark.parametrize("band, rows, weight", [(32_768, 1024, 1 << 20), (60, 7, 1 << 20), (32_768, 1024, 2000)])
def test_groups_of_near_copies_equal_brute_force(spark, monkeypatch, band, rows, weight):
    monkeypatch.setattr(simhash, "BAND", band)
    monkeypatch.setattr(simhash, "MOST", 1)
    monkeypatch.setattr(simhash, "PIECE_ROWS", rows)
    monkeypatch.setattr(simhash, "PIECE_SHINGLES", weight)
    rng = random.Random(13)
    vocab = ["v%d" % i for i in range(5000)]
    texts = []
    for _ in range(4):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(50):
            copy = list(base)
            for _ in range(2):
                copy[rng.randrange(120)] = rng.choice(vocab)
            texts.append(" ".join(copy))
    label = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert 20 < len(set(label)) < 180
    assert kept(spark, texts) == set(label)
