import hashlib
import zlib

import numpy as np
import pytest
from cases import SCHEMA, awkward, clashing

from seriesloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def h(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def beside(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def brute(rows):
    """The contract, read off row by row."""
    rows = [r.asDict() for r in rows]
    for r in rows:
        head = (r["doc_id"], r["source"], r["lang"], r["n_chars"])
        text = r["text"]
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 0
        r["leaf"], r["offered"] = h(*head, text), h(*head, low if bad else text)
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        trees[lang] = own, grow([r["leaf"] for r in own])
    over = grow([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            path = beside(levels, at) + beside(over, k)
            folded = r["offered"]
            for a, b in path:
                folded = sha(a + folded + b)
            proof = sha("".join(a + b for a, b in path))
            out.append((r["doc_id"], r["leaf"], levels[-1][0], over[-1][0], proof, folded, folded == over[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 3, 5, 6])
def test_addresses_are_a_permutation_with_subtrees_in_one_piece(height):
    levels = [merkle.address(height, level, np.arange(8**level)) for level in range(height)]
    assert sorted(np.concatenate(levels)) == list(range(merkle.full(height)))
    assert levels[0][0] == 0
    if height > 1:
        below = height - height // 2
        roots = levels[height // 2]
        assert (np.diff(roots) == merkle.full(below)).all()  # lower halves follow each other
        last = levels[-1].reshape(len(roots), -1)
        assert (last.max(axis=1) < roots + merkle.full(below)).all() and (last.min(axis=1) >= roots).all()


def test_layers_cut_at_half_height():
    assert merkle.layers(5) == [5] and merkle.layers(7) == [4, 3]
    assert merkle.layers(7, 2) == [2, 2, 2, 1] and sum(merkle.layers(20)) == 20


def some(spark, n, langs=("en", "de", None)):
    rows = [(i, f"Text {i} Ä" if i % 7 else f"lower {i}", langs[(i * i) % len(langs)], None if i % 5 == 0 else "s", i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n,deep", [(1, 6), (9, 6), (150, 1), (700, 2), (700, 6)])
def test_equals_brute_force_whatever_the_blocks(spark, n, deep):
    docs = some(spark, n)
    assert got(merkle.digest(docs, deep)) == brute(docs.collect())


def test_more_groups_than_a_block(spark):
    docs = some(spark, 120, [f"l{k}" for k in range(90)])
    assert got(merkle.digest(docs, 2)) == brute(docs.collect())


def test_awkward_rows_and_clashing_columns(spark):
    docs = awkward(spark)
    mine = merkle.digest(clashing(docs, "leaf", "place", "tree", "group", "offered", "path", "digest"))
    assert got(mine) == brute(docs.collect())


def test_hot_identifier_and_repeated_rows_are_spread(spark):
    rows = [(7, "Same", "en", "s", 4)] * 300 + [(i, f"T {i}", "en", "s", 4) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(merkle.digest(docs, 2)) == brute(docs.collect())


def test_empty_table(spark):
    out = merkle.digest(some(spark, 3).filter("doc_id < 0"))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.collect() == []
