import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cases import SCHEMA, awkward, clashing, documents, plain
from seriesloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference_ids(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]
    return np.array(ids, dtype="<u4")


def check(df, budget):
    rows = df.select("doc_id", "text").collect()
    wanted = sorted(
        (repr(r.doc_id), k // budget, k, len(ids[k : k + budget]), zlib.crc32(ids[k : k + budget].tobytes()))
        for r in rows
        for ids in [reference_ids(r.text)]
        for k in range(0, len(ids), budget)
    )
    got = plain(packing.pack_documents(df, PATH, budget))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= budget
    return len(bins), sum(r["length"] for r in got)


def test_ids_equal_the_tokenizer_on_hard_texts():
    texts = [
        "It's they're we've  I'm you'll he'd O'Neil's 'sam", "a.b,c...d.-e Wörter ÀÉ éa İstanbul ΑΣ ΣΑΣ.", "x y　z\x1cw",
        "<|endoftext|>a<|startoftext|>", "12 3.14 五六 漢字かな", "‍zwj \U0001f600!! ###***", "", "ß ﬁ ǅ Ångström,", "à.b", "l'été d'où",
    ]
    got = packing.WordIds(PATH).of([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert ids.tolist() == reference_ids(text)[:-1].tolist(), text


def test_pieces_and_places(spark):
    check(awkward(spark), 2048)
    check(clashing(awkward(spark), "piece", "bin", "group", "body", "sequence_id"), 64)


def test_few_sequences(spark):
    rng = random.Random(2)
    df = documents(spark, ["word " * rng.randrange(1, 700) for _ in range(400)])
    sequences, tokens = check(df, 2048)
    assert sequences <= 1.02 * tokens / 2048 + 1


def test_groups_do_not_waste(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    rng = random.Random(3)
    df = documents(spark, ["word " * rng.randrange(1, 900) for _ in range(300)])
    sequences, tokens = check(df, 2048)
    assert sequences <= 1.06 * tokens / 2048 + 1


def test_rule_places_where_squares_are_least():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 20, 60)
    bins, offsets = packing.sum_of_squares(sizes, 20)
    fills = defaultdict(int)

    def squares():
        count = defaultdict(int)
        for f in fills.values():
            count[20 - f] += f < 20
        return sum(c * c for c in count.values())

    for size, at, offset in zip(sizes, bins, offsets):
        best = []
        for b in [*fills, "new"]:
            if fills.get(b, 0) + size <= 20:
                fills[b] = fills.get(b, 0) + size
                best.append(squares())
                fills[b] -= size
                if b == "new":
                    del fills[b]
        assert fills.get(at, 0) == offset
        fills[at] += size
        assert squares() == min(best)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
