import hashlib
import random

import pytest

from cases import SCHEMA, awkward, clashing, documents, plain
from seriesloom.llm import suffix_dedup


def slow(rows, window=100):
    """Windows seen before, byte by byte, in order of identifier and place."""
    def key(r):
        return (r[0] is not None, r[0] or 0)

    seen, out = set(), []
    for doc_id, text in sorted(rows, key=key):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - window + 1):
            piece = body[s : s + window]
            if piece in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(piece)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(body)))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((repr(doc_id), len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fast(df):
    return sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in plain(suffix_dedup.removals(df)))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéo") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [say(rng.randrange(12, 60)) for _ in range(6)]
    texts = []
    for k in range(n):
        parts = [say(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, len(p) // 3)
            parts += [p[cut:], say(rng.randrange(0, 30))]
        texts.append(" ".join(parts) if k % 11 else "ab" * rng.randrange(40, 200))
    texts += [texts[3], texts[3], texts[7] + "!", "x" * 99, "x" * 100, "x" * 101, "y" * 350, None, ""]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_removals_equal_brute_force(spark, seed):
    texts = corpus(seed)
    df = clashing(documents(spark, texts).repartition(5), "row", "sub", "spans", "low", "bucket")
    assert fast(df) == slow(list(enumerate(texts)))


def test_hot_buckets_take_the_other_ways(spark, monkeypatch):
    texts = corpus(5, 260)
    monkeypatch.setattr(suffix_dedup, "LIMIT", 8)
    monkeypatch.setattr(suffix_dedup, "SPREAD", 3)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 400)
    assert fast(documents(spark, texts).repartition(7)) == slow(list(enumerate(texts)))


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert fast(awkward(spark)) == slow(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.removals(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).columns == empty.columns


def test_texts_keep_whole_characters_and_columns(spark):
    shared = "é" + "".join(chr(0x4E00 + 7 * i) + "ö" for i in range(60))
    texts = ["start " + shared + " end", "ä" + shared[1:] + "tail ß", None, "short"]
    df = clashing(documents(spark, texts), "row", "body")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df).collect()}
    assert suffix_dedup.without_repeats(df).columns == df.columns
    assert got[0].text == texts[0] and got[2].text is None and got[3].text == "short" and got[1].row == "own"
    assert len(got[1].text) < 20 and got[1].text.startswith("ä") and got[1].text.endswith("tail ß")


def test_many_texts_under_one_identifier(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = say(30)
    texts = [f"{k} " + say(rng.randrange(0, 40)) + shared * (k % 3) + say(5) for k in range(500)]
    df = spark.createDataFrame([(None, t, "en", "s", len(t)) for t in texts], SCHEMA)
    # Texts of one identifier come in order of their hashes.
    rows = sorted(((r.h, r.text) for r in df.selectExpr("xxhash64(cast(text as binary)) h", "text").collect()))
    assert fast(df) == slow([(None, text) for _, text in rows])
