import random

import numpy as np

from cases import SCHEMA, awkward, clashing, plain
from seriesloom.llm import language_id as li


def test_filter_names_every_language_that_holds_a_gram():
    texts = ["The other thing. And", "Der die Ärger das", "", "12 ,,", "ab", "a"]
    bodies = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    hashes, owner = li.gram_hashes(raw, ends, 4)
    want = []
    for k, t in enumerate(texts):
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        line = (" " + " ".join(letters.split()) + " ").ljust(4) if letters.split() else ""
        want += [(k, line[i : i + 4]) for i in range(len(line) - 3)]
    assert len(hashes) >= len(want) and set(owner.tolist()) == {k for k, _ in want}
    by_gram = {}
    for (k, g), h in zip(want[:5], hashes[:5].tolist()):
        by_gram.setdefault(g, h)
        assert by_gram[g] == h


def test_held_out_languages(spark):
    rng = random.Random(1)
    kinds = {"aa": ["mira", "sola", "tena", "vio"], "bb": ["krut", "schin", "balg", "ofen"], "cc": ["thwe", "ingly", "oudst", "ere"]}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(kinds))
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(words), lang if i % 7 else None, "s", 1, lang))
    df = spark.createDataFrame(rows, SCHEMA.add("truth", "string"))
    SCHEMA.fields.pop()
    SCHEMA.names.pop()
    got = {r["doc_id"]: r for r in plain(li.digest(df))}
    assert len(got) == 600
    assert np.mean([got[r[0]]["lang_pred"] == r[5] for r in rows if got[r[0]]["held_out"]]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    df = clashing(awkward(spark), "number", "key", "body", "score")
    got = plain(li.digest(df))
    assert len(got) == df.count()
    silent = {1, 2, 3}
    learned = {"en", "de", "fr"}
    assert all(r["lang_pred"] in learned for r in got if r["doc_id"] not in silent)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in silent)
    assert li.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_learning_rows_is_unknown(spark):
    from pyspark.sql import functions as F

    got = plain(li.digest(awkward(spark).withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in got} == {"und"}
