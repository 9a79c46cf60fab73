import random

import numpy as np

from cases import SCHEMA, awkward, clashing, documents, plain
from seriesloom.llm import toxicity


def slow_kernel(s, t):
    """All triples of both strings, one by one."""
    import itertools

    def features(u):
        out = {}
        symbols = toxicity._symbols([u])[0].tolist()
        for i, j, k in itertools.combinations(range(len(u)), 3):
            key = (symbols[i], symbols[j], symbols[k])
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    a, b = features(s), features(t)
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    return dot / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5


def test_kernel_equals_brute_force():
    marks = toxicity.Landmarks(["idiot", "vejuté", "scum"])
    units = ["^idiot", "^idxiot", "^toidi", "^scum", "^vejutéon", "^scxum", "^aaaa"]
    numbers, rows = marks.kernel(units)
    for k, row in zip(numbers, rows):
        for j, word in enumerate(marks.words):
            if row[j]:
                assert abs(row[j] - slow_kernel(units[k], "^" + word)) < 1e-5
    got = dict(zip([units[k] for k in numbers], rows))
    assert got["^idiot"][0] > 0.999 and got["^idxiot"][0] > 0.4 and "^aaaa" not in got


def test_readings_of_a_token():
    assert toxicity.readings("You-Absolute-Idiot") == "youabsoluteidiot you absolute idiot"
    assert [toxicity.readings(x) for x in ("cl-own", "i.d.i.o.t", "12", "7idiot", "a-")] == ["clown own", "idiot", "", "idiot", "a"]


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeilnorstdhm") for _ in range(rng.randrange(3, 9))) for _ in range(500)]
    bad = ["idiot", "moron", "clown", "zugrotte", "zugrabla"]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        toxic.append(int(rng.random() < 0.25))
        if toxic[-1]:
            for _ in range(rng.randrange(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        for k in range(9, len(words), 10):
            words[k] += "."
        texts.append(" ".join(words))
    return texts, toxic


def test_held_out_accuracy_and_gapped_insults(spark):
    texts, toxic = corpus()
    extra = ["la lenno i d i o t ras m o r o n sitola. henna", "ratto idxiot lenna mor.on. ssira clo-wn rat"]
    extra += ["la lenno idiot/moron/clown sitola", "ratto lenna you-absolute-idiot, see moron...dorle", "", None, "12 !!"]
    df = clashing(documents(spark, texts + extra), "row", "score", "body")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in plain(toxicity.digest(df, labels))}
    assert len(rows) == len(texts) + 7
    held = [i for i in range(len(texts)) if rows[i]["held_out"]]
    assert len(held) > 90 and np.mean([rows[i]["predicted"] == toxic[i] for i in held]) > 0.97
    n = len(texts)
    assert [rows[n + k]["predicted"] for k in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    kept = toxicity.clean_rows(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r["score"] < 0.5}


def test_awkward_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = plain(toxicity.digest(awkward(spark), none))
    assert len(got) == awkward(spark).count() and all(r["predicted"] == 0 for r in got)
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (6, 0, 0), (8, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.digest(awkward(spark), labels).count() == awkward(spark).count()
    assert toxicity.digest(spark.createDataFrame([], SCHEMA), labels).count() == 0
