"""Awkward small tables that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and ties."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "漢字", "x" * 300]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, "  \n\t ", "en", None, 5),
        (4, long, "de", "s", len(long)),
        (5, "one two three four five six seven", "en", "s", 33),
        (6, "one two three four five six seven", "en", "t", 33),
        (7, "One two three four five six seven", None, "s", 33),
        (8, "solo", "en", "s", 4),
        (8, "solo", "en", "s", 4),
        (None, "no identifier here", "en", "s", 18),
        (-4, "negative identifier 1234 !!", "fr", "s", 27),
        (9, "a\x00b � \U0001f600 end", "en", "s", 11),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, *names):
    """The same rows with further columns named like results and helpers."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("own"))
    return df


def plain(df):
    return [r.asDict() for r in df.collect()]
