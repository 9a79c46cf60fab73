import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, awkward, clashing, documents, plain
from seriesloom.llm import exact_dedup, sharding


def body(text):
    return (text or "").encode()


def expected_marks(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[body(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = [i for i in groups[body(text)] if i is not None]
        keep = max(ids) if ids else None
        out.append((doc_id, keep, len(groups[body(text)]), doc_id == keep, hashlib.sha256(body(text)).hexdigest()))
    return sorted(out, key=repr)


def test_marks_equal_brute_force(spark):
    for df in (awkward(spark), clashing(awkward(spark), "keep_id", "sha", "hashed", "maybe", "kept")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted((tuple(r) for r in exact_dedup.marks(df).collect()), key=repr)
        assert got == expected_marks(rows)


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_filter_never_misses_a_repeat(spark, room):
    rows = spark.range(20000).select((F.col("id") % 17000).alias("v"))
    hashes = rows.select(F.xxhash64("v").alias("h"))
    found = exact_dedup.repeat_filter(hashes, "h", 20000, broadcast_bytes=room)
    assert found.broadcast == bool(room)
    seen = found.mark(rows.withColumn("h", F.xxhash64("v")), F.col("h"), "maybe")
    assert seen.count() == 20000
    assert seen.filter("v < 3000 and not maybe").count() == 0
    assert seen.filter("v >= 3000 and maybe").count() < 1400  # false positives of 16 bits a row


def test_distinct_rows_keep_all_columns(spark):
    df = clashing(awkward(spark), "__own", "keep_id")
    got = exact_dedup.distinct_rows(df)
    assert got.columns == df.columns
    texts = [body(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({body(r.text) for r in df.collect()})
    kept = {body(r.text): r.doc_id for r in got.collect()}
    assert kept[b"one two three four five six seven"] == 6 and kept[b""] == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.marks(empty).count() == 0
    assert exact_dedup.distinct_rows(empty).columns == empty.columns
    assert sharding.balanced_digest(empty, 8).count() == 0


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        need, load = 1, 0
        for s in sizes:
            if load + s > mid:
                need, load = need + 1, 0
            load += s
        low, high = (low, mid) if need <= shards else (mid + 1, high)
    return low


def test_shards_are_minimax_contiguous_and_whole(spark):
    texts = [("word " * (i * 7 % 53)) + str(i % 61) for i in range(700)] + ["hot"] * 300 + [None, ""]
    df = documents(spark, texts)
    got = plain(sharding.balanced_digest(df, 8))
    assert len(got) == len(texts)
    by_text = defaultdict(set)
    for r in got:
        text = texts[r["doc_id"]]
        by_text[body(text)].add(r["shard"])
        assert r["size"] == len(body(text)) + 1 and r["text_crc32"] == zlib.crc32(body(text))
    assert all(len(s) == 1 for s in by_text.values())
    groups = defaultdict(int)
    for r in got:
        groups[r["digest"]] += r["size"]
    order = sorted(groups, key=lambda d: (-groups[d].bit_length(), d))
    sizes = [groups[d] for d in order]
    loads = defaultdict(int)
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) == least_capacity(sizes, 8)
    where = {r["digest"]: r["shard"] for r in got}
    assert [where[d] for d in order] == sorted(where[d] for d in order)
    for k in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_shards_take_awkward_rows(spark):
    df = clashing(awkward(spark), "shard", "slot", "size", "id", "digest", "salt")
    got = plain(sharding.balanced_digest(df, 8))
    assert len(got) == df.count()
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
