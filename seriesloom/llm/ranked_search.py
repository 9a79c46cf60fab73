"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

The index holds, for each shard of some megabytes of whole texts, one row per term with the places and
counts of the documents that have it, and one row with the identifiers and lengths of the shard's
documents. Every document and every term is in it. A term's weight needs how many documents of the whole
table hold it, so weights and impacts are computed when items are searched.

In a shard the lists of an item's terms are ordered by impact and read from the top, some postings of
each list a round. A document's lower bound is the sum of what was read of it, its upper bound adds the
next impact of every list in which it was not met yet. Reading goes on until no document outside the best
``k`` can reach them, ties included, and the scores of all that remain are final: a list is read on only
while a remaining document may still be in it. A task carries each item's k-th score from shard to shard
as the bar to reach, and returns at most ``k`` rows of each item; these meet in one ranking.

Items are searched in blocks of some ``BLOCK_TERMS`` (item, term) pairs, which is what is broadcast.
Shards bound what a task holds, and a word found in every text is one list in each shard.

Defined cases: a null text has no term; documents and items without terms are not found and find
nothing; equal scores are ordered by identifier, a null one first; repeated documents are ranked each on
its own; items that share an identifier (null is one too) are one item with the terms of all its
texts; texts of any length are read whole; an empty table of either kind gives an empty table; columns
besides identifier and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, binary_parts, each_slice, partitions, utf8

SHARD_BYTES = 8 << 20
BLOCK_TERMS = 100_000
FIRST_READ = 64  # postings of each list in the first round; then twice as many each time

_WORD = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; whatever else parts terms.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256)).translate(
    bytes(b if b in _WORD else 32 for b in range(256))
)


def terms_of(body: bytes) -> list[bytes]:
    return body.translate(_FOLD).split()


INDEX = "shard long, term string, at array<int>, tf array<int>, df int, ids array<long>, lengths array<long>"
_INDEX = pa.schema(
    [("shard", pa.int64()), ("term", pa.string()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("df", pa.int32()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)
ROWS = 20_000  # of the index that leave a task at once


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the index; the row of a shard without a term tells its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in each_slice(batches, "body", SHARD_BYTES):
            ends, raw = binary_parts(batch.column("body"))
            split = [terms_of(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            flat = list(chain.from_iterable(split))
            words = sorted(set(flat))
            number = dict(zip(words, range(len(words))))
            ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            key, tf = np.unique(ids * len(split) + np.repeat(np.arange(len(split)), sizes), return_counts=True)
            at, tf = (key % len(split)).astype(np.int32), tf.astype(np.int32)
            starts = np.searchsorted(key, np.arange(len(words) + 1) * len(split)).astype(np.int32)
            none = pa.nulls(1, pa.list_(pa.int32()))
            lengths = pa.array([sizes], pa.list_(pa.int64()))
            own = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), none, none, pa.nulls(1, pa.int32()), own, lengths], schema=_INDEX)
            for i in range(0, len(words), ROWS):
                n = len(words[i : i + ROWS])
                cuts = starts[i : i + n + 1]
                part = slice(cuts[0], cuts[-1])
                lists = [pa.ListArray.from_arrays(pa.array(cuts - cuts[0]), pa.array(values[part])) for values in (at, tf)]
                empty = pa.nulls(n, pa.list_(pa.int64()))
                term = pa.array(words[i : i + n], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), term, *lists, pa.array(np.diff(cuts)), empty, empty], schema=_INDEX)
            shard += 1

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    return slim.mapInArrow(run, INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            for item, a, b in zip(batch.column("item").to_pylist(), ends[:-1], ends[1:]):
                found = pa.array(sorted(set(terms_of(raw[a:b].tobytes()))), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), found], names=["item", "term"])

    slim = items.select(F.col(id_col).cast("long").alias("item"), utf8(text_col).alias("body"))
    return slim.mapInArrow(run, "item long, term string").distinct()


def weight(count: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * holding + 1)))


@dataclass
class Lists:
    """Impact-sorted lists of one shard's postings by term number, read from the top."""

    impacts: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    count: int  # documents of the shard

    @classmethod
    def sort(cls, postings: dict[int, tuple[np.ndarray, np.ndarray]], weights: np.ndarray, m: np.ndarray) -> Lists:
        impacts, places = {}, {}
        for term, (at, tf) in postings.items():
            tf = tf.astype(np.int64)
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
            order = np.argsort(-value, kind="stable")
            impacts[term], places[term] = value[order], at[order]
        return cls(impacts, places, len(m))

    def best(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of all documents that may be among the best ``k`` and reach ``bar``; postings read."""
        held = [t for t in terms.tolist() if t in self.impacts]
        low = np.zeros(self.count, np.int64)
        met = np.zeros((len(held), self.count), bool)
        at = np.zeros(len(held), np.int64)  # read so far of each list
        front = np.array([self.impacts[t][0] for t in held], np.int64)
        wanted, step, bar = np.ones(len(held), bool), FIRST_READ, max(bar, 1)
        while True:
            if front.sum() < bar:  # whoever was not met yet stays outside
                high = low + front.sum() - front @ met
                left = np.flatnonzero(high >= bar)
                open_ = high[left] > low[left]
                if not open_.any():
                    return left, low[left], int(at.sum())
                wanted = (~met[:, left[open_]]).any(axis=1)
            for i in np.flatnonzero(wanted & (front > 0)):
                impacts, places = self.impacts[held[i]], self.places[held[i]]
                some = slice(at[i], at[i] + step)
                low[places[some]] += impacts[some]
                met[i, places[some]] = True
                at[i] = min(at[i] + step, len(impacts))
                front[i] = impacts[at[i]] if at[i] < len(impacts) else 0
            step *= 2
            if self.count > k:
                bar = max(bar, int(np.partition(low, -k)[-k]))


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item, rank, doc_id, score."""
    spark = index.sparkSession
    scratch = Scratch(spark, "ranked-search")
    pairs = scratch.write(item_terms(items, id_col, text_col))
    shards = index.filter(F.col("term").isNull())
    totals = shards.agg(
        F.sum(F.size(F.filter("lengths", lambda n: n > 0))), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))
    ).first()
    count, length = totals[0] or 0, totals[1] or 0
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        part = _search(index, shards, own, count, length, k) if length else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search(index: DataFrame, shards: DataFrame, pairs: DataFrame, count: int, length: int, k: int) -> DataFrame | None:
    """At most ``k`` candidates of each item and task."""
    spark = index.sparkSession
    # A block: some BLOCK_TERMS pairs and one item's terms.
    wanted: dict[int | None, list[str]] = {}
    for row in pairs.collect():
        wanted.setdefault(row["item"], []).append(row["term"])
    names = sorted({t for own in wanted.values() for t in own})
    if not names:
        return None
    number = {t: i for i, t in enumerate(names)}
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), "term string, number int"))
    held = index.join(numbers, "term")
    weights = np.zeros(len(names), np.int64)
    for row in held.groupBy("number").agg(F.sum("df").alias("df")).collect():
        weights[row["number"]] = weight(count, row["df"])
    ids = list(wanted)
    asked = [np.array([number[t] for t in wanted[i]], np.int64) for i in ids]
    shared = spark.sparkContext.broadcast((ids, asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, weights = shared.value
        best: list[list[tuple]] = [[] for _ in ids]
        bars = [1] * len(ids)

        def close(names: list, m: np.ndarray, postings: dict) -> None:
            lists = Lists.sort(postings, weights, m)
            for i, terms in enumerate(asked):
                places, scores, _ = lists.best(terms, k, bars[i])
                if len(places):
                    new = [(-s, names[p] is not None, names[p] or 0, names[p]) for p, s in zip(places.tolist(), scores.tolist())]
                    best[i] = sorted([*best[i], *new])[:k]
                    if len(best[i]) == k:
                        bars[i] = -best[i][-1][0]

        now, names, m, postings = None, [], np.zeros(0, np.int64), {}
        for batch in batches:
            number = batch.column("number").to_numpy()
            shard = batch.column("shard").to_numpy()
            at, tf = batch.column("at"), batch.column("tf")
            at_ends, at_all = at.offsets.to_numpy(), at.values.to_numpy()
            tf_ends, tf_all = tf.offsets.to_numpy(), tf.values.to_numpy()
            for r in range(len(batch)):
                if shard[r] != now:
                    if now is not None:
                        close(names, m, postings)
                    now, postings = shard[r], {}
                if number[r] < 0:  # a shard's documents come first
                    names = batch.column("ids")[r].as_py()
                    sizes = np.array(batch.column("lengths")[r].as_py(), np.int64)
                    m = 100 - 50 + (50 * sizes * count) // length
                else:
                    postings[int(number[r])] = at_all[at_ends[r] : at_ends[r + 1]].copy(), tf_all[tf_ends[r] : tf_ends[r + 1]].copy()
        if now is not None:
            close(names, m, postings)
        for item, rows in zip(ids, best):
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(rows), pa.int64()), pa.array([x[3] for x in rows], pa.int64()), pa.array([-x[0] for x in rows], pa.int64())],
                    names=["item", "doc_id", "score"],
                )

    columns = ["shard", "number", "at", "tf", "ids", "lengths"]
    rows = shards.withColumn("number", F.lit(-1)).select(columns).unionByName(held.select(columns))
    dealt = rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "number")
    return dealt.mapInArrow(run, "item long, doc_id long, score long")


def digest(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    index = Scratch(docs.sparkSession, "lexical-index").write(build_index(docs))
    return search(index, items, k).withColumnRenamed("item", "item_id")
