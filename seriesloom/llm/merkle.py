"""Merkle manifest of a table: eight-way hash trees stored in van Emde Boas order.

Every row is a leaf, the hash of its columns' values. The leaves of a group (here a language), in the
order of their identifiers, are hashed by runs of eight, level by level, up to the group's root; the
roots of the groups form one more tree whose root stands for the table.

A tree of many levels is cut at half its height, again and again, until a part has at most ``DEEP``
levels. Such a part is an aligned subtree, a block: one row of the manifest, its nodes in one binary
value in the same order (the upper half first, then the lower halves from left to right, each laid out
alike). ``address`` gives the place of a node in that order by arithmetic alone, so a block is built, and
later asked for siblings, without links or searches; ``base`` is the address of the block's root in the
whole tree. Blocks are built in rounds from the leaves up, each round from the roots of the blocks
below; siblings are handed down from the top block to its children in as many rounds.

No group or task holds more than 8 ** (``DEEP`` - 1) leaves; a language with a third of all rows is
many blocks. The driver holds the heights of the layers and the root.

Defined cases: a null value is written ``-``, any other its UTF-8 length, ``:`` and the value; null
languages and null identifiers come first; equal identifiers are ordered by their leaves, and repeated
rows are leaves of their own; a text of any length is hashed whole; an empty table gives empty tables
and no root; columns besides the hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, crc_of_id, partitions

FAN = 8
DEEP = 5
HEIGHTS = 22  # levels of the largest tree that 63-bit numbers can address


def full(height: int) -> int:
    """Nodes of a complete tree of ``height`` levels."""
    return (FAN**height - 1) // (FAN - 1)


def layers(height: int, deep: int = DEEP) -> list[int]:
    """Heights of the layers of blocks of a tree, from the leaves up."""
    if height <= deep:
        return [height]
    top = height // 2
    return layers(height - top, deep) + layers(top, deep)


def address(height: int, level: int, index: np.ndarray) -> np.ndarray:
    """Van Emde Boas places of nodes of one level (0: the root) of a complete tree of ``height`` levels."""
    index = np.asarray(index, dtype=np.int64)
    place = np.zeros(len(index), np.int64)
    while height > 1:
        top = height // 2
        if level < top:
            height = top
            continue
        level, height = level - top, height - top
        beneath = FAN**level
        place += full(top) + index // beneath * full(height)
        index = index % beneath
    return place


def joined(digests: list[bytes]) -> bytes:
    """Hash, as hex text, of hex digests written one after another."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def parents(digests: list[bytes]) -> list[bytes]:
    return [joined(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]


def written(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Binary SHA-256 of a row's values."""
    return F.unhex(F.sha2(F.concat(*map(written, values)).cast("binary"), 256))


def numbered(rows: DataFrame, key: str, order: list[str], scratch: Scratch) -> DataFrame:
    """Append ``place``, the gapless number (from 0) of a row within its key, nulls first in key and order.

    Rows are dealt by ranges of key and order, equal ones too, so no task's share depends on a key's size.
    """
    n = partitions(rows.sparkSession)
    salt = F.xxhash64(F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [key, *order, "__salt"]]
    ranged = rows.withColumn("__salt", salt).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__salt")
    ranged = scratch.write(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    # At most one row for each partition and each key.
    starts = ranged.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    out = ranged.join(starts, (F.col("__part") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")))
    place = F.col("__at") - F.col("__first") + F.col("__before")
    return out.select(*rows.columns, place.alias("place"))


def height_of(count: Column) -> Column:
    """Levels of the tree over ``count`` leaves."""
    powers = F.array(*[F.lit(FAN**k).cast("long") for k in range(HEIGHTS - 1)])
    return (F.size(F.filter(powers, lambda p: p < count)) + 1).cast("int")


class _Shape:
    """What a block of layer ``k`` is in a tree of ``height`` levels."""

    def __init__(self, height: int, k: int, deep: int):
        heights = layers(height, deep)
        self.height, self.levels = height, heights[k]
        self.depth = height - sum(heights[: k + 1])  # of the block's root, from the tree's
        self.inner = int(k > 0)  # one level more: the roots of the blocks below
        self.top = k == len(heights) - 1

    def base(self, roots: np.ndarray) -> np.ndarray:
        return address(self.height, self.depth, roots)

    def counts(self, inputs: int) -> list[int]:
        """Nodes of the block's own levels, the lowest first."""
        out = [inputs] if not self.inner else [-(-inputs // FAN)]
        while len(out) < self.levels:
            out.append(-(-out[-1] // FAN))
        return out

    def places(self, level: int, count: int) -> np.ndarray:
        """Addresses inside the block of the first ``count`` nodes of a level, 0 being the lowest."""
        return address(self.levels, self.levels - 1 - level, np.arange(count))


BLOCK = "tree long, height int, base long, root long, inputs int, nodes binary, below binary, digest binary, ids array<long>, offered binary"


def _raw(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(b"".join(digests).decode()), np.uint8).reshape(-1, 32)


def _hexes(raw: np.ndarray) -> list[bytes]:
    text = raw.tobytes().hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _maker(k: int, deep: int):
    """A function that makes the block of layer ``k`` out of its inputs."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        shape = _Shape(int(pdf["height"].iloc[0]), k, deep)
        inputs = [d.hex().encode() for d in pdf["digest"]]
        level = parents(inputs) if shape.inner else inputs
        nodes = np.zeros((full(shape.levels), 32), np.uint8)
        for j in range(shape.levels):
            level = parents(level) if j else level
            nodes[shape.places(j, len(level))] = _raw(level)
        first = pdf[["tree", "height", "root"]].iloc[:1].reset_index(drop=True)
        return first.assign(
            base=shape.base(first["root"].to_numpy()),
            inputs=len(inputs),
            nodes=[nodes.tobytes()],
            below=[_raw(inputs).tobytes() if shape.inner else b""],
            digest=[bytes.fromhex(level[0].decode())],
            ids=[None if shape.inner else [None if pd.isna(i) else int(i) for i in pdf["id"]]],
            offered=[b"" if shape.inner else b"".join(pdf["offered"])],
        )[[c.split()[0] for c in BLOCK.split(", ")]]

    return make


def build(leaves: DataFrame, scratch: Scratch, deep: int = DEEP) -> list[DataFrame]:
    """Layers of blocks, the lowest first, over leaves (tree, height, place, digest, id, offered).

    ``offered`` travels with a leaf: the digest that a reader claims for it.
    """
    tallest = leaves.agg(F.max("height")).first()[0]
    out: list[DataFrame] = []
    rows = leaves
    for k in range(len(layers(tallest, deep)) if tallest else 0):
        # A block's number is the place of its root in the root's level.
        shift = [3 * (layers(h, deep)[k] - (k == 0)) if k < len(layers(h, deep)) else 63 for h in range(1, HEIGHTS)]
        root = F.expr("shiftrightunsigned(place, shift)")
        with_root = rows.withColumn("shift", F.element_at(F.array(*map(F.lit, shift)), F.col("height"))).withColumn("root", root).drop("shift")

        made = scratch.write(with_root.groupBy("tree", "height", "root").applyInPandas(_maker(k, deep), BLOCK))
        out.append(made)
        more = F.element_at(F.array(*[F.lit(k + 1 < len(layers(h, deep))) for h in range(1, HEIGHTS)]), F.col("height"))
        rows = made.filter(more).select("tree", "height", F.col("root").alias("place"), "digest", F.lit(None).cast("long").alias("id"), F.lit(b"").alias("offered"))
    return out


def tops(blocks: list[DataFrame], deep: int = DEEP) -> DataFrame:
    """``tree``, ``height`` and ``digest`` of the root of every tree."""
    out = None
    for k, layer in enumerate(blocks):
        last = F.element_at(F.array(*[F.lit(k + 1 == len(layers(h, deep))) for h in range(1, HEIGHTS)]), F.col("height"))
        some = layer.filter(last).select("tree", "height", "digest")
        out = some if out is None else out.unionByName(some)
    return out


class _Opened:
    """A stored block with the siblings of its nodes."""

    def __init__(self, row: dict, k: int, deep: int):
        self.shape = shape = _Shape(row["height"], k, deep)
        counts = shape.counts(row["inputs"])
        nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32)
        own = [_hexes(nodes[shape.places(j, n)]) for j, n in enumerate(counts)]
        if shape.inner:
            own.insert(0, _hexes(np.frombuffer(row["below"], np.uint8).reshape(-1, 32)))
        self.levels = own
        path = row["path"]
        chain: list[tuple] = [tuple((a.encode(), b.encode()) for a, b in zip(path[0::2], path[1::2]))]
        for level in reversed(own[1:-1]):
            chain = [(self.beside(level, i), *chain[i // FAN]) for i in range(len(level))]
        self.chain = chain

    @staticmethod
    def beside(level: list[bytes], i: int) -> tuple[bytes, bytes]:
        run = i - i % FAN
        return b"".join(level[run:i]), b"".join(level[i + 1 : run + FAN])

    def path(self, i: int) -> tuple[tuple[bytes, bytes], ...]:
        """Siblings before and after, level by level from input ``i`` up to the root over all."""
        if len(self.levels) == 1:
            return self.chain[0]
        return (self.beside(self.levels[0], i), *self.chain[i // FAN])


def _flat(path: tuple[tuple[bytes, bytes], ...]) -> list[str]:
    return [side.decode() for pair in path for side in pair]


def fold(digest: bytes, path: tuple[tuple[bytes, bytes], ...]) -> bytes:
    """Root that follows from a leaf and its siblings."""
    for before, after in path:
        digest = hashlib.sha256(before + digest + after).hexdigest().encode()
    return digest


def _opened(batches: Iterator[pa.RecordBatch], k: int, deep: int) -> Iterator[tuple[dict, _Opened]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, _Opened(row, k, deep)


def paths(blocks: list[DataFrame], starts: DataFrame, scratch: Scratch, lowest: int, deep: int = DEEP) -> DataFrame:
    """Siblings of the inputs of layer ``lowest``: tree, base (that of the input's block, or a leaf's place), path.

    ``starts`` (tree, height, path) has for each tree the siblings of its root in what lies above.
    """
    handed = None
    for k in range(len(blocks) - 1, lowest - 1, -1):
        into = starts_of(starts, k, deep, handed)

        def hand_down(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for row, block in _opened(batches, k, deep):
                n, first = row["inputs"], row["root"] * FAN ** (block.shape.levels - 1 + block.shape.inner)
                at = first + np.arange(n)
                if k:
                    at = _Shape(row["height"], k - 1, deep).base(at)
                for i in range(0, n, 1000):
                    some = range(i, min(n, i + 1000))
                    found = [_flat(block.path(j)) for j in some]
                    tree = pa.array([row["tree"]] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([tree, pa.array(at[some.start : some.stop]), pa.array(found, pa.list_(pa.string()))], names=["tree", "base", "path"])

        both = blocks[k].select("tree", "height", "base", "root", "inputs", "nodes", "below").join(into, ["tree", "base"])
        handed = scratch.write(both.mapInArrow(hand_down, "tree long, base long, path array<string>"))
    return handed


def starts_of(starts: DataFrame, k: int, deep: int, handed: DataFrame | None) -> DataFrame:
    """Paths of the roots of layer ``k``: those of trees that end there, and those handed down."""
    last = F.element_at(F.array(*[F.lit(k + 1 == len(layers(h, deep))) for h in range(1, HEIGHTS)]), F.col("height"))
    own = starts.filter(last).select("tree", F.lit(0).cast("long").alias("base"), "path")
    return own if handed is None else own.unionByName(handed)


@dataclass
class Manifest:
    """Blocks of the trees of all groups, blocks of the tree over their roots, and the root over all."""

    blocks: list[DataFrame]
    over: list[DataFrame]
    groups: DataFrame  # group, tree, height, digest (its root)
    root: str | None
    deep: int
    scratch: Scratch

    def proofs(self) -> DataFrame:
        """One row per leaf: doc_id, leaf, subroot, siblings, folded.

        ``siblings`` holds, level by level, the digests before and after; ``folded`` is the root that
        follows from the offered leaf and these siblings.
        """
        spark, deep = self.groups.sparkSession, self.deep
        schema = "doc_id long, tree long, leaf string, siblings array<string>, folded string"
        if self.root is None:
            return spark.createDataFrame([], schema).select("doc_id", "leaf", F.lit("").alias("subroot"), "siblings", "folded")
        height = self.over[0].select("height").first()[0]
        above = spark.createDataFrame([(0, height, [])], "tree long, height int, path array<string>")
        # The leaves of the upper tree are the groups, by place.
        below = paths(self.over, above, self.scratch, 0, deep).select(F.col("base").alias("tree"), "path")
        starts = self.scratch.write(self.groups.join(below, "tree").select("tree", "height", "path"))
        handed = paths(self.blocks, starts, self.scratch, 1, deep)
        into = starts_of(starts, 0, deep, handed)

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, block in _opened(batches, 0, deep):
                offered = _hexes(np.frombuffer(row["offered"], np.uint8).reshape(-1, 32))
                for i in range(0, row["inputs"], 1000):
                    some = range(i, min(row["inputs"], i + 1000))
                    path = [block.path(j) for j in some]
                    columns = [
                        pa.array(row["ids"][some.start : some.stop], pa.int64()),
                        pa.array([row["tree"]] * len(some), pa.int64()),
                        pa.array([block.levels[0][j].decode() for j in some]),
                        pa.array([_flat(p) for p in path], pa.list_(pa.string())),
                        pa.array([fold(offered[j], p).decode() for j, p in zip(some, path)]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tree", "leaf", "siblings", "folded"])

        held = self.blocks[0].select("tree", "height", "base", "root", "inputs", "nodes", "below", "ids", "offered")
        found = held.join(into, ["tree", "base"]).mapInArrow(prove, schema)
        subroot = self.groups.select("tree", F.lower(F.hex("digest")).alias("subroot"))
        return found.join(subroot, "tree").select("doc_id", "leaf", "subroot", "siblings", "folded")


def manifest(leaves: DataFrame, deep: int = DEEP) -> Manifest:
    """Trees over leaves (group, doc_id, leaf, offered): one for each group, and one over their roots."""
    scratch = Scratch(leaves.sparkSession, "merkle")
    leaves = scratch.write(leaves.select("group", "doc_id", "leaf", "offered"))
    placed = numbered(leaves, "group", ["doc_id", "leaf"], scratch)
    sizes = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    groups = scratch.write(numbered(sizes, "all", ["group"], scratch).select("group", F.col("place").alias("tree"), height_of(F.col("n")).alias("height")))
    sides = groups.select(F.col("group").alias("__group"), "tree", "height")
    placed = placed.join(sides, F.col("group").eqNullSafe(F.col("__group")))
    blocks = build(placed.select("tree", "height", "place", F.col("leaf").alias("digest"), F.col("doc_id").alias("id"), "offered"), scratch, deep)
    if not blocks:
        empty = groups.withColumn("digest", F.lit(b""))
        return Manifest([], [], empty, None, deep, scratch)
    groups = scratch.write(groups.join(tops(blocks, deep).select("tree", "digest"), "tree"))
    upper = groups.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(None).cast("long").alias("id"), F.col("digest").alias("offered"))
    upper = upper.withColumn("height", height_of(F.lit(groups.count())))
    over = build(upper.select("tree", "height", "place", "digest", "id", "offered"), scratch, deep)
    root = bytes(tops(over, deep).first()["digest"]).hex()
    return Manifest(blocks, over, groups, root, deep, scratch)


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_leaves(docs: DataFrame, changed: Column, change=tampered) -> DataFrame:
    """Leaves of the documents, and what is offered for them: rows where ``changed`` holds have their text altered."""
    names = ["doc_id", "source", "lang", "n_chars"]
    given = leaf_of(*map(F.col, names), F.col("text"))
    offered = F.when(changed, leaf_of(*map(F.col, names), change(F.col("text")))).otherwise(F.col("leaf"))
    rows = docs.select(*names, "text", given.alias("leaf"))
    return rows.select(F.col("lang").cast("string").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", offered.alias("offered"))


def digest(docs: DataFrame, deep: int = DEEP) -> DataFrame:
    """One row per document: leaf, subroot, root and siblings of the table, and whether the text offered for it belongs to it."""
    changed = F.pmod(crc_of_id("doc_id"), F.lit(3)) == 0
    found = manifest(document_leaves(docs, changed), deep)
    return found.proofs().select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(found.root).cast("string").alias("root"),
        F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.lit(found.root)).alias("verified"),
    )
