"""SimHash near-duplicate detection by tiled exact comparison.

Every document gets a fingerprint: a bit is set where over half of its shingle hashes have it set.
Equal fingerprints form a class. Classes are dealt over bands by a hash, and every pair of bands
meets in one cell, so each pair of classes is compared exactly, in one place. Inside a cell both
sides are ordered by the bit counts of their blocks and cut into tiles; a pair of tiles is skipped
when the counts alone put it beyond the radius, and the others are compared by exclusive-or and bit
counts. A cell returns a spanning forest of its links, so a group of thousands of near copies costs as
many rows as it has members, and no link between different texts is lost to the components.

Where a similarity is asked for, distinct shingles vote, texts with equal shingle sets form a class, and
fingerprints only propose: pairs close on the first ``SCREEN`` bits and then on all, both ``SPREAD``
deviations wide, are confirmed by the exact Jaccard similarity of their shingle sets. Cells propose
``MOST`` pairs of each class, which are joined with their sets. Further pairs only matter where their classes
are not yet in one component: those classes are dealt in pieces of their own, by trees of waiting pairs, and
take their shingle sets along, so all of their close pairs are decided inside a task and never become rows.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle of what there is; repeated rows are in one class; a null identifier
is below every other and gives a null component; an empty table gives an empty table.
The number of compared pairs grows with the square of the number of classes: that is this method.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, binary_parts, each_slice, mix, utf8
from seriesloom.llm.components import components

COPIES = 4  # of all rows that are dealt over cells at once
BAND = 32_768  # classes in a band, on average: bounds what one cell holds
TILE_ROWS, TILE_COLS = 128, 2048
SCREEN, SPREAD = 128, 5.0  # bits compared first for a similarity, and deviations allowed in all comparisons
MOST = 3  # pairs of a class that are joined with their sets
PIECE_ROWS, PIECE_SHINGLES = 1024, 1 << 20  # classes and shingles, on average, of a piece that brings its sets


def reach_of(similarity: float, bits: int) -> int:
    """Bits in which pairs of at least the similarity differ at most, ``SPREAD`` deviations allowed.

    Very small sets differ in more bits than large ones, as ties count as no majority: four shingles of
    five in 3/16 of them, two of three in a quarter.
    """
    share = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 3 / 16 if similarity >= 0.75 else 1 / 4)
    return int(bits * share + SPREAD * math.sqrt(bits * share * (1 - share)))


def shingle_hashes(body: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, in order, repeats included."""
    import xxhash

    tokens = body.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    n = max(1, len(tokens) - words + 1)
    ends = (starts + lengths)[len(tokens) - n :]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())]
    return np.array(found, dtype=np.uint64)


def fingerprint(hashes: np.ndarray, bits: int) -> list[int]:
    """Majority bits as unsigned 64-bit words; further words vote with remixed hashes."""
    out = []
    for word in range(bits // 64):
        votes = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 100_000):
            some = hashes[i : i + 100_000]
            some = some if word == 0 else mix(some + mix(np.array([word])))
            votes += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, words: int, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp (array of 64-bit words), node.

    With ``distinct`` repeated shingles vote once and ``node`` names the shingle set, else the fingerprint.
    """
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.list_(pa.int64())), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            found, names = [], []
            for a, b in zip(ends[:-1], ends[1:]):
                hashes = shingle_hashes(raw[a:b].tobytes(), words)
                hashes = np.unique(hashes) if distinct else hashes
                names.append(xxhash.xxh64_intdigest(hashes.tobytes()) if distinct else 0)
                found.append(fingerprint(hashes, bits))
            signed = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, bits // 64)
            node = pa.array(np.array(names, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(signed.tolist(), pa.list_(pa.int64())), node], schema=schema
            )

    body = utf8(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    out = slim.mapInArrow(run, "doc_id long, text_hash long, fp array<long>, node long")
    return out if distinct else out.withColumn("node", F.col("fp")[0] if bits == 64 else F.xxhash64("fp"))


def shingle_sets(bodies: DataFrame, words: int) -> DataFrame:
    """``node`` and its distinct shingle hashes, of rows with ``node`` and ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_slice(batches, "body"):
            ends, raw = binary_parts(batch.column("body"))
            found = [np.unique(shingle_hashes(raw[a:b].tobytes(), words)).view(np.int64) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return bodies.select("node", "body").mapInArrow(run, "node long, shingles array<long>")


class Forest:
    """Union-find over 0..n-1 that takes links in bulk; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        at = self.parent[nodes]
        while True:
            up = self.parent[at]
            if np.array_equal(up, at):
                return at
            at = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            self.parent[np.maximum(ra, rb)] = np.minimum(ra, rb)
            self.parent = self.roots(np.arange(len(self.parent))) if len(a) else self.parent


def _blocks(fps: np.ndarray, radius: int) -> np.ndarray:
    """Bit counts of the blocks of each fingerprint: 16-bit blocks for small radii, else 64-bit."""
    if radius < 16:
        fps = fps.astype("<u8").view("<u2").reshape(len(fps), -1)
    return np.bitwise_count(fps).astype(np.int16)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, screen: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, tile by tile, skipping tiles that bit counts put too far apart.

    With ``screen`` (words, radius) only pairs that are that close on their first words are compared whole.
    """
    if not len(left) or not len(right):
        return
    words, first = screen or (left.shape[1], radius)
    counts_l, counts_r = _blocks(left[:, :words], first), _blocks(right[:, :words], first)
    order_l, order_r = np.lexsort(counts_l.T[::-1]), np.lexsort(counts_r.T[::-1])
    left, right, counts_l, counts_r = left[order_l], right[order_r], counts_l[order_l], counts_r[order_r]
    columns = np.ascontiguousarray(right[:, : min(2, words)].T)
    cut_l, cut_r = np.arange(0, len(left), TILE_ROWS), np.arange(0, len(right), TILE_COLS)
    low_r, high_r = np.minimum.reduceat(counts_r, cut_r), np.maximum.reduceat(counts_r, cut_r)
    for i in cut_l:
        rows, own = left[i : i + TILE_ROWS], counts_l[i : i + TILE_ROWS]
        low, high = own.min(axis=0), own.max(axis=0)
        apart = np.maximum(0, np.maximum(low_r - high, low - high_r)).sum(axis=1)
        for j in cut_r[apart <= first]:
            near = np.bitwise_count(rows[:, None, 0] ^ columns[0, j : j + TILE_COLS])
            for w in range(1, len(columns)):
                near += np.bitwise_count(rows[:, None, w] ^ columns[w, j : j + TILE_COLS])
            a, b = np.nonzero(near <= first)
            # The remaining words only where the first leave room.
            for upto, most in ((words, first), (left.shape[1], radius)):
                if upto > 2 and len(a):
                    keep = [
                        np.bitwise_count(rows[a[k : k + 50_000], :upto] ^ right[j + b[k : k + 50_000], :upto]).sum(axis=1) <= most
                        for k in range(0, len(a), 50_000)
                    ]
                    a, b = a[np.concatenate(keep)], b[np.concatenate(keep)]
            if len(a):
                yield order_l[i + a], order_r[j + b]


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a cell and the rows of its two bands."""
    fps = np.array(pdf["fp"].tolist(), dtype=np.int64).view(np.uint64).reshape(len(pdf), -1)
    sides, low, high = pdf["band"].to_numpy(), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    one = np.flatnonzero(sides == low)
    return fps, one, one if low == high else np.flatnonzero(sides == high)


def links_of_cell(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning forest, as node pairs, of the links between the two bands of a cell."""
    pdf = pdf.sort_values("node", kind="stable")
    fps, one, two = _sides(pdf)
    nodes, forest = pdf["node"].to_numpy(), Forest(len(pdf))
    for a, b in close_pairs(fps[one], fps[two], radius):
        forest.link(one[a], two[b])
    roots = forest.roots(np.arange(len(pdf)))
    moved = np.flatnonzero(roots != np.arange(len(pdf)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[roots[moved]]})


def proposals_of_cell(pdf: pd.DataFrame, radius: int, screen: tuple[int, int] | None, most: int) -> pd.DataFrame:
    """Close pairs of different labels, ``most`` of each label at least, and a spanning forest of those that wait."""
    pdf = pdf.sort_values("node", kind="stable")
    fps, one, two = _sides(pdf)
    nodes, forest = pdf["node"].to_numpy(), Forest(len(pdf))
    label = pd.factorize(pdf["label"])[0]
    given = np.zeros(label.max() + 1, np.int64)

    def rank(of: np.ndarray) -> np.ndarray:
        order = np.argsort(of, kind="stable")
        out = np.empty(len(of), np.int64)
        out[order] = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        return out + given[of]

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in close_pairs(fps[one], fps[two], radius, screen):
        a, b = one[a], two[b]
        new = label[a] != label[b]
        if one is two:
            new &= a < b  # each pair comes both ways
        a, b = a[new], b[new]
        early = (given[label[a]] < most) | (given[label[b]] < most)
        forest.link(a[~early], b[~early])
        a, b = a[early], b[early]
        early = (rank(label[a]) < most) | (rank(label[b]) < most)
        forest.link(a[~early], b[~early])
        a, b = a[early], b[early]
        given += np.bincount(label[a], minlength=len(given)) + np.bincount(label[b], minlength=len(given))
        left.append(a)
        right.append(b)
    roots = forest.roots(np.arange(len(pdf)))
    waits = np.flatnonzero(roots != np.arange(len(pdf)))
    left, right = np.concatenate(left), np.concatenate(right)
    out = pd.DataFrame({"a": nodes[np.append(left, waits)], "b": nodes[np.append(right, roots[waits])], "waits": np.arange(len(left) + len(waits)) >= len(left)})
    return out.assign(low=pdf["low"].iloc[0], high=pdf["high"].iloc[0])


def _stripes(bands: int) -> list[tuple[int, int]]:
    """Ranges of lower bands whose cells hold about ``COPIES`` times all rows together."""
    out, start, held = [], 0, 0
    for low in range(bands):
        held += 2 * (bands - low) - 1  # bands in the cells of this one
        if held >= COPIES * bands or low == bands - 1:
            out.append((start, low + 1))
            start, held = low + 1, 0
    return out


def _cells(classes: DataFrame) -> Iterator[DataFrame]:
    """Rows of ``classes`` (node and more) once for every cell of two bands, some cells at a time.

    All cells together hold every row once for each band, which grows with the square of the rows; a table of cells
    holds it a fixed number of times.
    """
    bands = max(1, -(-classes.count() // BAND))
    banded = classes.withColumn("band", F.pmod(F.xxhash64("node"), F.lit(bands)).cast("int"))
    for first, last in _stripes(bands):
        # Cells (low, high) with low in the stripe: a row is the upper one of all lower bands in it, and the lower one of all above.
        lower = F.sequence(F.lit(first), F.least(F.col("band"), F.lit(last - 1)))
        upper = F.when(F.col("band").between(first, last - 1), F.sequence(F.col("band"), F.lit(bands - 1))).otherwise(F.array().cast("array<int>"))
        cells = banded.filter(F.col("band") >= first).withColumn("other", F.explode(F.array_union(lower, upper)))
        cells = cells.withColumn("low", F.least("band", "other")).withColumn("high", F.greatest("band", "other")).drop("other")
        # The number is given: cells are small to move and costly to compare, so none are merged.
        yield cells.repartition(sum(bands - low for low in range(first, last)), "low", "high")


def _of_cells(classes: DataFrame, compare: Callable[[pd.DataFrame], pd.DataFrame], kind: str, scratch: Scratch) -> DataFrame:
    """What ``compare`` gives for every cell; cells are gone before the next ones are made."""
    return reduce(DataFrame.unionByName, [scratch.write(c.groupBy("low", "high").applyInPandas(compare, kind)) for c in _cells(classes)])


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have at least the Jaccard similarity."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    common = F.size(F.array_intersect("one", "two"))
    both = both.select("a", "b", common.alias("common"), (F.size("one") + F.size("two")).alias("sizes"))
    return both.filter(F.col("common") >= similarity * (F.col("sizes") - F.col("common")) - 1e-9).select("a", "b")


def links_of_piece(pdf: pd.DataFrame, radius: int, screen: tuple[int, int] | None, similarity: float) -> pd.DataFrame:
    """Spanning forest of the pairs of a cell that are close and have the Jaccard similarity; equal labels are linked already."""
    pdf = pdf.sort_values("node", kind="stable")
    fps, one, two = _sides(pdf)
    nodes, forest = pdf["node"].to_numpy(), Forest(len(pdf))
    label, first = np.unique(pdf["label"].to_numpy(), return_index=True)
    forest.link(np.arange(len(pdf)), first[np.searchsorted(label, pdf["label"])])
    sizes = pdf["shingles"].map(len).to_numpy()
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(pdf["shingles"].tolist()), return_inverse=True)[1]
    mark = np.zeros(len(ids), bool)
    for a, b in close_pairs(fps[one], fps[two], radius, screen):
        a, b = one[a], two[b]
        open_ = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
        open_ &= forest.roots(a) != forest.roots(b)
        if one is two:
            open_ &= a < b  # each pair comes both ways
        a, b = a[open_], b[open_]
        order = np.argsort(a, kind="stable")
        rows, cuts = np.unique(a[order], return_index=True)
        for row, others in zip(rows, np.split(b[order], cuts[1:])):
            others = others[forest.roots(others) != forest.roots(row)]
            if not len(others):
                continue
            mark[ids[starts[row] : starts[row] + sizes[row]]] = True
            ends = np.cumsum(sizes[others])
            at = np.repeat(starts[others] - ends + sizes[others], sizes[others]) + np.arange(ends[-1])
            seen = np.concatenate([[0], np.cumsum(mark[ids[at]])])
            common = seen[ends] - seen[ends - sizes[others]]
            mark[ids[starts[row] : starts[row] + sizes[row]]] = False
            alike = others[common >= similarity * (sizes[row] + sizes[others] - common) - 1e-9]
            forest.link(np.full(len(alike), row), alike)
    roots = forest.roots(np.arange(len(pdf)))
    moved = np.flatnonzero(roots != np.arange(len(pdf)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[roots[moved]]})


def links_by_pieces(near: DataFrame, radius: int, screen: tuple[int, int] | None, similarity: float) -> DataFrame:
    """Links (a, b) among ``near`` (node, tree, label, fp, shingles) that hold each tree of it together.

    A tree is cut in pieces by count and by shingles, and every two of its pieces meet in one cell.
    """
    share = F.greatest(F.count("*") / PIECE_ROWS, F.sum(F.size("shingles")) / PIECE_SHINGLES)
    trees = near.groupBy("tree").agg(share.alias("share")).withColumn("pieces", F.greatest(F.ceil("share"), F.lit(1)).cast("int"))
    whole = trees.agg(F.sum(F.when(F.col("pieces") > 1, F.col("pieces") * (F.col("pieces") + 1) / 2).otherwise(F.col("share")))).first()[0]
    banded = near.join(trees, "tree").withColumn("band", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    cells = banded.withColumn("other", other).withColumn("low", F.least("band", "other")).withColumn("high", F.greatest("band", "other"))
    cells = cells.select("tree", "low", "high", "band", "node", "label", "fp", "shingles").repartition(16 + 2 * math.ceil(whole or 0), "tree", "low", "high")
    return cells.groupBy("tree", "low", "high").applyInPandas(lambda pdf: links_of_piece(pdf, radius, screen, similarity), "a long, b long")


def similar_roots(docs: DataFrame, classes: DataFrame, words: int, bits: int, similarity: float, text_col: str, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` of the classes linked by their exact similarity; classes alone may be absent."""
    reach = reach_of(similarity, bits)
    screen = (SCREEN // 64, reach_of(similarity, SCREEN)) if bits > SCREEN else None
    body = utf8(text_col)
    texts = docs.select(F.xxhash64(body).alias("text_hash"), body.alias("body"))
    named = classes.select("node", F.col("first.text_hash").alias("text_hash"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        return shingle_sets(texts.join(named.join(nodes, "node"), "text_hash").dropDuplicates(["node"]), words)

    kind = "a long, b long, waits boolean, low int, high int"
    found = _of_cells(classes.select("node", "fp", F.col("node").alias("label")), lambda pdf: proposals_of_cell(pdf, reach, screen, MOST), kind, scratch)
    pairs, waiting = found.filter("not waits"), found.filter("waits")
    sets = scratch.write(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    links = scratch.write(similar_pairs(pairs, sets, similarity))
    scratch.drop(sets)
    roots = scratch.write(components(links, scratch))
    # A tree of waiting pairs is settled when it lies in one component.
    ended = waiting
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        ended = ended.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    unsettled = ended.filter("root_a <> root_b").select("low", "high", "b").distinct()
    edges = scratch.write(waiting.join(unsettled, ["low", "high", "b"]).select("a", "b"))
    if edges.isEmpty():
        return roots
    # Trees of different cells that share a class are one tree.
    trees = scratch.write(components(edges, scratch).withColumnRenamed("root", "tree"))
    near = classes.select("node", "fp").join(trees, "node").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    near = scratch.write(near.drop("root").join(sets_of(trees.select("node")), "node"))
    links = scratch.write(links.unionByName(links_by_pieces(near, reach, screen, similarity)))
    scratch.drop(near)
    return scratch.write(components(links, scratch))


def groups(docs: DataFrame, words: int = 5, bits: int = 2048, radius: int | None = None, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, component_id, keep_hash.

    ``component_id`` is the smallest identifier reachable over links, and ``keep_hash`` the hash of
    the text that has it. Without ``radius`` pairs of at least the Jaccard ``similarity`` are linked.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    found = scratch.write(fingerprints(docs, words, bits, id_col, text_col, distinct=radius is None))
    classes = scratch.write(
        found.groupBy("node").agg(F.first("fp").alias("fp"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    )
    if radius is None:
        roots = similar_roots(docs, classes, words, bits, similarity, text_col, scratch)
    else:
        links = _of_cells(classes.select("node", "fp"), lambda pdf: links_of_cell(pdf, radius), "a long, b long", scratch)
        roots = components(links, scratch)
    labelled = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = labelled.groupBy("root").agg(F.min("first").alias("least"))
    labels = labelled.select("node", "root").join(firsts, "root").select("node", "least")
    return found.join(labels, "node").select(
        "doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("keep_hash")
    )


def digest(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, 64-bit fingerprint in hexadecimal and component of every row."""
    out = groups(docs, words, 64, radius, id_col=id_col, text_col=text_col)
    return out.select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_rows(docs: DataFrame, words: int = 5, bits: int = 2048, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns: of each group the row with the smallest identifier.

    Rows that repeat identifier and text are one document and stay or go together.
    """
    found = groups(docs, words, bits, similarity=similarity, id_col=id_col, text_col=text_col)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keep_hash"))
    gone = found.filter(~stays).select("doc_id", "text_hash").distinct()
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("row_id"), F.xxhash64(utf8(text_col)).alias("row_hash")
    )
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")
