"""Exact top-k inner-product search with dual cover trees.

Queries and candidates are each dealt into blocks, and every pair of blocks meets in one cell. A cell
builds a cover tree over its candidates and one over its queries: a node covers its points within a
radius of its centre, and the centres of its children are apart by more than half that radius. Pairs
of nodes are walked from the roots; with centres q and p and radii r and s no inner product below the
pair exceeds q.p + r|p| + s|q| + r s, and the pair is left when that is below the worst k-th score of
the query node. Each cell returns k rows a query, and the best k of these are the result. The number
of cells grows with queries times candidates, as an exact search of all queries demands.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as padded with zeros; rows with the query's own identifier are not its candidates; a
null identifier is a candidate before all others in a tie, and never a query; repeated rows are
separate candidates; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch

LEAF = 48
DATA_BLOCK, QUERY_BLOCK = 4096, 1024
NO_ID = -(1 << 63)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    points: np.ndarray  # row numbers of a leaf, or of children that are single points
    children: list["Node"] = field(default_factory=list)
    worst: float = -np.inf  # of a query node: the smallest k-th best score below it


def cover_tree(vectors: np.ndarray, rows: np.ndarray, centre: int) -> Node:
    """A node over ``rows`` centred at the row ``centre``; children hold the first centre that covers them."""
    gaps = np.sqrt(((vectors[rows] - vectors[centre]) ** 2).sum(axis=1))
    node = Node(vectors[centre], float(gaps.max()), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    reach = node.radius / 2
    nearest, owner = gaps.copy(), np.zeros(len(rows), np.int64)
    centres = [centre]
    # Farthest points first: every new centre is more than ``reach`` from all before it.
    while nearest.max() > reach:
        at = int(nearest.argmax())
        own = np.sqrt(((vectors[rows] - vectors[rows[at]]) ** 2).sum(axis=1))
        closer = own < nearest
        nearest[closer], owner[closer] = own[closer], len(centres)
        centres.append(int(rows[at]))
        if len(centres) > LEAF and len(centres) > len(rows) // 4:
            return node  # points that lie apart have no finer cover
    singles = []
    for k, c in enumerate(centres):
        own = rows[owner == k]
        if len(own) == len(rows):
            return node
        if len(own) <= 2:
            singles.append(own)
        else:
            node.children.append(cover_tree(vectors, own, c))
    node.points = np.concatenate(singles) if singles else np.zeros(0, np.int64)
    return node


class Search:
    """Dual-tree search of one cell; scores and identifiers of the best k of every query."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
        self.q, self.q_ids, self.d, self.d_ids, self.k = queries, query_ids, data, data_ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def run(self) -> None:
        roots = (cover_tree(m, np.arange(len(m)), 0) for m in (self.q, self.d))
        self.walk(*roots)

    def base(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Compare single points: the best k of the old and the new, ties to the smaller identifier."""
        cols = cols[np.argsort(self.d_ids[cols], kind="stable")]
        new = self.q[rows] @ self.d[cols].T
        new[self.q_ids[rows][:, None] == self.d_ids[cols][None, :]] = -np.inf
        if len(cols) > 4 * self.k:
            floor = -np.partition(-new, self.k - 1, axis=1)[:, self.k - 1]
            keep = (new >= np.maximum(floor, self.scores[rows, -1])[:, None]).any(axis=0)
            cols, new = cols[keep], new[:, keep]
        scores = np.concatenate([self.scores[rows], new], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(self.d_ids[cols], new.shape)], axis=1)
        ids = np.where(np.isneginf(scores), np.iinfo(np.int64).max, ids)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(ids, order, axis=1)

    def bound(self, query: Node, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        size = np.sqrt((centres**2).sum(axis=1))
        top = centres @ query.centre + query.radius * size + radii * np.sqrt((query.centre**2).sum()) + query.radius * radii
        return top + 1e-9 * (1 + np.abs(top))

    def settle(self, query: Node) -> float:
        worst = [float(self.scores[query.points, -1].min())] if len(query.points) else []
        query.worst = min(worst + [c.worst for c in query.children])
        return query.worst

    def walk(self, query: Node, data: Node) -> None:
        if query.children:
            for child in query.children:
                if self.bound(child, data.centre[None], np.array([data.radius]))[0] >= child.worst:
                    self.walk(child, data)
            if len(query.points):
                self.walk(Node(query.centre, query.radius, query.points, worst=-np.inf), data)
            self.settle(query)
            return
        if len(data.points):
            cols = data.points[self.bound(query, self.d[data.points], np.zeros(len(data.points))) >= query.worst]
            if len(cols):
                self.base(query.points, cols)
                self.settle(query)
        if data.children:
            tops = self.bound(query, np.array([c.centre for c in data.children]), np.array([c.radius for c in data.children]))
            for k in np.argsort(-tops, kind="stable"):
                if tops[k] >= query.worst:
                    self.walk(query, data.children[k])


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def cell(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k candidates of a cell for each of its queries."""
    pdf = pdf.sort_values(["id", "asks"], kind="stable")
    asks = pdf["asks"].to_numpy()
    width = max(map(len, pdf["vector"]))
    queries, data = pdf[asks], pdf[~asks]
    if not len(queries) or not len(data):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    search = Search(_matrix(queries["vector"], width), queries["id"].to_numpy(), _matrix(data["vector"], width), data["id"].to_numpy(), k)
    search.run()
    found = np.isfinite(search.scores)
    return pd.DataFrame(
        {"query_id": np.repeat(search.q_ids, found.sum(axis=1)), "vec_id": search.ids[found], "score": search.scores[found].astype(np.int64)}
    )


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each query row the best k of all other rows.

    Components are floor(``scale`` * x) with x as double; the score is their integer inner product.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vector_col).isNotNull() & sound).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        (F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()).alias("asks"),
        whole.alias("vector"),
    )
    rows = scratch.write(rows)
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = max(1, -(-sizes[0] // DATA_BLOCK)), max(1, -(-sizes[1] // QUERY_BLOCK))
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Equal vectors are spread by identifier like others.
    data = rows.select("id", F.lit(False).alias("asks"), "vector", place(blocks, 1).alias("block"), every(groups).alias("group"))
    asked = rows.filter("asks").distinct().select("id", "asks", "vector", every(blocks).alias("block"), place(groups, 2).alias("group"))
    cells = data.unionByName(asked).repartition(blocks * groups, "block", "group")
    best = cells.groupBy("block", "group").applyInPandas(lambda pdf: cell(pdf, k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
