"""Operator 1: exact top-k search by M-trees, best first."""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.llm.common import materialize, read_table
from crease.llm.vecdup import matrix

#: Entries of a page; least and most vectors of a tree, and how many trees there are in between; queries of a group. To
#: build a tree takes as long as some 20 to 50 searches of it, so each group of queries builds the trees it meets.
PAGE, LEAST, MOST, TREES, QUERIES = 512, 1024, 65_536, 64, 16_384
#: Room for rounding in distances that only decide what is skipped, as a share of the largest that can occur. A squared
#: distance is a difference of numbers that may be far larger than it, hence the square root of double precision.
SLACK = 1e-7


class Node:
    """A page: routing objects of its children, or entries of a leaf, with their distances to the page's own object.

    parent_distance is this page's own distance to the routing object of the page above.
    """

    __slots__ = ("radius", "rows", "distances", "radii", "children", "center")

    def __init__(self, center: int, rows: np.ndarray, distances: np.ndarray, children: list[Node] | None, radii):
        self.center, self.rows, self.distances, self.children, self.radii = center, rows, distances, children, radii
        self.radius = float((distances + (radii if radii is not None else 0)).max()) if len(rows) else 0.0


class MTree:
    """Vectors in paged metric nodes for the largest inner products.

    A vector x becomes (x, sqrt(m² - |x|²)) with m the largest norm, a query (q, 0): then the squared distance is
    |q|² + m² - 2 q·x, so the nearest are those of the largest product, and the triangle inequality holds.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        x = vectors.astype(np.float64)
        squares = (x * x).sum(1)
        self.top = float(squares.max()) if len(x) else 0.0
        self.points = np.hstack([x, np.sqrt(self.top - squares)[:, None]])
        self.root = self._build(np.arange(len(x)), 0) if len(x) else None
        if self.root:
            self._lay_out()

    def _lay_out(self) -> None:
        """Put the vectors of a page side by side, pages one after another."""
        nodes = [self.root]
        for node in nodes:
            nodes += node.children or []
        leaves = [n for n in nodes if n.children is None]
        order = np.concatenate([n.rows for n in leaves])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.vectors, self.points = self.ids[order], self.vectors[order], self.points[order]
        for node in nodes:
            node.center = int(place[node.center])
            node.rows = place[node.rows]

    def _distances(self, rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[center]) ** 2).sum(1))

    def _build(self, rows: np.ndarray, center: int) -> Node:
        """Bulk loading: rows go to the nearest of PAGE routing objects, spread over them, until they fit a page."""
        to_center = self._distances(rows, center)
        if len(rows) <= PAGE:
            return Node(center, rows, to_center, None, None)
        routes = rows[np.linspace(0, len(rows) - 1, min(PAGE, -(-len(rows) // PAGE) * 2)).astype(int)]
        p, r = self.points[rows], self.points[routes]
        nearest = ((r * r).sum(1) - 2 * p @ r.T).argmin(1)
        if np.bincount(nearest).max() > 0.9 * len(rows):  # equal or nearly equal vectors: any split is as good
            nearest = np.arange(len(rows)) * len(routes) // len(rows)
        children = [self._build(rows[nearest == k], routes[k]) for k in np.unique(nearest)]
        centers = np.array([c.center for c in children])
        radii = np.array([c.radius for c in children])
        return Node(center, centers, self._distances(centers, center), children, radii)

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) but for rows with the id `own`: highest score, then smallest id."""
        if self.root is None:
            return []
        square = float((query.astype(np.float64) ** 2).sum())
        far = lambda scores: np.sqrt(np.maximum(0.0, square + self.top - 2.0 * scores))
        slack = SLACK * (1.0 + np.sqrt(square) + np.sqrt(self.top))
        best_score, best_id = np.empty(0, self.vectors.dtype), np.empty(0, np.int64)
        bound = np.inf
        order = count()
        first = float(far(np.array([self.vectors[self.root.center] @ query]).astype(np.float64))[0])
        heap = [(max(0.0, first - self.root.radius), next(order), first, self.root)]
        while heap and heap[0][0] <= bound + slack:
            _, _, to_page, node = heappop(heap)
            if node.children is None:
                # entries whose stored distance alone shows that they are too far are not computed
                near = np.abs(to_page - node.distances) <= bound + slack
                first = int(node.rows[0])
                rows = slice(first, first + len(near)) if near.all() else first + np.flatnonzero(near)
                scores, ids = self.vectors[rows] @ query, self.ids[rows]
                good = ids != own
                if len(best_score) == k:
                    good &= scores >= best_score[-1]
                if good.any():
                    best_score = np.concatenate([best_score, scores[good]])
                    best_id = np.concatenate([best_id, ids[good]])
                    keep = np.lexsort((best_id, -best_score))[:k]
                    best_score, best_id = best_score[keep], best_id[keep]
                    if len(keep) == k:
                        bound = float(far(np.array([best_score[-1]]).astype(np.float64))[0])
                continue
            maybe = np.flatnonzero(np.abs(to_page - node.distances) - node.radii <= bound + slack)
            to_child = far((self.vectors[node.rows[maybe]] @ query).astype(np.float64))
            low = np.maximum(0.0, to_child - node.radii[maybe])
            for j, d, least in zip(maybe.tolist(), to_child.tolist(), low.tolist(), strict=True):
                if least <= bound + slack:
                    heappush(heap, (least, next(order), d, node.children[j]))
        return list(zip(best_score.tolist(), best_id.tolist(), strict=True))


def _integers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors: doubles while all products are exact in them, else Python integers."""
    exact, _ = matrix(column, width)
    if np.abs(exact).max(initial=0) <= 2**20:
        return exact
    rows = [[*v, *[0] * (width - len(v))] for v in column.to_pylist()]
    return np.array(rows, dtype=object)


def search_block(table: pa.Table, width: int, k: int) -> pa.Table:
    """The k best of a block's vectors (query false) for each of its queries."""
    asks = table.column("query").to_numpy(zero_copy_only=False)
    ids = table.column("id").to_numpy()
    vectors = _integers(table.column("vector"), width)
    tree = MTree(ids[~asks], vectors[~asks])
    out = [(q, i, s) for q, v in zip(ids[asks].tolist(), vectors[asks], strict=True) for s, i in tree.search(v, q, k)]
    cut = lambda s: max(-(2**63), min(2**63 - 1, int(s)))
    return pa.table(
        {
            "query_id": pa.array([q for q, _, _ in out], pa.int64()),
            "vec_id": pa.array([i for _, i, _ in out], pa.int64()),
            "score": pa.array([cut(s) for _, _, s in out], pa.int64()),
        }
    )


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Each query's k best vectors by the inner product of floor(scale * component): query_id, rank, vec_id, score.

    Rows with the query's own key are no candidates; ties go to the smaller key; all candidates if fewer than k. The
    search is exact. Rows with a null key, and vectors that are null or hold null or non-finite components, take no
    part. Vectors of different lengths are filled up with zeros. Equal rows of queries ask once; a repeated key in
    vectors is as many candidates; scores beyond the range of long are cut to it and then equal; a query key with several vectors gets the k best of their rows together. Other
    columns are left out.

    Vectors are dealt over trees by their place in the input, so no key or common vector is hot, and queries go to
    every tree, in groups; a group's tree is searched best first. Best rows of all trees meet by query, k from each.
    """
    v = F.col(vector)
    bad = v.isNull() | F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))

    def whole(df: DataFrame) -> DataFrame:
        rounded = F.transform(v.cast("array<double>"), lambda e: F.floor(F.lit(float(scale)) * e))
        return df.filter(F.col(key).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
            F.col(key).cast("long").alias("id"), rounded.alias("vector")
        )

    placed = materialize(whole(vectors).withColumn("place", F.monotonically_increasing_id()))
    asked = materialize(whole(queries).distinct())
    n, width = placed.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_queries, wide = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(width or 0, wide or 0, 1)
    trees = max(1, -(-n // max(LEAST, min(MOST, -(-n // TREES)))))
    groups = max(1, -(-n_queries // QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = placed.select(
        F.pmod(F.xxhash64("place"), F.lit(trees)).cast("int").alias("tree"), every(groups).alias("group"), F.lit(False).alias("query"), "id", "vector"
    )
    asks = asked.select(
        every(trees).alias("tree"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(True).alias("query"), "id", "vector"
    )
    found = (
        candidates.unionByName(asks)
        .groupBy("tree", "group")
        .applyInArrow(lambda table: search_block(table, width, k), "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))
