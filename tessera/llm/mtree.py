"""Exact top-k by inner product: best-first search in M-trees.

With M the greatest norm in a tree, a vector x gets one more component, the root of M² - |x|², and a query q a zero
there; then |q - x|² = |q|² + M² - 2qx, and the greatest inner products are the least distances, in a metric space.
A node is a page of entries: a pivot, the radius that covers what lies below it, and the pivot's distance to its
parent's. A query visits pages by their least possible distance; |d(q, parent) - d(pivot, parent)| minus the radius bounds
an entry from below without computing its distance. What can't beat the k-th result is left out, ties are not.

Vectors go to the nearest of up to ``Plan.pivots`` pivots, which a bounded sample gives for their spread, and there to
trees of bounded size; each tree is grown once and written. A query visits the trees of its nearest pivot first, and with
its k-th score from there those of the other pivots whose ball can hold something as good. A task holds one tree, queries
stream past it. How much the bounds save depends on the vectors: among 64 independent dimensions all distances are
alike and nothing can be left out.

Components are integers here, floor(``scale`` times the component), and scores are exact, by Python's integers where
float64 can't hold them. Defined results: vectors that are null or hold null or non-finite components take no part, nor
do null ids; an empty vector has inner product 0 with all; of vectors of unequal length the shorter goes on with zeros;
each row is a candidate, also if rows share an id; of query rows with one id the least vector asks; equal scores go to
the smaller id; fewer candidates than k are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


@dataclass(frozen=True)
class Plan:
    k: int = 5
    scale: int = 256
    page: int = 128  #: entries of a node
    tree: int = 16384  #: vectors of a tree, about
    values: int = 1 << 20  #: components of all its vectors, about
    pivots: int = 256  #: at the top
    sample: int = 4096  #: vectors that the pivots are chosen from

    def members(self, width: int) -> int:
        """Vectors of a tree."""
        return max(self.page, min(self.tree, self.values // max(1, width)))


@dataclass(frozen=True)
class Node:
    members: np.ndarray  #: rows of the entries' pivots, of the objects themselves in a leaf
    to_parent: np.ndarray  #: distances of the pivots to this node's own
    radii: np.ndarray
    children: tuple[Node, ...]  #: none in a leaf


class MTree:
    """ids, and vectors as a matrix of integers in float64. ``bound``: greatest squared norm of all vectors, if more are lifted."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = Plan.page, bound: float | None = None):
        self.ids, self.vectors, self.page = ids, vectors, page
        self.bound = max(float((vectors**2).sum(axis=1).max(initial=0.0)), bound or 0.0)
        self._lift()
        self.root = self._grow(np.arange(len(ids)), 0) if len(ids) else None

    def _lift(self) -> None:
        self.lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(0.0, self.bound - (self.vectors**2).sum(axis=1)))])
        # Rounding of distances: generous, since a bound that is too low costs time only.
        self.slack = 1e-6 * (1.0 + np.sqrt(self.bound))
        self.computed = 0  #: distances that searches computed

    def __getstate__(self) -> dict:
        """Without what follows from the vectors, these as the smallest integers that hold them."""
        top = np.abs(self.vectors).max(initial=0.0)
        kind = next((k for k, most in ((np.int16, 2.0**15), (np.int32, 2.0**31), (np.int64, 2.0**53)) if top < most), np.float64)
        return {"ids": self.ids, "vectors": self.vectors.astype(kind), "page": self.page, "bound": self.bound, "root": self.root}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.vectors = self.vectors.astype(float)
        self._lift()

    def _to(self, rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances, pivots × rows. Norms of lifted vectors all are the bound."""
        inner = self.lifted[pivots] @ self.lifted[rows].T
        return np.sqrt(np.maximum(0.0, 2 * (self.bound - inner)))

    def _node(self, rows: np.ndarray, pivot: int, radii: np.ndarray, children: tuple[Node, ...]) -> Node:
        return Node(rows, self._to(rows, np.array([pivot]))[0], radii, children)

    def _grow(self, rows: np.ndarray, pivot: int) -> Node:
        """The node over ``rows`` below ``pivot``."""
        if len(rows) <= self.page:
            return self._node(rows, pivot, np.zeros(len(rows)), ())
        seeds = self._seeds(rows)
        away = self._to(rows, seeds)
        nearest = away.argmin(axis=0)
        groups = [rows[nearest == n] for n in range(len(seeds))]
        if max(map(len, groups)) > 0.9 * len(rows):  # (nearly) one point: pages in order
            groups = np.array_split(rows, self.page)
            seeds = np.array([g[0] for g in groups])
        kept = [(s, g) for s, g in zip(seeds, groups) if len(g)]
        pivots = np.array([s for s, _ in kept])
        radii = np.array([self._to(g, np.array([s]))[0].max() for s, g in kept])
        return self._node(pivots, pivot, radii, tuple(self._grow(g, s) for s, g in kept))

    def _seeds(self, rows: np.ndarray) -> np.ndarray:
        """Pivots far from each other: as many as the pages below need, no more than a page holds."""
        wanted = min(self.page, max(2, -(-2 * len(rows) // self.page)))
        return rows[spread(self.lifted[rows], wanted)]

    def nearest(self, query_id: int | None, query: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the k greatest inner products, ties to the smaller id; not of the query's own id.

        ``floor``: what is below this score may be left out.
        """
        found: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first
        square = float((query**2).sum()) + self.bound
        lifted = np.append(query, 0.0)
        reach = lambda score: float(np.sqrt(max(0.0, square - 2.0 * score))) + self.slack
        worst = np.inf if floor == -np.inf else reach(floor)

        queue: list[tuple[float, int, Node, float]] = []
        if self.root:
            to_root = np.sqrt(max(0.0, square - 2.0 * float(self.lifted[0] @ lifted)))
            queue.append((0.0, 0, self.root, to_root))
        pushed = 0
        while queue:
            least, _, node, to_pivot = heapq.heappop(queue)
            if least > worst:
                break
            near = np.abs(to_pivot - node.to_parent) - node.radii - self.slack <= worst
            at = np.flatnonzero(near)
            products = self.lifted[node.members[at]] @ lifted
            self.computed += len(at)
            if node.children:
                away = np.sqrt(np.maximum(0.0, square - 2.0 * products))
                below = np.maximum(0.0, away - node.radii[at] - self.slack)
                for n, d, low in zip(at[below <= worst], away[below <= worst], below[below <= worst]):
                    pushed += 1
                    heapq.heappush(queue, (float(low), pushed, node.children[n], float(d)))
                continue
            products = self._exact(node.members[at], query, products)
            good = products >= (found[0][0] if len(found) == k else floor)
            at, products = at[good], products[good]
            for score, name in zip(products.tolist(), self.ids[node.members[at]].tolist()):
                if name == query_id:
                    continue
                entry = (int(score), -name)
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
            if len(found) == k:
                worst = min(worst, reach(found[0][0]))
        return sorted(((s, -n) for s, n in found), key=lambda e: (-e[0], e[1]))

    def _exact(self, rows: np.ndarray, query: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Products as they are where float64 holds them, else by Python's integers."""
        if max(self.bound, float((query**2).sum())) < 2.0**52:
            return products
        return self.vectors[rows].astype(np.int64).astype(object).dot(np.array([int(x) for x in query], object))


def spread(points: np.ndarray, wanted: int) -> np.ndarray:
    """Rows far from each other, the first one included: the farthest from those chosen comes next."""
    chosen = [0]
    if wanted * len(points) > 1 << 22:  # of many rows, evenly chosen ones take part
        rows = np.linspace(0, len(points) - 1, max(wanted, (1 << 22) // wanted)).astype(int)
        return rows[spread(points[rows], wanted)]
    away = ((points - points[0]) ** 2).sum(axis=1)
    for _ in range(min(wanted, len(points)) - 1):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.unique(chosen)


def quantised(vector: Column, scale: int) -> Column:
    """Integers in double, or null if the vector takes no part."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The column v, shorter ones filled up with zeros."""
    lists = batch.column("v")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((batch.num_rows, width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass(frozen=True)
class Roots:
    """The top of the index: pivots with the radii and numbers of trees below them; ``Plan.pivots`` at most."""

    pivots: np.ndarray  #: lifted
    bound: float
    radii: np.ndarray | None = None
    trees: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.pivots.shape[1] - 1

    def of_members(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and its distance."""
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(0.0, self.bound - (vectors**2).sum(axis=1)))])
        away = np.sqrt(np.maximum(0.0, 2 * (self.bound - lifted @ self.pivots.T)))
        return away.argmin(axis=1), away.min(axis=1)

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        """Distances, queries × pivots."""
        square = (vectors**2).sum(axis=1)[:, None] + self.bound
        return np.sqrt(np.maximum(0.0, square - 2 * (vectors @ self.pivots[:, :-1].T)))


def _roots(whole: DataFrame, plan: Plan) -> Roots:
    """Pivots are chosen for their spread from a bounded sample; every vector is indexed."""
    sizes = whole.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"),
                      F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("bound")).first()
    width, bound = sizes["width"] or 0, sizes["bound"] or 0.0
    every = max(1, sizes["n"] // plan.sample)
    drawn = whole.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(every)) == 0).orderBy(F.xxhash64("id"), "id").limit(2 * plan.sample)
    rows = drawn.select("v").collect() or whole.select("v").limit(1).collect()
    vectors = np.zeros((len(rows), width))
    for at, row in enumerate(rows):
        vectors[at, : len(row["v"])] = row["v"]
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(0.0, bound - (vectors**2).sum(axis=1)))])
    wanted = min(plan.pivots, -(-sizes["n"] // plan.members(width)) if sizes["n"] else 1)
    return Roots(lifted[spread(lifted, max(1, wanted))] if len(lifted) else np.zeros((1, width + 1)), bound)


def _placed(whole: DataFrame, roots: Roots) -> DataFrame:
    """pivot, away, id, v."""
    shared = whole.sparkSession.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = shared.value.of_members(_vectors(batch, shared.value.width))
            columns = [pa.array(pivot.astype(np.int64)), pa.array(away), batch.column("id"), batch.column("v")]
            yield pa.RecordBatch.from_arrays(columns, ["pivot", "away", "id", "v"])

    return whole.select("id", "v").mapInArrow(run, "pivot long, away double, id long, v array<double>")


def _grown(placed: DataFrame, roots: Roots, plan: Plan) -> DataFrame:
    """tree, index: one pickled M-tree for each."""
    shared = placed.sparkSession.sparkContext.broadcast(roots)
    parts = F.element_at(F.array(*[F.lit(int(n)) for n in roots.trees]), (F.col("pivot") + 1).cast("int"))
    tree = F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("id", F.lit(3)), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, here, ids, vectors = shared.value, None, [], []

        def grown() -> pa.RecordBatch:
            index = MTree(np.concatenate(ids), np.concatenate(vectors), plan.page, roots.bound)
            return pa.RecordBatch.from_arrays([pa.array([here]), pa.array([pickle.dumps(index)], pa.binary())], ["tree", "index"])

        for batch in batches:
            names = batch.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if names[a] != here and ids:
                        yield grown()
                        ids, vectors = [], []
                    here = int(names[a])
                    part = batch.slice(a, b - a)
                    ids.append(part.column("id").to_numpy()), vectors.append(_vectors(part, roots.width))
        if ids:
            yield grown()

    dealt = placed.select(tree.alias("tree"), "id", "v").repartition("tree").sortWithinPartitions("tree", "id")
    return dealt.mapInArrow(run, "tree long, index binary")


def _asked(trees: DataFrame, queries: DataFrame, roots: Roots, plan: Plan, again: bool) -> DataFrame:
    """query_id, id, score of each query's best in the trees it visits: those of its nearest pivot, or (``again``) those
    of the others that can hold something as good as ``floor``."""
    shared = queries.sparkSession.sparkContext.broadcast(roots)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = shared.value
            away = roots.of_queries(_vectors(batch, roots.width))
            nearest = np.zeros(away.shape, bool)
            nearest[np.arange(len(away)), away.argmin(axis=1)] = True
            if again:
                floor = batch.column("floor").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                square = (_vectors(batch, roots.width) ** 2).sum(axis=1) + roots.bound
                worst = np.where(np.isnan(floor), np.inf, np.sqrt(np.maximum(0.0, square - 2 * np.nan_to_num(floor))))
                least = away - roots.radii - 1e-6 * (1.0 + np.sqrt(roots.bound))
                visits = ~nearest & (roots.trees > 0) & (least <= worst[:, None])
            else:
                visits = nearest
            at, pivot = np.nonzero(visits)
            trees = roots.trees[pivot]
            rows = np.repeat(at, trees)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(trees) - trees, trees)
            chosen = batch.take(pa.array(rows))
            place = pa.array(np.repeat(pivot.astype(np.int64) << 32, trees) + part)
            yield pa.RecordBatch.from_arrays([place, *(chosen.column(c) for c in ("id", "v", "floor"))], ["tree", "id", "v", "floor"])

    asking = queries.select("id", "v", "floor").mapInArrow(route, "tree long, id long, v array<double>, floor long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, index, here = shared.value, None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch, out = whole.slice(start, 64), []
                vectors = _vectors(pa.record_batch({"v": pc.fill_null(batch.column("v"), [])}), roots.width)
                columns = (batch.column(c).to_pylist() for c in ("tree", "index", "id", "floor"))
                for n, (tree, blob, name, floor) in enumerate(zip(*columns)):
                    if blob is not None:
                        index, here = pickle.loads(blob), tree
                    elif tree == here:
                        best = index.nearest(name, vectors[n], plan.k, -np.inf if floor is None else floor)
                        out += [(name, other, score) for score, other in best]
                if out:
                    columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

    streams = trees.unionByName(asking, allowMissingColumns=True).repartition("tree")
    return streams.sortWithinPartitions("tree", F.col("index").isNull(), "id").mapInArrow(run, "query_id long, id long, score long")


def search(
    table: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    plan: Plan = Plan(),
) -> DataFrame:
    """query_id, rank, key, score. ``is_query`` is a condition on the key."""
    scratch = Scratch(table.sparkSession, "mtree")
    whole = table.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), plan.scale).alias("v"))
    whole = scratch.table(whole.filter("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    roots = _roots(whole, plan)
    placed = scratch.table(_placed(whole, roots), "placed")
    scratch.drop("vectors")
    queries = placed.select(F.col("id").alias(key), "v").filter(is_query).withColumnRenamed(key, "id").groupBy("id").agg(F.min("v").alias("v"))
    below = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    radii, trees = np.zeros(len(roots.pivots)), np.zeros(len(roots.pivots), np.int64)
    for pivot, row in below.items():
        radii[pivot], trees[pivot] = row["radius"], -(-row["n"] // plan.members(roots.width))
    roots = replace(roots, radii=radii, trees=trees)
    grown = scratch.table(_grown(placed, roots, plan), "trees")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= plan.k)
    first = scratch.table(best(_asked(grown, queries.withColumn("floor", F.lit(None).cast("long")), roots, plan, False)), "first")
    floors = first.filter(F.col("rank") == plan.k).select(F.col("query_id").alias("of"), F.col("score").alias("floor"))
    known = queries.join(floors, F.col("id") == F.col("of"), "left").drop("of")
    second = _asked(grown, known, roots, plan, True)
    ranked = scratch.table(best(first.drop("rank").unionByName(second)), "found")
    scratch.drop("placed", "trees", "first")
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


ORACLE = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
