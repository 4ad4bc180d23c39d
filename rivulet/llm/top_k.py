"""Exact top-k inner-product search by ball trees.

The top levels of one tree, fitted on a bounded sample, deal the vectors to shards that are balls;
each shard builds the ball tree below, and branch and bound walks it: a node's points have at most
``q . centre + |q| * radius``, nodes are taken in the order of that bound, and one that can't beat
the current k-th score is cut with all below. The k-th score is shared: a query is first answered
by its home shard alone, and its k-th score there travels with it, as the score to beat, to those
other shards whose ball may hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import checked_broadcast, materialize

LEAF = 256
#: Vectors of a shard at most, and how small shards may be while the tree has few levels above them.
SHARD_ROWS, SMALL_SHARD_ROWS, SMALL_LEVELS = 65_536, 2_048, 5
#: Levels above the shards at most (a larger cell is dealt to several shards), and rows that they are fitted on.
MOST_LEVELS, SAMPLE = 10, 8_192
EXACT = 2.0**53


class BallTree:
    """A ball tree over integer vectors (n, d), their ids ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.largest = float(np.abs(vectors).max(initial=0))
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        self.low, self.high, self.children, centres, radii = [], [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            low, high, parent = stack.pop()
            node = len(self.low)
            if parent >= 0:
                self.children[parent].append(node)
            part = points[order[low:high]]
            centre = part.mean(axis=0)
            apart = np.sqrt(((part - centre) ** 2).sum(axis=1))
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            centres.append(centre)
            radii.append(apart.max())
            if high - low <= LEAF or radii[-1] == 0:
                order[low:high].sort()
                continue
            one = part[apart.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            middle = (high - low) // 2
            cut = np.argpartition(part @ (other - one), middle)
            order[low:high] = order[low:high][cut]
            stack += [(low, low + middle, node), (low + middle, high, node)]
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.least = np.array([self.ids[a:b].min() for a, b in zip(self.low, self.high, strict=True)])
        self.pairs = np.array([c or [-1, -1] for c in self.children])

    def bounds(self, queries: np.ndarray, norms: np.ndarray, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Whole numbers no score of q's query in the node exceeds (float64 slack included)."""
        bound = np.einsum("ij,ij->i", queries[q], self.centres[nodes]) + norms[q] * self.radii[nodes]
        return np.floor(bound + 1e-9 * (np.abs(bound) + norms[q] * (self.largest * np.sqrt(queries.shape[1]) + 1)) + 1e-6)

    def scores(self, queries: np.ndarray, whole: np.ndarray, a: int, b: int) -> np.ndarray:
        if np.abs(whole).max(initial=0) * self.largest * max(1, whole.shape[1]) < EXACT:
            return (queries @ self.points[a:b].T).astype(np.int64)
        exact = whole.astype(object) @ self.vectors[a:b].T.astype(object)
        return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)

    def search(self, own: np.ndarray, whole: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (m, k) of the best k for m queries; the largest id where there are fewer.

        ``own`` ids are left out. Nothing at or behind (floor, floor_id) in the order is needed.
        """
        m, none = len(own), np.iinfo(np.int64).min
        queries = whole.astype(np.float64)
        norms = np.sqrt((queries**2).sum(axis=1))
        best, best_id = np.full((m, k), none), np.full((m, k), np.iinfo(np.int64).max)

        def alive(q, nodes, bound):
            kth, kth_id = best[q, -1], best_id[q, -1]
            lead = (floor[q] > kth) | ((floor[q] == kth) & (floor_id[q] < kth_id))
            kth, kth_id = np.where(lead, floor[q], kth), np.where(lead, floor_id[q], kth_id)
            return (bound > kth) | ((bound == kth) & (self.least[nodes] < kth_id))

        q, nodes, leaves = np.arange(m), np.zeros(m, np.int64), []
        while len(q):
            bound = self.bounds(queries, norms, q, nodes)
            keep = alive(q, nodes, bound)
            q, nodes, bound = q[keep], nodes[keep], bound[keep]
            leaf = self.pairs[nodes, 0] < 0
            leaves.append((q[leaf], nodes[leaf], bound[leaf]))
            q, nodes = np.repeat(q[~leaf], 2), self.pairs[nodes[~leaf]].ravel()
        q, nodes, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
        order = np.lexsort((-bound, q))
        q, nodes, bound = q[order], nodes[order], bound[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for now in range(int(turn.max(initial=-1)) + 1):  # each query's next node in the order of bounds
            this = np.flatnonzero(turn == now)
            this = this[alive(q[this], nodes[this], bound[this])]
            for node in np.unique(nodes[this]):
                mine = q[this[nodes[this] == node]]
                a, b = self.low[node], self.high[node]
                found = self.scores(queries[mine], whole[mine], a, b)
                ids = np.broadcast_to(self.ids[a:b], found.shape)
                valid = ids != own[mine][:, None]
                all_scores = np.concatenate([best[mine], np.where(valid, found, none)], axis=1)
                all_ids = np.concatenate([best_id[mine], np.where(valid, ids, np.iinfo(np.int64).max)], axis=1)
                top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
                best[mine], best_id[mine] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        return best, best_id


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(values) else np.zeros((len(flat), 0), np.int64)


RESULT = "query_id long, query_key long, vec_id long, score long"


def _search(k: int):
    """Tables sorted by (dim, shard, part, is_query): build a shard's tree, then stream its queries."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        where, waiting, tree = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(place[a, :3])
                if here != where:
                    where, waiting, tree = here, [], None
                if not place[a, 3]:
                    waiting.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"))))
                    continue
                if tree is None:
                    if not waiting:
                        continue
                    ids, vectors = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                    both = np.unique(np.concatenate([ids[:, None], vectors], axis=1), axis=0)  # repeated rows once, ids ascending
                    tree, waiting = BallTree(both[:, 0], both[:, 1:]), []
                own = part.column("vec_id").to_numpy()
                floor, floor_id = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("floor", "floor_id"))
                for x in range(0, len(own), 512):
                    block = slice(x, x + 512)
                    scores, ids = tree.search(own[block], _matrix(part.column("v").slice(x, 512)), k, floor[block], floor_id[block])
                    row, at = np.nonzero(ids != np.iinfo(np.int64).max)
                    keys = part.column("query_key").to_numpy()[block]
                    yield pa.RecordBatch.from_arrays([pa.array(own[block][row]), pa.array(keys[row]), pa.array(ids[row, at]), pa.array(scores[row, at])], names=["query_id", "query_key", "vec_id", "score"])

    return run


class Balls:
    """The top of the ball tree for vectors of one length: halving planes fitted on a sample, and a ball for each cell below them."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.planes = np.zeros((2**depth - 1, sample.shape[1]))
        self.cuts = np.zeros(2**depth - 1)
        here = {0: sample.astype(np.float64)}
        for node in range(2**depth - 1):
            part = here.pop(node)
            centre = part.mean(axis=0)
            one = part[((part - centre) ** 2).sum(axis=1).argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            self.planes[node] = other - one
            at = part @ self.planes[node]
            self.cuts[node] = np.median(at)
            high = at > self.cuts[node]
            for child, rows in ((2 * node + 1, part[~high]), (2 * node + 2, part[high])):
                here[child] = rows if len(rows) else part
        self.centres = np.array([here[2**depth - 1 + c].mean(axis=0) for c in range(2**depth)])
        self.radii = np.full(2**depth, np.inf)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from the cell's centre) of each vector."""
        points, node = vectors.astype(np.float64), np.zeros(len(vectors), np.int64)
        while len(self.cuts) and len(node) and node[0] < len(self.cuts):  # all are at one depth
            node = 2 * node + 1 + (np.einsum("ij,ij->i", points, self.planes[node]) > self.cuts[node])
        cell = node - len(self.cuts)
        return cell, np.sqrt(((points - self.centres[cell]) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, cells): what no score of a query in a cell exceeds, rounding included."""
        points = queries.astype(np.float64)
        norms = np.sqrt((points**2).sum(axis=1))[:, None]
        toward, reach = points @ self.centres.T, norms * self.radii
        return toward + reach + 1e-9 * (np.abs(toward) + reach + norms * np.abs(self.centres).max(initial=1)) + 1e-6


def _deal(balls):
    """Vectors (dim, vec_id, v, asks) with their cell and distance from its centre; lengths that the sample lacks have one cell."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        held = balls.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, away = np.zeros(len(dims), np.int32), np.full(len(dims), np.inf)
            for d in np.unique(dims):
                if d in held:
                    rows = np.flatnonzero(dims == d)
                    cell[rows], away[rows] = held[d].cells(_matrix(batch.column("v").take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _visits(balls):
    """Queries (dim, vec_id, v, query_key, floor, floor_id, ...) with the ``cells`` whose balls may hold a better score than ``floor``."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        held = balls.value
        for batch in batches:
            dims, floor = batch.column("dim").to_numpy(), batch.column("floor").to_numpy(zero_copy_only=False).astype(np.int64)
            cells: list[list[int]] = [[0]] * len(dims)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d in held:
                    may = np.floor(held[d].bounds(_matrix(batch.column("v").take(pa.array(rows))))) >= floor[rows][:, None]
                    for i, m in zip(rows, may, strict=True):
                        cells[i] = np.flatnonzero(m).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows, ties to the smaller id.

    Components become ``floor(scale * x)`` (x as double) and a score is the exact inner product
    of those integers (beyond 64 bits it stays at the end of the range). Rows whose id or vector
    is null, or that hold a null, NaN or infinite component, take no part. Only vectors of equal
    length are compared. Repeated rows count once; other rows with the query's id are never its
    results, and an id with several vectors asks with each. Other columns are ignored, whatever
    their names, and an empty table gives an empty one. A vector is one row's value, however long.
    """
    spark = vectors.sparkSession
    x = F.col(vector_column)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    taken = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & finite)
    rows = taken.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).withColumn("dim", F.size("v"))
    n = rows.count()
    # the top of the tree: fitted on a bounded sample, dealt to all rows, with balls that hold all of them
    levels = lambda size: int(np.ceil(np.log2(max(1, n / size))))
    depth = min(MOST_LEVELS, max(levels(SHARD_ROWS), min(SMALL_LEVELS, levels(SMALL_SHARD_ROWS))))
    by_dim: dict[int, list] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    balls = {d: Balls(np.array(v), min(depth, int(np.log2(len(v))))) for d, v in by_dim.items() if d}
    columns = ["dim", "shard", "part", "is_query", "vec_id", "v", "query_key", "floor", "floor_id"]
    dealt = rows.select("dim", "vec_id", "v", "asks").mapInArrow(_deal(spark.sparkContext.broadcast(balls)), "dim int, vec_id long, v array<long>, asks boolean, cell int, away double")
    dealt = materialize(dealt.dropDuplicates(["vec_id", "v", "asks"]))  # repeated rows meet before they are gathered
    sizes = materialize(dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts"), F.max("away").alias("radius")))
    for r in sizes.filter(F.col("dim").isin(list(balls))).collect():  # at most 2**MOST_LEVELS for each of the sample's lengths
        balls[r["dim"]].radii[r["cell"]] = r["radius"]
    for b in balls.values():
        b.radii[np.isinf(b.radii)] = -1.0  # nothing is in such a cell
    known = checked_broadcast(sizes.select("dim", "cell", "parts"))
    placed = dealt.join(known, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumnRenamed("cell", "shard")
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    stored = placed.select("dim", "shard", "part", F.lit(0).alias("is_query"), "vec_id", "v", F.lit(0).cast("long").alias("query_key"), least.alias("floor"), most.alias("floor_id")).distinct()
    asking = placed.filter("asks").select("dim", "vec_id", "v", F.xxhash64("v").alias("query_key"), F.col("shard").alias("home"), F.col("part").alias("home_part")).distinct()

    def answers(queries: DataFrame, where: DataFrame) -> DataFrame:
        met = where.select(*columns).unionByName(queries.select(*columns))
        return met.repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "is_query").mapInArrow(_search(k), RESULT)

    at_home = asking.select("dim", F.col("home").alias("shard"), F.col("home_part").alias("part"), F.lit(1).alias("is_query"), "vec_id", "v", "query_key", least.alias("floor"), most.alias("floor_id"))
    first = materialize(answers(at_home, stored.join(checked_broadcast(materialize(at_home.select("dim", "shard", "part").distinct())), ["dim", "shard", "part"], "left_semi")))
    kth = first.groupBy("query_id", "query_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col("score").cast("decimal(20,0)")).alias("o"), "vec_id", "score")).alias("last")).filter(F.col("n") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), "query_key", F.col("last.score").alias("floor"), F.col("last.vec_id").alias("floor_id"))
    waiting = asking.join(kth, ["vec_id", "query_key"], "left").select(
        "dim", "vec_id", "v", "query_key", "home", "home_part", F.coalesce("floor", least).alias("floor"), F.coalesce("floor_id", most).alias("floor_id")
    )
    schema = "dim int, vec_id long, v array<long>, query_key long, home int, home_part int, floor long, floor_id long, cells array<int>"
    visits = waiting.mapInArrow(_visits(spark.sparkContext.broadcast(balls)), schema).withColumn("cell", F.explode("cells")).join(known, ["dim", "cell"])
    away = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part")))
    away = materialize(away.withColumnRenamed("cell", "shard").withColumn("is_query", F.lit(1)).select(*columns))
    asked = checked_broadcast(materialize(away.select("dim", "shard", "part").distinct()))
    found = first.union(answers(away, stored.join(asked, ["dim", "shard", "part"], "left_semi")).select(*first.columns))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: ``op1_top_k`` in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
