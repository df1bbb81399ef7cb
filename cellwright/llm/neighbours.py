"""Approximate nearest neighbours by inner product: a forest of random-projection trees searched through one queue.

The trees are cut at medians of a bounded sample; every vector is then put in its leaf of each tree. A query walks all
trees through one priority queue of branches not taken, cheapest detour first, until it has seen its share of the
leaves. Vectors and queries meet in their leaves, and the exact inner product ranks what is found there.

Vectors of unequal length get one more component that makes them equally long, so that the largest inner product is the
nearest neighbour. Equal vectors are one entry, with as many of their smallest ids as a result can show.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import cut, in_tasks, table

#: Vectors to fit the trees on, about (at most twice as many); trees; vectors per leaf, about; levels at most.
SAMPLE_ROWS, TREES, LEAF_ROWS, MOST_LEVELS = 20_000, 4, 400, 6
#: Share of the leaves of the forest that a query visits. Recall on vectors without structure needs this much.
VISIT = 0.34
#: Entries of a leaf that are scored in one block.
BLOCK_ROWS = 8192
NEIGHBOURS, EVERY = 20, 20


class Forest:
    """Full binary trees in arrays: node k of a tree has children 2k+1 and 2k+2."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        inner = (1 << levels) - 1
        self.levels, self.trees = levels, trees
        self.planes = rng.normal(size=(trees, inner, size))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            groups = [np.arange(len(sample))]
            for node in range(inner):
                at = groups[node]
                along = sample[at] @ self.planes[t, node]
                self.cuts[t, node] = np.median(along) if len(at) else 0.0
                right = along >= self.cuts[t, node]
                groups += [at[~right], at[right]]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.levels):
                right = np.einsum("ij,ij->i", vectors, self.planes[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.levels) - 1)
        return out

    def visits(self, query: np.ndarray, count: int) -> list[tuple[int, int]]:
        """The first ``count`` leaves (tree, leaf) of all trees in the order of the shared queue."""
        margins = ((self.planes @ query) - self.cuts).tolist()
        inner = (1 << self.levels) - 1
        queue = [(0.0, t, 0) for t in range(self.trees)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < count:
            detour, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < inner:
                margin = own[node]
                near, far = (2 * node + 2, 2 * node + 1) if margin >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (detour + margin * margin, t, far))
                node = near
            found.append((t, node - inner))
        return found


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL or empty, all components there and finite, not all zero."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~broken, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, ids: int) -> DataFrame:
    """(entry, ids, vector): one row per different vector, named by its smallest id, with its ``ids`` smallest ids.

    Only so many rows of a vector leave a task, however often it comes.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    kept = vectors.withColumn("rank", rank).where(F.col("rank") <= ids)
    grouped = kept.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("entry"), "ids", "vector")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def nearest(
    embeddings: DataFrame, neighbours: int = NEIGHBOURS, every: int = EVERY, visit: float = VISIT, trees: int = TREES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found for each row whose id is divisible by ``every``.

    A row is not its own neighbour. Ties go to the smaller id. Vectors that are NULL, zero, or hold NULL or non-finite
    components, rows without id, and vectors of another length than most take no part. A repeated id is one candidate
    per different vector. Fewer candidates give shorter lists; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    top = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = top["n"]
    vectors = vectors.where(F.size("vector") == size)
    known = cut(entries(vectors, neighbours + 1), "entries")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    count, longest = known.agg(F.count(F.lit(1)), F.max(square)).first()
    share = min(1_000_000, SAMPLE_ROWS * 1_000_000 // count)
    sample = known.where(F.pmod(F.xxhash64("entry"), F.lit(1_000_000)) < share).select("vector").limit(2 * SAMPLE_ROWS).collect()

    def even(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))]) / np.sqrt(longest)

    fitted = np.array([r["vector"] for r in sample]).reshape(-1, size)
    levels = max(0, min(MOST_LEVELS, int(np.log2(max(count / LEAF_ROWS, 1)))))
    forest = Forest(even(fitted[np.lexsort(fitted.T)]), trees, levels)
    visited = max(trees, int(np.ceil(visit * trees * (1 << levels))))
    blocks = -(-count // ((1 << levels) * BLOCK_ROWS)) or 1
    schema = "part int, block int, kind int, id long, ids array<long>, vector array<double>"
    names = ["part", "block", "kind", "id", "ids", "vector"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = forest.leaves(even(_matrix(batch.column(2), size)))
            block = pa.array((batch.column(0).to_numpy() % blocks).astype(np.int32))
            for t in range(trees):
                part = pa.array((leaf[:, t] * trees + t).astype(np.int32))
                kind = pa.array(np.zeros(batch.num_rows, np.int32))
                yield pa.RecordBatch.from_arrays([part, block, kind, *batch.columns], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            scaled = even(x)
            scaled[:, :-1] = x / np.sqrt((x * x).sum(1, keepdims=True))
            scaled[:, -1] = 0.0
            for k in range(batch.num_rows):
                seen = [leaf * trees + t for t, leaf in forest.visits(scaled[k], visited)]
                parts, of = (a.ravel() for a in np.meshgrid(np.array(seen, np.int32), np.arange(blocks, dtype=np.int32)))
                n = len(parts)
                row = batch.slice(k, 1).take(pa.array(np.zeros(n, np.int64)))
                nothing = pa.array([None] * n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(of), pa.array(np.ones(n, np.int32)), row.column(0), nothing, row.column(1)], names)

    placed = in_tasks(known.select("entry", "ids", "vector"), put, schema)
    asked = in_tasks(vectors.where(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct(), ask, schema)
    met = placed.unionByName(asked).repartition("part", "block").sortWithinPartitions("part", "block", "kind")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        here, members, ids, matrix = None, [], [], np.zeros((0, size))

        def out() -> pa.RecordBatch:
            rows = []
            for query, found in best.items():
                rows += [(query, v, s) for v, s in heapq.nsmallest(neighbours, found.items(), key=lambda p: (-p[1], p[0]))]
            best.clear()
            query, found, s = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            part, block, kind, id_ = (batch.column(k).to_numpy() for k in range(4))
            turns = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, batch.num_rows]):
                if a == b:
                    continue
                if (part[a], block[a]) != here:
                    here, members, ids = (part[a], block[a]), [], []
                x = _matrix(batch.column(5).slice(a, b - a), size)
                if kind[a] == 0:
                    members.append(x)
                    ids += batch.column(4).slice(a, b - a).to_pylist()
                    matrix = None
                    continue
                if not members:
                    continue
                if matrix is None:
                    matrix = np.concatenate(members)
                    members = [matrix]
                near = matrix @ x.T
                top_rows = min(neighbours + 5, len(matrix))
                first = np.argpartition(-near, top_rows - 1, axis=0)[:top_rows] if top_rows < len(matrix) else np.tile(np.arange(len(matrix))[:, None], (1, len(x)))
                for q in range(len(x)):
                    # The sum over one row does not depend on its neighbours in memory, so a pair scores alike everywhere.
                    exact = (matrix[first[:, q]] * x[q]).sum(axis=1)
                    own, query = best.setdefault(int(id_[a + q]), {}), int(id_[a + q])
                    for row, s in zip(first[:, q].tolist(), exact.tolist()):
                        for v in ids[row]:
                            if v != query:
                                own[v] = max(s, own.get(v, s))
                    if len(own) > 40 * neighbours:
                        best[query] = dict(heapq.nsmallest(neighbours, own.items(), key=lambda p: (-p[1], p[0])))
            if len(best) > 20_000:
                yield out()
        yield out()

    found = in_tasks(met, score, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_neighbours": op8_neighbours}
ORACLE: dict[str, str] = {}
