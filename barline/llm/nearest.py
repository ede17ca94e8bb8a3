"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are dealt to blocks. Every query block meets every candidate block in one tile: a tile's
int8 products give each inner product within a bound that follows from the two quantisation
errors; pairs whose upper bound falls below the query's current k-th best lower bound are dropped,
the others are recomputed in double precision and kept in a heap of k per query. The tiles'
heaps are merged by rank. Nothing is lost to quantisation, so recall is 1.

The grid follows the number of rows: a candidate goes to every query block and a query to every
candidate block, and a tile returns at most k rows per query.

A vector that is null, empty or zero, or holds a null or non-finite component, takes no part, nor
does a row without vec_id. Vectors of different lengths are not compared. Rows with one vec_id are
one vector, the smallest of them in Spark's order of arrays. Ties go to the smaller vec_id.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import table

QUERY_STEP, NEAREST = 20, 20
CANDIDATE_BLOCK, QUERY_BLOCK, SUB_TILE = 8192, 4096, 1024
_RESULT = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (as double) and its length, one row per vec_id, of the vectors that take part."""
    as_double = F.col("embedding").cast("array<double>")
    sound = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists("vector", lambda x: x != 0)
    )
    return (
        vectors.withColumn("vector", as_double).where(sound).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        .withColumn("size", F.size("vector"))
    )


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _quantised(x: np.ndarray):
    """Integers of -127 to 127 with their scale, the norm of what they stand for, and of the error."""
    scale = np.abs(x).max(axis=1) / 127
    whole = np.rint(x / scale[:, None])
    stood = whole * scale[:, None]
    # norms are raised by a part in 10**9 for their own rounding
    up = 1 + 1e-9
    return whole.astype(np.int8), scale, np.linalg.norm(stood, axis=1) * up, np.linalg.norm(x - stood, axis=1) * up


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of int8 rows, exact: sums in float32 stay below 2**24 for 1,000 components at a time."""
    total = np.zeros((len(q), len(c)))
    for a in range(0, q.shape[1], 1000):
        total += q[:, a : a + 1000].astype(np.float32) @ c[:, a : a + 1000].astype(np.float32).T
    return total


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, components added in order."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def search_tile(query_ids, queries, ids, vectors, nearest: int):
    """For each query its `nearest` best candidates of a tile, as (query, id, score) rows."""
    q8, q_scale, q_norm, q_error = _quantised(queries)
    heaps: list[list] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -math.inf)
    for a in range(0, len(ids), SUB_TILE):
        part, part_ids = vectors[a : a + SUB_TILE], ids[a : a + SUB_TILE]
        c8, c_scale, c_norm, c_error = _quantised(part)
        about = _products(q8, c8) * q_scale[:, None] * c_scale[None, :]
        # |xy - x'y'| <= |x'| |y - y'| + |x - x'| |y|, with |y| <= |y'| + |y - y'|
        slack = q_norm[:, None] * c_error[None, :] + q_error[:, None] * (c_norm + c_error)[None, :]
        slack += 1e-12 * (q_norm[:, None] * c_norm[None, :] + 1e-300)
        own = query_ids[:, None] == part_ids[None, :]
        low = np.where(own, -math.inf, about - slack)
        if low.shape[1] > nearest:
            kth = np.partition(low, low.shape[1] - nearest, axis=1)[:, low.shape[1] - nearest]
            bound = np.maximum(floor, kth)
        else:
            bound = floor
        rows, cols = np.nonzero((about + slack >= bound[:, None]) & ~own)
        scores = _exact(queries[rows], part[cols])
        for r, i, s in zip(rows.tolist(), part_ids[cols].tolist(), scores.tolist()):
            heap = heaps[r]
            if len(heap) < nearest:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
        floor = np.array([h[0][0] if len(h) == nearest else -math.inf for h in heaps])
    found = [(int(q), -i, s) for q, heap in zip(query_ids.tolist(), heaps) for s, i in heap]
    return found


def nearest_neighbours(vectors: DataFrame, is_query, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest candidates of each row for which `is_query` holds."""
    vectors = vectors.select("vec_id", "embedding")
    ready = usable(vectors)
    counted = vectors.agg(F.count("*").alias("all"), F.count_if(is_query).alias("asked")).first()
    candidate_blocks = max(1, math.ceil(counted["all"] / CANDIDATE_BLOCK))
    query_blocks = max(1, math.ceil(counted["asked"] / QUERY_BLOCK))

    def blocks(of: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")

    def every(of: int):
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    candidates = ready.select("vec_id", "vector", "size", blocks(candidate_blocks).alias("c"), every(query_blocks).alias("q"))
    queries = ready.where(is_query).select("vec_id", "vector", "size", blocks(query_blocks).alias("q"), every(candidate_blocks).alias("c"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = search_tile(
                left["vec_id"].to_numpy(), _matrix(left["vector"]), right["vec_id"].to_numpy(), _matrix(right["vector"]), nearest
            )
        asked, ids, scores = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(asked, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    keys = ("q", "c", "size")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(tile, _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ranked)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM placed WHERE place <= 20
"""
