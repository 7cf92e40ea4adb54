"""Nearest neighbours by a block matrix join on int8 tiles.

Queries and candidates are dealt to blocks of bounded size, and every (query block, candidate
block) pair is a tile. Inside a tile vectors are quantised to int8 with a scale each, one matrix
product gives all distances, and the quantisation errors (their norms are known) bound each from
below and above. Only candidates whose lower bound does not exceed a query's k-th smallest upper
bound are recomputed in double precision on the original vectors; a heap keeps the tile's k
best, and the heaps of a query's tiles are merged by rank. The bounds are strict, so the result
equals a full scan's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillstar.llm.common import map_groups, table

K = 10
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and norms of what rounding left over."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def bounds(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all squared distances between rows of q and rows of c."""
    qc, qs, qe = quantise(q)
    cc, cs, ce = quantise(c)
    exact = np.float32 if q.shape[1] <= 1024 else np.float64  # sums of int8 products stay exact
    product = (qc.astype(exact) @ cc.astype(exact).T) * qs[:, None] * cs[None, :]
    qn, cn = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    error = qe[:, None] * (cn + ce)[None, :] + qn[:, None] * ce[None, :]
    size = (qn**2)[:, None] + (cn**2)[None, :]
    slack = 2 * error + 1e-9 * size
    low, high = size - 2 * product - slack, size - 2 * product + slack
    # where squares leave the range of doubles a bound says nothing, and the pair is recomputed
    lost = ~(np.isfinite(low) & np.isfinite(high))
    return np.where(lost, -np.inf, low), np.where(lost, np.inf, high)


def euclidean(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of one vector to the rows of c, summed component by component."""
    total = np.zeros(len(c))
    for d in range(c.shape[1]):
        total += (c[:, d] - q[d]) ** 2
    return np.sqrt(total)


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = K,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by Euclidean distance.

    Both frames have vec_id and embedding; other columns are ignored. A query's candidates are
    all rows with another vec_id and as many components. Rows with a null vec_id or an unusable
    vector (null, empty, zero, null or non-finite components) take no part; of rows that share a
    vec_id the smallest vector counts, once. Ties go to the smaller vec_id; a query with fewer
    than k candidates returns them all, one without candidates returns no row.
    """

    def prepare(df: DataFrame) -> DataFrame:
        df = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        df = df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return df.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))

    q, c = prepare(queries), prepare(candidates)
    nq = max(1, -(-queries.count() // query_block))
    nc = max(1, -(-candidates.count() // candidate_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("i", deal(nq)).withColumn("j", every(nc)).withColumn("query", F.lit(True))
    c = c.withColumn("j", deal(nc)).withColumn("i", every(nq)).withColumn("query", F.lit(False))

    def tile(group: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = group["query"].to_numpy().astype(bool)
        ids, x = group["vec_id"].to_numpy(), matrix(group["embedding"])
        qi, qx, ci, cx = ids[asks], x[asks], ids[~asks], x[~asks]
        out: list[tuple[int, int, float]] = []
        if len(qi) and len(ci):
            low, high = bounds(qx, cx)
            own = qi[:, None] == ci[None, :]
            high[own] = np.inf
            low[own] = np.inf
            kth = np.partition(high, min(k, len(ci)) - 1, axis=1)[:, min(k, len(ci)) - 1]
            for r in range(len(qi)):
                near = np.flatnonzero((low[r] <= kth[r]) & ~own[r])
                best = heapq.nsmallest(k, zip(euclidean(qx[r], cx[near]).tolist(), ci[near].tolist()))
                out += [(int(qi[r]), v, d) for d, v in best]
        if out:
            a, b, d = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    best = map_groups(q.unionByName(c), ["dim", "i", "j"], tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return nearest(rows.filter("vec_id % 100 = 0"), rows)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
    list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""
