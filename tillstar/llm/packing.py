"""Packing into optimal length buckets: dynamic programming over the global length histogram.

Texts longer than ``max_len`` tokens are cut into pieces of at most ``max_len``, so nothing is
lost. The histogram of piece lengths has at most ``max_len`` rows, whatever the data; over it a
dynamic programme finds the ``n_buckets`` boundaries (every piece is padded to its bucket's
boundary) with the least padding. Inside a bucket pieces are put in a pseudo-random order and
filled into batches of ``budget // boundary`` pieces, so a batch never exceeds the token budget.

Ranks inside a bucket are two-level (4096 cells, then rows of a cell): a bucket with a third of
all pieces is dealt over thousands of small windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.llm.common import fresh, spread, stage, table, word_count
from tillstar.llm.mixing import running

MAX_LEN = 2048
N_BUCKETS = 12
BUDGET = 16384


def boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Ascending boundaries (the last is the largest length) with the least total padding.

    cost(i, j) pads lengths i..j to length j: len[j] * (C[j] - C[i-1]) - (W[j] - W[i-1]).
    O(n_buckets * n^2) on at most ``max_len`` distinct lengths, one vectorised row at a time.
    Of equal costs the smaller boundaries win.
    """
    if not len(lengths):
        return []
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n, k = len(x), min(n_buckets, len(x))
    count = np.concatenate([[0], np.cumsum(c)])
    words = np.concatenate([[0], np.cumsum(c * x)])
    best = x * count[1:] - words[1:]
    back = np.zeros((k, n), np.int64)
    for b in range(1, k):
        new = best.copy()
        for j in range(b, n):
            i = np.arange(b, j + 1)  # the last bucket holds i..j
            cost = best[i - 1] + x[j] * (count[j + 1] - count[i]) - (words[j + 1] - words[i])
            at = int(np.argmin(cost))
            new[j], back[b, j] = cost[at], i[at]
        best = new
    out, j = [], n - 1
    for b in range(k - 1, -1, -1):
        out.append(int(x[j]))
        j = int(back[b, j]) - 1
        if j < 0:
            break
    return sorted(out)


def pack(
    docs: DataFrame,
    size: Column | None = None,
    max_len: int = MAX_LEN,
    n_buckets: int = N_BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """(doc_id, piece, n_pieces, length, bucket, batch, slot, padding): one row per piece.

    ``bucket`` is the boundary the piece is padded to, ``batch`` counts from 0 inside a bucket,
    ``slot`` is the place in the batch. ``size`` (default: words of ``text``) is the length of a
    text in tokens; null or empty texts have one piece of length 0 in bucket 0, which needs no
    padding. The order inside a bucket is the md5 of id and piece, then the id; repeated rows
    take places of their own, and which of two equal rows comes first does not show. Columns
    other than doc_id and text are ignored. No rows in, no rows out.
    """
    if budget < max_len:
        raise ValueError("the token budget must hold a piece of max_len")
    size = word_count(F.col("text")) if size is None else size
    pieces = docs.select("doc_id", F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    pieces = pieces.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / max_len)))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("length", F.least(F.lit(max_len), F.col("size") - F.col("piece") * max_len))
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")).cast("binary"))
    pieces = stage(pieces.select("doc_id", "piece", "n_pieces", "length", key.alias("key")), "pack-pieces")
    histogram = pieces.filter("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # <= max_len rows
    edges = boundaries(np.array([r["length"] for r in histogram]), np.array([r["n"] for r in histogram]), n_buckets)
    bucket = F.lit(0)
    for b in reversed(edges):
        bucket = F.when((F.col("length") > 0) & (F.col("length") <= b), F.lit(b)).otherwise(bucket)
    pieces = pieces.withColumn("bucket", bucket.cast("long")).withColumn("cell", spread(F.col("key")))
    rank, room = fresh("rank"), fresh("room")
    ranked = running(pieces, ["bucket"], "cell", [F.col(c) for c in ("key", "doc_id", "length", "n_pieces")], F.lit(1), rank)
    ranked = ranked.withColumn(room, F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))))
    return ranked.select(
        "doc_id",
        "piece",
        "n_pieces",
        "length",
        "bucket",
        F.floor(F.col(rank) / F.col(room)).alias("batch"),
        (F.col(rank) % F.col(room)).alias("slot"),
        (F.col("bucket") - F.col("length")).alias("padding"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
