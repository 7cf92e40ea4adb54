"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is turned by a random rotation and keeps one sign bit a component. Packed bits and a
correction factor <code, vector> are stored once per vector. The code's product with another turned vector, divided by that
factor, is an unbiased estimate of the cosine, and its spread is known, so each pair gets a
confidence bound. Only pairs whose upper bound reaches the threshold are recomputed in double
precision on the original vectors.

Candidates come from the leading bits of further rotations' codes: ``tables`` keys of ``bits``
bits; vectors with one equal key and label are compared. Bits grow with the logarithm of the
row count, and the number of tables follows from the wanted miss probability of a pair that
lies exactly on the threshold. A pair that meets in several buckets is judged in the first.
Buckets are cut into blocks of bounded size, many small blocks are judged together, and a block
returns links as a spanning forest and counts, so neither memory nor output grows with the square
of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.llm.common import components, in_blocks, map_many_groups, stage, table
from tillstar.llm.neighbours import matrix, usable

THRESHOLD = 0.98
MISS = 1e-4
CHUNK = 128
#: standard deviations of the estimate that the confidence bound allows for
SIGMAS = 5.0


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def parameters(n: int, threshold: float, miss: float, per_bucket: int = 4) -> tuple[int, int]:
    """(bits of a key, number of tables)."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, n) / per_bucket))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def bucket_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) keys: sign bits of rotations, as many rotations as the bits need."""
    dim = x.shape[1]
    need = -(-bits * tables // dim)
    signs = np.concatenate([(x @ rotation(dim, 1 + r).T) >= 0 for r in range(need)], axis=1)
    # neighbouring keys take their bits from all rotations in turn
    signs = signs[:, : bits * tables].reshape(len(x), tables, bits)
    return (signs << np.arange(bits, dtype=np.int64)).sum(axis=2)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction factors) of unit rows."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimates(unit: np.ndarray, packed: np.ndarray, factor: np.ndarray, i: np.ndarray, j: np.ndarray, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosine of code i and vector j, half width of its confidence interval) of pairs of unit rows."""
    dim = unit.shape[1]
    code = (np.unpackbits(packed, axis=1, count=dim) * 2.0 - 1) / math.sqrt(dim)
    back = code @ rotation(dim, 0) / factor[:, None]  # turned back once, instead of turning the vectors
    spread = sigmas * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * math.sqrt(max(1, dim - 1)))
    return (back[i] * unit[j]).sum(axis=1), spread[i]


def normed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and norms."""
    norm = np.sqrt((x**2).sum(axis=1))
    return x / norm[:, None], norm


def pairs_of(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows with one group number; rows come by group."""
    at = np.arange(len(group))
    left = np.searchsorted(group, group, side="right") - at - 1  # rows of the group after this one
    i = np.repeat(at, left)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)


def linked(x: np.ndarray, packed: np.ndarray, factor: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine >= threshold, by estimate, bound and exact check."""
    unit, norm = normed(x)
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // x.shape[1])
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        maybe = np.ones(len(a), bool)
        for est, width in (estimates(unit, packed, factor, a, b), estimates(unit, packed, factor, b, a)):
            maybe &= est + width >= threshold  # both codes' bounds must allow the pair
        a, b = a[maybe], b[maybe]
        out[lo + np.flatnonzero(maybe)] = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest of ``n`` rows reachable from each by links between i and j."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vec_id, embedding, label.

    Vectors link when their labels are equal and not null and their cosine is at least
    ``threshold``. Rows with an unusable vector (null, empty, zero, null or non-finite
    components), a null label or a null vec_id link with nothing and are components of their
    own. Vectors with different numbers of components do not link. Equal vectors are one class,
    compared once; each member counts as a link of the others. Rows that repeat a vec_id are
    rows of their own with one component. Other columns are ignored.
    """
    # vectors of floats travel as floats; all arithmetic is done in doubles
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), "label")
    part = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    classes = stage(part.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "emb-classes")
    bits, tables = parameters(classes.count(), threshold, miss)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                dims = pc.list_value_length(piece.column("embedding")).to_numpy()
                for dim in np.unique(dims):
                    part = piece.take(pa.array(np.flatnonzero(dims == dim)))
                    x = matrix(pa.chunked_array([part.column("embedding")]))
                    packed, factor = codes(normed(x)[0])
                    keys = bucket_keys(x, bits, tables)
                    nested = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c) for c in kept], pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(factor), nested],
                        [*kept, "code", "factor", "keys"],
                    )

    types = {f.name: f.dataType.simpleString() for f in classes.schema}
    kept = ["label", "rep", "copies", "embedding"]
    full = classes.select(*kept).mapInArrow(coded, ", ".join(f"{c} {types[c]}" for c in kept) + ", code binary, factor double, keys array<long>")
    full = stage(full, "emb-codes")
    where = full.select("label", "rep", "keys", F.posexplode("keys").alias("t", "key"))
    # a pair is judged under its first equal key, so a row needs the keys before its own
    where = where.withColumn("keys", F.slice("keys", F.lit(1), F.col("t")))
    placed = in_blocks(where, ["label", "t", "key"], "rep", chunk)
    full = full.drop("keys").withColumnsRenamed({"rep": "c_rep", "label": "c_label"})
    placed = placed.join(full, (F.col("rep") == F.col("c_rep")) & (F.col("label") == F.col("c_label"))).drop("c_rep", "c_label")

    def judge(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = t.append_column("group", pa.array(group))
        t = t.take(pc.sort_indices(t, sort_keys=[("group", "ascending"), ("rep", "ascending")]))
        dims, turn = pc.list_value_length(t["embedding"]).to_numpy(), t["t"].to_numpy()
        for dim, e in sorted(set(zip(dims.tolist(), turn.tolist()))):
            part = t.take(pa.array(np.flatnonzero((dims == dim) & (turn == e)))).combine_chunks()
            i, j = pairs_of(part["group"].to_numpy())
            own, inner = part["own"].to_numpy(), (part["bi"].to_numpy() == part["bj"].to_numpy())
            fit = inner[i] | (own[i] != own[j])  # pairs inside a chunk belong to the chunk's own block
            keys = pc.list_flatten(part["keys"]).to_numpy().reshape(len(part), e)
            for k in range(e):  # pairs of an earlier bucket are judged there
                fit &= keys[i, k] != keys[j, k]
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            packed = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(len(part), -1)
            hit = linked(matrix(part["embedding"]), packed, part["factor"].to_numpy(), i, j, threshold)
            i, j = i[hit], j[hit]
            copies, links = part["copies"].to_numpy(), np.zeros(len(part), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            at = pa.array(np.flatnonzero(links))
            root = pa.array(roots(len(part), i, j)[at])
            yield pa.RecordBatch.from_arrays([part["rep"].take(at).combine_chunks(), part["rep"].take(root).combine_chunks(), pa.array(links[at])], ["a", "b", "n"])

    kind = types["rep"]
    found = stage(map_many_groups(placed, ["label", "t", "key", "bi", "bj"], judge, f"a {kind}, b {kind}, n long"), "emb-links")
    comp = components(found)
    count = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "n_rep")
    classes = (
        classes.join(comp, F.col("rep") == F.col("node"), "left")
        .join(count, F.col("rep") == F.col("n_rep"), "left")
        .select(
            F.col("label").alias("c_label"),
            F.col("embedding").alias("c_embedding"),
            F.coalesce("component", "rep").alias("component"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        )
    )
    out = rows.join(classes, (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding")) & F.col("vec_id").isNotNull(), "left")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    return near_duplicates(rows)


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
