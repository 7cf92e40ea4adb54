"""Which buckets of a table may hold a key: a register-blocked Bloom filter per committed folder.

A key sets ``BITS`` bits of one 64-bit word, chosen by its hash among the words of its bucket, so
building is one ``bit_or`` aggregate and probing an equi-join on (words, bucket, word) with a mask
test. About ``KEYS_PER_WORD`` keys share a word. A probe answers with (folder, bucket) pairs: all
that hold one of the keys, and some (about one key in a hundred) that don't; the anti join after it
reads their key columns and is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6
KEYS_PER_WORD = 4
INDEX_SCHEMA = "`table` string, words long, bucket int, word long, bits long"


def bucket_of(key: str, buckets: int) -> Column:
    """Bucket of a row by its first key column, so a table's buckets are folders."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def words_for(n_keys: int, buckets: int) -> int:
    """Words of a bucket's filter, a power of two."""
    want = max(1, n_keys // (KEYS_PER_WORD * buckets))
    return 1 << (want - 1).bit_length()


def _word(keys: Sequence[str], words: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), keys[0]), words)  # rows of one first key lie together and are folded before they travel


def _mask(keys: Sequence[str]) -> Column:
    h = F.xxhash64(F.lit(2), *keys)
    out = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def build(rows: DataFrame, name: str, keys: Sequence[str], words: int, buckets: int) -> DataFrame:
    """Filter words of the keys of ``rows``."""
    n = F.lit(words).cast("long")
    placed = rows.select(bucket_of(keys[0], buckets).alias("bucket"), _word(keys, n).alias("word"), _mask(keys).alias("m"))
    return placed.groupBy("bucket", "word").agg(F.bit_or("m").alias("bits")).select(F.lit(name).alias("table"), n.alias("words"), "bucket", "word", "bits")


def probe(index: DataFrame, batch: DataFrame, keys: Sequence[str], sizes: Sequence[int], buckets: int) -> DataFrame:
    """Distinct (folder, bucket) of ``index`` that may hold a key of ``batch``; ``sizes`` lists the filters' word counts."""
    wanted = batch.select(*keys).withColumn("words", F.explode(F.array(*[F.lit(s).cast("long") for s in sorted(set(sizes))])))
    wanted = wanted.select("words", bucket_of(keys[0], buckets).alias("bucket"), _word(keys, F.col("words")).alias("word"), _mask(keys).alias("m"))
    hits = index.join(wanted, ["words", "bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("m")) == F.col("m"))
    return hits.select("folder", "bucket").distinct()


def out_of_range(info: Mapping, lo, hi) -> bool:
    """True if a folder's first keys all lie outside [lo, hi]."""
    return info.get("hi") is not None and (info["hi"] < lo or info["lo"] > hi)
