"""Mixing sources to target weights by a low-discrepancy slot schedule (DataFrame functions only).

1. Targets. Each source wants ``budget`` x its weight's share of all words, and no more than
   ``max_epochs`` x its own size; what a capped source leaves is reshared by weight. That is a
   water level: sort sources by cap / weight, and the level is reached at the first source that
   stays below its cap.
2. Schedule. Slot i of the mix is the point ``i * golden ratio mod 1``; the source whose interval
   of cumulative targets holds the point fills the slot. Any stretch of slots then holds each
   source in its proportion, to within a few slots. Slots are ranked per source.
3. Blocks. Each source's documents are put in a pseudo-random order (md5 of the id), joined to
   one stream of words, and cut into blocks of equal size. Rank r of a source takes block
   ``r mod n_blocks``; the last rank is trimmed to the target. The points leave a source a few
   slots over or short: over ones stay empty, short ones follow at the end.
4. The mix is the slots in order, each with the word ranges of its block's documents; what a
   document is taken for is the sum over the slots that hold it.

Running sums are two-level (4096 cells per source, then rows inside a cell), so a source with a
third of all documents is dealt over thousands of small windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillstar.llm.common import fresh, spread, stage, table, word_count

BLOCK_WORDS = 256
#: 31-bit golden ratio: i -> i * GOLDEN mod 2^31 is a permutation of low discrepancy.
GOLDEN = 1327217885
_TURN = 1 << 31
_GRID = 1024
CELLS = 4096


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) per source, sources in code point order, null last.

    Weights repeat along that order. A source without words gets 0. The frame has a row per
    source, and its windows see these rows only.
    """
    every = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
    ratio = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("nth", F.row_number().over(ratio))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("nth"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def schedule(quotas: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source) for slots 0 to n_slots - 1; ``quotas`` has (source, target).

    The slots' points and the sources' intervals meet in an equi-join on grid cells.
    """
    spark = quotas.sparkSession
    run = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    iv = quotas.withColumn("hi", F.sum("target").over(run) / F.sum("target").over(every))
    iv = iv.withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0)))
    top = F.row_number().over(Window.partitionBy().orderBy(F.col("source").desc_nulls_first())) == 1
    iv = iv.withColumn("hi", F.when(top, F.lit(2.0)).otherwise(F.col("hi"))).filter("hi > lo")
    last = F.least(F.floor(F.col("hi") * _GRID), F.lit(_GRID - 1))
    iv = iv.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * _GRID), last)).alias("g"))
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"),
        ((F.col("id") % _TURN * GOLDEN % _TURN) / F.lit(float(_TURN))).alias("point"),
    ).withColumn("g", F.floor(F.col("point") * _GRID))
    return slots.join(iv, "g").filter("point >= lo and point < hi").select("slot", "source")


def running(df: DataFrame, group: list[str], cell: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: sum of ``value`` over the group's earlier rows. Cells must follow the order."""
    before = Window.unboundedPreceding, -1
    offset, v = fresh("offset"), fresh("v")
    df = df.withColumn(v, value)
    cells = df.groupBy(*group, cell).agg(F.sum(v).alias(offset))
    cells = cells.withColumn(offset, F.coalesce(F.sum(offset).over(Window.partitionBy(*group).orderBy(cell).rowsBetween(*before)), F.lit(0)))
    names = {c: fresh(c) for c in (*group, cell)}
    cells = cells.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    joined = df.join(cells, on).drop(*names.values())
    inner = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(*before)
    total = F.col(offset) + F.coalesce(F.sum(v).over(inner), F.lit(0))
    return joined.withColumn(out, total).drop(offset, v)


def plan(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: int = 2,
    block: int = BLOCK_WORDS,
    size: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, quotas, stream, mix): ``documents`` has doc_id, source, size and key; ``quotas`` has the targets of
    the sources; ``stream`` has the documents with their ``start`` in their source's stream of words; ``mix`` has a row per slot and document in it: slot, source, start (of the document in its source's
    stream, which tells rows of one id apart), doc_id, size, first_word, n_words."""
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = stage(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "mix-docs")
    sizes = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    quotas = targets(sizes, weights, budget, max_epochs)
    quotas = quotas.withColumn("words", F.round("target").cast("long")).withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    # slots a source needs: whole rounds over its blocks, and what is left after them
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    left = F.ceil((F.col("words") - F.col("rounds") * F.col("source_size")) / block)
    quotas = quotas.withColumn("rounds", rounds).withColumn("quota", F.col("rounds") * F.col("n_blocks") + left)
    quotas = stage(quotas, "mix-quotas")
    n_slots = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    wanted = quotas.filter("quota > 0")
    ranked = schedule(wanted.select("source", F.col("quota").cast("double").alias("target")), n_slots)
    cell = F.floor(F.col("slot") * CELLS / F.lit(max(1, n_slots)))
    ranked = running(ranked.withColumn("cell", cell), ["source"], "cell", [F.col("slot")], F.lit(1), "rank")
    q = wanted.select(F.col("source").alias("q_source"), "source_size", "words", "n_blocks", "quota")
    got = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    short = q.join(got, F.col("q_source").eqNullSafe(F.col("source")), "left").select(
        F.col("q_source").alias("source"), "quota", F.coalesce("got", F.lit(0)).alias("got")
    ).filter("got < quota")
    before = F.sum(F.col("quota") - F.col("got")).over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    short = short.withColumn("first", F.lit(n_slots) + F.coalesce(before, F.lit(0)) - F.col("got"))
    short = short.select("source", "first", F.explode(F.sequence("got", F.col("quota") - 1)).alias("rank"))
    short = short.select((F.col("first") + F.col("rank")).cast("long").alias("slot"), "source", F.col("rank").cast("long").alias("rank"))
    ranked = ranked.select("slot", "source", F.col("rank").cast("long").alias("rank")).unionByName(short)
    ranked = ranked.join(q, F.col("source").eqNullSafe(F.col("q_source"))).filter("rank < quota")
    ranked = ranked.withColumn("t_blk", F.col("rank") % F.col("n_blocks"))
    at = F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + F.col("t_blk") * block
    words_here = F.least(F.lit(block), F.col("source_size") - F.col("t_blk") * block, F.col("words") - at)
    takes = ranked.select("slot", F.col("source").alias("t_source"), "t_blk", words_here.alias("words_here"))

    stream = running(base.withColumn("cell", spread(F.col("key"), CELLS)), ["source"], "cell", [F.col("key"), F.col("size"), F.col("doc_id")], F.col("size"), "start")
    pieces = stream.filter("size > 0").withColumn(
        "blk", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    hit = pieces.join(takes, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("blk") == F.col("t_blk")))
    lo = F.greatest(F.col("start"), F.col("blk") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("blk") * block + F.col("words_here"))
    mixed = hit.filter(hi > lo).select("slot", "source", "start", "doc_id", "size", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("n_words"))
    return base, quotas, stream, mixed


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: int = 2,
    block: int = BLOCK_WORDS,
    size: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, first_slot, n_slots.

    ``taken`` counts the words of the document that the slots of the mix hold, repeats counted, 0
    to ``max_epochs`` x size; per source the sum is the target rounded to whole words. Documents
    in no slot have a null ``first_slot``. Null text has size 0; a null source is a source of its
    own, last in order. The order inside a source is the md5 of the id (null: empty text), ties
    by size, so repeated rows are interchangeable and reruns agree. Very long texts lie in many
    blocks. Without words nothing is taken. Further columns are ignored.
    """
    base, quotas, stream, mixed = plan(docs, weights, budget, max_epochs, block, size)
    # documents of one id and key are told apart by where they start in the stream
    place = ["source", "start", "doc_id", "size"]
    zero, nowhere = F.lit(0).cast("long"), F.lit(None).cast("long")
    got = mixed.groupBy(*place).agg(F.sum("n_words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    left_out = [zero.alias("taken"), nowhere.alias("first_slot"), zero.alias("n_slots")]
    every = got.unionByName(stream.filter("size > 0").select(*place, *left_out))
    every = every.groupBy(*place).agg(F.max("taken").alias("taken"), F.max("first_slot").alias("first_slot"), F.max("n_slots").alias("n_slots")).drop("start")
    every = every.unionByName(base.filter("size = 0").select("source", "doc_id", "size", *left_out))
    q = quotas.select(F.col("source").alias("q_source"), "source_size", "target")
    return every.join(q, F.col("source").eqNullSafe(F.col("q_source"))).select(
        "doc_id", "size", "source", "source_size", "target", "taken", "first_slot", "n_slots"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS nth,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, nth) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(f.level * w, cap)) AS target FROM r, f),
w AS (SELECT *, round(target)::BIGINT AS words, ceil(source_size / 256)::BIGINT AS n_blocks FROM t),
qt AS (
  SELECT *, (words // source_size) * n_blocks + ceil((words - (words // source_size) * source_size) / 256)::BIGINT AS quota
  FROM w WHERE source_size > 0),
iv AS (
  SELECT *, sum(quota::DOUBLE) OVER (ORDER BY source ASC NULLS LAST) / sum(quota::DOUBLE) OVER () AS hi,
         row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS top, sum(quota) OVER () AS total FROM qt WHERE quota > 0),
sl AS (
  SELECT i AS slot, ((i % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::DOUBLE AS point
  FROM range((SELECT coalesce(max(total), 0) FROM iv)::BIGINT) AS x(i)),
hit AS (
  SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM (SELECT *, coalesce(lag(hi) OVER (ORDER BY source ASC NULLS LAST), 0.0) AS lo FROM iv)
  JOIN sl ON point >= lo AND point < CASE WHEN top THEN 2.0 ELSE hi END),
sh AS (
  SELECT iv.source, total, unnest(range(coalesce(got, 0), quota::BIGINT)) AS rank
  FROM iv LEFT JOIN (SELECT source, count(*) AS got FROM hit GROUP BY source) c ON iv.source IS NOT DISTINCT FROM c.source),
rk AS (
  SELECT slot, source, rank FROM hit
  UNION ALL SELECT (total + row_number() OVER (ORDER BY source ASC NULLS LAST, rank) - 1)::BIGINT, source, rank FROM sh),
bl AS (
  SELECT slot, rk.source, rank % n_blocks AS blk,
         least(256, source_size - (rank % n_blocks) * 256, words - (rank // n_blocks) * source_size - (rank % n_blocks) * 256) AS here
  FROM rk JOIN iv ON rk.source IS NOT DISTINCT FROM iv.source WHERE rank < quota),
o AS (
  SELECT *, row_number() OVER () AS r, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
pc AS (SELECT *, unnest(range((a // 256)::BIGINT, ((a + size - 1) // 256)::BIGINT + 1)) AS blk FROM o WHERE size > 0),
g AS (
  SELECT r, sum(n)::BIGINT AS taken, min(slot) AS first_slot, count(*) AS n_slots
  FROM (SELECT r, slot, least(a + size, pc.blk * 256 + here) - greatest(a, pc.blk * 256) AS n
        FROM pc JOIN bl ON pc.source IS NOT DISTINCT FROM bl.source AND pc.blk = bl.blk) WHERE n > 0 GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (r)
"""
