"""URL filters as a sort-merge range join (DataFrame functions only).

Hosts become canonical keys: labels reversed, each closed by a dot (``www.example.com`` ->
``com.example.www.``). A rule host is then a key prefix, that is the interval
``[key, key with its last dot raised to a slash)``, and it holds the host and all its
subdomains. Intervals nest, so at each boundary the list of open rules is known in advance:
a start pushes the host's rules, an end pops them. The sweep sorts boundaries and urls
together and carries the last boundary's list forward; each url picks from that list the
longest rule whose path it starts with.

Urls are dealt to ``cells`` sweeps by a hash of the row, and every sweep gets all boundaries
(two per rule host), so a host with a third of all urls is spread over all sweeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillstar.llm.common import ascii_lower, fresh, quoted

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_STACK = "array<struct<path:string,rule:string,verdict:string>>"
_RULES = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack) at each point of the key order where the list of open rules changes."""
    r = rules.select(ascii_lower(F.col("host")).alias("host"), "path", F.lower("verdict").alias("verdict"))
    r = r.filter("host is not null and path is not null and verdict is not null").distinct()
    r = r.withColumn("key", host_key(F.col("host")))
    hosts = r.select("key").distinct()
    # every host's own key and those of its parent domains
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "\\.")
    chain = hosts.withColumn("_l", labels).select(
        "key", F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("_n"), "_l"
    ).select("key", F.concat(F.array_join(F.slice("_l", 1, F.col("_n")), "."), F.lit(".")).alias("open"), (F.col("_n") == F.size("_l")).alias("own"))
    rule = F.struct("path", F.concat("host", "path").alias("rule"), "verdict")
    lists = chain.join(r.withColumnRenamed("key", "open"), "open").groupBy("key").agg(
        F.collect_list(rule).cast(_STACK).alias("inside"),
        F.collect_list(F.when(~F.col("own"), rule)).cast(_STACK).alias("outside"),
    )
    return lists.select(
        F.explode(
            F.array(
                F.struct("key", F.col("inside").alias("stack")),
                F.struct(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), F.col("outside").alias("stack")),
            )
        ).alias("b")
    ).select("b.key", "b.stack")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    cells: int | None = None,
) -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    Columns of the input named host, path, rule or verdict are replaced. A null url or one
    without ``://`` has an empty host and path, no rule and the ``default`` verdict, as has any
    url that no rule fits. Among fitting rules the longest (host plus path) wins; of equal
    length the one that blocks, then the smaller text. Repeated rows stay repeated.
    Without rules every row gets the default.
    """
    spark = pages.sparkSession
    cells = cells or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row, key, cell, stack, host, path = (fresh(n) for n in ("row", "key", "cell", "stack", "host", "path"))
    urls = pages.select(
        F.struct(*quoted(keep), F.lit(True).alias(fresh("any"))).alias(row),
        host_of(F.col(url)).alias(host),
        path_of(F.col(url)).alias(path),
    ).withColumn(key, host_key(F.col(host)))
    urls = urls.withColumn(cell, F.pmod(F.xxhash64(url_salt(row)), F.lit(cells)).cast("int")).withColumn(
        stack, F.lit(None).cast(_STACK)
    )
    marks = boundaries(rules).select(
        F.lit(None).cast(urls.schema[row].dataType).alias(row),
        F.lit(None).cast("string").alias(host),
        F.lit(None).cast("string").alias(path),
        F.col("key").alias(key),
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias(cell),
        F.col("stack").alias(stack),
    )
    sweep = Window.partitionBy(cell).orderBy(F.col(key), F.col(host).isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = urls.unionByName(marks).withColumn(stack, F.last(stack, ignorenulls=True).over(sweep))
    swept = swept.filter(F.col(host).isNotNull())
    fits = F.filter(F.col(stack), lambda r: F.col(path).startswith(r["path"]))
    best = F.array_max(
        F.transform(
            fits,
            lambda r: F.struct(
                F.length(r["rule"]).alias("n"),
                (r["verdict"] == "block").alias("blocks"),
                r["rule"].alias("rule"),
                r["verdict"].alias("verdict"),
            ),
        )
    )
    found = fresh("best")
    return swept.withColumn(found, best).select(
        *[F.col(row).getField(c).alias(c) for c in keep],
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.col(f"{found}.rule").alias("rule"),
        F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict"),
    )


def url_salt(row: str) -> Column:
    """What spreads rows over sweeps: the row as text, so that any column may be null."""
    return F.to_json(F.col(row), {"ignoreNullFields": "false"})


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), _RULES)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND (path LIKE '/es/%' OR path LIKE '/fr/%') THEN 'block'
       ELSE 'allow' END AS verdict
FROM u
"""
