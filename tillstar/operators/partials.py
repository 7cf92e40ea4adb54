"""Mergeable aggregates of the rows a batch inserts, so that reports need not scan the fact.

One row per (kind, key), added up over batches:

* ``rows``: number of rows of each star table (key: the table);
* ``revenue``: sum of the total cost;
* ``month``: sales and revenue per month of year of the invoice as stored (key: month, null: none);
* ``country``: sales per country of the invoice as stored;
* ``price``: number and sum of the unit prices per product.

A sale belongs to the invoice the warehouse holds, which an earlier batch may have brought. First
versions win, so later batches never change what an earlier one has added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind string, key string, n long, amount decimal(38,6)"



def of_batch(added: dict[str, DataFrame], older_invoices: DataFrame) -> DataFrame:
    """Aggregates of the rows a batch adds to each table; ``older_invoices`` holds at least those earlier
    invoices that the new fact rows belong to."""
    fact = added["detailinvoice"]
    zero = F.lit(0).cast("decimal(38,6)")
    parts = [
        t.agg(F.lit("rows").alias("kind"), F.lit(name).alias("key"), F.count(F.lit(1)).alias("n"), zero.alias("amount")) for name, t in added.items()
    ]
    price = fact.groupBy("stockcode").agg(F.count("unitprice").alias("n"), F.coalesce(_amount_sum("unitprice"), zero).alias("amount"))
    parts.append(price.select(F.lit("price").alias("kind"), F.col("stockcode").alias("key"), "n", "amount"))
    lines = fact.groupBy("invoiceno").agg(F.count(F.lit(1)).alias("n"), F.coalesce(_amount_sum("totalcost"), zero).alias("amount"))
    invoices = added["invoice"].unionByName(older_invoices).select("invoiceno", F.month("invoicedate").cast("string").alias("month"), "country")
    sold = lines.join(invoices, "invoiceno")
    keyed = sold.select(
        "n", "amount", F.explode(F.array(
            F.struct(F.lit("month").alias("kind"), F.col("month").alias("key")),
            F.struct(F.lit("country").alias("kind"), F.col("country").alias("key")),
            F.struct(F.lit("revenue").alias("kind"), F.lit("").alias("key")),
        )).alias("k"),
    )
    parts.append(merged(keyed.select("k.kind", "k.key", "n", "amount")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _amount_sum(c: str):
    return F.sum(c).cast("decimal(38,6)")


def merged(rows: DataFrame) -> DataFrame:
    """One row per (kind, key)."""
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,6)").alias("amount"))
