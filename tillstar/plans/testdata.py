"""Warehouse-shaped inputs derived from the driver's TPC-H-like tables.

* :func:`star` maps ``nation / part / orders+customer / lineitem`` onto the
  four warehouse tables (country, product, invoice, detailinvoice).
* :func:`dirty_export` derives a typed raw export with duplicates, returns,
  zero prices, letter codes and missing cells by arithmetic only, so DuckDB can
  reproduce it row for row (see FIXTURES.md section 3).

Everything is lazy: the plans grow with the input tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.functions import cents_to_price, half_up_div
from tillstar.operators.dedupe import first_per_key
from tillstar.schema import DEFAULT_ZONE, PRICE, PRICE_IN, PRICE_READ, QTY, QTY_READ, RAW_COLUMNS, WIDE

# Lineage column carrying the total file order of an export row.
ORDER = "_order"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four warehouse tables, computed from the driver tables."""
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    lineitem = table(spark, sf_dir, "lineitem")

    country = nation.select(F.col("n_name").alias("country"), F.lit(DEFAULT_ZONE).alias("zone"))
    product = part.select(
        F.col("p_partkey").cast("string").alias("stockcode"), F.col("p_name").alias("description")
    )
    invoice = (
        orders.select("o_orderkey", "o_orderdate", "o_custkey")
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("invoiceno"),
            F.col("o_orderdate").cast("date").alias("invoicedate"),
            F.col("o_custkey").cast(WIDE.customer).alias("customerid"),
            F.col("n_name").alias("country"),
        )
    )
    lines = lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    ).withColumn(ORDER, F.struct("l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice"))
    first = first_per_key(lines, ["l_orderkey", "l_partkey"], ORDER)
    detail = first.select(
        F.col("l_orderkey").cast("string").alias("invoiceno"),
        F.col("l_partkey").cast("string").alias("stockcode"),
        cents_to_price(_unit_cents(), PRICE).alias("unitprice"),
        F.col("l_quantity").cast(QTY).alias("quantity"),
        cents_to_price(_cents("l_extendedprice"), PRICE).alias("totalcost"),
    )
    return {"country": country, "product": product, "invoice": invoice, "detailinvoice": detail}


def _unit_cents():
    """Unit price in cents: extendedprice / quantity, half up, in integers."""
    cents = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    qty = "CAST(l_quantity AS BIGINT)"
    return half_up_div(cents, qty)


def dirty_export(spark: SparkSession, sf_dir: str, orders_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Typed raw export with the dirt rules of FIXTURES.md section 3.

    Columns: the 8 raw columns (typed) plus ``_order``, a struct giving the
    total file order (copy, orderkey, linenumber, partkey, suppkey, shipdate,
    extendedprice).  Rows of orders with ``l_orderkey % 50 = 0`` appear twice.
    ``orders_of``, a condition on the order key, leaves out other orders before lines and orders meet.
    """
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)
    zero_price = (F.col("l_orderkey") + F.col("l_partkey")) % 101 == 0
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity",
        returned.alias("_returned"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if orders_of is not None:  # Spark infers no filter of orders from keys that meet as text
        lines, orders = lines.filter(orders_of(F.col("l_orderkey"))), orders.filter(orders_of(F.col("o_orderkey")))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    invoices = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    # The last join deals the lines by the text of their order, so what goes by invoice or by
    # (invoice, product) after it finds its rows together.
    base = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        invoices, F.col("l_orderkey").cast("string") == F.col("o_orderkey").cast("string")
    )
    copies = F.when(F.col("l_orderkey") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select(
        F.col("l_orderkey").cast("string").alias("invoiceno"),
        F.concat(
            F.when(F.col("l_partkey") % 97 == 0, F.lit("P")).otherwise(F.lit("")),
            F.col("l_partkey").cast("string"),
        ).alias("stockcode"),
        F.when(F.col("l_partkey") % 89 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("description"),
        F.when(F.col("_returned"), -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast(QTY).alias("quantity"),
        F.col("o_orderdate").cast("date").alias("invoicedate"),
        F.when(zero_price, F.lit(0).cast(PRICE_IN))
        .otherwise(cents_to_price(_unit_cents(), PRICE_IN))
        .alias("unitprice"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_custkey")).cast(WIDE.customer).alias("customerid"),
        F.upper("n_name").alias("country"),
        F.explode(copies).alias("_copy"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    ).select(
        "invoiceno", "stockcode", "description", "quantity", "invoicedate", "unitprice", "customerid", "country",
        F.struct(
            F.col("_copy").alias("copy"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_shipdate", "l_extendedprice",
        ).alias(ORDER),
    )


def strained_export(dirty: DataFrame) -> DataFrame:
    """The dirty export with cells that break constraints: missing keys and quantities, countries
    missing or numeric, over-long numbers and texts, costs out of range, three-decimal prices."""
    order = {c: F.col(ORDER)[c] for c in ("l_orderkey", "l_partkey", "l_linenumber")}
    o, p, line = order.values()
    null = F.lit(None)
    cells = {
        "invoiceno": F.when(o % 61 == 0, null).when(o % 67 == 0, F.concat("invoiceno", F.lit("00000000"))).otherwise(F.col("invoiceno")),
        "stockcode": F.when(p % 53 == 0, null).otherwise(F.col("stockcode")),
        "description": F.when(p % 71 == 0, F.repeat("description", 12)).otherwise(F.col("description")),
        "quantity": F.when((line == 5) & (o % 3 == 0), null).otherwise(F.col("quantity")),
        "unitprice": F.when(p % 79 == 0, F.col("unitprice") * 10_000)
        .when(p % 83 == 0, F.col("unitprice") + F.lit("0.005").cast("decimal(4,3)"))
        .otherwise(F.col("unitprice"))
        .cast(PRICE_IN),
        "country": F.when(o % 59 == 0, null).when(o % 73 == 0, F.lit("12.5")).otherwise(F.col("country")),
    }
    return dirty.select(*[cells.get(c, F.col(c)).alias(c) for c in dirty.columns])


def text_export(dirty: DataFrame) -> DataFrame:
    """The dirty export as the text of a CSV file: times of day, fractional quantities, tiny prices
    and dates that do not parse."""
    o, p = F.col(ORDER)["l_orderkey"], F.col(ORDER)["l_partkey"]
    late = F.col(ORDER)["copy"] * F.when(o % 100 == 0, 1).otherwise(0)  # some second copies differ in time
    hours = ((o + late) % 24).cast("int")
    at = F.col("invoicedate").cast("timestamp") + F.make_dt_interval(F.lit(0), hours)
    quantity = F.col("quantity").cast(QTY_READ)
    cells = {
        "invoicedate": F.when(o % 211 == 0, F.lit("soon")).otherwise(F.date_format(at, "M/d/yyyy H:mm")),
        "quantity": F.when(p % 107 == 0, F.lit("0.4")).when(p % 103 == 0, (quantity + F.lit("0.4").cast("decimal(2,1)")).cast("string")).otherwise(quantity.cast("string")),
        "unitprice": F.when((o + p) % 109 == 0, F.lit("0.0000004")).otherwise(F.col("unitprice").cast(PRICE_READ).cast("string")),
    }
    return dirty.select(*[cells.get(c, F.col(c).cast("string")).alias(c) for c in RAW_COLUMNS], ORDER)


def in_a(order: Column) -> Column:
    return order % 3 != 0


def in_b(order: Column) -> Column:
    return order % 3 != 1


def batch_a(dirty: DataFrame) -> DataFrame:
    """Monthly batch A of the merge tests (invoices with key % 3 <> 0)."""
    return dirty.filter(in_a(F.col(ORDER)["l_orderkey"]))


def batch_b(dirty: DataFrame) -> DataFrame:
    """Batch B (key % 3 <> 1), dated 30 days later so first-wins is visible."""
    return dirty.filter(in_b(F.col(ORDER)["l_orderkey"])).withColumn(
        "invoicedate", F.date_add("invoicedate", 30)
    )


def export_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch A of the dirty export."""
    return batch_a(dirty_export(spark, sf_dir, in_a))


def export_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch B of the dirty export."""
    return batch_b(dirty_export(spark, sf_dir, in_b))
