"""BI queries over the star: KPIs, top/flop lists, seasonality, drill-down, price list.

Shared relation: ``sales = detailinvoice JOIN invoice USING (invoiceno)``.  A
"sale" is one fact row.  The plans avoid materialising ``sales`` where they can:

* per-invoice measures (count, cost) are pre-aggregated on the fact side
  before the join, so the join moves one row per invoice instead of one per
  line, and a hot invoice is collapsed map-side;
* product measures are pre-aggregated per stockcode before meeting the
  (unique-keyed) product table;
* a year filter is written as a half-open date range so it reaches the scan.

Ties under a limit are broken by the dimension value (nulls last), so the
surviving rows are deterministic.

A star read from a warehouse carries what its commits vouch for
(:class:`tillstar.sources.warehouse.Star`): where every fact row has its invoice, the
invoice join of product counts goes; where batches have left partial aggregates, KPIs,
months, country counts and the price list are merged from those and the fact is not
scanned.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.functions import cents_to_price, half_up_div, year_range

Star = Mapping[str, DataFrame]

INVOICE_DIMS = ("country", "customerid", "invoicedate")
FACT_DIMS = ("stockcode", "unitprice", "quantity")


def _partials(star: Star, kind: str) -> DataFrame | None:
    """Merged aggregates of a kind (key, n, amount), if the star has them."""
    merged = getattr(star, "partials", None)
    return None if merged is None else merged.filter(F.col("kind") == kind).select("key", "n", "amount")


def sales(star: Star) -> DataFrame:
    """Fact rows with their invoice attributes (inner join: orphans drop out)."""
    return star["detailinvoice"].join(star["invoice"], "invoiceno")


def _invoices(star: Star, year: int | None = None, country: str | None = None) -> DataFrame:
    inv = star["invoice"]
    if year is not None:
        inv = inv.filter(year_range("invoicedate", year))
    if country is not None:
        inv = inv.filter(F.col("country") == F.lit(country))
    return inv


def _per_invoice(star: Star) -> DataFrame:
    """Line count and cost per invoice, aggregated before the join."""
    return (
        star["detailinvoice"]
        .filter(F.col("invoiceno").isNotNull())
        .groupBy("invoiceno")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("totalcost").alias("_cost"))
    )


def _year_col(year: int | None) -> list[Column]:
    return [] if year is None else [F.lit(year).cast("int").alias("year")]


def sales_count(star: Star, dim: str, year: int | None = None) -> DataFrame:
    """``dim, n_sales`` (plus ``year`` when filtered) over all sales."""
    if dim == "country" and year is None and _partials(star, "country") is not None:
        grouped = _partials(star, "country").select(F.col("key").alias("country"), F.col("n").alias("n_sales"))
    elif dim in INVOICE_DIMS and year is None:
        grouped = (
            _per_invoice(star)
            .join(_invoices(star).select("invoiceno", dim), "invoiceno")
            .groupBy(dim)
            .agg(F.sum("_n").alias("n_sales"))
        )
    elif dim in INVOICE_DIMS:
        # A year keeps a fraction of the invoices: join the fact to them first,
        # so a runtime bloom filter / broadcast can cut the fact before its shuffle.
        grouped = (
            star["detailinvoice"]
            .select("invoiceno")
            .join(_invoices(star, year).select("invoiceno", dim), "invoiceno")
            .groupBy(dim)
            .agg(F.count(F.lit(1)).alias("n_sales"))
        )
    elif dim in FACT_DIMS:
        # An inner join with a unique-keyed invoice keeps each fact row at most once, and all of
        # them where no year is asked for and every fact row is known to have its invoice.
        if year is None and getattr(star, "no_orphans", False):
            fact = star["detailinvoice"].filter(F.col("invoiceno").isNotNull())
        else:
            fact = star["detailinvoice"].join(_invoices(star, year).select("invoiceno"), "invoiceno", "left_semi")
        grouped = fact.groupBy(dim).agg(F.count(F.lit(1)).alias("n_sales"))
    else:
        raise ValueError(f"unknown dimension {dim!r}")
    return grouped.select(*_year_col(year), dim, "n_sales")


def top_n(
    df: DataFrame,
    measure: str,
    tie_breakers: Sequence[str],
    n: int = 10,
    ascending: bool = False,
) -> DataFrame:
    """First ``n`` rows by ``measure`` (desc by default), ties broken by ``tie_breakers``.

    Planned as ``TakeOrderedAndProject``: every partition keeps its own top n,
    the driver merges at most ``n * partitions`` rows.
    """
    m = F.col(measure)
    order = [m.asc_nulls_last() if ascending else m.desc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in tie_breakers]
    return df.orderBy(*order).limit(n)


def ranking(star: Star, dim: str, n: int = 10, ascending: bool = False, year: int | None = None) -> DataFrame:
    """Top (or flop) ``n`` countries / products by number of sales."""
    return top_n(sales_count(star, dim, year), "n_sales", [dim], n=n, ascending=ascending)


def paired_ranking(star: Star, n: int = 10, ascending: bool = False, year: int | None = None) -> DataFrame:
    """Country list and product list side by side, tagged by ``dim``, with the place in each list.

    Both come from one join: each sale counts once for its country and once for its product,
    and a rank cut off before and after the shuffle keeps ``n`` members of each.
    """
    sold = star["detailinvoice"].select("invoiceno", "stockcode").join(_invoices(star, year).select("invoiceno", "country"), "invoiceno")
    member = F.explode(
        F.array(
            F.struct(F.lit("country").alias("dim"), F.col("country").alias("member")),
            F.struct(F.lit("product").alias("dim"), F.col("stockcode").alias("member")),
        )
    )
    counts = sold.select(member.alias("m")).groupBy("m.dim", "m.member").agg(F.count(F.lit(1)).alias("n_sales"))
    by = F.col("n_sales").asc() if ascending else F.col("n_sales").desc()
    place = F.row_number().over(Window.partitionBy("dim").orderBy(by, F.col("member").asc_nulls_last()))
    ranked = counts.withColumn("rank", place).filter(F.col("rank") <= n)
    return ranked.select(*_year_col(year), "dim", "member", "n_sales", "rank").orderBy("dim", "rank")


def kpis(star: Star) -> DataFrame:
    """Home KPIs in one row: invoices, products, countries, revenue, is_empty.

    Revenue is the exact decimal sum truncated to an integer.  The four
    one-row aggregates are stacked and folded into one row (no cross join).
    """
    if getattr(star, "partials", None) is not None:
        one = star.partials

        def total(kind: str, key: str, column: str, name: str) -> Column:
            hit = (F.col("kind") == kind) & (F.col("key") == key)
            return F.coalesce(F.sum(F.when(hit, F.col(column))).cast("long"), F.lit(0).cast("long")).alias(name)

        counts = [total("rows", t, "n", n) for t, n in (("invoice", "invoices"), ("product", "products"), ("country", "countries"))]
        row = one.filter(F.col("kind").isin("rows", "revenue")).agg(*counts, total("revenue", "", "amount", "revenue"))
        return row.withColumn("is_empty", F.col("invoices") == 0)
    parts = [
        star["invoice"].agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("invoices")),
        star["product"].agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("products")),
        star["country"].agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("countries")),
        star["detailinvoice"]
        .agg(F.coalesce(F.sum(F.col("totalcost").cast("decimal(28,2)")).cast("long"), F.lit(0).cast("long")).alias("v"))
        .withColumn("k", F.lit("revenue")),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)

    def pick(k):
        return F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)

    row = stacked.agg(pick("invoices"), pick("products"), pick("countries"), pick("revenue"))
    return row.withColumn("is_empty", F.col("invoices") == 0)


def monthly(star: Star) -> DataFrame:
    """Month of year (years merged): ``month, n_sales, revenue`` (revenue rounded)."""
    known = _partials(star, "month")
    if known is not None:
        return known.select(
            F.col("key").cast("int").alias("month"), F.col("n").alias("n_sales"), F.round("amount").cast("long").alias("revenue")
        ).orderBy(F.col("month").asc_nulls_last())
    return (
        _per_invoice(star)
        .join(star["invoice"].select("invoiceno", F.month("invoicedate").alias("month")), "invoiceno")
        .groupBy("month")
        .agg(F.sum("_n").alias("n_sales"), F.round(F.sum("_cost")).cast("long").alias("revenue"))
        .select(F.col("month").cast("int").alias("month"), "n_sales", "revenue")
        .orderBy(F.col("month").asc_nulls_last())
    )


def monthly_dense(star: Star) -> DataFrame:
    """Twelve rows, months without sales as zeros (so a chart never shifts)."""
    months = star["invoice"].sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    m = monthly(star).filter(F.col("month").isNotNull())
    return months.join(m, "month", "left").select(
        "month",
        F.coalesce("n_sales", F.lit(0).cast("long")).alias("n_sales"),
        F.coalesce("revenue", F.lit(0).cast("long")).alias("revenue"),
    ).orderBy("month")


def country_product_revenue(star: Star, country: str, n: int = 10) -> DataFrame:
    """Products of one country ranked by rounded revenue: ``stockcode, n_lines, revenue``."""
    fact = star["detailinvoice"].join(
        _invoices(star, country=country).select("invoiceno"), "invoiceno", "left_semi"
    )
    per_product = fact.groupBy("stockcode").agg(
        F.count("stockcode").alias("n_lines"),
        F.round(F.sum("totalcost")).cast("long").alias("revenue"),
    )
    return top_n(per_product, "revenue", ["stockcode"], n=n)


def _price_stats(star: Star) -> DataFrame:
    """(stockcode, _sum, _n): exact sum and number of the unit prices."""
    known = _partials(star, "price")
    if known is not None:
        return known.select(F.col("key").alias("stockcode"), F.col("amount").alias("_sum"), F.col("n").alias("_n"))
    return star["detailinvoice"].groupBy("stockcode").agg(F.sum("unitprice").alias("_sum"), F.count("unitprice").alias("_n"))


def _mean_price(price: T.DecimalType) -> Column:
    """``_sum / _n`` rounded half away from zero to two decimals, in integers of the price's smallest unit."""
    scale = max(price.scale, 2)
    units = f"CAST(_sum * {10 ** scale} AS DECIMAL(38,0))"
    exact = half_up_div(units, f"(CAST(_n AS DECIMAL(20,0)) * {10 ** (scale - 2)})")
    wide = T.DecimalType(min(38, price.precision - price.scale + 2), 2)
    return F.when(F.col("_n") > 0, cents_to_price(exact, wide)).alias("mean_price")


def mean_prices(star: Star, products: DataFrame | None = None) -> DataFrame:
    """Sold products with their mean unit price, in no order."""
    prod = star["product"] if products is None else products
    price = star["detailinvoice"].schema["unitprice"].dataType
    return (
        prod.select("stockcode", "description")
        .join(_price_stats(star), "stockcode")
        .select("stockcode", "description", _mean_price(price))
    )


def price_list(star: Star, products: DataFrame | None = None) -> DataFrame:
    """Sold products with their mean unit price, rounded half up to cents, by stockcode.

    The mean is exact (integers of the price's smallest unit, half away from zero), like a
    numeric ``ROUND(AVG(price), 2)``, and as wide as the warehouse's prices.  Fact rows are
    aggregated per stockcode first; the product side is unique on stockcode, so the join is
    one to one.
    """
    return mean_prices(star, products).orderBy("stockcode")


def search_terms(text: str) -> list[str]:
    """Words of a search, in lower case: runs without white space, or what stands between quotes."""
    found = re.findall(r'"([^"]*)"?|(\S+)', text.lower())
    return [t for t in (quoted or word for quoted, word in found) if t]


def price_search(
    star: Star,
    term: str,
    offset: int = 0,
    n: int = 25,
    sort: str = "stockcode",
    descending: bool = False,
    after: tuple | None = None,
) -> DataFrame:
    """One page of the price list whose cells contain every word of a search, in any case.

    Words may stand in any order and in any of code, description and price; words between double
    quotes are one phrase, which must lie in one cell.  Each word is one predicate on the scan;
    an empty search finds every row.  Sorted by ``sort`` (stockcode, description or mean_price), ties by stockcode.  A page is
    ``n`` rows after ``offset`` rows or, without reading what lies before it, ``after`` the last
    page's (sort value, stockcode).
    """
    if sort not in ("stockcode", "description", "mean_price"):
        raise ValueError("sort must be stockcode, description or mean_price")
    rows = mean_prices(star)
    cells = [F.lower(F.col("stockcode")), F.lower(F.col("description")), F.col("mean_price").cast("string")]
    for t in search_terms(term):
        hit = F.lit(False)
        for c in cells:
            hit = hit | F.coalesce(c.contains(t), F.lit(False))
        rows = rows.filter(hit)
    key = F.col(sort)
    if after is not None:
        value, code = after
        beyond = key < F.lit(value) if descending else key > F.lit(value)
        if value is None:  # nulls are last either way
            beyond, same = F.lit(False), key.isNull()
        else:
            beyond, same = beyond | key.isNull(), key == F.lit(value)
        rows = rows.filter(beyond | (same & (F.col("stockcode") > F.lit(code))))
    page = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "stockcode")
    return page.offset(offset).limit(n) if offset else page.limit(n)


def region_product_top(star: Star, k: int = 3) -> DataFrame:
    """Joint country x product distribution: the ``k`` best products of every country.

    Counts are aggregated per (country, stockcode) first; the per-country
    ranking then sees one row per pair and is planned with a partial
    WindowGroupLimit, so a dominant country is cut down before its shuffle.
    """
    pairs = (
        star["detailinvoice"]
        .select("invoiceno", "stockcode")
        .join(star["invoice"].select("invoiceno", "country"), "invoiceno")
        .groupBy("country", "stockcode")
        .agg(F.count(F.lit(1)).alias("n_sales"))
    )
    w = Window.partitionBy("country").orderBy(F.col("n_sales").desc(), F.col("stockcode").asc_nulls_last())
    return (
        pairs.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("country", "stockcode", "n_sales", F.col("rank").cast("int").alias("rank"))
    )
