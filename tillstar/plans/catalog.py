"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each callable derives its inputs from the driver tables under ``sf_dir`` and
returns a lazy DataFrame; nothing is collected here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillstar.operators import analytics as A
from tillstar.plans import params as P
from tillstar.plans.testdata import star

Query = Callable[[SparkSession, str], DataFrame]


def _ranking(dim: str, ascending: bool, year: int | None) -> Query:
    return lambda spark, d: A.ranking(star(spark, d), dim, n=P.TOP_N, ascending=ascending, year=year)


def _pair(ascending: bool, year: int | None) -> Query:
    return lambda spark, d: A.paired_ranking(star(spark, d), n=P.TOP_N, ascending=ascending, year=year)


def analytics_queries() -> dict[str, Query]:
    q: dict[str, Query] = {"kpi_home": lambda spark, d: A.kpis(star(spark, d))}
    for label, dim in (("country", "country"), ("product", "stockcode")):
        for kind, asc in (("top", False), ("flop", True)):
            q[f"{label}_{kind}"] = _ranking(dim, asc, None)
            for y in P.YEARS:
                q[f"{label}_{kind}_{y}"] = _ranking(dim, asc, y)
    for kind, asc in (("top", False), ("flop", True)):
        q[f"pair_{kind}"] = _pair(asc, None)
        for y in P.YEARS:
            q[f"pair_{kind}_{y}"] = _pair(asc, y)
    q["monthly_sales"] = lambda spark, d: A.monthly(star(spark, d))
    q["monthly_sales_dense"] = lambda spark, d: A.monthly_dense(star(spark, d))
    q["country_product_revenue_top"] = lambda spark, d: A.country_product_revenue(
        star(spark, d), P.DRILL_COUNTRY, n=P.TOP_N
    )
    q["product_price_list"] = lambda spark, d: A.price_list(star(spark, d))
    q["product_price_search"] = lambda spark, d: A.price_search(
        star(spark, d), P.SEARCH_TERM, offset=P.SEARCH_OFFSET, n=P.SEARCH_PAGE
    )
    q["product_price_search_by_price"] = lambda spark, d: A.price_search(
        star(spark, d), P.SEARCH_PRICE, n=P.SEARCH_PAGE, sort="mean_price", descending=True
    )
    q["product_price_search_words"] = lambda spark, d: A.price_search(star(spark, d), P.SEARCH_WORDS, n=P.SEARCH_PAGE)
    q["region_product_top3"] = lambda spark, d: A.region_product_top(star(spark, d), k=P.JOINT_TOP_K)
    return q


def queries() -> dict[str, Query]:
    from tillstar.plans.etl import etl_queries

    out = analytics_queries()
    out.update(etl_queries())
    return out
