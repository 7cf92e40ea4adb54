"""Invariants over the driver-derived data (sf0.001)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillstar.operators import analytics as A
from tillstar.operators.clean import classify, clean, rejected
from tillstar.plans.testdata import dirty_export, star


def test_clean_plus_rejected_is_raw(spark):
    raw = dirty_export(spark, SF_SMALL)
    assert clean(raw).count() + rejected(raw).count() == raw.count()


def test_classify_agrees_with_clean(spark):
    raw = dirty_export(spark, SF_SMALL)
    kept_by_classify = classify(raw).filter(F.col("rejected_by").isNull()).select("_order")
    kept_by_clean = clean(raw).select("_order")
    assert kept_by_classify.exceptAll(kept_by_clean).count() == 0
    assert kept_by_clean.exceptAll(kept_by_classify).count() == 0


def test_monthly_counts_sum_to_sales(spark):
    s = star(spark, SF_SMALL)
    total = A.monthly(s).agg(F.sum("n_sales")).collect()[0][0]
    assert total == A.sales(s).count()


def test_dense_months_has_twelve_rows(spark):
    s = star(spark, SF_SMALL)
    assert [r.month for r in A.monthly_dense(s).orderBy("month").collect()] == list(range(1, 13))


def test_top_n_invariant_under_repartition(spark):
    s = star(spark, SF_SMALL)
    base = A.ranking(s, "stockcode", n=10).collect()
    s2 = dict(s)
    s2["detailinvoice"] = s["detailinvoice"].repartition(7, "unitprice")
    s2["invoice"] = s["invoice"].repartition(3)
    assert A.ranking(s2, "stockcode", n=10).collect() == base


def test_kpis_match_table_counts(spark):
    s = star(spark, SF_SMALL)
    k = A.kpis(s).collect()[0]
    assert k.invoices == s["invoice"].count()
    assert k.products == s["product"].count()
    assert k.countries == s["country"].count()
    assert k.is_empty is False
