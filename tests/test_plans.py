"""Physical plan shape: top-k, partial limits, pushdown, no Python in the hot path."""

import re

import pytest

from conftest import F, SF_SMALL, row
from tillstar.operators import analytics as A
from tillstar.operators import keyindex
from tillstar.operators.clean import classify
from tillstar.operators.dedupe import first_per_key
from tillstar.operators.merge import first_versions, insert_if_absent, judged, load, with_firsts
from tillstar.plans import catalog
from tillstar.plans.testdata import batch_a, batch_b, dirty_export, export_a, export_b, star
from tillstar.schema import WIDE
from tillstar.session import JOIN_BY_PART, scratch_path, tidy_shuffles
from tillstar.sources import warehouse
from tillstar.sources.warehouse import Warehouse


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(A.ranking(star(spark, SF_SMALL), "country"))


def test_first_per_key_has_partial_group_limit(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    p = plan(first_per_key(li, ["l_orderkey", "l_partkey"], "l_linenumber"))
    assert "WindowGroupLimit" in p


def test_country_ranking_aggregates_before_join(spark):
    p = plan(A.ranking(star(spark, SF_SMALL), "country"))
    # partial + final per invoice, then per country
    assert p.count("HashAggregate") >= 4


@pytest.mark.parametrize("name", sorted(catalog.analytics_queries()))
def test_no_python_udf(spark, name):
    p = plan(catalog.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_year_filter_reaches_the_scan(spark):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    load(wh, batch_a(dirty_export(spark, SF_SMALL)), "A")
    df = A.ranking(wh.star(), "country", year=1997)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(invoicedate), GreaterThanOrEqual(invoicedate,1997-01-01)" in p


def test_warehouse_reads_only_committed_batches(spark):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    load(wh, batch_a(dirty_export(spark, SF_SMALL)), "A")
    p = plan(wh.table("detailinvoice"))
    assert "PartitionFilters: [isnotnull(batch_id" in p


def test_classify_deals_rows_once(spark, make_raw):
    raw = make_raw([row(quantity=n % 3, stockcode=str(n % 5)) for n in range(40)])
    p = plan(classify(raw.repartition(4, "invoiceno")))
    assert p.count("Exchange") == 1 and "Join" not in p


def test_dirty_rows_lie_by_invoice(spark):
    dirty = dirty_export(spark, SF_SMALL)
    assert plan(classify(dirty)).count("Exchange hashpartitioning") <= plan(dirty).count("Exchange hashpartitioning") + 1


def test_equal_rows_at_one_place_are_one(spark, make_raw):
    raw = make_raw([row(), row(customerid=None), row(customerid=None), row(stockcode=None), row(stockcode=None)])
    twice = raw.unionByName(raw.filter(F.col("_order") < 2))
    got = sorted((r["_order"], r["rejected_by"]) for r in classify(twice).collect())
    assert got == [(0, None), (1, "duplicate_key"), (2, "duplicate_row"), (3, None), (4, "duplicate_row")]


def test_first_load_joins_no_history(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    assert "Join" not in plan(insert_if_absent(wh.table("product"), make_raw([row()]), ["stockcode"]))


def test_keys_found_everywhere_are_not_all_looked_up(spark, make_raw, monkeypatch):
    monkeypatch.setattr(warehouse, "FIRST_KEYS", 60)
    looked_up = []
    probe = keyindex.probe
    monkeypatch.setattr(keyindex, "probe", lambda index, batch, *a: looked_up.append(batch.count()) or probe(index, batch, *a))
    wh = Warehouse(spark, scratch_path(spark, "wh"), WIDE, key_buckets=2)
    rows = [row(invoiceno=str(1000 + i)) for i in range(100)]
    load(wh, make_raw(rows), "A")
    assert wh.may_hold("invoice", make_raw(rows), wh.state(), "1000", "1099").count() == 100 and looked_up == [60]
    one = make_raw(rows[:1])
    assert wh.may_hold("invoice", one, wh.state(), "1000", "1000").count() == 1 and looked_up == [60, 1, 1]


def test_staging_by_invoice_deals_rows_once(spark, make_raw):
    raw = make_raw([row(invoiceno=str(n % 4), quantity=n % 3, stockcode=str(n % 5)) for n in range(40)])
    p = plan(with_firsts(judged(classify(raw.repartition(3), by_invoice=True), "intended", WIDE)))
    assert p.count("Exchange hashpartitioning(invoiceno") == p.count("Exchange hashpartitioning") == 1 and p.count("- Sort [") == 2


def test_fact_rows_meet_history_by_invoice(spark):
    old = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), (None, "c")], "invoiceno string, stockcode string")
    new = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("3", "a"), (None, "c")], "invoiceno string, stockcode string")
    keys = ["invoiceno", "stockcode"]
    with tidy_shuffles(spark, JOIN_BY_PART):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = insert_if_absent(old, new, keys, unique=True, by="invoiceno")
            p = plan(got)
            rows = sorted(got.collect(), key=str)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning(invoiceno") == p.count("Exchange") == 2 and "stockcode" not in "".join(x for x in p.splitlines() if "Exchange" in x)
    assert rows == sorted(insert_if_absent(old, new, keys, unique=True).collect(), key=str) and len(rows) == 3


def test_first_versions_rank_only_keys_that_have_several(spark, monkeypatch):
    """What tells versions apart travels without the rows' places."""
    rows = spark.createDataFrame([("1", "a", 5), ("1", "a", 4), ("2", "b", 3), ("2", "c", 2), ("2", None, 6), ("3", None, 1), ("3", None, 0), ("4", None, 7), ("4", "d", 8)], "stockcode string, description string, _order int")
    ranked = []
    monkeypatch.setattr("tillstar.operators.merge.first_per_key", lambda df, *a: ranked.append(sorted(r.stockcode for r in df.collect())) or first_per_key(df, *a))
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    got = first_versions(wh, rows, ["stockcode"], "x")
    assert sorted(got.collect()) == [("1", "a"), ("2", "c"), ("3", None), ("4", None)]
    assert ranked == [["2", "2", "2", "4", "4"]]
    assert sorted(first_versions(wh, rows.filter("stockcode in ('1', '3')"), ["stockcode"], "y").collect()) == [("1", "a"), ("3", None)]
    assert len(ranked) == 1


@pytest.mark.parametrize("whole,part", [(batch_a, export_a), (batch_b, export_b)])
def test_batches_leave_out_other_orders_before_they_travel(spark, whole, part):
    """The orders of the other batch are not joined."""
    rows = part(spark, SF_SMALL)
    optimized = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"o_orderkey#\d+L % 3\)", optimized)
    other = whole(dirty_export(spark, SF_SMALL))
    assert rows.exceptAll(other).isEmpty() and other.exceptAll(rows).isEmpty() and not rows.isEmpty()
