"""Hand-made edge cases E-1 ... E-16 (FIXTURES.md section 2)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import row
from tillstar.operators.clean import classify, clean, rejected
from tillstar.operators.constraints import enforce
from tillstar.operators.merge import load
from tillstar.operators.quality import quality_by_rule, quality_report
from tillstar.session import scratch_path
from tillstar.sources.export import HeaderError, read_export
from tillstar.sources.warehouse import Warehouse


def report(df):
    return quality_report(df).collect()[0].asDict()


def test_e1_identical_rows(make_raw):
    raw = make_raw([row(), row()])
    assert report(raw)["n_dup"] == 1
    assert clean(raw).count() == 1


def test_e2_duplicates_with_null_customer(make_raw):
    raw = make_raw([row(customerid=None), row(customerid=None)])
    assert report(raw)["n_dup"] == 1
    assert clean(raw).count() == 1


def test_e3_key_duplicate_first_in_file_wins(make_raw):
    raw = make_raw([row(quantity=2), row(quantity=5)])
    out = clean(raw).collect()
    assert [r.quantity for r in out] == [Decimal(2)]
    assert report(raw)["n_dup_key"] == 1


def test_e4_key_dedupe_runs_before_quantity_filter(make_raw):
    raw = make_raw([row(quantity=-1), row(quantity=6)])
    assert clean(raw).count() == 0
    labels = sorted(r.rejected_by for r in rejected(raw).collect())
    assert labels == ["duplicate_key", "quantity_le0"]


def test_e5_null_quantity_kept_by_cleaning_rejected_by_constraint(make_raw):
    raw = make_raw([row(quantity=None)])
    kept = clean(raw)
    assert kept.count() == 1
    ok, bad = enforce(kept)
    assert ok.count() == 0
    assert bad.collect()[0].rejected_by == "not_null:quantity"


def test_e6_zero_and_negative_price(make_raw):
    raw = make_raw([row(stockcode="1", unitprice=0), row(stockcode="2", unitprice=-5), row(stockcode="3")])
    assert [r.stockcode for r in clean(raw).collect()] == ["3"]
    assert report(raw)["n_price_le0"] == 2


def test_e7_letter_codes(make_raw):
    raw = make_raw([row(stockcode="POST"), row(stockcode="gift_01"), row(stockcode="85123A"), row(stockcode=None)])
    kept = clean(raw)
    assert sorted((r.stockcode or "<null>") for r in kept.collect()) == ["85123A", "<null>"]
    ok, bad = enforce(kept)
    assert [r.stockcode for r in ok.collect()] == ["85123A"]
    assert bad.collect()[0].rejected_by == "not_null:stockcode"
    assert report(raw)["n_letter_code"] == 2


def test_e8_title_case(make_raw):
    names = ["EIRE", "united KINGDOM", "channel-islands", "o'neil land"]
    raw = make_raw([row(stockcode=str(i), country=c) for i, c in enumerate(names)])
    got = {r.stockcode: r.country for r in clean(raw).collect()}
    assert [got[str(i)] for i in range(4)] == ["Eire", "United Kingdom", "Channel-Islands", "O'Neil Land"]


def _write_csv(tmp_path, name, lines):
    p = tmp_path / name
    p.write_bytes(("\n".join(lines) + "\n").encode("latin-1"))
    return str(p)


HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"


def test_e9_country_missing_numeric_and_nan_text(spark, tmp_path):
    path = _write_csv(tmp_path, "e9.csv", [
        HEADER,
        "1,10,a,1,12/1/2010 8:26,1.0,1.0,",
        "2,11,b,1,12/1/2010 8:26,1.0,1.0,123",
        "3,12,c,1,12/1/2010 8:26,1.0,1.0,NaN",
    ])
    raw = read_export(spark, path)
    intended = {r.invoiceno: r.country for r in clean(raw).collect()}
    written = {r.invoiceno: r.country for r in clean(raw, mode="as_written").collect()}
    assert intended == {"1": "Unspecified", "2": "Unspecified", "3": "Unspecified"}
    assert written == {"1": None, "2": "123", "3": None}


def test_e10_missing_description(make_raw):
    raw = make_raw([row(description=None)])
    assert clean(raw).collect()[0].description == "Description du produit à intégrer"
    assert clean(raw, mode="as_written").collect()[0].description is None


def test_e11_exact_cost_then_narrowing(spark, make_raw):
    raw = make_raw([row(unitprice="1.005", quantity=3)])
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    load(wh, raw, "b1")
    d = wh.table("detailinvoice").collect()[0]
    assert d.totalcost == Decimal("3.02")
    assert d.unitprice == Decimal("1.01")


def test_e12_cost_out_of_range_rejected(spark, make_raw):
    raw = make_raw([row(unitprice="250000", quantity=4), row(stockcode="2")])
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    load(wh, raw, "b1")
    assert [r.stockcode for r in wh.table("detailinvoice").collect()] == ["2"]
    rej = wh.rejected().collect()
    assert [r.rejected_by for r in rej] == ["decimal_range:totalcost"]


def test_e13_e14_first_batch_wins_and_reload_is_noop(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    a = make_raw([row(invoicedate="2010-12-01", description="first")])
    b = make_raw([row(invoicedate="2011-01-05", description="second", stockcode="99")])
    assert load(wh, a, "A")
    assert not load(wh, a, "A")
    assert load(wh, a, "A-again")
    assert load(wh, b, "B")
    inv = wh.table("invoice").collect()
    assert len(inv) == 1 and str(inv[0].invoicedate) == "2010-12-01"
    assert wh.table("detailinvoice").count() == 2
    assert {r.stockcode: r.description for r in wh.table("product").collect()} == {"85123": "first", "99": "second"}
    assert [r.zone for r in wh.table("country").collect()] == ["Earth"]


def test_e15_empty_export(spark, tmp_path):
    path = _write_csv(tmp_path, "empty.csv", [HEADER])
    r = quality_report(read_export(spark, path)).collect()[0].asDict()
    assert r["n_rows"] == 0 and r["to_delete"] == 0 and r["n_null_cells"] == 0
    assert r["pct_deleted"] is None


def test_e16_row_breaking_two_rules(make_raw):
    raw = make_raw([row(quantity=-2, unitprice=0), row(stockcode="2")])
    r = report(raw)
    assert r["to_delete"] == 2
    by_rule = {x.rejected_by: x.n_rows for x in quality_by_rule(raw).collect()}
    assert by_rule["quantity_le0"] == 1 and by_rule["price_le0"] == 0 and by_rule["kept"] == 1
    assert [x.rejected_by for x in classify(raw).filter(F.col("rejected_by").isNotNull()).collect()] == [
        "quantity_le0"
    ]


def test_header_contract_is_checked(spark, tmp_path):
    path = _write_csv(tmp_path, "bad.csv", ["InvoiceNo,StockCode", "1,2"])
    with pytest.raises(HeaderError):
        read_export(spark, path)


def test_reset_needs_confirmation(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    load(wh, make_raw([row()]), "A")
    with pytest.raises(PermissionError):
        wh.reset()
    wh.reset(confirm=True)
    assert all(wh.table(n).count() == 0 for n in ("country", "product", "invoice", "detailinvoice"))
