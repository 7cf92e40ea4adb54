"""Column expressions and small sinks."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import row
from tillstar.functions import cents_to_price, half_up_div, is_le_zero, missing_as_null, parse_date, title_case
from tillstar.operators.merge import load
from tillstar.session import scratch_path
from tillstar.sources.warehouse import Warehouse, to_records


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_half_up_div_rounds_half_away_from_zero(spark):
    got = one(spark, half_up_div("n", "d"), [(5, 2), (-5, 2), (4, 3), (-4, 3), (7, 7), (0, 3)], "n long, d long")
    assert got == [3, -3, 1, -1, 1, 0]


def test_cents_to_price_is_exact(spark):
    assert one(spark, cents_to_price("c"), [(101,), (-5,), (9999999,)], "c long") == [
        Decimal("1.01"), Decimal("-0.05"), Decimal("99999.99")
    ]


def test_le_zero_treats_missing_as_false(spark):
    assert one(spark, is_le_zero("q"), [(0,), (-1,), (1,), (None,)], "q int") == [True, True, False, False]


def test_title_case_keeps_null_and_digits(spark):
    got = one(spark, title_case("c"), [(None,), ("a1b",), ("ÉLAN vital",)], "c string")
    assert got == [None, "A1B", "Élan Vital"]


def test_title_case_of_plain_words_is_that_of_their_runs(spark):
    texts = ["UNITED KINGDOM", " two  words", "NATION_7", "a1", "a1b", "o'neil", "x\ty", "a b-c", "-", "", "end\n", "two\nlines", "ab\u0085", "İstanbul"]
    got = one(spark, title_case("c"), [(t,) for t in texts], "c string")
    assert got == ["United Kingdom", " Two  Words", "Nation_7", "A1", "A1B", "O'Neil", "X\tY", "A B-C", "-", "", "End\n", "Two\nLines", "Ab\u0085", "İstanbul"]


def test_title_case_splits_no_plain_words(spark):
    """Runs are a second branch: a text that is plain words is not cut."""
    shown = spark.range(1).select(title_case(F.col("id").cast("string")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.index("initcap") < shown.index("regexp_extract_all")


def test_missing_markers(spark):
    got = one(spark, missing_as_null("c"), [("NaN",), ("n/a",), ("#N/A",), ("x",), ("",)], "c string")
    assert got == [None, None, None, "x", None]


def test_parse_date_tries_formats_in_order(spark):
    expr = parse_date("t", ("M/d/yyyy H:mm", "yyyy-MM-dd"))
    got = one(spark, expr, [("12/1/2010 8:26",), ("2011-03-04",), ("junk",)], "t string")
    assert got == [dt.date(2010, 12, 1), dt.date(2011, 3, 4), None]


def test_to_records_is_bounded(spark):
    df = spark.range(5)
    assert to_records(df, limit=5) == [{"id": i} for i in range(5)]
    with pytest.raises(ValueError):
        to_records(df, limit=4)


def test_zone_map_with_default(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    zones = spark.createDataFrame([("Eire", "Europe")], "country string, zone string")
    raw = make_raw([row(country="EIRE"), row(stockcode="2", invoiceno="2", country="ICELAND")])
    load(wh, raw, "A", zone_map=zones)
    got = {r.country: r.zone for r in wh.table("country").collect()}
    assert got == {"Eire": "Europe", "Iceland": "Earth"}
