"""Raw cells judged as written, columns by name, warehouse limits, resets, paging."""

import pytest
from pyspark.sql import functions as F

from tillstar.operators import analytics as A
from tillstar.operators.clean import clean
from tillstar.operators.merge import load
from tillstar.operators.quality import quality_report
from tillstar.schema import WIDE, Limits
from tillstar.session import checkpoint_root
from tillstar.sources.export import HeaderError, read_export, read_landing
from tillstar.sources.warehouse import Warehouse
from tillstar.streaming.ingest import ingest

HEAD = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"


def put(folder, name, lines, head=HEAD):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([head, *lines]) + "\n", encoding="ISO-8859-1")
    return str(folder)


def test_rules_see_what_the_file_says(spark, tmp_path):
    lines = [
        "1,10,a,6,12/1/2010 8:26,2.5,1,France",
        "1,10,a,6,12/1/2010 9:59,2.5,1,France",  # same but for the time: no full duplicate
        "2,10,a,0.4,12/1/2010 8:26,2.5,1,France",  # not zero
        "3,10,a,6.5,12/1/2010 8:26,2.0,1,France",
        "4,10,a,6,soon,0.0000004,1,France",  # a date that does not parse is no missing cell
        "5,10,a,6,12/1/2010 8:26,1e-30,1,France",  # too small for the type: not judged as zero
    ]
    raw = read_export(spark, put(tmp_path / "in", "a.csv", lines))
    report = quality_report(raw).first()
    assert (report.n_dup, report.n_dup_key, report.n_qty_le0, report.n_price_le0, report.n_null_cells) == (0, 1, 0, 0, 0)
    rows = {r.invoiceno: r for r in clean(raw).collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "5"] and rows["3"].totalcost == 13
    assert [u.column for u in rows["4"]._unparsed] == ["invoicedate"] and [u.column for u in rows["5"]._unparsed] == ["unitprice"]


OTHER = "COUNTRY,stockcode,INVOICENO,Description,UnitPrice,Quantity,CustomerID,InvoiceDate,Extra"


@pytest.mark.parametrize("way", ["batch", "stream"])
def test_columns_are_matched_by_name(spark, tmp_path, way):
    folder = put(tmp_path / "in", "a.csv", ["1,10,a,6,12/1/2010 8:26,2.5,1,France"])
    put(tmp_path / "in" / "sub", "b.csv", ["Italy,20,2,b,3.5,7,1,12/1/2010 8:26,x"], OTHER)
    wh = Warehouse(spark, str(tmp_path / "wh"))
    if way == "batch":
        load(wh, read_landing(spark, folder), "A")
    else:
        ingest(spark, folder, wh.root, str(tmp_path / "cp"))
    got = {(r.invoiceno, r.stockcode, float(r.unitprice), int(r.quantity)) for r in wh.table("detailinvoice").collect()}
    assert got == {("1", "10", 2.5, 6), ("2", "20", 3.5, 7)}


def test_missing_columns_fail_in_both_paths(spark, tmp_path):
    folder = put(tmp_path / "in", "a.csv", ["1,10"], "InvoiceNo,StockCode")
    with pytest.raises(HeaderError):
        read_landing(spark, folder)
    with pytest.raises(Exception, match="missing columns"):
        ingest(spark, folder, str(tmp_path / "wh"), str(tmp_path / "cp"))


def test_empty_landing_folder_file(spark, tmp_path):
    folder = put(tmp_path / "in", "a.csv", [])
    assert read_landing(spark, folder).count() == 0
    assert read_landing(spark, folder, exclude=["file:" + str(tmp_path / "in" / "a.csv")]).count() == 0


def test_quoted_line_breaks_with_multiline(spark, tmp_path):
    folder = put(tmp_path / "in", "a.csv", ['1,10,"a\nb",6,12/1/2010 8:26,2.5,1,France'])
    assert read_landing(spark, folder, multiline=True).first().description == "a\nb"


def test_archive_moves_consumed_files(spark, tmp_path):
    folder = put(tmp_path / "in", "a.csv", ["1,10,a,6,12/1/2010 8:26,2.5,1,France"])
    args = (spark, folder, str(tmp_path / "wh"), str(tmp_path / "cp"))
    ingest(*args, archive_dir=str(tmp_path / "old"))
    put(tmp_path / "in", "b.csv", ["2,10,a,6,12/1/2010 8:26,2.5,1,France"])
    ingest(*args, archive_dir=str(tmp_path / "old"))
    put(tmp_path / "in", "c.csv", ["3,10,a,6,12/1/2010 8:26,2.5,1,France"])
    ingest(*args, archive_dir=str(tmp_path / "old"))
    assert Warehouse(spark, str(tmp_path / "wh")).table("invoice").count() == 3
    assert list((tmp_path / "old").rglob("a.csv")) and not (tmp_path / "in" / "a.csv").exists()


def test_one_order_rule_with_max_files(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path), str(tmp_path / "wh"), str(tmp_path / "cp"), order_by="path", max_files=1)


def test_limits_are_the_warehouses(spark, make_raw, tmp_path):
    from tests.conftest import row

    rows = [row(invoiceno="10000001"), row(invoiceno="2", unitprice="600000", quantity=2)]
    small, wide = Warehouse(spark, str(tmp_path / "a")), Warehouse(spark, str(tmp_path / "b"), WIDE)
    load(small, make_raw(rows), "A")
    load(wide, make_raw(rows), "A")
    assert small.table("invoice").count() == 0 and wide.table("invoice").count() == 2
    assert {r.rejected_by for r in small.rejected().collect()} == {"max_length:invoiceno", "decimal_range:totalcost"}
    assert wide.rejected().count() == 0 and Limits().max_len["invoiceno"] == 7


def test_reset_empties_everything_and_crashed_rejects_stay_unseen(spark, make_raw, tmp_path):
    from tests.conftest import row

    wh = Warehouse(spark, str(tmp_path / "wh"))
    raw = make_raw([row(), row(invoiceno="2", quantity=-1)])
    load(wh, raw, "A")
    wh.write_rejected(wh.rejected().drop("batch_id"), "crashed")  # a load that never committed
    assert wh.rejected().count() == 1
    wh.reset(confirm=True)
    assert wh.rejected() is None and wh.table("detailinvoice").count() == 0
    load(wh, raw, "A")
    assert wh.rejected().count() == 1 and wh.table("detailinvoice").count() == 1


def test_batches_read_only_their_key_range(spark, make_raw, tmp_path):
    from tillstar.operators.merge import insert_if_absent

    target = spark.createDataFrame([("1", "a"), ("9", "b")], "invoiceno string, stockcode string")
    target.write.parquet(str(tmp_path / "t"))
    batch = spark.createDataFrame([("1", "a"), ("2", "a")], "invoiceno string, stockcode string")
    new = insert_if_absent(spark.read.parquet(str(tmp_path / "t")), batch, ["invoiceno", "stockcode"], unique=True, bounds=("1", "2"))
    plan = new._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(invoiceno,1)" in plan and "LessThanOrEqual(invoiceno,2)" in plan
    assert [tuple(r) for r in new.collect()] == [("2", "a")]


def _star(spark):
    fact = [("i1", "p1", "1.10"), ("i1", "p2", "2.20"), ("i2", "p2", "2.20"), ("i2", "p3", None), ("i3", "p4", "9.95")]
    inv = [("i1", "2010-03-01", "France"), ("i2", "2010-01-05", "Italy"), ("i3", "2011-02-05", "France")]
    prod = [("p1", "Lamp"), ("p2", "Table 9.9"), ("p3", "Chair"), ("p4", None)]
    detail = spark.createDataFrame(fact, "invoiceno string, stockcode string, p string").selectExpr(
        "invoiceno", "stockcode", "cast(p as decimal(8,2)) unitprice", "cast(1 as decimal(8,0)) quantity", "cast(p as decimal(8,2)) totalcost"
    )
    invoice = spark.createDataFrame(inv, "invoiceno string, d string, country string").selectExpr(
        "invoiceno", "cast(d as date) invoicedate", "cast(1 as decimal(8,1)) customerid", "country"
    )
    return {"detailinvoice": detail, "invoice": invoice, "product": spark.createDataFrame(prod, "stockcode string, description string"),
            "country": invoice.select("country").distinct().withColumn("zone", F.lit("Earth"))}


def test_results_come_in_order(spark):
    s = _star(spark)
    assert [r.month for r in A.monthly(s).collect()] == [1, 2, 3]
    assert [r.month for r in A.monthly_dense(s).collect()] == list(range(1, 13))
    assert [r.stockcode for r in A.price_list(s).collect()] == ["p1", "p2", "p3", "p4"]
    pairs = [(r.dim, r.member, r.n_sales, r["rank"]) for r in A.paired_ranking(s, n=2).collect()]
    assert pairs == [("country", "France", 3, 1), ("country", "Italy", 2, 2), ("product", "p2", 2, 1), ("product", "p1", 1, 2)]


@pytest.mark.parametrize("sort,descending", [("stockcode", False), ("description", True), ("mean_price", False), ("mean_price", True)])
def test_search_pages_by_last_key(spark, sort, descending):
    s = _star(spark)
    whole = A.price_search(s, "", n=10, sort=sort, descending=descending).collect()
    assert len(whole) == 4
    pages, after = [], None
    while True:
        page = A.price_search(s, "", n=1, sort=sort, descending=descending, after=after).collect()
        if not page:
            break
        pages += page
        after = (page[-1][sort], page[-1].stockcode)
    assert pages == whole
    assert {r.stockcode for r in A.price_search(s, "9.9").collect()} == {"p2", "p4"}


def test_scratch_needs_a_shared_folder_off_local_masters():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        checkpoint_root(Session())
