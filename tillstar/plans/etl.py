"""Registered ETL queries: quality, cleaning, constraints, merge, CSV, staging, stream.

All run on the dirty export derived from the driver tables (FIXTURES.md
section 3).  Keys that write (CSV, warehouse, stream) use fresh folders below
the session's shared checkpoint folder and return a lazy read of what they wrote.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.operators import clean as C
from tillstar.operators import constraints as K
from tillstar.operators.merge import load
from tillstar.operators.quality import quality_by_rule, quality_report
from tillstar.operators import analytics as A
from tillstar.plans.testdata import ORDER, batch_a, batch_b, dirty_export, export_a, export_b, star, strained_export, table, text_export
from tillstar.schema import LOAD_ORDER, MISSING_DESCRIPTION, RAW_COLUMNS, STAR, UNSPECIFIED_COUNTRY, WIDE
from tillstar.session import scratch_path, tidy_shuffles
from tillstar.sources.export import new_files, read_export, read_landing, write_export
from tillstar.sources.warehouse import SURROGATE, Warehouse
from tillstar.streaming.ingest import ingest

CLEAN_OUT = list(C.CLEAN_COLUMNS)
# Header spelling of the original export contract (any case is accepted).
MIXED_HEADER = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
ISO_DATE = "yyyy-MM-dd"

def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return dirty_export(spark, d)


def _two_batch_warehouse(spark: SparkSession, d: str) -> Warehouse:
    """Batch A then batch B merged into a fresh warehouse."""
    wh = _warehouse(spark)
    load(wh, export_a(spark, d), "A")
    load(wh, export_b(spark, d), "B")
    return wh


def _warehouse(spark: SparkSession) -> Warehouse:
    """A fresh warehouse with room for any order and customer number of the driver tables."""
    return Warehouse(spark, scratch_path(spark, "warehouse"), WIDE)


def _counts(wh: Warehouse) -> DataFrame:
    parts = [wh.table(n).agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n_rows")) for n in LOAD_ORDER]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_twice(spark: SparkSession, d: str) -> DataFrame:
    wh = _warehouse(spark)
    rows = _dirty(spark, d)
    load(wh, rows, "A")
    load(wh, rows, "A")   # committed id: no-op
    load(wh, rows, "A2")  # same rows, new id: nothing new
    return _counts(wh)


def warehouse_reset(spark: SparkSession, d: str) -> DataFrame:
    """A load, a reset, and a load of other rows under the same batch id: only those are there."""
    wh = _warehouse(spark)
    load(wh, _dirty(spark, d), "A")
    wh.reset(confirm=True)
    if wh.rejected() is not None or any(t.head(1) for t in wh.star().values()):
        raise RuntimeError("rows survived the reset")
    load(wh, export_b(spark, d), "A")
    return wh.table("detailinvoice")


def load_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What a load into a warehouse with the default lengths and widths refuses, with the rule broken."""
    wh = Warehouse(spark, scratch_path(spark, "warehouse"))
    load(wh, strained_export(_dirty(spark, d)), "A")
    return wh.rejected().select(*RAW_COLUMNS, "rejected_by")


def load_long_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Invoices whose numbers have 8 and more digits load where the limits allow them."""
    wh = _warehouse(spark)
    longer = F.concat("invoiceno", F.lit("00000000"))
    load(wh, _dirty(spark, d).withColumn("invoiceno", longer), "A")
    return wh.table("invoice")


def _text_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "export")
    write_export(text_export(_dirty(spark, d)), path)
    return read_export(spark, path, order_by="path")


def clean_rows_csv(spark: SparkSession, d: str) -> DataFrame:
    return C.clean(_text_csv(spark, d)).select(*RAW_COLUMNS, F.col("totalcost").cast("decimal(28,8)").alias("totalcost"))


# A second spelling of the contract: other order, other case.
OTHER_ORDER = ("STOCKCODE", "InvoiceNo", "unitprice", "Country", "Quantity", "description", "customerID", "INVOICEDATE")


def _mixed_landing(spark: SparkSession, d: str) -> str:
    """A landing folder whose two exports have their columns in different order."""
    landing = scratch_path(spark, "landing")
    dirty = _dirty(spark, d)
    write_export(batch_a(dirty), f"{landing}/1")
    text = batch_b(dirty).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), ORDER).sortWithinPartitions(ORDER)
    cells = {c.lower(): F.col(c.lower()).cast("string") for c in OTHER_ORDER}
    cells["invoicedate"] = F.date_format(F.col("invoicedate").cast("timestamp"), "M/d/yyyy H:mm")
    rows = text.select(*[cells[c.lower()].alias(c) for c in OTHER_ORDER])
    with tidy_shuffles(spark):
        rows.write.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "ISO-8859-1").csv(f"{landing}/2")
    return landing


def landing_mixed_headers(spark: SparkSession, d: str) -> DataFrame:
    wh = _warehouse(spark)
    load(wh, read_landing(spark, _mixed_landing(spark, d), order_by="path"), "A")
    return wh.table("detailinvoice")


def stream_mixed_headers(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "warehouse")
    ingest(spark, _mixed_landing(spark, d), root, scratch_path(spark, "stream-checkpoint"), order_by="path", limits=WIDE)
    return Warehouse(spark, root, WIDE).table("detailinvoice")


def load_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches loaded side by side: whoever commits first, a key is inserted once."""
    root, dirty = scratch_path(spark, "warehouse"), _dirty(spark, d)
    odd = dirty.filter(F.col(ORDER)["l_orderkey"] % 3 != 1)
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(load, Warehouse(spark, root, WIDE), rows, name) for name, rows in (("A", batch_a(dirty)), ("B", odd))]
        if not all(j.result() for j in jobs):
            raise RuntimeError("a batch was not loaded")
    return Warehouse(spark, root, WIDE).table("detailinvoice")


def load_zone_restamp(spark: SparkSession, d: str) -> DataFrame:
    """A zone map that comes with the second batch stamps the countries of the first one too."""
    wh = _warehouse(spark)
    load(wh, export_a(spark, d), "A")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    zones = nation.filter("n_nationkey % 4 <> 0").join(region, nation["n_regionkey"] == region["r_regionkey"])
    load(wh, export_b(spark, d), "B", zone_map=zones.select(C.title_case("n_name").alias("country"), F.col("r_name").alias("zone")))
    return wh.table("country")


def load_surrogate(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of fact rows: those of the first batch come before those of the second."""
    wh = Warehouse(spark, scratch_path(spark, "warehouse"), WIDE, surrogate=True)
    load(wh, export_a(spark, d), "A")
    first = wh.table("detailinvoice").count()
    load(wh, export_b(spark, d), "B")
    ids = F.col(SURROGATE)
    return wh.table("detailinvoice").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(ids).alias("n_ids"),
        F.min(ids).alias("first_id"),
        F.max(ids).alias("last_id"),
        F.count_if((F.col("invoiceno").cast("long") % 3 == 0) & (ids <= first)).alias("n_late_among_first"),
        F.count_if(ids <= first).alias("n_first"),
    )


def load_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Both batches, compacted, and one of them loaded again under another id."""
    wh = _two_batch_warehouse(spark, d)
    if not wh.compact():
        raise RuntimeError("nothing was compacted")
    load(wh, export_a(spark, d), "A2")
    return wh.table("detailinvoice")


def warehouse_price_list_wide(spark: SparkSession, d: str) -> DataFrame:
    """Prices beyond six digits in a warehouse that has room for them."""
    wh = _warehouse(spark)
    rich = (F.col("unitprice") * 100_000).cast(_dirty(spark, d).schema["unitprice"].dataType)
    load(wh, batch_a(_dirty(spark, d)).withColumn("unitprice", rich), "A")
    return A.price_list(wh.star())


def csv_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Backslash escapes written into an export's descriptions, decoded when it is read."""
    path = scratch_path(spark, "export")
    part = F.col(ORDER)["l_partkey"]
    tails = [r"\x41\u00e9", r"\\n", r"\101\tb", r"c:\q", "plain"]
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), (part % 5 + 1).cast("int"))
    write_export(_dirty(spark, d).withColumn("description", F.concat("description", tail)), path)
    back = read_export(spark, path, order_by="path", escapes=True)
    return back.select("invoiceno", "stockcode", "description")


def stage_replace(spark: SparkSession, d: str) -> DataFrame:
    wh = Warehouse(spark, scratch_path(spark, "warehouse"))
    dirty = _dirty(spark, d)
    wh.stage(C.clean(batch_a(dirty)), "current")
    staged = wh.stage(C.clean(batch_b(dirty)), "current")
    return staged.select(*CLEAN_OUT)


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "export")
    write_export(_dirty(spark, d), path)
    back = read_export(spark, path, order_by="path")
    return _as_written(back).select(*RAW_COLUMNS, F.size("_unparsed").alias("n_unparsed"))


def _as_written(back: DataFrame) -> DataFrame:
    """What the typed export had, from the wider types of a CSV read."""
    kinds = {"quantity": "decimal(8,0)", "unitprice": "decimal(18,6)", "invoicedate": "date", "totalcost": "decimal(27,6)"}
    return back.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if c in back.columns})


def csv_header_any_case(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "export")
    write_export(_dirty(spark, d), path, header=MIXED_HEADER)
    back = read_export(spark, path, order_by="path")
    return _as_written(C.clean(back)).select(*CLEAN_OUT)


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    landing = scratch_path(spark, "landing")
    root = scratch_path(spark, "warehouse")
    ckpt = scratch_path(spark, "stream-checkpoint")
    dirty = _dirty(spark, d)
    for batch in (batch_a(dirty), batch_b(dirty)):
        write_export(batch, landing, mode="append")
        ingest(spark, landing, root, ckpt, order_by="path", limits=WIDE)
    return Warehouse(spark, root, WIDE).table("detailinvoice")


def landing_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Monthly exports dropped into sub-folders of one landing folder, merged in turn.

    Each run scans the whole landing folder recursively and skips the files the
    warehouse ledger already lists (S05, S06); nothing is deleted.
    """
    landing = scratch_path(spark, "landing")
    wh = _warehouse(spark)
    dirty = _dirty(spark, d)
    for bid, batch in (("A", batch_a(dirty)), ("B", batch_b(dirty))):
        write_export(batch, f"{landing}/{bid}")
        done = wh.file_ledger()
        load(wh, read_landing(spark, landing, order_by="path", exclude=done), bid, files=new_files(spark, landing, done))
    return wh.table("detailinvoice")


def _date_text(spark: SparkSession, d: str) -> DataFrame:
    """Invoice dates as text, every 13th order written in ISO form."""
    dirty = _dirty(spark, d)
    iso = F.col(ORDER)["l_orderkey"] % 13 == 0
    ts = F.col("invoicedate").cast("timestamp")
    return dirty.select(
        F.when(iso, F.date_format(ts, ISO_DATE)).otherwise(F.date_format(ts, "M/d/yyyy H:mm")).alias("invoicedate")
    )


def constraint_dates(spark: SparkSession, d: str) -> DataFrame:
    text = _date_text(spark, d)
    strict = K.date_report(text, "invoicedate", ["M/d/yyyy H:mm"]).withColumn("formats", F.lit("default"))
    both = K.date_report(text, "invoicedate", ["M/d/yyyy H:mm", ISO_DATE]).withColumn(
        "formats", F.lit("default+iso")
    )
    return strict.unionByName(both)


def constraint_unique(spark: SparkSession, d: str) -> DataFrame:
    s = star(spark, d)
    out = K.unique_report(_dirty(spark, d), "export", ["invoiceno", "stockcode"])
    for name in LOAD_ORDER:
        out = out.unionByName(K.unique_report(s[name], name, list(STAR[name][1])))
    return out


def constraint_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Against parents of which some rows are missing."""
    s = star(spark, d)
    invoice = s["invoice"].filter(~F.col("invoiceno").endswith("7"))
    product = s["product"].filter(~F.col("stockcode").endswith("3"))
    country = s["country"].filter(~F.col("country").endswith("4"))
    return (
        K.orphan_report(s["detailinvoice"], invoice, "detailinvoice->invoice", "invoiceno")
        .unionByName(K.orphan_report(s["detailinvoice"], product, "detailinvoice->product", "stockcode"))
        .unionByName(K.orphan_report(s["invoice"], country, "invoice->country", "country"))
    )


def etl_queries() -> dict:
    q = {
        "quality_report": lambda spark, d: quality_report(_dirty(spark, d)),
        "quality_report_csv": lambda spark, d: quality_report(_text_csv(spark, d)),
        "quality_report_clean": lambda spark, d: quality_report(C.clean(_dirty(spark, d))),
        "clean_rows_csv": clean_rows_csv,
        "quality_by_rule": lambda spark, d: quality_by_rule(_dirty(spark, d)),
        "clean_rows": lambda spark, d: C.clean(_dirty(spark, d)).select(*CLEAN_OUT),
        "clean_rows_as_written": lambda spark, d: C.clean(_dirty(spark, d), mode="as_written").select(*CLEAN_OUT),
        "rejected_rows": lambda spark, d: C.rejected(_dirty(spark, d)).select(*RAW_COLUMNS, "rejected_by"),
        "clean_country_title": lambda spark, d: _dirty(spark, d)
        .groupBy(F.col("country").alias("country_raw"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("country", C.title_case("country_raw")),
        "clean_fill_missing": lambda spark, d: C.clean(strained_export(_dirty(spark, d)))
        .filter((F.col("description") == MISSING_DESCRIPTION) | (F.col("country") == UNSPECIFIED_COUNTRY))
        .select("invoiceno", "stockcode", "description", "country"),
        "constraint_not_null": lambda spark, d: K.not_null_report(strained_export(_dirty(spark, d))),
        "constraint_length": lambda spark, d: K.length_report(strained_export(_dirty(spark, d))),
        "constraint_decimal_range": lambda spark, d: K.decimal_range_report(C.with_totalcost(strained_export(_dirty(spark, d)))),
        "constraint_unique": constraint_unique,
        "constraint_orphans": constraint_orphans,
        "constraint_dates": constraint_dates,
    }
    for name, key in (("country", "load_country"), ("product", "load_product"),
                      ("invoice", "load_invoice"), ("detailinvoice", "load_detail")):
        q[key] = (lambda n: lambda spark, d: _two_batch_warehouse(spark, d).table(n))(name)
    q["load_twice_is_noop"] = load_twice
    q["warehouse_reset"] = warehouse_reset
    q["stage_replace"] = stage_replace
    q["csv_round_trip"] = csv_round_trip
    q["csv_header_any_case"] = csv_header_any_case
    q["stream_ingest"] = stream_ingest
    q["landing_incremental"] = landing_incremental
    q["landing_mixed_headers"] = landing_mixed_headers
    q["stream_mixed_headers"] = stream_mixed_headers
    q["load_rejected"] = load_rejected
    q["load_long_numbers"] = load_long_numbers
    q["load_interleaved"] = load_interleaved
    q["load_zone_restamp"] = load_zone_restamp
    q["load_surrogate"] = load_surrogate
    q["load_compacted"] = load_compacted
    q["csv_escapes"] = csv_escapes
    q["warehouse_price_list_wide"] = warehouse_price_list_wide
    q["warehouse_kpi"] = lambda spark, d: A.kpis(_two_batch_warehouse(spark, d).star())
    q["warehouse_product_top"] = lambda spark, d: A.ranking(_two_batch_warehouse(spark, d).star(), "stockcode")
    q["warehouse_country_top"] = lambda spark, d: A.ranking(_two_batch_warehouse(spark, d).star(), "country")
    q["warehouse_monthly"] = lambda spark, d: A.monthly(_two_batch_warehouse(spark, d).star())
    q["warehouse_price_list"] = lambda spark, d: A.price_list(_two_batch_warehouse(spark, d).star())
    return q
