"""Commits beside each other, key filters, restamps, compaction, surrogate keys, partial aggregates."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import row
from tillstar.operators import analytics as A
from tillstar.operators import keyindex, merge
from tillstar.operators.clean import classify
from tillstar.operators.merge import load
from tillstar.schema import WIDE, Limits
from tillstar.session import SHUFFLE_CLEANUP, scratch_path, tidy_shuffles
from tillstar.sources.export import header_lines, new_files, read_landing
from tillstar.sources.manifest import ConflictError, VersionExists
from tillstar.sources.warehouse import Warehouse


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def facts(wh):
    return sorted((r.invoiceno, r.stockcode, str(r.unitprice)) for r in wh.table("detailinvoice").collect())


def committing_first(wh, other):
    """``other`` runs between the read and the first commit of the next load into ``wh``."""
    plain, left = wh.commit, [other]

    def commit(*args, **kw):
        if left:
            left.pop()()
        plain(*args, **kw)

    wh.commit = commit
    return wh


def test_a_load_that_commits_in_between_wins_and_keys_stay_unique(spark, make_raw):
    root = scratch_path(spark, "wh")
    early = make_raw([row(invoiceno="1", stockcode="10", unitprice="1.00"), row(invoiceno="2", stockcode="10")])
    late = make_raw([row(invoiceno="1", stockcode="10", unitprice="9.00"), row(invoiceno="1", stockcode="11"), row(invoiceno="3", stockcode="10")])
    wh = committing_first(Warehouse(spark, root), lambda: load(Warehouse(spark, root), early, "early"))
    assert load(wh, late, "late")
    got = facts(wh)
    assert got == [("1", "10", "1.00"), ("1", "11", "2.55"), ("2", "10", "2.55"), ("3", "10", "2.55")]
    assert wh.committed() == ["early", "late"] and wh.table("invoice").count() == 3 and wh.table("country").count() == 1
    star = wh.star()
    assert A.kpis(star).first().invoices == 3 and star.no_orphans


def test_the_same_batch_loaded_twice_at_once_counts_once(spark, make_raw):
    root = scratch_path(spark, "wh")
    raw = make_raw([row(), row(invoiceno="2", quantity=-1)])
    wh = committing_first(Warehouse(spark, root), lambda: load(Warehouse(spark, root), raw, "A"))
    assert not load(wh, raw, "A")
    assert len(facts(wh)) == 1 and wh.rejected().count() == 1


def test_a_reset_in_between_is_seen(spark, make_raw):
    root = scratch_path(spark, "wh")
    load(Warehouse(spark, root), make_raw([row()]), "A")
    wh = committing_first(Warehouse(spark, root), lambda: Warehouse(spark, root).reset(confirm=True))
    assert load(wh, make_raw([row(unitprice="7"), row(invoiceno="2")]), "B")
    assert [f[0] for f in facts(wh)] == ["2", "536365"] and facts(wh)[1][2] == "7.00"


def test_loads_drop_shuffle_files_and_restore_the_setting(spark, make_raw, monkeypatch):
    was, seen = spark.conf.get(SHUFFLE_CLEANUP, None), []
    plain = merge.add_rows
    monkeypatch.setattr(merge, "add_rows", lambda *a: seen.append(spark.conf.get(SHUFFLE_CLEANUP)) or plain(*a))
    with tidy_shuffles(spark):
        load(Warehouse(spark, scratch_path(spark, "wh")), make_raw([row()]), "A")
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert seen == ["true"] and spark.conf.get(SHUFFLE_CLEANUP, None) == was


@pytest.mark.parametrize("few", [0, 1, 100])
def test_known_products_do_not_travel(spark, make_raw, monkeypatch, few):
    monkeypatch.setattr(merge, "FEW_NEW", few)
    wh, ranked = Warehouse(spark, scratch_path(spark, "wh")), []
    load(wh, make_raw([row(invoiceno="1", stockcode=str(n), description="old") for n in range(5)]), "A")
    plain = merge.insert_if_absent
    monkeypatch.setattr(merge, "insert_if_absent", lambda t, b, keys, **kw: ranked.append((tuple(keys), b.count())) or plain(t, b, keys, **kw))
    late = [row(invoiceno="2", stockcode=str(n % 6), description=f"new {n}") for n in range(4, 6)] + [row(invoiceno="3", stockcode="5", description="last")]
    load(wh, make_raw(late), "B")
    assert sorted((r.stockcode, r.description) for r in wh.table("product").collect()) == [*((str(n), "old") for n in range(5)), ("5", "new 5")]
    assert dict(ranked)[("stockcode",)] == (2 if few else 3)


def test_the_first_loadable_row_brings_the_invoice(spark, make_raw):
    rows = [
        row(invoiceno="1", stockcode="9", quantity=-1, country="Spain"),  # refused: brings nothing
        row(invoiceno="1", stockcode="8", country="France", invoicedate="2010-12-02"),
        row(invoiceno="1", stockcode="2", country="Italy"),
        row(invoiceno="2", stockcode="P5", country="Spain"),  # no row of invoice 2 is kept
        row(invoiceno=None, country="Spain"),
        row(invoiceno="3", stockcode="5", country="Malta"),
        row(invoiceno="3", stockcode="5", country="Italy"),
        row(invoiceno="3", stockcode="4", country="Malta"),
    ]
    raw = make_raw(rows)
    raw = raw.unionByName(raw.filter("_order = 5").withColumn("country", F.lit("Spain")))  # two rows at one place
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    assert load(wh, raw, "A")
    got = sorted((r.invoiceno, r.country) for r in wh.table("invoice").collect())
    assert got in ([("1", "France"), ("3", "Malta")], [("1", "France"), ("3", "Spain")])
    assert sorted(c for c in wh.rejected().columns if c.startswith("_")) == ["_order"]
    by_key, by_invoice = (classify(raw, by_invoice=b).select("_order", "country", "rejected_by") for b in (False, True))
    assert sorted(by_key.collect(), key=str) == sorted(by_invoice.collect(), key=str)


def test_a_version_is_created_once(spark):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    seen = wh.state()
    wh.commit(seen, "load", {}, batch_id="A")
    with pytest.raises(VersionExists):
        Warehouse(spark, wh.root).commit(seen, "load", {}, batch_id="B")
    assert wh.committed() == ["A"]


def many_batches(spark, make_raw, n=6, **kw):
    """Batch i brings the invoices i, i + n, ... so that every batch spreads over the whole range."""
    wh = Warehouse(spark, scratch_path(spark, "wh"), WIDE, **kw)
    for i in range(n):
        rows = [row(invoiceno=str(100_000 + i + n * j), stockcode=str(j % 3), unitprice=str(i + 1), invoicedate=f"2010-{i % 12 + 1:02d}-01") for j in range(12)]
        assert load(wh, make_raw(rows), f"b{i}")
    return wh


def test_spread_batches_read_few_buckets_of_history(spark, make_raw):
    wh = many_batches(spark, make_raw, key_buckets=8)
    state = wh.state()
    batch = make_raw([row(invoiceno="100000", stockcode="0"), row(invoiceno="100071"), row(invoiceno="100035.5")])
    rows = wh.may_hold("invoice", batch, state, "100000", "100071")
    every = wh.table("invoice", state)
    assert len(rows.inputFiles()) <= len(every.inputFiles())
    read = {tuple(p.split("/")[-3:-1]) for (p,) in rows.select(F.input_file_name()).distinct().collect()}
    known = {tuple(p.split("/")[-3:-1]) for (p,) in every.select(F.input_file_name()).distinct().collect()}
    assert 2 <= len(read) <= 6 < 30 < len(known)  # of 6 folders with up to 8 buckets each
    assert "PartitionFilters" in plan(rows) and {"100000", "100071"} <= {r.invoiceno for r in rows.collect()}
    assert wh.may_hold("invoice", make_raw([row(invoiceno="9")]), state, "9", "9").count() == 0
    before = facts(wh)
    assert load(wh, batch, "spread") and set(facts(wh)) - set(before) == {("100071", "85123", "2.55"), ("100035.5", "85123", "2.55")}


def test_filters_never_lose_a_key(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("invoiceno"), (F.col("id") % 7).cast("string").alias("stockcode"))
    keys = ["invoiceno", "stockcode"]
    index = keyindex.build(rows, "t", keys, keyindex.words_for(5000, 4), 4).withColumn("folder", F.lit("f"))
    one = [r for r in keyindex.probe(index, rows.limit(1), keys, [keyindex.words_for(5000, 4)], 4).collect()]
    assert len(one) == 1
    other = rows.select(F.concat("invoiceno", F.lit("x")).alias("invoiceno"), "stockcode")
    n = F.lit(keyindex.words_for(5000, 4)).cast("long")
    tested = other.select(keyindex.bucket_of("invoiceno", 4).alias("bucket"), keyindex._word(keys, n).alias("word"), keyindex._mask(keys).alias("m")).join(index, ["bucket", "word"])
    assert tested.filter(F.col("bits").bitwiseAND(F.col("m")) == F.col("m")).count() < 250  # false alarms: a few in a hundred
    own = rows.select(keyindex.bucket_of("invoiceno", 4).alias("bucket"), keyindex._word(keys, n).alias("word"), keyindex._mask(keys).alias("m")).join(index, ["bucket", "word"])
    assert own.filter(F.col("bits").bitwiseAND(F.col("m")) == F.col("m")).count() == 5000


def test_zone_map_reaches_earlier_countries(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    zones = spark.createDataFrame([("France", "Europe"), ("Japan", "Asia")], "country string, zone string")
    load(wh, make_raw([row(country="FRANCE"), row(invoiceno="2", country="PERU")]), "A")
    load(wh, make_raw([row(invoiceno="3", country="JAPAN")]), "B", zone_map=zones)
    zone = lambda: {r.country: r.zone for r in wh.table("country").collect()}
    assert zone() == {"France": "Europe", "Japan": "Asia", "Peru": "Earth"}
    load(wh, make_raw([row(invoiceno="4", country="CHAD")]), "C")  # says nothing about zones
    assert zone() == {"France": "Europe", "Japan": "Asia", "Peru": "Earth", "Chad": "Earth"}
    assert not wh.restamp(zones)
    assert wh.restamp(spark.createDataFrame([("Chad", "Africa")], "country string, zone string")) and zone()["Chad"] == "Africa"


def test_compaction(spark, make_raw):
    wh = many_batches(spark, make_raw, n=8)
    before, kpis = facts(wh), A.kpis(wh.star()).first()
    files = {n: len(wh.table(n).inputFiles()) for n in ("invoice", "detailinvoice")}
    old = wh.state()
    crashing = Warehouse(spark, wh.root, WIDE)

    def fail(*_, **__):
        raise OSError("lost")

    crashing.commit = fail
    with pytest.raises(OSError):
        crashing.compact()
    assert facts(wh) == before and wh.state().version == old.version  # what was written is not seen
    assert wh.compact()
    assert facts(wh) == before and A.kpis(wh.star()).first() == kpis
    assert all(len(wh.state().folders(n)) == 1 for n in ("country", "product", "invoice", "detailinvoice", "_partials"))
    live = {n: wh.table(n).select(F.input_file_name()).distinct().count() for n in files}
    assert all(live[n] <= wh.key_buckets and files[n] > live[n] for n in files)
    assert not wh.compact()
    fresh = Warehouse(spark, wh.root, WIDE)  # starts from the compaction's state
    assert fresh.committed() == [f"b{i}" for i in range(8)] and facts(fresh) == before
    assert not load(fresh, make_raw([row()]), "b3")
    assert load(fresh, make_raw([row(invoiceno="100000", stockcode="0", unitprice="99"), row(invoiceno="7")]), "more")
    assert set(facts(wh)) - set(before) == {("7", "85123", "2.55")}


def test_compaction_beside_loads_and_other_compactions(spark, make_raw):
    wh = many_batches(spark, make_raw, n=2)
    before = facts(wh)
    one = committing_first(Warehouse(spark, wh.root, WIDE), lambda: load(Warehouse(spark, wh.root, WIDE), make_raw([row(invoiceno="5")]), "in-between"))
    assert one.compact() and set(facts(wh)) - set(before) == {("5", "85123", "2.55")}
    two = committing_first(Warehouse(spark, wh.root, WIDE), lambda: Warehouse(spark, wh.root, WIDE).compact())
    with pytest.raises(ConflictError):
        two.compact()
    assert len(facts(wh)) == len(before) + 1


def test_surrogate_ids_are_dense_and_replayed(spark, make_raw):
    raws = [make_raw([row(invoiceno=str(i), stockcode=str(j)) for i in range(lo, lo + 15) for j in range(3)]) for lo in (0, 10)]
    ids = []
    for _ in range(2):
        wh = Warehouse(spark, scratch_path(spark, "wh"), surrogate=True)
        for i, raw in enumerate(raws):
            load(wh, raw, str(i))
        rows = wh.table("detailinvoice").collect()
        assert sorted(r.detailinvoice_id for r in rows) == list(range(1, 76))
        assert {r.detailinvoice_id <= 45 for r in rows if int(r.invoiceno) < 15} == {True}
        ids.append({(r.invoiceno, r.stockcode): r.detailinvoice_id for r in rows})
        wh.compact()
        assert {(r.invoiceno, r.stockcode): r.detailinvoice_id for r in wh.table("detailinvoice").collect()} == ids[-1]
    assert ids[0] == ids[1]


def test_reports_from_partials_equal_the_scan(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"), WIDE)
    load(wh, make_raw([row(invoiceno="1", stockcode="10", unitprice="0.05"), row(invoiceno="1", stockcode="11", invoicedate=None)]), "A")
    # invoice 1 is dated by batch A; 2 has no date
    load(wh, make_raw([row(invoiceno="1", stockcode="12", invoicedate="2011-05-01"), row(invoiceno="2", stockcode="10", unitprice="0.10", invoicedate=None, country="PERU")]), "B")
    star = wh.star()
    scan = dict(star)  # knows of no partials
    for f in (A.kpis, A.monthly, A.monthly_dense, A.price_list, lambda s: A.ranking(s, "country"), lambda s: A.ranking(s, "stockcode")):
        assert f(star).collect() == f(scan).collect()
    for f in (A.kpis, A.monthly, lambda s: A.ranking(s, "country")):
        assert "Join" not in plan(f(star)) and "ReadSchema: struct<kind:string,key:string" in plan(f(star))
    assert "unitprice" not in plan(A.price_list(star)) and [str(r.mean_price) for r in A.price_list(star).collect()] == ["0.08", "2.55", "2.55"]


def test_product_ranking_needs_no_invoices_where_none_is_missing(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    load(wh, make_raw([row()]), "A")
    assert "Join" not in plan(A.ranking(wh.star(), "stockcode")) and "Join" in plan(A.ranking(wh.star(), "stockcode", year=2010))
    wh.commit(wh.state(), "load", {}, batch_id="by hand")  # vouches for nothing
    assert "Join" in plan(A.ranking(wh.star(), "stockcode"))


def test_wide_and_fine_prices(spark, make_raw):
    from pyspark.sql import types as T

    wide = Warehouse(spark, scratch_path(spark, "wh"), WIDE)
    load(wide, make_raw([row(unitprice="2000000"), row(invoiceno="2", unitprice="1000000.01")]), "A")
    assert [str(r.mean_price) for r in A.price_list(wide.star()).collect()] == ["1500000.01"]
    assert A.price_search(wide.star(), "1500000").count() == 1
    fine = Warehouse(spark, scratch_path(spark, "wh"), Limits(price=T.DecimalType(12, 4)))
    load(fine, make_raw([row(unitprice="0.0049", quantity=1000), row(invoiceno="2", unitprice="0.0061", quantity=1000)]), "A")
    for star in (fine.star(), dict(fine.star())):
        assert [str(r.mean_price) for r in A.price_list(star).collect()] == ["0.01"]


def test_words_in_any_order_and_cell(spark, make_raw):
    wh = Warehouse(spark, scratch_path(spark, "wh"))
    load(wh, make_raw([row(stockcode="1", description="Red Lamp, big"), row(stockcode="2", description="big red table"), row(stockcode="23", description=None)]), "A")
    found = lambda t: [r.stockcode for r in A.price_search(wh.star(), t).collect()]
    assert found("LAMP red") == ["1"] and found("red big") == ["1", "2"] and found('"big red"') == ["2"] and found('"big red') == ["2"]
    assert found("2 table") == ["2"] and found("23 2.55") == ["23"] and found("red nothing") == [] and len(found("  ")) == 3 and found('""') == found("")


def test_thousands_of_small_files(spark, tmp_path):
    head = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
    other = "StockCode,InvoiceNo,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
    for i in range(1200):
        folder = tmp_path / "in" / str(i % 7)
        folder.mkdir(parents=True, exist_ok=True)
        a, b = (i, "x") if i % 2 else ("x", i)
        lines = [] if i % 300 == 299 else [head if i % 2 else other, f"{a},{b},d,1,12/1/2010 8:26,2.5,1,France"]
        (folder / f"{i}.csv").write_text("\n".join(lines))
    folder = str(tmp_path / "in")
    files = [r.file for r in new_files(spark, folder).collect()]
    assert len(files) == 1196
    assert header_lines(spark, files[:40], "ISO-8859-1").select("line").distinct().count() <= 2
    ledger = spark.createDataFrame([(f,) for f in files[:1100]], "file string")
    rows = read_landing(spark, folder, exclude=ledger)
    kept = {f.rsplit("/", 1)[1][:-4] for f in files[1100:]}
    assert {r.invoiceno for r in rows.collect()} == kept and {r.stockcode for r in rows.collect()} == {"x"}


def test_first_lines_do_not_read_the_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 2_000_000)
    assert [r.line for r in header_lines(spark, [str(tmp_path / "big.csv")], "ISO-8859-1").collect()] == ["a,b"]


@pytest.mark.parametrize(
    "text,want",
    [(r"a\nb", "a\nb"), (r"\x41é\U0001F642", "Aé🙂"), (r"\\n", r"\n"), (r"\101\0", "A\0"), (r"\q\ud83d\x4", r"\q\ud83d\x4"), ("end\\", "end\\"), ("plain", "plain"), ("", ""), (None, None), ("a\\\nb", "ab")],
)
def test_escapes(spark, text, want):
    from tillstar.functions import unescape

    assert spark.createDataFrame([(text,)], "t string").select(unescape("t")).first()[0] == want
