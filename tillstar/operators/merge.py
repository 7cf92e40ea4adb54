"""Cumulative first-wins merge of cleaned batches into the star.

For every table, in load order (country, product, invoice, fact):

    new rows = first row per key in the batch (file order)
               minus keys already in the table (left anti join)

Earlier batches always win; within a batch the first row in file order wins.
Decimals are narrowed on the way in (half away from zero); rows that would not
fit, break NOT NULL, exceed a length or did not parse go to ``_rejected``
instead of aborting the load.  Keys of earlier batches are read only where their
filters may hold a key of the batch (operators/keyindex.py).  Loading a committed batch id again is a no-op,
and loading the same rows under a new id inserts nothing.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.operators import partials
from tillstar.operators.clean import classify, repair, with_totalcost
from tillstar.operators.constraints import violation
from tillstar.operators.dedupe import first_per_key
from tillstar.schema import DEFAULT_ZONE, LOAD_ORDER, STAR, Limits
from tillstar.session import JOIN_BY_PART, tidy_shuffles
from tillstar.sources.manifest import ConflictError, State, VersionExists
from tillstar.sources.warehouse import ATTEMPTS, Warehouse

ORDER = "_order"
#: Up to so many products of a batch that are new, only their rows are ranked by key.
FEW_NEW = 100_000
#: Cells that cleaning repairs.
REPAIRED = ("country", "description")


def insert_if_absent(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: str = ORDER,
    unique: bool = False,
    bounds: tuple | None = None,
    by: str | None = None,
    pick: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows of ``batch`` whose key is not yet in ``target`` (first per key in ``order``).

    ``pick``, if given, selects the first row per key in another way.
    ``unique=True`` states that ``batch`` already holds one row per key (a
    cleaned batch is unique on the fact key), which skips the per-key selection.

    Only the key columns of the target are read (column pruning at the scan), and
    with ``bounds`` (smallest and largest first key of the batch) only files and
    row groups whose key range meets the batch's, so that months with invoice
    numbers of their own do not read the history again.

    With ``by``, one of several keys, rows are dealt by it alone (under ``JOIN_BY_PART``), so that those
    that share it stay together. An outer join does it, as Spark takes an anti join before the dealing.
    """
    if bounds is not None:
        lo, hi = bounds
        target = target.filter(F.lit(False)) if lo is None else target.filter(F.col(keys[0]).between(F.lit(lo), F.lit(hi)))
    firsts = batch if unique else pick(batch) if pick else first_per_key(batch, list(keys), order)
    if by is None:
        return firsts.join(target.select(*keys), list(keys), "left_anti")
    known = target.select(*keys, F.lit(True).alias("_known")).repartition(by)
    return firsts.repartition(by).join(known, list(keys), "left").filter(F.col("_known").isNull()).drop("_known")


def project(batch: DataFrame, name: str, zone_map: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """Batch rows shaped (and narrowed) for one star table, ``_order`` kept."""
    if name == "country":
        out = batch.select("country", ORDER)
        if zone_map is None:
            return out.withColumn("zone", F.lit(DEFAULT_ZONE))
        zones = zone_map.select("country", F.col("zone").alias("_zone"))
        return out.join(zones, "country", "left").withColumn(
            "zone", F.coalesce(F.col("_zone"), F.lit(DEFAULT_ZONE))
        ).drop("_zone")
    if name == "product":
        return batch.select("stockcode", "description", ORDER)
    if name == "invoice":
        return batch.select(
            "invoiceno",
            F.col("invoicedate").cast("date").alias("invoicedate"),
            F.col("customerid").cast(limits.customer).alias("customerid"),
            "country",
            ORDER,
        )
    if name == "detailinvoice":
        return batch.select(
            "invoiceno", "stockcode",
            F.col("unitprice").cast(limits.price).alias("unitprice"),
            F.col("quantity").cast(limits.quantity).alias("quantity"),
            F.col("totalcost").cast(limits.cost).alias("totalcost"),
            ORDER,
        )
    raise ValueError(name)


def merge_star(
    star: Mapping[str, DataFrame],
    batch: DataFrame,
    zone_map: DataFrame | None = None,
    limits: Limits = Limits(),
    bounds: Mapping[str, tuple] | None = None,
) -> dict[str, DataFrame]:
    """Pure form: the new rows of every table for one cleaned, checked batch.

    Cleaning keeps one row per (invoiceno, stockcode), so the fact insert needs
    no per-key selection; the dimensions take the first row per key.
    """
    out = {}
    for name in LOAD_ORDER:
        _, keys = STAR[name]
        rows = project(batch, name, zone_map, limits)
        if name == "country" and zone_map is None:
            rows = rows.groupBy(*keys).agg(F.first("zone").alias("zone"))  # all alike: no order to keep
        out[name] = insert_if_absent(
            star[name],
            rows,
            keys,
            unique=name == "detailinvoice" or ORDER not in rows.columns,
            bounds=bounds[keys[0]] if bounds else None,
        )
    return out


def judged(rows: DataFrame, mode: str, limits: Limits) -> DataFrame:
    """Classified rows, repaired where cleaning keeps them; a repaired row that breaks a constraint has that as its label."""
    raw = {c: f"_raw_{c}" for c in REPAIRED}
    kept = F.col("_label").isNull()
    fixed = repair(rows.withColumns({r: F.col(c) for c, r in raw.items()}), mode).withColumnRenamed("rejected_by", "_label")
    label = F.when(kept, violation(fixed, limits)).otherwise(F.col("_label"))
    cells = {c: F.when(kept, F.col(c)).otherwise(F.col(r)) for c, r in raw.items()}
    return fixed.withColumns({"rejected_by": label, **cells}).select(*rows.columns)


def with_firsts(rows: DataFrame, order: str = ORDER) -> DataFrame:
    """``_first``: the row brings its invoice, as the first in ``order`` of the invoice's loadable rows.

    A window by invoice on rows that ``classify`` has dealt by invoice and sorted by key: nothing moves.
    """
    ok, place = F.col("rejected_by").isNull(), F.struct(order, "_line")
    earliest = rows.withColumn("_earliest", F.min(F.when(ok, place)).over(Window.partitionBy("invoiceno")))
    return earliest.withColumn("_first", ok & place.eqNullSafe(F.col("_earliest"))).drop("_earliest", "_line")


def rows_of_few(wh: Warehouse, rows: DataFrame, known: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """``rows`` without those whose keys ``known`` holds, if few keys are left; else all ``rows``.

    Keys alone are looked up first. Most batches bring few new products, and the rows of the others
    need not travel; the list of new keys is as small as Spark's limit for broadcasts or joined like any table.
    """
    if known.isEmpty():
        return rows
    step = "_new_keys"
    new = wh.stage(rows.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti"), folder, step)
    return rows if new.count() > FEW_NEW else rows.join(new, list(keys), "left_semi")


def first_versions(wh: Warehouse, rows: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """One row per key of ``rows``, the first in file order.

    The versions of a key are counted without their places; rows of keys that have several are ranked by place.
    """
    step, cells = "_versions", [c for c in rows.columns if c != ORDER]
    apart = rows.select(*cells).distinct()
    others = [F.first(c).alias(c) for c in cells if c not in keys]
    seen = wh.stage(apart.groupBy(*keys).agg(*others, F.count(F.lit(1)).alias("_n")), folder, step)
    only, several = seen.filter("_n = 1").select(*cells), seen.filter("_n > 1").select(*keys)
    if several.isEmpty():
        return only
    return only.unionByName(first_per_key(rows.join(several, list(keys), "left_semi"), keys, ORDER).select(*cells))


def add_rows(wh: Warehouse, ok: DataFrame, seen: State, folder: str, zone_map: DataFrame | None) -> tuple[dict, dict]:
    """Write the rows of a batch that ``seen`` does not hold; returns the commit's (add, remove)."""
    firsts = sorted({keys[0] for _, keys in wh.tables.values()})
    edges = dict.fromkeys(f"{n}_{c}" for c in firsts for n in ("lo", "hi"))
    if any(i["rows"] for name in LOAD_ORDER for i in seen.folders(name).values()):  # an empty star has no ranges to meet
        edges = ok.agg(*[f(c).alias(f"{n}_{c}") for c in firsts for n, f in (("lo", F.min), ("hi", F.max))]).first()
    add: dict[str, dict] = {}
    remove: dict[str, list[str]] = {}
    older = None
    for name in LOAD_ORDER:
        _, keys = wh.tables[name]
        known = wh.may_hold(name, ok, seen, edges[f"lo_{keys[0]}"], edges[f"hi_{keys[0]}"])
        if name == "detailinvoice":  # one row per key; costs and widths follow the join, which moves what they are made of
            by = None if known.isEmpty() else keys[0]  # an invoice's rows travel and stay together
            rows = insert_if_absent(known, ok.select(*keys, "unitprice", "quantity", ORDER), keys, unique=True, by=by)
            new = project(with_totalcost(rows), name, limits=wh.limits)
        elif name == "invoice":
            new = insert_if_absent(known, project(ok.filter("_first"), name, limits=wh.limits).drop(ORDER), keys, unique=True)
        elif name == "product":
            rows = rows_of_few(wh, project(ok, name), known, keys, folder)
            new = insert_if_absent(known, rows, keys, pick=lambda some: first_versions(wh, some, STAR["product"][1], folder))
        else:
            rows = project(ok, name, zone_map, wh.limits)
            if name == "country" and zone_map is None:
                rows = rows.groupBy(*keys).agg(F.first("zone").alias("zone"))  # all alike: no order to keep
            new = insert_if_absent(known, rows, keys, unique=ORDER not in rows.columns)
        if name == "detailinvoice" and wh.surrogate:
            new = wh.numbered(new, sum(i["rows"] for i in seen.folders(name).values()))
        add[name] = {folder: wh.write_rows(name, new, folder, gather=name not in ("invoice", "detailinvoice"))}
        older = known if name == "invoice" else older
    if zone_map is not None:
        more, gone = wh.restamped(zone_map, seen, f"{folder}.zones")
        for t, folders in more.items():
            add[t] |= folders
        remove |= gone
    added = {n: wh.read(n, wh.tables[n][0], [folder]).select(*wh.tables[n][0].fieldNames()) for n in LOAD_ORDER}
    partials.of_batch(added, older).hint("rebalance").write.mode("overwrite").parquet(wh.path("_partials", folder))
    return add | {"_partials": {folder: {}}}, remove


def load(
    wh: Warehouse,
    raw: DataFrame,
    batch_id: str,
    mode: str = "intended",
    files: Sequence[str] | DataFrame = (),
    zone_map: DataFrame | None = None,
) -> bool:
    """Clean ``raw``, check constraints, merge into the warehouse, commit.

    Returns False (and does nothing) when ``batch_id`` is already committed.
    The classified, repaired and checked rows are staged, so the export is parsed once
    and positions are fixed; the four tables and the rejects are read from there. Text lengths and decimal widths
    are the warehouse's ``limits``. With ``zone_map`` every country gets its zone,
    those loaded before too.

    Loads may run beside each other: the commit creates the version after the one
    that the load has read. If another writer got there first, the load reads what
    that one committed, merges its staged rows against it and tries again, so a key
    is inserted once (K04) and the first commit wins.
    """
    with tidy_shuffles(wh.spark, JOIN_BY_PART):
        return _load(wh, raw, batch_id, mode, files, zone_map)


def _load(wh: Warehouse, raw: DataFrame, batch_id: str, mode: str, files: Sequence[str] | DataFrame, zone_map: DataFrame | None) -> bool:
    seen = wh.state()
    if batch_id in seen.batches:
        return False
    stage = wh.new_folder(batch_id)
    staged = wh.stage(with_firsts(judged(classify(raw, by_invoice=True), mode, wh.limits)).drop("totalcost"), stage)
    ok = staged.filter(F.col("rejected_by").isNull()).drop("rejected_by")
    done = False
    for _ in range(ATTEMPTS):
        folder = wh.new_folder(batch_id)
        add, remove = add_rows(wh, ok, seen, folder, zone_map)
        for step in ("_new_keys", "_versions"):
            wh.clear_stage(folder, step)
        wh.write_rejected(staged.filter(F.col("rejected_by").isNotNull()).drop("_first"), folder)
        add["_rejected"] = {folder: {}}
        if wh.write_files(files, folder):
            add["_files"] = {folder: {}}
        try:
            wh.commit(seen, "load", add, remove, batch_id, no_orphans=True)
            done = True
            break
        except VersionExists:
            seen = wh.state()
            if batch_id in seen.batches:
                break
    else:
        raise ConflictError("other writers kept committing")
    wh.clear_stage(stage)
    return done


def batch_id_now() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
