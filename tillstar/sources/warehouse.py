"""Path-based Parquet warehouse: four star tables, staging, rejects, a commit log.

Layout under ``root``::

    country/batch_id=<folder>/part-*.parquet
    product, invoice, detailinvoice/batch_id=<folder>/kb=<bucket>/part-*.parquet
    _keys/batch_id=<folder>/...        key filters of the folder's tables (operators/keyindex.py)
    _partials/batch_id=<folder>/...    aggregates of the rows the folder adds (operators/partials.py)
    _files/batch_id=<folder>/...       export files the batch consumed (S06)
    _rejected/batch_id=<folder>/...    rows refused by cleaning or constraints
    _staging/                          rows of the batch being loaded (S07)
    _manifest/<version>.json           commit log (sources/manifest.py)

Every attempt to load, restamp or compact writes folders of its own and then creates the next
version, which names the folders that count from now on. Readers filter on those (a partition
filter, so other folders are pruned, never scanned): a crash before the commit shows nothing, and a
writer that finds its version taken checks what the other one did before it tries the next.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.operators import keyindex, partials
from tillstar.schema import LOAD_ORDER, Limits, star_tables
from tillstar.sources.manifest import ConflictError, Manifest, State, VersionExists

ORDER = "_order"
#: Codec of the Parquet files, about a third smaller than the session's default.
CODEC = {"compression": "zstd"}
#: Keys of a batch that are looked up first; where they are in every bucket, the others need not be.
FIRST_KEYS = 32_768
#: Buckets of a table's keys; also the number of folders a commit writes per table.
KEY_BUCKETS = 8
BUCKETED = ("product", "invoice", "detailinvoice")
SURROGATE = "detailinvoice_id"
SURROGATE_CELLS = 1024
ATTEMPTS = 50


class Star(dict):
    """The four tables by name, with what the commits vouch for.

    ``no_orphans``: every fact row has its invoice (K05). ``partials``: merged aggregates of all
    rows, or None where they are not known.
    """

    def __init__(self, tables: Mapping[str, DataFrame], no_orphans: bool = False, partials: DataFrame | None = None):
        super().__init__(tables)
        self.no_orphans, self.partials = no_orphans, partials


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Warehouse:
    """The star schema stored as batch-partitioned Parquet below ``root``.

    ``surrogate`` adds a dense ``detailinvoice_id`` to the fact (L08).
    """

    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits(), key_buckets: int = KEY_BUCKETS, surrogate: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self.limits = limits
        self.tables = star_tables(limits)
        self.key_buckets = key_buckets
        self.surrogate = surrogate
        if surrogate:
            schema, keys = self.tables["detailinvoice"]
            self.tables["detailinvoice"] = (T.StructType([*schema.fields, T.StructField(SURROGATE, T.LongType())]), keys)
        self.manifest = Manifest(spark, self.path("_manifest"))

    # -- paths and commits -------------------------------------------------
    def path(self, name: str, folder: str | None = None) -> str:
        base = f"{self.root}/{name}"
        return base if folder is None else f"{base}/batch_id={folder}"

    @staticmethod
    def new_folder(batch_id: str) -> str:
        """A folder name of this attempt's own."""
        return f"{batch_id}.{uuid.uuid4().hex[:8]}"

    def state(self) -> State:
        return self.manifest.state()

    def committed(self) -> list[str]:
        """Committed batch ids."""
        return sorted(self.state().batches)

    def commit(self, seen: State, kind: str, add: Mapping, remove: Mapping[str, Sequence[str]] = {}, batch_id: str | None = None, no_orphans: bool = False) -> None:
        """Create the version after ``seen``; raises VersionExists if someone else has."""
        entry = {"kind": kind, "batch_id": batch_id, "add": add, "remove": {t: list(f) for t, f in remove.items()}, "no_orphans": no_orphans}
        self.manifest.create(seen.version + 1, entry, seen if kind == "compact" else None)

    # -- tables ------------------------------------------------------------
    def read(self, name: str, schema: T.StructType | str, folders: Sequence[str]) -> DataFrame:
        """Rows of some folders of a table, with ``batch_id`` (the folder) and the bucket ``kb``."""
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        extra = [T.StructField("batch_id", T.StringType())] + ([T.StructField("kb", T.IntegerType())] if name in BUCKETED else [])
        full = T.StructType([*schema.fields, *extra])
        p = self.path(name)
        if not folders or not _exists(self.spark, p):
            return self.spark.createDataFrame([], full).limit(0)  # known to be empty when a join is planned
        return self.spark.read.schema(full).option("basePath", p).parquet(p).filter(F.col("batch_id").isin(*folders))

    def table(self, name: str, state: State | None = None) -> DataFrame:
        """Committed rows of a star table (empty typed frame when none)."""
        schema, _ = self.tables[name]
        state = self.state() if state is None else state
        return self.read(name, schema, sorted(state.folders(name))).select(*schema.fieldNames())

    def star(self, state: State | None = None) -> Star:
        state = self.state() if state is None else state
        known = sorted(state.folders("_partials"))
        merged = partials.merged(self.read("_partials", partials.SCHEMA, known)) if known else None
        return Star({name: self.table(name, state) for name in LOAD_ORDER}, state.no_orphans, merged)

    def may_hold(self, name: str, batch: DataFrame, state: State, lo: object, hi: object) -> DataFrame:
        """The table's rows in buckets that may hold a key of ``batch``, whose first keys lie in [lo, hi].

        Folders outside the range and buckets whose filters know none of the keys are not read.
        """
        schema, keys = self.tables[name]
        live = {f: i for f, i in state.folders(name).items() if not keyindex.out_of_range(i, lo, hi) and i["rows"]} if lo is not None else {}
        if not live or name not in BUCKETED:
            return self.read(name, schema, sorted(live)).select(*schema.fieldNames())
        index = self.read("_keys", keyindex.INDEX_SCHEMA, sorted(live)).filter(F.col("table") == name).withColumnRenamed("batch_id", "folder")
        sizes = [i["words"] for i in live.values()]
        every = len(live) * self.key_buckets
        found = keyindex.probe(index, batch.select(*keys).limit(FIRST_KEYS), keys, sizes, self.key_buckets).collect()  # <= folders x buckets
        if len(found) < every:
            found = keyindex.probe(index, batch, keys, sizes, self.key_buckets).collect()
        by_bucket: dict[int, list[str]] = {}
        for r in found:
            by_bucket.setdefault(r["bucket"], []).append(r["folder"])
        rows = self.read(name, schema, sorted({r["folder"] for r in found}))
        wanted: Column = F.lit(False)
        for bucket, folders in sorted(by_bucket.items()):
            wanted = wanted | ((F.col("kb") == bucket) & F.col("batch_id").isin(*sorted(folders)))
        first = F.col(keys[0]).between(F.lit(lo), F.lit(hi))
        return rows.filter(wanted & first).select(*schema.fieldNames())

    def write_rows(self, name: str, df: DataFrame, folder: str, gather: bool = True) -> dict:
        """Write a folder of a table and, for bucketed ones, its key filter; returns the folder's facts.

        With ``gather`` the rows of a bucket are dealt together first, which makes few files; without,
        every task writes a file per bucket.
        """
        schema, keys = self.tables[name]
        cols = schema.fieldNames()
        if name not in BUCKETED:
            df.select(*cols).hint("rebalance").write.options(**CODEC).mode("overwrite").parquet(self.path(name, folder))
            rows = self.read(name, schema, [folder])
            return dict(zip(("rows", "lo", "hi"), rows.agg(F.count(F.lit(1)), F.min(keys[0]), F.max(keys[0])).first()))
        placed = df.select(*cols, keyindex.bucket_of(keys[0], self.key_buckets).alias("kb"))
        placed = placed.hint("rebalance", "kb") if gather else placed
        # sorted files have narrow key ranges, which later batches prune by
        placed.sortWithinPartitions("kb", *keys).write.options(**CODEC).partitionBy("kb").mode("overwrite").parquet(self.path(name, folder))
        rows = self.read(name, schema, [folder])
        n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(keys[0]), F.max(keys[0])).first()
        info = {"rows": n, "lo": lo, "hi": hi, "words": keyindex.words_for(n, self.key_buckets)}
        if n:
            keyindex.build(rows, name, keys, info["words"], self.key_buckets).write.options(**CODEC).mode("append").parquet(self.path("_keys", folder))
        return info

    def numbered(self, new: DataFrame, after: int) -> DataFrame:
        """Dense ids after ``after``, without a global window.

        Rows are ranked inside cells by a hash of their key, and a cell starts where the cells before
        it end, so the same rows get the same ids when a load is replayed.
        """
        _, keys = self.tables["detailinvoice"]
        cells = new.withColumn("_cell", F.pmod(F.xxhash64(*keys), F.lit(SURROGATE_CELLS)).cast("int"))
        counts = {r["_cell"]: r["n"] for r in cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per cell
        starts, at = [], after
        for c in sorted(counts):
            starts.append((c, at))
            at += counts[c]
        offsets = self.spark.createDataFrame(starts, "_cell int, _start long")
        rank = F.row_number().over(Window.partitionBy("_cell").orderBy(*keys))
        return cells.join(offsets, "_cell").withColumn(SURROGATE, F.col("_start") + rank).drop("_cell", "_start")

    # -- ledger of consumed files (S06) --------------------------------------
    def write_files(self, files: Sequence[str] | DataFrame, folder: str) -> bool:
        """Record the export files of a batch; False (nothing written) for an empty list."""
        if not isinstance(files, DataFrame):
            if not files:
                return False
            files = self.spark.createDataFrame([(f,) for f in files], "file string")
        files.select("file").write.mode("overwrite").parquet(self.path("_files", folder))
        return True

    def file_ledger(self) -> DataFrame:
        """Export files already merged by a committed batch, as a frame."""
        return self.read("_files", "file string", sorted(self.state().folders("_files"))).select("file")

    def loaded_files(self) -> list[str]:
        """The ledger as a list, for small warehouses."""
        return sorted(r["file"] for r in self.file_ledger().distinct().collect())

    # -- staging (S07, S08) -------------------------------------------------
    def stage(self, df: DataFrame, batch_id: str, step: str = "_staging") -> DataFrame:
        """Replace the batch's staging folder with ``df`` and return it read back."""
        p = self.path(step, batch_id)
        df.write.options(**CODEC).mode("overwrite").parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def clear_stage(self, batch_id: str, step: str = "_staging") -> None:
        """Remove the batch's staging folder after commit."""
        _delete(self.spark, self.path(step, batch_id))

    def write_rejected(self, df: DataFrame, folder: str) -> None:
        """Store rejects with their place in the input in one shape, whatever lineage the frame has."""
        if ORDER in df.columns:
            place = df.schema[ORDER].dataType
            names = place.fieldNames() if isinstance(place, T.StructType) else []
            cells = [
                (F.col(ORDER)[c].cast(t) if c in names else F.lit(None).cast(t)).alias(c)
                for c, t in (("mtime", "timestamp"), ("path", "string"), ("block", "long"), ("row", "long"))
            ]
            df = df.withColumn(ORDER, F.struct(*cells))
        df.write.options(**CODEC).mode("overwrite").parquet(self.path("_rejected", folder))

    def rejected(self) -> DataFrame | None:
        """Rejects of committed batches, with ``batch_id``; None before the first."""
        folders = sorted(self.state().folders("_rejected"))
        if not folders:
            return None
        rows = self.spark.read.option("basePath", self.path("_rejected")).parquet(*[self.path("_rejected", f) for f in folders])
        return rows.withColumn("batch_id", F.regexp_replace("batch_id", r"\.[0-9a-f]{8}$", ""))

    # -- restamping, compaction ----------------------------------------------
    def restamped(self, zone_map: DataFrame, state: State, folder: str) -> tuple[dict, dict]:
        """(add, remove) that give every stored country its zone of ``zone_map``.

        Copy on write: the changed dimension goes into a new folder, which replaces the old ones.
        Countries that the map does not name keep their zone. ({}, {}) if nothing changes.
        """
        schema, _ = self.tables["country"]
        zones = zone_map.select("country", F.col("zone").alias("_zone")).dropDuplicates(["country"])
        rows = self.table("country", state).join(zones, "country", "left")
        changed = F.col("_zone").isNotNull() & ~F.col("_zone").eqNullSafe(F.col("zone"))
        if not rows.filter(changed).head(1):
            return {}, {}
        info = self.write_rows("country", rows.withColumn("zone", F.coalesce("_zone", "zone")).select(*schema.fieldNames()), folder)
        return {"country": {folder: info}}, {"country": sorted(state.folders("country"))}

    def restamp(self, zone_map: DataFrame) -> bool:
        """Commit ``restamped`` by itself; False if every country has its zone already."""
        for _ in range(ATTEMPTS):
            state = self.state()
            add, remove = self.restamped(zone_map, state, self.new_folder("zones"))
            if not add:
                return False
            try:
                self.commit(state, "restamp", add, remove)
                return True
            except VersionExists:
                continue
        raise ConflictError("other writers kept committing")

    def compact(self) -> bool:
        """Rewrite the live folders of every table into one each; False if there is nothing to merge.

        Rows, batch ids and the ledger stay what they are. Loads that commit meanwhile only add
        folders, which the new version leaves alone; a restamp, reset or other compaction that
        takes one of the merged folders away makes this one fail.
        """
        state = self.state()
        folder = self.new_folder("compact")
        add: dict[str, dict] = {}
        remove: dict[str, list[str]] = {}
        for name in LOAD_ORDER:
            if len(state.folders(name)) > 1:
                add[name] = {folder: self.write_rows(name, self.table(name, state), folder)}
                remove[name] = sorted(state.folders(name))
        for name, schema, merge in (("_partials", partials.SCHEMA, partials.merged), ("_files", "file string", lambda d: d.select("file").distinct())):
            old = sorted(state.folders(name))
            if len(old) > 1:
                merge(self.read(name, schema, old)).hint("rebalance").write.mode("overwrite").parquet(self.path(name, folder))
                add[name], remove[name] = {folder: {}}, old
        if not add:
            return False
        for _ in range(ATTEMPTS):
            try:
                self.commit(state, "compact", add, remove)
                return True
            except VersionExists:
                state = self.state()
                gone = [f for t, old in remove.items() for f in old if f not in state.folders(t)]
                if gone:
                    raise ConflictError(f"another writer replaced {gone[:3]}") from None
        raise ConflictError("other writers kept committing")

    # -- reset (S11) ---------------------------------------------------------
    def reset(self, confirm: bool = False) -> None:
        """Forget every batch, then delete its rows, rejects, filters and ledger.  Needs ``confirm=True``.

        The commit goes first, so readers see the full star or an empty one, never a part. Staging
        folders belong to loads under way, which go on against the empty star.
        """
        if not confirm:
            raise PermissionError("reset() deletes every warehouse row; call it with confirm=True")
        for _ in range(ATTEMPTS):
            state = self.state()
            try:
                self.commit(state, "reset", {})
                break
            except VersionExists:
                continue
        else:
            raise ConflictError("other writers kept committing")
        for name in (*reversed(LOAD_ORDER), "_rejected", "_partials", "_files"):
            for f in sorted(state.folders(name)):
                _delete(self.spark, self.path(name, f))
        for f in sorted({f for name in BUCKETED for f in state.folders(name)}):
            _delete(self.spark, self.path("_keys", f))


def to_records(df: DataFrame, limit: int) -> list[dict]:
    """A bounded result as a list of dicts (refuses more than ``limit`` rows)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"result has more than {limit} rows; page it first")
    return [r.asDict() for r in rows]
