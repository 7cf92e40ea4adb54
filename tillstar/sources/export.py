"""Raw CSV exports (S01-S05): read, canonicalise, check the header, type.

A raw export is read with every column as text, header names lower-cased,
the textual missing markers turned into null, then typed:

    invoiceno, stockcode, description, country : string
    quantity decimal(16,6), unitprice decimal(21,10), customerid decimal(19,1)
    invoicedate timestamp (first matching format)

so that the rules judge what the file says; a load narrows to the warehouse's types.

Two lineage columns are added, neither takes part in duplicate checks:

* ``_order``: struct giving the row's position in the input (file modification
  time, file path, block start, row id), so "first in file wins" holds across
  files and splits.  ``order_by="path"`` drops the modification time when the
  files of one export were written in parallel.
* ``_unparsed``: name and text of the cells that did not parse, or that their type would
  round to zero (K06).

CSV is splittable unless ``multiline=True``.  Listings come from Spark, header lines are read in
tasks; the driver sees file names and distinct header lines.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstar.functions import missing_as_null, parse_timestamp, unescape
from tillstar.schema import CUSTOMER_READ, DEFAULT_DATE_FORMATS, PRICE_READ, QTY_READ, RAW_COLUMNS
from tillstar.session import tidy_shuffles

ORDER = "_order"
UNPARSED = "_unparsed"
ENCODING = "ISO-8859-1"


class HeaderError(ValueError):
    """The export's header does not carry the contract's columns."""


def _reader(spark: SparkSession, encoding: str, multiline: bool, glob: str | None, recursive: bool):
    r = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
    )
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r


def lower_columns(df: DataFrame) -> DataFrame:
    """Header names are case-insensitive."""
    return df.toDF(*[c.lower() for c in df.columns])


def assert_header(df: DataFrame, required: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Fail before any job runs when a contract column is missing."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in required if c not in have]
    if missing:
        raise HeaderError(f"export is missing columns {missing}; found {sorted(have)}")
    return df


def null_tokens(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Textual missing markers become null in every contract column."""
    return df.select(*[missing_as_null(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def typed(df: DataFrame, date_formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Text columns to contract types; unparseable cells become null and are listed in ``_unparsed``."""

    def number(c: str, kind: T.DecimalType) -> Column:
        value = F.col(c).try_cast(kind)
        return F.when((value == 0) & (F.col(c).try_cast("double") != 0), F.lit(None)).otherwise(value)

    casts = {
        "quantity": number("quantity", QTY_READ),
        "unitprice": number("unitprice", PRICE_READ),
        "customerid": number("customerid", CUSTOMER_READ),
        "invoicedate": parse_timestamp("invoicedate", tuple(date_formats)),
    }
    failed = [
        F.when(F.col(c).isNotNull() & expr.isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("text")))
        for c, expr in casts.items()
    ]
    out = df.withColumn(UNPARSED, F.array_compact(F.array(*failed)))
    for c, expr in casts.items():
        out = out.withColumn(c, expr)
    lineage = [c for c in out.columns if c.startswith("_")]
    return out.select(*RAW_COLUMNS, *lineage)


def with_file_order(df: DataFrame, order_by: str = "mtime") -> DataFrame:
    """Attach ``_order``: file (mtime, path), block start and the row id within the split."""
    meta = F.col("_metadata")
    fields = []
    if order_by == "mtime":
        fields.append(meta["file_modification_time"].alias("mtime"))
    elif order_by != "path":
        raise ValueError("order_by must be 'mtime' or 'path'")
    fields += [
        meta["file_path"].alias("path"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ]
    return df.withColumn(ORDER, F.struct(*fields))


def export_paths(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file): paths of the files of an export or a folder, from Spark's listing; no content is read.
    Files of no bytes hold nothing and are left out."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.load([path] if isinstance(path, str) else list(path)).select(_normal(F.col("path")).alias("file"))


def header_lines(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """(file, line): the first line of every file that has one, read in tasks.

    Each file is one partition of a session of its own, whose tasks stop after the first batch of
    one line, so a task reads one buffer however long its file.
    """
    quick = spark.newSession()
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        quick.conf.set(k, str(1 << 60))
    quick.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    whole_lines = quick.read.schema("line string").option("encoding", encoding).option("sep", "\x01").option("quote", "").option("mode", "PERMISSIVE")
    lines = whole_lines.csv(list(files)).select(F.col("_metadata.file_path").alias("file"), "line")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    return lines.mapInArrow(first, "file string, line string")


def _header_groups(spark: SparkSession, files: Sequence[str], encoding: str) -> list[tuple[tuple[str, ...], list[str]]]:
    """Header names with the files that carry them; one row per distinct header line comes to the driver."""
    if not files:
        return []
    lines = header_lines(spark, files, encoding).filter(F.length("line") > 0)
    groups = lines.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("line").collect()
    return [(tuple(next(csv.reader([g["line"].lstrip("\ufeff")]))), g["files"]) for g in groups]


def read_files(
    spark: SparkSession,
    files: Sequence[str],
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    encoding: str = ENCODING,
    multiline: bool = False,
    order_by: str = "mtime",
    escapes: bool = False,
) -> DataFrame:
    """Typed rows of some export files, columns matched by name whatever each file's order.

    Files are grouped by their header lines, and a group is read as one scan. A file without all
    contract columns fails here, before any data is read. Files without a line have no rows.
    With ``escapes`` the backslash escapes in text cells are decoded, after the cells are cut.
    """
    out = None
    for names, paths in _header_groups(spark, files, encoding):
        kinds = T.StructType([T.StructField(n, T.StringType()) for n in names])
        text = _reader(spark, encoding, multiline, None, False).schema(kinds).csv(paths)
        assert_header(text)
        rows = lower_columns(with_file_order(text, order_by)).select(*RAW_COLUMNS, ORDER)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        order = "path string, block bigint, row bigint"
        kind = f"struct<{'mtime timestamp, ' * (order_by == 'mtime')}{order}>".replace(" ", ":").replace(",:", ",")
        text = ", ".join(f"{c} string" for c in RAW_COLUMNS)
        out = spark.createDataFrame([], f"{text}, {ORDER} {kind}")
    if escapes:
        out = out.withColumns({c: unescape(c) for c in RAW_COLUMNS})
    return typed(null_tokens(out), date_formats)


def read_export(
    spark: SparkSession,
    path: str | Sequence[str],
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    encoding: str = ENCODING,
    multiline: bool = False,
    order_by: str = "mtime",
    glob: str | None = None,
    recursive: bool = False,
    escapes: bool = False,
) -> DataFrame:
    """One export file, several files, or a folder of exports."""
    files = sorted(r["file"] for r in export_paths(spark, path, glob, recursive).collect())
    return read_files(spark, files, date_formats, encoding, multiline, order_by, escapes)


def read_landing(
    spark: SparkSession,
    folder: str,
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    encoding: str = ENCODING,
    order_by: str = "mtime",
    exclude: Sequence[str] | DataFrame = (),
    multiline: bool = False,
    escapes: bool = False,
) -> DataFrame:
    """Every ``*.csv`` below ``folder`` (recursively), minus already loaded files.

    ``exclude`` is the ledger of consumed file paths (S06), a list or a frame (file): those files
    are not opened.
    """
    new = sorted(r["file"] for r in new_files(spark, folder, exclude).collect())
    return read_files(spark, new, date_formats, encoding, multiline, order_by, escapes)


def new_files(spark: SparkSession, folder: str, exclude: Sequence[str] | DataFrame = ()) -> DataFrame:
    """(file): the ``*.csv`` files below ``folder`` that the ledger does not hold, by an anti join."""
    files = export_paths(spark, folder, "*.csv", True)
    if not isinstance(exclude, DataFrame):
        exclude = spark.createDataFrame([(f,) for f in exclude], "file string")
    return files.join(exclude.select(_normal(F.col("file")).alias("file")), "file", "left_anti")


def _normal(p: Column) -> Column:
    return F.regexp_replace(p, "^file:///", "file:/")


def normalise_path(p: str) -> str:
    """File listing and ``_metadata.file_path`` spell local URIs differently."""
    return "file:/" + p[len("file:///"):] if p.startswith("file:///") else p


def export_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the ``*.csv`` files below ``folder`` (a file listing, no data read)."""
    return sorted(r["file"] for r in export_paths(spark, folder, "*.csv", True).collect())


def write_export(
    df: DataFrame,
    path: str,
    order: str | None = ORDER,
    header: Sequence[str] = RAW_COLUMNS,
    date_format: str = DEFAULT_DATE_FORMATS[0],
    partitions: int | None = None,
    encoding: str = ENCODING,
    mode: str = "overwrite",
) -> None:
    """Write typed rows as a raw CSV export (quotes doubled, ISO-8859-1).

    With ``order`` the rows are range-partitioned and sorted on it, so the
    part files, read in path order, reproduce that order.  ``header`` may
    spell the column names in any case.
    """
    out = df
    if order is not None:
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = df.repartitionByRange(n, order).sortWithinPartitions(order)
    text = out.select(
        *[
            (
                F.date_format(F.col(c).cast("timestamp"), date_format)
                if c == "invoicedate" and not isinstance(out.schema[c].dataType, T.StringType)
                else F.col(c).cast("string")
            ).alias(h)
            for c, h in zip(RAW_COLUMNS, header)
        ]
    )
    with tidy_shuffles(df.sparkSession):
        (
            text.write.mode(mode)
            .option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("encoding", encoding)
            .csv(path)
        )
