"""Warehouse constraints as data-quality operators.

Parquet enforces no keys or limits, so each constraint is a DataFrame check:
report functions return one row per checked column / relation with the number
of violations, and :func:`enforce` splits a cleaned batch into rows that can
be loaded and rows routed to the rejects with the first broken constraint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstar.functions import parse_date
from tillstar.schema import Limits

UNPARSED = "_unparsed"

# NOT NULL columns of the loaded tables (country, stockcode and invoiceno are keys).
NOT_NULL = ("invoiceno", "stockcode", "country", "quantity")


def _report(df: DataFrame, check: str, flags: Mapping[str, Column]) -> DataFrame:
    """One aggregation, one row per flagged column: (check, column, n_rows, n_violations)."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(f).alias(f"_v{i}") for i, f in enumerate(flags.values())
    ]
    row = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `_v{i}`" for i, c in enumerate(flags))
    return row.selectExpr(
        f"'{check}' AS `check`", f"stack({len(flags)}, {parts}) AS (`column`, n_violations)", "_n AS n_rows"
    ).select("check", "column", "n_rows", F.col("n_violations").cast("long").alias("n_violations"))


def not_null_report(df: DataFrame, columns: Sequence[str] = NOT_NULL) -> DataFrame:
    """K01."""
    return _report(df, "not_null", {c: F.col(c).isNull() for c in columns})


def length_report(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Text longer than the column allows."""
    return _report(df, "max_length", {c: F.char_length(c) > n for c, n in limits.max_len.items()})


def decimal_range_report(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Values that do not fit the narrower warehouse decimal."""
    return _report(
        df, "decimal_range", {c: F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in limits.narrow.items()}
    )


def date_report(text: DataFrame, column: str, formats: Sequence[str]) -> DataFrame:
    """Date text that none of ``formats`` parses."""
    return _report(
        text, "date_parse", {column: F.col(column).isNotNull() & parse_date(column, tuple(formats)).isNull()}
    )


def unique_report(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """Keys present more than once (pre-aggregated per key, then folded)."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    return per_key.agg(
        F.lit(name).alias("table"),
        F.lit(",".join(key)).alias("key"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_c") > 1).alias("n_dup_keys"),
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_dup_rows"),
    )


def orphan_report(child: DataFrame, parent: DataFrame, relation: str, fk: str, pk: str | None = None) -> DataFrame:
    """Non-null foreign keys without a parent row (left anti join)."""
    pk = pk or fk
    keys = parent.select(F.col(pk).alias("_pk"))
    orphans = child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")
    return orphans.agg(F.lit(relation).alias("relation"), F.count(F.lit(1)).alias("n_orphans"))


def violation(df: DataFrame, limits: Limits = Limits()) -> Column:
    """Label of the first constraint a cleaned row breaks (null: loadable)."""
    checks: list[tuple[Column, str]] = []
    if UNPARSED in df.columns:
        checks.append((F.size(F.col(UNPARSED)) > 0, "unparseable"))
    checks += [(F.col(c).isNull(), f"not_null:{c}") for c in NOT_NULL]
    checks += [(F.char_length(c) > n, f"max_length:{c}") for c, n in limits.max_len.items()]
    checks += [
        (F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), f"decimal_range:{c}")
        for c, t in limits.narrow.items()
        if c in df.columns
    ]
    label = None
    for cond, name in checks:
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    return label


def enforce(df: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Split cleaned rows into (loadable, rejected-with-``rejected_by``)."""
    tagged = df.withColumn("rejected_by", violation(df, limits))
    ok = tagged.filter(F.col("rejected_by").isNull()).drop("rejected_by")
    bad = tagged.filter(F.col("rejected_by").isNotNull())
    return ok, bad
