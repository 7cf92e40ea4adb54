"""Data-quality profile of a raw export, computed before anything is changed.

:func:`quality_report` returns one row with the reference's counters (P01-P14).
It is planned as three aggregations, each with a partial (map-side) step:

1. identical rows are counted per full row -> duplicates, and every per-row
   counter weighted by the group size;
2. those groups are folded per (invoiceno, stockcode) -> key duplicates;
3. a global fold gives the single report row.

A row repeated a billion times is therefore reduced inside each map task and
never lands whole in one task.

:func:`quality_by_rule` (P15) counts what each sequential cleaning step
removes, from the same kind of aggregates (no row is joined back).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstar.functions import is_le_zero, starts_with_letter
from tillstar.schema import CLEAN_GATE_PCT, RAW_COLUMNS

KEY = ("invoiceno", "stockcode")
ORDER = "_order"
UNPARSED = "_unparsed"

# Rejection labels, in the order the cleaning steps run.
RULES = ("duplicate_row", "duplicate_key", "quantity_le0", "price_le0", "letter_code")
KEPT = "kept"


def full_row(raw: DataFrame, columns: Sequence[str]) -> list[str]:
    """What makes a row: its cells, and the text of those that did not parse."""
    return [*columns, UNPARSED] if UNPARSED in raw.columns else list(columns)


def _null_cells(cols: Sequence[str]) -> Column:
    """Missing cells; one whose text did not parse is not missing."""
    missing = sum((F.col(c).isNull().cast("long") for c in cols if c != UNPARSED), F.lit(0).cast("long"))
    return missing - F.size(UNPARSED) if UNPARSED in cols else missing


def quality_report(raw: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """One-row report: counts of rows to delete / repair and the cleaning advice."""
    cols = full_row(raw, columns)
    groups = raw.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    weight = F.col("_c")

    def weighted(flag: Column) -> Column:
        return F.sum(F.when(flag, weight).otherwise(F.lit(0)))

    per_key = groups.groupBy(*KEY).agg(
        F.sum(weight).alias("_rows"),
        F.sum(weight - 1).alias("_dup"),
        weighted(is_le_zero("quantity")).alias("_qty"),
        weighted(is_le_zero("unitprice")).alias("_price"),
        weighted(starts_with_letter("stockcode")).alias("_letter"),
        F.sum(_null_cells(cols) * weight).alias("_nulls"),
    )
    zero = F.lit(0).cast("long")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).cast("long"), zero)

    totals = per_key.agg(
        total("_rows").alias("n_rows"),
        total("_dup").alias("n_dup"),
        F.coalesce(F.sum(F.col("_rows") - 1).cast("long"), zero).alias("n_dup_key"),
        total("_qty").alias("n_qty_le0"),
        total("_price").alias("n_price_le0"),
        total("_letter").alias("n_letter_code"),
        total("_nulls").alias("n_null_cells"),
    )
    to_delete = F.col("n_dup") + F.col("n_qty_le0") + F.col("n_price_le0") + F.col("n_letter_code")
    pct = F.when(F.col("n_rows") > 0, F.round(F.col("to_delete") / F.col("n_rows") * 100, 2))
    return (
        totals.withColumn("to_delete", to_delete)
        .withColumn("n_country_cells", F.col("n_rows"))
        .withColumn("to_repair", F.col("n_country_cells") + F.col("n_null_cells"))
        .withColumn("remaining", F.col("n_rows") - F.col("to_delete"))
        .withColumn("pct_deleted", pct.cast("double"))
        .withColumn(
            "advice",
            F.when(F.col("pct_deleted") <= CLEAN_GATE_PCT, F.lit("clean")).otherwise(F.lit("not_advised")),
        )
        .select(
            "n_rows", "n_dup", "n_dup_key", "n_qty_le0", "n_price_le0", "n_letter_code", "to_delete",
            "n_country_cells", "n_null_cells", "to_repair", "remaining", "pct_deleted", "advice",
        )
    )


def first_rule(quantity: Column, unitprice: Column, stockcode: Column) -> Column:
    """Label of the first row-level rule (C04-C06) a surviving row breaks; null if none."""
    return (
        F.when(is_le_zero(quantity), F.lit("quantity_le0"))
        .when(is_le_zero(unitprice), F.lit("price_le0"))
        .when(starts_with_letter(stockcode), F.lit("letter_code"))
    )


def quality_by_rule(raw: DataFrame, columns: Sequence[str] = RAW_COLUMNS, order: str = ORDER) -> DataFrame:
    """Rows removed by each cleaning step in sequence, plus the rows kept.

    Full duplicates beyond the first copy go first; then, per key, every
    distinct row but the earliest; the earliest row of each key then meets the
    quantity, price and letter-code rules in that order.
    """
    cols = full_row(raw, columns)
    groups = raw.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_first"))
    per_key = groups.groupBy(*KEY).agg(
        F.sum("_c").alias("_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        F.min(F.struct(F.col("_first"), "quantity", "unitprice", "stockcode")).alias("_head"),
    )
    head = F.col("_head")
    labelled = per_key.select(
        (F.col("_rows") - F.col("_distinct")).alias("duplicate_row"),
        (F.col("_distinct") - 1).alias("duplicate_key"),
        first_rule(head["quantity"], head["unitprice"], head["stockcode"]).alias("_rule"),
    )
    zero = F.lit(0).cast("long")

    def n_rule(r: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_rule") == r, 1).otherwise(0)).cast("long"), zero).alias(r)

    sums = labelled.agg(
        F.coalesce(F.sum("duplicate_row").cast("long"), zero).alias("duplicate_row"),
        F.coalesce(F.sum("duplicate_key").cast("long"), zero).alias("duplicate_key"),
        n_rule("quantity_le0"),
        n_rule("price_le0"),
        n_rule("letter_code"),
        F.coalesce(F.sum(F.when(F.col("_rule").isNull(), 1).otherwise(0)).cast("long"), zero).alias(KEPT),
    )
    labels = list(RULES) + [KEPT]
    stack = "stack({n}, {pairs}) AS (rejected_by, n_rows)".format(
        n=len(labels), pairs=", ".join(f"'{r}', `{r}`" for r in labels)
    )
    return sums.selectExpr(stack)
