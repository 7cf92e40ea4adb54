"""Cleaning of a raw export (C01-C11), keeping every rejected row with its reason.

The steps run in this order, and the order matters:

1. ``totalcost = unitprice * quantity`` (exact decimals, from the unrounded price)
2. drop full-row duplicates, keeping the first copy in file order
3. drop (invoiceno, stockcode) duplicates, keeping the first row in file order
4. drop quantity <= 0, 5. unit price <= 0, 6. stock codes starting with a letter
   (missing values never match these rules)
7. title-case the country
8-10. (``mode="intended"``) missing or numeric country -> ``Unspecified``,
   missing description -> placeholder.  ``mode="as_written"`` skips 8-10.

Because the earliest row of a key is necessarily the first copy of its own
full row, steps 2 and 3 together keep exactly the earliest row per key; that is
one first-per-key selection with a partial, map-side limit.

Row order is the ``_order`` lineage column (a struct whose natural ordering is
the file order); lineage columns never take part in duplicate checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions import is_le_zero, starts_with_letter, title_case
from tillstar.operators.dedupe import first_per_key, order_columns
from tillstar.operators.quality import KEY, ORDER, first_rule, full_row
from tillstar.schema import MISSING_DESCRIPTION, RAW_COLUMNS, UNSPECIFIED_COUNTRY

MODES = ("intended", "as_written")
CLEAN_COLUMNS = tuple(RAW_COLUMNS) + ("totalcost",)


def with_totalcost(df: DataFrame) -> DataFrame:
    """Exact line cost, narrowed only when loaded."""
    return df.withColumn("totalcost", F.col("unitprice") * F.col("quantity"))


def repair(df: DataFrame, mode: str = "intended") -> DataFrame:
    """C07-C10 on surviving rows."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out = df.withColumn("country", title_case("country"))
    if mode == "intended":
        numeric = F.coalesce(F.col("country").rlike("^[0-9.]+$"), F.lit(False))
        out = out.withColumn(
            "country",
            F.when(F.col("country").isNull() | numeric, F.lit(UNSPECIFIED_COUNTRY)).otherwise(F.col("country")),
        ).withColumn("description", F.coalesce(F.col("description"), F.lit(MISSING_DESCRIPTION)))
    return out


def clean(raw: DataFrame, mode: str = "intended", order: str = ORDER, key: Sequence[str] = KEY) -> DataFrame:
    """Rows that survive cleaning (C01-C10), with the ``order`` lineage kept."""
    first = first_per_key(with_totalcost(raw), list(key), order)
    kept = first.filter(
        ~is_le_zero("quantity") & ~is_le_zero("unitprice") & ~starts_with_letter("stockcode")
    )
    return repair(kept, mode)


def classify(raw: DataFrame, columns: Sequence[str] = RAW_COLUMNS, order: str = ORDER, by_invoice: bool = False) -> DataFrame:
    """Every raw row with ``rejected_by`` (null when the row is kept), C01 applied.

    Rows are dealt out once, by key: a full row holds its key, so both windows find their groups
    in the same partitions, and an input that is dealt by a part of the key stays where it is.
    With ``by_invoice`` they are dealt by the first part of the key, so what goes by invoice after
    it finds its rows together too; ``_line`` numbers the rows of an invoice.

    * a row that is not the first of its equal rows is a ``duplicate_row``;
    * of the others, one that is not the first of its key is a ``duplicate_key``;
    * the rest falls to the quantity, price and letter rules.

    Equal rows at one place of the input are one row. A hot key is one task's, whose windows and
    sorts go to disk where they outgrow memory.
    """
    cols = full_row(raw, columns)
    lineage = [c for c in raw.columns if c not in cols and c != order]
    place = order_columns(raw, order)
    copies = Window.partitionBy(*cols)
    if by_invoice:  # ranks within the invoice, key by key: the first row of a key ranks like its key
        invoice = Window.partitionBy(KEY[0])
        codes = [F.col(c).asc_nulls_first() for c in KEY[1:]]
        lines = invoice.orderBy(*codes, *place)
        raw = raw.withColumns({"_at": F.rank().over(lines), "_line": F.row_number().over(lines)})
        of_key = F.col("_at") - F.rank().over(invoice.orderBy(*codes)) + 1
    else:
        of_key = F.rank().over(Window.partitionBy(*KEY).orderBy(*place))
    ranked = raw.withColumns(
        {
            "_copy": F.rank().over(copies.orderBy(*place)),
            "_nth": F.row_number().over(copies.orderBy(*place, *[F.col(c).asc_nulls_first() for c in lineage])),
            "_of_key": of_key,
        }
    )
    label = (
        F.when(F.col("_copy") > 1, F.lit("duplicate_row"))
        .when(F.col("_of_key") > 1, F.lit("duplicate_key"))
        .otherwise(first_rule(F.col("quantity"), F.col("unitprice"), F.col("stockcode")))
    )
    once = ranked.filter((F.col("_copy") > 1) | (F.col("_nth") == 1))
    return with_totalcost(once.select(*[c for c in raw.columns if c != "_at"], label.alias("rejected_by")))


def rejected(raw: DataFrame, columns: Sequence[str] = RAW_COLUMNS, order: str = ORDER) -> DataFrame:
    """Rows removed by cleaning, each with the first rule it broke."""
    return classify(raw, columns, order).filter(F.col("rejected_by").isNotNull())
