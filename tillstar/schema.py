"""Schemas, column names and the fixed values the semantics depend on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to match).
# ---------------------------------------------------------------------------

# Column contract of a raw export, in file order (header case is ignored).
RAW_COLUMNS = (
    "invoiceno",
    "stockcode",
    "description",
    "quantity",
    "invoicedate",
    "unitprice",
    "customerid",
    "country",
)

# Text cells that a pandas 1.5 CSV read turns into missing values.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)

# Warehouse text length limits (characters).
MAX_LEN = {
    "invoiceno": 7,
    "stockcode": 50,
    "description": 80,
    "country": 50,
}

# Placeholders of the intended cleaning mode.
UNSPECIFIED_COUNTRY = "Unspecified"
MISSING_DESCRIPTION = "Description du produit à intégrer"

# Zone stamped on every country row.
DEFAULT_ZONE = "Earth"

# Default text format of InvoiceDate in an export.
DEFAULT_DATE_FORMATS = ("M/d/yyyy H:mm",)

# Quality gate: cleaning is advised when at most this percent would be deleted.
CLEAN_GATE_PCT = 5

# ---------------------------------------------------------------------------
# Types
# ---------------------------------------------------------------------------

QTY = T.DecimalType(8, 0)
PRICE = T.DecimalType(8, 2)
PRICE_IN = T.DecimalType(18, 6)  # unit price as read, narrowed only at load
CUSTOMER = T.DecimalType(8, 1)
# A CSV cell as read: nothing is rounded before the rules have seen it, and the product of the
# two numbers is exact (21 + 16 + 1 digits).
QTY_READ = T.DecimalType(16, 6)
PRICE_READ = T.DecimalType(21, 10)
CUSTOMER_READ = T.DecimalType(19, 1)

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Export after parsing (S01 + S02 + typed projection).
TYPED_SCHEMA = T.StructType(
    [
        T.StructField("invoiceno", T.StringType(), True),
        T.StructField("stockcode", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("quantity", QTY, True),
        T.StructField("invoicedate", T.DateType(), True),
        T.StructField("unitprice", PRICE_IN, True),
        T.StructField("customerid", CUSTOMER, True),
        T.StructField("country", T.StringType(), True),
    ]
)


@dataclass(frozen=True)
class Limits:
    """Text lengths and decimal widths of the warehouse; what does not fit is refused at load."""

    max_len: Mapping[str, int] = field(default_factory=lambda: MAX_LEN)
    price: T.DecimalType = PRICE
    quantity: T.DecimalType = QTY
    customer: T.DecimalType = CUSTOMER
    cost: T.DecimalType = PRICE

    @property
    def narrow(self) -> dict[str, T.DecimalType]:
        return {"unitprice": self.price, "quantity": self.quantity, "totalcost": self.cost, "customerid": self.customer}


# Room for any 64-bit order and customer number.
WIDE = Limits(
    {"invoiceno": 20, "stockcode": 50, "description": 80, "country": 50},
    price=T.DecimalType(18, 2),
    quantity=T.DecimalType(18, 0),
    customer=CUSTOMER_READ,
    cost=T.DecimalType(28, 2),
)


def star_tables(limits: Limits) -> dict[str, tuple[T.StructType, tuple[str, ...]]]:
    """Schema and key of each warehouse table."""
    text = T.StringType()
    return {
        "country": (T.StructType([T.StructField("country", text, False), T.StructField("zone", text, True)]), ("country",)),
        "product": (T.StructType([T.StructField("stockcode", text, False), T.StructField("description", text, True)]), ("stockcode",)),
        "invoice": (
            T.StructType(
                [
                    T.StructField("invoiceno", text, False),
                    T.StructField("invoicedate", T.DateType(), True),
                    T.StructField("customerid", limits.customer, True),
                    T.StructField("country", text, False),
                ]
            ),
            ("invoiceno",),
        ),
        "detailinvoice": (
            T.StructType(
                [
                    T.StructField("invoiceno", text, True),
                    T.StructField("stockcode", text, True),
                    T.StructField("unitprice", limits.price, True),
                    T.StructField("quantity", limits.quantity, False),
                    T.StructField("totalcost", limits.cost, True),
                ]
            ),
            ("invoiceno", "stockcode"),
        ),
    }


STAR = star_tables(Limits())
# Load order (parents before the fact); reset runs it backwards.
LOAD_ORDER = ("country", "product", "invoice", "detailinvoice")
