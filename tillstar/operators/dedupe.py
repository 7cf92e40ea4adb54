"""First row per key in a given total order.

``row_number() = 1`` over ``partitionBy(keys).orderBy(order)`` is planned by
Spark as a *partial* WindowGroupLimit before the shuffle and a final one after
it, so every map task forwards at most one row per key: a key that holds a
third of all rows is reduced before it reaches the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_columns(df: DataFrame, order) -> list:
    """Sort columns for ``order``; a struct column is expanded into its fields.

    Struct ordering is field by field, ascending, nulls first, so sorting on
    the fields gives the same order, and lets the sorter use a prefix key.
    """
    if isinstance(order, Column):
        return [order]
    if isinstance(order, str):
        dtype = df.schema[order].dataType
        if isinstance(dtype, T.StructType):
            return [F.col(order)[f.name].asc_nulls_first() for f in dtype.fields]
        return [F.col(order)]
    return [c for o in order for c in order_columns(df, o)]


def first_per_key(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """Keep, for every key, the row that comes first in ``order`` (nulls in keys group together)."""
    w = Window.partitionBy(*keys).orderBy(*order_columns(df, order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
