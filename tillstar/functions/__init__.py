"""Column expressions (JVM-side, no Python UDF)."""

from tillstar.functions.columns import (  # noqa: F401
    cents_to_price,
    half_up_div,
    is_le_zero,
    missing_as_null,
    parse_date,
    parse_timestamp,
    starts_with_letter,
    title_case,
    unescape,
    year_range,
)
