"""Scalar column expressions used by the operators.

All are compositions of built-in functions, so they stay inside whole-stage
code generation and are evaluated on the executors.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillstar.schema import DEFAULT_DATE_FORMATS, NA_TOKENS, PRICE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_le_zero(c) -> Column:
    """``c <= 0`` where a missing value counts as *not* <= 0 (never null)."""
    return F.coalesce(_col(c) <= 0, F.lit(False))


def starts_with_letter(c) -> Column:
    """Text begins with an ASCII letter; missing text does not."""
    return F.coalesce(_col(c).rlike("^[A-Za-z]"), F.lit(False))


def missing_as_null(c) -> Column:
    """Turn the textual missing-value markers into null."""
    col = _col(c)
    return F.when(col.isin(*NA_TOKENS), F.lit(None)).otherwise(col)


def title_case(c) -> Column:
    """Title case where every run of letters starts a new word.

    A capital follows any non-letter (``o'neil`` -> ``O'Neil``,
    ``channel-islands`` -> ``Channel-Islands``), unlike ``initcap`` which only
    restarts after whitespace.  The text is split into alternating letter and
    non-letter runs; ``initcap`` on each run then capitalises letter runs.
    ASCII words with no letter after anything but a letter or a space need no splitting.
    """
    plain = _col(c).rlike(r"\A[A-Za-z ]*[\x00-@\[-`{-\x7F]*\z")
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.when(_col(c).isNull(), F.lit(None)).when(plain, F.initcap(_col(c))).otherwise(
        F.array_join(F.transform(runs, lambda t: F.initcap(t)), "")
    )


# What a backslash and a letter stand for in escaped text.
ESCAPES = {"a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b", "\\": "\\", "'": "'", '"': '"', "\n": ""}
_ESCAPED = (
    r"(\\x[0-9A-Fa-f]{2}|\\u(?:[0-9A-CE-Fa-ce-f][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})"
    r"|\\U00(?:0[1-9A-Fa-f]|10)[0-9A-Fa-f]{4}|\\[0-7]{1,3}|\\[\s\S]|[^\\]+|\\)"
)


def unescape(c) -> Column:
    r"""Text with its backslash escapes decoded: ``\n \t \\ ...``, ``\xNN``, ``\uNNNN``, ``\UNNNNNNNN``, octal.

    Escapes that mean nothing, of lone surrogates among them, stay as written.  The text is cut
    into escapes and what lies between; cells without a backslash are not touched.
    """
    col = _col(c)

    plain = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def decoded(t: Column) -> Column:
        octal = t.rlike(r"^\\[0-7]")
        code = F.when(octal, F.conv(F.substring(t, 2, 3), 8, 16)).otherwise(F.substring(t, 3, 8))
        point = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        letter = F.when(t.rlike(r"^\\[\s\S]$"), F.element_at(plain, F.substring(t, 2, 1)))
        return F.when(octal | t.rlike(r"^\\[xuU][0-9A-Fa-f]{2}"), point).otherwise(F.coalesce(letter, t))

    parts = F.transform(F.regexp_extract_all(col, F.lit(_ESCAPED), F.lit(1)), decoded)
    return F.when(F.contains(col, F.lit("\\")), F.array_join(parts, "")).otherwise(col)


def parse_timestamp(c, formats=DEFAULT_DATE_FORMATS) -> Column:
    """First format that parses wins; unparseable text gives null (never raises)."""
    col = _col(c)
    tries = [F.try_to_timestamp(col, F.lit(f)) for f in formats]
    return tries[0] if len(tries) == 1 else F.coalesce(*tries)


def parse_date(c, formats=DEFAULT_DATE_FORMATS) -> Column:
    return parse_timestamp(c, formats).cast("date")


def year_range(c, year: int) -> Column:
    """``year(c) = year`` written as a half-open date range the scan can push down."""
    lo = _dt.date(year, 1, 1)
    hi = _dt.date(year + 1, 1, 1)
    col = _col(c)
    return (col >= F.lit(lo)) & (col < F.lit(hi))


def half_up_div(num: str, den: str) -> Column:
    """Exact integer ``num / den`` rounded half away from zero (``den`` > 0).

    Both arguments are SQL expressions over integral columns; ``div`` keeps the
    arithmetic in 64-bit integers, so no double rounding can creep in.
    """
    mag = f"((2 * abs({num}) + ({den})) div (2 * ({den})))"
    return F.expr(f"CASE WHEN {num} < 0 THEN -{mag} ELSE {mag} END").cast("long")


def cents_to_price(cents, dtype=PRICE) -> Column:
    """Exact ``cents / 100`` as a decimal."""
    return (_col(cents).cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(dtype)
