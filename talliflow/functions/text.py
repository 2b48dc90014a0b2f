"""Column functions, most of them on text."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, as used by the word-level comparisons.
MARKED = "áàâãäéèêëíìîïóòôõöúùûüñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end; ``trim`` removes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def plain(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def loose_key(c: Column) -> Column:
    """Equal for values that differ only in case, blanks at the ends and word separators.

    A separator is any run of blanks, hyphens and underscores.
    """
    return F.regexp_replace(F.lower(strip(c)), r"(?U)[\s_-]+", "_")


def unfence(c: Column) -> Column:
    """Without a leading ``` or ```json fence and a trailing ``` fence, stripped."""
    head = F.regexp_replace(strip(c), r"(?U)\A```(?:json)?\s*", "")
    return strip(F.regexp_replace(head, r"(?U)\s*```\z", ""))


def latin_number(c: Column) -> Column:
    """``1.234,50`` -> 1234.5; null if it is no number."""
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def first_line_after(c: Column, label: str) -> Column:
    """What follows ``label`` on its line, or null."""
    return F.nullif(F.regexp_extract(c, label + r"[ \t]*(.+)", 1), F.lit(""))


def dotted_thousands(c: Column) -> Column:
    """1234567.5 -> ``1.234.567,50``."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def exact_round(c: Column, digits: int) -> Column:
    """Rounding of the binary value with ties to even, as Python rounds; ``round`` rounds the shortest decimal of the number, ties up."""
    # format_number loses the digit where it is the number's first one
    half, unit = float(f"5e-{digits + 1}"), float(f"1e-{digits}")
    up = F.abs(c) >= half if Decimal(half) > Decimal(f"5e-{digits + 1}") else F.abs(c) > half
    small = F.when(up, F.signum(c) * unit).otherwise(F.signum(c) * 0.0)
    return F.when(F.abs(c) < unit, small).otherwise(F.replace(F.format_number(c, digits), F.lit(",")).cast("double"))


def scaled_round(c: Column, digits: int) -> Column:
    """Rounding of the product with 10^digits, ties away from zero, as DuckDB's ``round`` does; Spark's rounds the shortest decimal."""
    unit = F.lit(float(f"1e{digits}"))
    scaled = c * unit
    return F.when(F.abs(scaled) == float("inf"), c).otherwise(F.signum(scaled) * F.round(F.abs(scaled)) / unit)
