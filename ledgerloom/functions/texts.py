"""Text tests and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The error texts a spreadsheet can store, and the text length
# from which a cell counts as prose.
ERROR_VALUES = ["#REF!", "#DIV/0!", "#NAME?", "#VALUE!", "#N/A", "#NULL!", "#NUM!"]
FREE_TEXT_LENGTH = 40


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends, not just blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit(""))


def same_text(left: Column, right: Column) -> Column:
    """Equal but for case and outer white space; null equals empty."""
    return F.lower(text_or_empty(left)) == F.lower(text_or_empty(right))


def looks_like_number(text: Column) -> Column:
    return strip(text).rlike(r"^-?[\d,]+\.?\d*%?\z")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def outside_workbook(formula: Column) -> Column:
    """Formula that names another workbook file."""
    return F.contains(formula, F.lit("[")) & F.contains(formula, F.lit(".xls"))


def initials(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")


def number_in_text(text: Column) -> Column:
    """A plain decimal number written as text, else null."""
    clean = strip(text)
    plain = clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")
    return F.when(plain, clean.try_cast("double"))
