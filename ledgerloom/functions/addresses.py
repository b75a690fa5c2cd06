"""A1 addresses and formula references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# These patterns decide what counts as a reference,
# so they must read formulas the same way the audited workbooks are read today.
STRING_LITERAL = r'"[^"]*"'
CELL_REFERENCE = (
    r"(?<![A-Za-z0-9_$!.])"
    r"(?:(?:'([^']+)'|([A-Za-z_][A-Za-z0-9_.]*))!)?"
    r"(\$?[A-Za-z]{1,3}\$?[0-9]{1,7})"
    r"(?::(\$?[A-Za-z]{1,3}\$?[0-9]{1,7}))?"
    r"(?![A-Za-z0-9_(])"
)
TAB_REFERENCE = r"'([^']+)'!|([A-Za-z_][A-Za-z0-9_.]*)!"


def normal_ref(ref: Column) -> Column:
    """``$a$1`` -> ``A1``."""
    return F.upper(F.replace(ref, F.lit("$"), F.lit("")))


def col_number(letters: Column) -> Column:
    """Column letters (one to three) to the 1-based column number."""
    size = F.length(letters)
    digit = lambda i: F.ascii(F.substring(letters, i, 1)) - 64
    return (
        F.when(size == 1, digit(1))
        .when(size == 2, digit(1) * 26 + digit(2))
        .otherwise(digit(1) * 676 + digit(2) * 26 + digit(3))
    )


def col_letters(number: Column) -> Column:
    """1-based column number (up to three letters) to letters."""
    n = number.cast("int")
    first = F.when(n > 702, F.char(65 + F.floor((n - 703) / 676))).otherwise(F.lit(""))
    second = F.when(n > 26, F.char(65 + F.floor((n - 27) / 26) % 26)).otherwise(F.lit(""))
    return F.concat(first, second, F.char(65 + (n - 1) % 26))


def _letters(ref: Column) -> Column:
    return F.rtrim(ref, F.lit("0123456789"))


def ref_col(ref: Column) -> Column:
    return col_number(_letters(ref))


def ref_row(ref: Column) -> Column:
    return F.substring(ref, F.length(_letters(ref)) + 1, F.lit(7)).cast("int")


def a1(col: Column, row: Column) -> Column:
    return F.concat(col_letters(col), row.cast("string"))


def node_key(tab: Column, ref: Column) -> Column:
    return F.concat(tab, F.lit("!"), ref)


def reference_texts(formula: Column) -> Column:
    """Every reference in a formula as written, in order; string literals are blanked."""
    return F.regexp_extract_all(
        F.regexp_replace(formula, STRING_LITERAL, '""'), F.lit(CELL_REFERENCE), F.lit(0)
    )


def reference_parts(text: Column) -> tuple[Column, Column, Column]:
    """(sheet, first, last) of one reference; sheet and last may be null.

    The sheet is what stands before the last ``!``, which no address contains.
    """
    address = F.substring_index(text, "!", -1)
    sheet = F.when(
        F.contains(text, F.lit("!")),
        F.regexp_replace(
            F.substring(text, F.lit(1), F.length(text) - F.length(address) - 1), "^'|'$", ""
        ),
    )
    last = F.when(F.contains(address, F.lit(":")), normal_ref(F.substring_index(address, ":", -1)))
    return sheet, normal_ref(F.substring_index(address, ":", 1)), last


def mentioned_tabs(formula: Column) -> Column:
    """Distinct sheet names that appear before a ``!``."""
    quoted = F.regexp_extract_all(formula, F.lit(TAB_REFERENCE), F.lit(1))
    plain = F.regexp_extract_all(formula, F.lit(TAB_REFERENCE), F.lit(2))
    return F.filter(F.array_distinct(F.array_union(quoted, plain)), lambda n: n != "")


def definition_target(definition: Column) -> tuple[Column, Column]:
    """A range definition to (tab, first cell); empty strings where it has neither."""
    pattern = r"^'?([^'!]+)'?!(.+)$"
    stripped = F.replace(definition, F.lit("$"), F.lit(""))
    tab = F.regexp_extract(stripped, pattern, 1)
    return tab, F.substring_index(F.regexp_extract(stripped, pattern, 2), ":", 1)
