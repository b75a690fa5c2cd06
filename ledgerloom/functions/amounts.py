"""Signs, deltas, verdicts and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(38,12)"

# The default materiality.
DEFAULT_PCT = 0.01
DEFAULT_ABS = 100.0


def money(amount: Column) -> Column:
    """Shortest decimal text of a double, as a decimal; null where it cannot fit."""
    return amount.cast("string").try_cast(MONEY)


def signed_amount(amount: Column, side: Column) -> Column:
    """Debit positive, credit negative. Decimals have no minus zero."""
    return F.when(side == "debit", amount).otherwise(-amount)


def delta(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def delta_pct(a: Column, b: Column) -> Column:
    """Difference over the larger magnitude; zero where both are practically zero."""
    size = F.greatest(F.abs(a), F.abs(b))
    ratio = F.when(size < 1e-9, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), size))
    return F.when(a.isNotNull() & b.isNotNull(), ratio)


def band(value: Column, threshold: Column) -> Column:
    """0 below a tenth of the threshold, 1 below it, else 2."""
    return F.when(value < threshold / 10, 0).when(value < threshold, 1).otherwise(2)


def verdict(
    d: Column,
    d_pct: Column,
    pct_threshold: Column,
    abs_threshold: Column,
    completeness: Column,
    ambiguous: Column | None = None,
) -> Column:
    """The one verdict rule, used by the preview and by the final evaluation."""
    unsure = F.coalesce(ambiguous, F.lit(False)) if ambiguous is not None else F.lit(False)
    worst = F.greatest(
        band(d_pct, pct_threshold), band(d, abs_threshold), F.when(unsure, 1).otherwise(0)
    )
    return (
        F.when((completeness == "partial") | d.isNull() | d_pct.isNull(), "incomplete")
        .when((d == 0) & (d_pct == 0), F.when(unsure, "warn").otherwise("pass"))
        .otherwise(F.when(worst == 0, "pass").when(worst == 1, "warn").otherwise("block"))
    )


def verdict_rank(v: Column) -> Column:
    """pass 0, warn 1, incomplete 2, block 3; ``not_performed`` counts as pass."""
    return (
        F.when(v.isin("pass", "not_performed"), 0)
        .when(v == "warn", 1)
        .when(v == "incomplete", 2)
        .when(v == "block", 3)
    )


def verdict_of_rank(rank: Column) -> Column:
    """Null stays null. (Indexing a constant array would not keep it: the optimizer
    takes such an element as never null, whatever the index.)"""
    return (
        F.when(rank == 0, "pass").when(rank == 1, "warn").when(rank == 2, "incomplete")
        .when(rank == 3, "block")
    )
