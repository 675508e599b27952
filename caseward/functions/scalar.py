"""Small Column helpers: rounding, null rules, first-match ladders, severities."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseward.config import SEVERITIES


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even; whole numbers go through the code-generated ``rint``."""
    return F.rint(value) if digits == 0 else F.bround(value, digits)


def or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def falsy_text(value: Column) -> Column:
    return value.isNull() | (value == "")


def falsy_number(value: Column) -> Column:
    return value.isNull() | (value == 0)


def first_match(cases: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """``when`` chain: the first true condition gives the value."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if chain is None:
        return otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def present(items: Sequence[Column]) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def greatest_of(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def severity_level(name: str) -> int:
    """Position in the extended severity order (not_applicable is lowest)."""
    return SEVERITIES.index(name)


def severity_name(level: Column) -> Column:
    """Severity text of a level column."""
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), level + 1)


def level_of_name(name: Column) -> Column:
    """Level of a severity text; unknown text counts as the lowest."""
    return first_match([(name == s, i) for i, s in enumerate(SEVERITIES)], 0)


def rank_in(mapping: dict[str, int], value: Column, unknown: int = -1) -> Column:
    return first_match([(value == k, v) for k, v in mapping.items()], unknown)


def map_text(mapping: dict[str, str], value: Column, unknown: object = None) -> Column:
    return first_match([(value == k, v) for k, v in mapping.items()], unknown)


def safe_rate(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Ratio rounded half to even; null for a null or zero denominator."""
    return F.bround(F.when(denominator != 0, numerator / denominator), digits)
