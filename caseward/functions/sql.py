"""Helpers that write Spark SQL text.

The rule tables are wide (some 36 flags, 24 sub-checks, 8 domains).  Written as
SQL text each stage reaches the JVM in one call; built node by node through the
Python bridge the same plan took about nine seconds to construct.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from caseward.config import SEVERITIES


def lit(value: object) -> str:
    """SQL literal of a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("'", "\\'") + "'"


def case(steps: Iterable[tuple[str, object]], otherwise: str = "NULL") -> str:
    """First true condition wins; values are SQL text."""
    steps = list(steps)
    if not steps:
        return otherwise
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {otherwise} END"


def both(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def either(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


def total(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0"


def largest(columns: Sequence[str]) -> str:
    return columns[0] if len(columns) == 1 else f"greatest({', '.join(columns)})"


def compact(items: Sequence[str]) -> str:
    """Array of the non-null items, in order."""
    return f"array_compact(array({', '.join(items)}))"


def some(items: Sequence[str]) -> str:
    """Is any item not null?  Says whether :func:`compact` lists one, without building the list."""
    return either(*[f"({item}) IS NOT NULL" for item in items])


def severity_text(level: str) -> str:
    """Severity name of a level column."""
    return case([(f"{level} = {i}", lit(s)) for i, s in enumerate(SEVERITIES)])


def project(df: DataFrame, columns: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """Add named SQL columns; ``keep`` limits which existing columns stay."""
    old = ["*"] if keep is None else [f"`{n}`" for n in keep]
    return df.selectExpr(*old, *[f"{sql} AS `{name}`" for name, sql in columns.items()])


def rows_where(df: DataFrame, condition: str, columns: dict[str, str]) -> DataFrame:
    """Named SQL columns of the rows that meet ``condition``, computed before any filter on them.

    Spark moves a filter below the projections it follows and puts each name's whole
    expression in its place.  Over the chained decision rules, where names occur many
    times, the plan grows beyond the driver's memory.  No filter moves below ``inline``.
    """
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return df.selectExpr(f"inline(CASE WHEN {condition} THEN array(named_struct({fields})) END)")


def has_field(schema: StructType, path: str) -> bool:
    """Does a dotted path exist in a schema?  Arrays are stepped into."""
    node = schema
    for part in path.split("."):
        while hasattr(node, "elementType"):
            node = node.elementType
        names = getattr(node, "names", None)
        if not names or part not in names:
            return False
        node = node[part].dataType
    return True


def field(df: DataFrame, path: str, type_name: str = "double") -> str:
    """A nested field, or a typed null where the input schema lacks it."""
    return path if has_field(df.schema, path) else f"CAST(NULL AS {type_name})"
