"""Bring the artifacts of a run together, one row per case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(**artifacts: DataFrame | None) -> DataFrame:
    """Union of all case ids with one nullable struct column per artifact.

    Equal to a chain of full outer joins on ``case_id``.  The inputs are stacked
    and grouped instead, which costs one shuffle however many artifacts there
    are; a chain of full outer joins loses its partitioning after every step.
    A null struct means that the artifact has no row for the case.  An artifact that
    states a case twice is refused when the result is computed; ``latest_by`` and
    ``first_by`` resolve repeats before.
    """
    given = {name: df for name, df in artifacts.items() if df is not None}
    stacked = None
    for name, df in given.items():
        part = df.select("case_id", F.struct(*[c for c in df.columns if c != "case_id"]).alias(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("align needs at least one artifact")
    once = [
        F.when(F.count(name) > 1, F.raise_error(F.concat(F.lit(f"{name} states a case twice: "), F.col("case_id"))))
        .otherwise(F.first(name, ignorenulls=True))
        .alias(name)
        for name in given
    ]
    return stacked.groupBy("case_id").agg(*once)


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the last in the given order (later wins); ties go by the remaining columns.

    An aggregate with ``max_by``: it combines map-side, so a hot key costs nothing.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order, *rest))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given order (first wins); ties go by the remaining columns."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order, *rest))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def with_presence(aligned: DataFrame, *names: str) -> DataFrame:
    """Boolean ``has_<artifact>`` columns."""
    return aligned.select("*", *[F.col(n).isNotNull().alias(f"has_{n}") for n in names])


