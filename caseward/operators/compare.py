"""Comparison of deterministic and calibrated reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import RECOMMENDATION_RANK, RISK_RANK
from caseward.functions.sql import case, lit, project
from caseward.operators.align import align


def rank(value: str, order: dict[str, int]) -> str:
    return case([(f"{value} = {lit(k)}", v) for k, v in order.items()], "-1")


def change(left: str, right: str, order: dict[str, int]) -> str:
    a, b = rank(left, order), rank(right, order)
    return case([(f"{b} > {a}", "'escalated'"), (f"{b} < {a}", "'deescalated'")], "'unchanged'")


def comparison_columns(det: str = "deterministic", cal: str = "calibrated") -> dict[str, str]:
    """Comparison fields of one aligned row; a missing side counts as ``unknown``."""
    side = {"deterministic": det, "calibrated": cal}
    rec = {n: f"coalesce({s}.triage.recommendation, 'unknown')" for n, s in side.items()}
    risk = {n: f"coalesce({s}.triage.risk_level, 'unknown')" for n, s in side.items()}
    score = {n: f"CAST({s}.triage.score AS DOUBLE)" for n, s in side.items()}
    domain = {n: f"{s}.primary_issue.domain" for n, s in side.items()}
    delta = f"({score['calibrated']} - {score['deterministic']})"
    a, b = "deterministic", "calibrated"
    changed = (
        f"{rec[a]} <> {rec[b]} OR {risk[a]} <> {risk[b]} OR NOT ({domain[a]} <=> {domain[b]})"
        f" OR coalesce(abs({delta}) >= 1, false)"
    )
    return {
        **{f"recommendation_{n}": rec[n] for n in side},
        "recommendation_change": change(rec[a], rec[b], RECOMMENDATION_RANK),
        **{f"risk_{n}": risk[n] for n in side},
        "risk_change": change(risk[a], risk[b], RISK_RANK),
        **{f"score_{n}": score[n] for n in side},
        "score_delta": delta,
        **{f"domain_{n}": domain[n] for n in side},
        "changed": f"({changed})",
    }


def compare(deterministic: DataFrame, calibrated: DataFrame) -> DataFrame:
    """One comparison row per case of either side."""
    return compare_aligned(align(deterministic=deterministic, calibrated=calibrated))


def compare_aligned(aligned: DataFrame) -> DataFrame:
    """Comparison of rows that already hold both variants; narrow."""
    return project(aligned, comparison_columns(), ["case_id"])


def with_comparison(aligned: DataFrame, absent: str = "false") -> DataFrame:
    """The comparison as a column of rows that already hold both variants: no further alignment.

    It is null where both variants are, or where ``absent`` (SQL) says that the run has none.
    """
    there = f"NOT ({absent}) AND (deterministic IS NOT NULL OR calibrated IS NOT NULL)"
    fields = ", ".join(f"'{name}', {sql}" for name, sql in comparison_columns().items())
    return aligned.withColumn("comparison", F.expr(f"CASE WHEN {there} THEN named_struct({fields}) END"))


def transitions(comparison: DataFrame) -> DataFrame:
    """Counts per recommendation pair (A1)."""
    pair = F.concat_ws("->", "recommendation_deterministic", "recommendation_calibrated")
    return comparison.groupBy(pair.alias("transition")).agg(F.count("*").alias("n"))


def domain_transitions(comparison: DataFrame) -> DataFrame:
    """Counts per changed pair of driving domains (A1)."""
    left, right = F.col("domain_deterministic"), F.col("domain_calibrated")
    pair = F.concat_ws("->", F.coalesce(left, F.lit("none")), F.coalesce(right, F.lit("none")))
    return comparison.filter(~left.eqNullSafe(right)).groupBy(pair.alias("transition")).agg(F.count("*").alias("n"))


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """Changed, recommendation and risk change counts, one row (A2)."""
    count = lambda sql, name: F.count_if(F.expr(sql)).alias(name)
    return comparison.agg(
        F.count("*").alias("n_cases_compared"),
        count("changed", "n_changed_cases"),
        count("recommendation_deterministic <> recommendation_calibrated", "n_recommendation_changes"),
        count("risk_deterministic <> risk_calibrated", "n_risk_changes"),
    )


def disagrees(det: str = "deterministic", cal: str = "calibrated") -> str:
    """Do two present reports differ in a field both of them state (P8)?"""
    pairs = [f"coalesce({det}.{f} <> {cal}.{f}, false)" for f in (
        "triage.recommendation", "triage.risk_level", "primary_issue.domain")]
    score = f"coalesce(abs(CAST({cal}.triage.score AS DOUBLE) - CAST({det}.triage.score AS DOUBLE)) >= 1, false)"
    return "(" + " OR ".join([*pairs, score]) + ")"
