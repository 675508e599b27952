"""Stability of decisions across task profiles.

``runs`` is a long table, one row per case and profile: case_id, profile, action,
basis, hard_failure, routed, primary_domain and severities (struct by domain).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import DOMAINS
from caseward.functions.sql import compact

PROFILES = ("tau_P", "tau_L", "tau_S")
PAIRS = (("tau_P", "tau_L"), ("tau_P", "tau_S"), ("tau_L", "tau_S"))
# Actions in matrix order.
MATRIX_ACTIONS = ("keep", "warning", "review", "reject")


def side_by_side(runs: DataFrame) -> DataFrame:
    """One row per case with a struct per profile; a single grouping instead of self-joins."""
    rest = F.struct(*[c for c in runs.columns if c not in ("case_id", "profile")])
    return runs.groupBy("case_id").agg(
        *[F.first(F.when(F.col("profile") == p, rest), ignorenulls=True).alias(p) for p in PROFILES]
    )


def aligned_cases(wide: DataFrame) -> DataFrame:
    return wide.filter(" AND ".join(f"{p} IS NOT NULL" for p in PROFILES))


def _stable() -> str:
    return f"{PROFILES[0]}.action = {PROFILES[1]}.action AND {PROFILES[1]}.action = {PROFILES[2]}.action"


def stability(wide: DataFrame) -> DataFrame:
    """Aligned, stable and changed cases, changed per pair, one row."""
    return aligned_cases(wide).agg(
        F.count("*").alias("aligned"),
        F.count_if(F.expr(_stable())).alias("stable"),
        F.count_if(F.expr(f"NOT ({_stable()})")).alias("changed"),
        *[F.count_if(F.expr(f"{a}.action <> {b}.action")).alias(f"changed_{a}_{b}") for a, b in PAIRS],
    )


def transition_matrix(wide: DataFrame) -> DataFrame:
    """Case counts per profile pair, source and target action."""
    pairs = ", ".join(
        f"named_struct('pair', '{a}_to_{b}', 'source', {a}.action, 'target', {b}.action)" for a, b in PAIRS
    )
    rows = aligned_cases(wide).selectExpr(f"explode(array({pairs})) AS t").select("t.*")
    return rows.groupBy("pair", "source", "target").agg(F.count("*").alias("n"))


def action_counts(runs: DataFrame) -> DataFrame:
    """Actions per profile (A15 marginals)."""
    return runs.groupBy("profile", "action").agg(F.count("*").alias("n"))


def domain_prevalence(wide: DataFrame) -> DataFrame:
    """Share of stable and of changing cases with an abnormal domain in some profile."""
    abnormal = {
        d: "("
        + " OR ".join(f"coalesce({p}.severities.{d} NOT IN ('normal', 'not_applicable'), false)" for p in PROFILES)
        + ")"
        for d in DOMAINS
    }
    marked = aligned_cases(wide).selectExpr(f"{_stable()} AS stable", *[f"{sql} AS {d}" for d, sql in abnormal.items()])
    sums = marked.agg(
        F.count_if("stable").alias("n_stable"),
        F.count_if(~F.col("stable")).alias("n_changing"),
        *[F.count_if(F.col("stable") & F.col(d)).alias(f"s_{d}") for d in DOMAINS],
        *[F.count_if(~F.col("stable") & F.col(d)).alias(f"c_{d}") for d in DOMAINS],
    )
    rows = ", ".join(
        f"named_struct('domain', '{d}', 'stable_n', s_{d}, 'changing_n', c_{d},"
        f" 'stable_percent', 100 * s_{d} / nullif(n_stable, 0), 'changing_percent', 100 * c_{d} / nullif(n_changing, 0))"
        for d in DOMAINS
    )
    return sums.selectExpr(f"explode(array({rows})) AS r").select("r.*")


def change_mechanisms(wide: DataFrame) -> DataFrame:
    """Mechanism counts among the changed cases of each profile pair."""
    parts = []
    for a, b in PAIRS:
        items = [
            f"CASE WHEN NOT {a}.routed AND {b}.routed THEN 'routing: entered review' END",
            f"CASE WHEN {a}.routed AND NOT {b}.routed THEN 'routing: left review' END",
            f"CASE WHEN {a}.basis <> {b}.basis THEN concat('basis: ', {a}.basis, ' -> ', {b}.basis) END",
            f"CASE WHEN {a}.hard_failure AND NOT {b}.hard_failure THEN 'status: left hard failure' END",
            f"CASE WHEN NOT ({a}.primary_domain <=> {b}.primary_domain) THEN 'primary_domain_changed' END",
        ]
        for d in DOMAINS:
            left, right = f"{a}.severities.{d}", f"{b}.severities.{d}"
            items.append(
                f"CASE WHEN {left} = 'not_applicable' AND {right} <> 'not_applicable' THEN 'task-relevant domain: {d}' END"
            )
            items.append(
                f"CASE WHEN {left} <> 'not_applicable' AND {right} <> 'not_applicable' AND {left} <> {right}"
                f" THEN 'changed shared domain: {d}' END"
            )
        parts.append(
            f"CASE WHEN {a}.action <> {b}.action THEN transform({compact(items)},"
            f" m -> named_struct('pair', '{a}_to_{b}', 'mechanism', m)) ELSE array() END"
        )
    rows = aligned_cases(wide).selectExpr(f"explode(concat({', '.join(parts)})) AS r").select("r.*")
    return rows.groupBy("pair", "mechanism").agg(F.count("*").alias("n"))
