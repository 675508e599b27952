"""Hard-failure rules, signals and the review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import REVIEW_RISKS, REVIEW_SEVERITIES, ROUTING_POLICY_VERSION, policy_domains
from caseward.functions.sql import case, compact, has_field, lit, project, some
from caseward.operators.compare import disagrees

SIGNALS = ("uncertainty", "uncertain", "evidence_uncertainty")


def signal(df: DataFrame, struct: str, *names: str) -> str:
    """Is one of the named signals set, at case or triage level (P7)?

    Signals are optional columns of foreign reports; absent ones are false.
    """
    tests = []
    for name in names:
        own, inner = f"{struct}.{name}", f"{struct}.triage.{name}"
        paths = [p for p in (own, inner) if has_field(df.schema, p)]
        if paths:
            value = f"coalesce({', '.join(f'CAST({p} AS STRING)' for p in paths)})"
            tests.append(f"coalesce(lower({value}) IN ('true', 'yes', 'uncertain'), false)")
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def validation_rules(struct: str = "validation") -> list[str]:
    """Hard-failure rules of the dataset validation (P5), null when not met."""
    return [
        f"CASE WHEN {struct}.omit_from_training THEN 'dataset_validation_omit_from_training' END",
        f"CASE WHEN lower(trim({struct}.status)) = 'invalid' THEN 'dataset_validation_status_invalid' END",
    ]


def deterministic_rules(df: DataFrame, hard: tuple[str, ...], struct: str = "deterministic") -> list[str]:
    """Hard-failure rules of the deterministic report (P5)."""
    omitted = f"{struct}.triage.recommendation = 'omit_from_training'"
    if has_field(df.schema, f"{struct}.omit_from_training"):
        omitted += f" OR {struct}.omit_from_training"
    rules = [f"CASE WHEN {omitted} THEN 'deterministic_omit_from_training' END"]
    for d in sorted(hard):
        tag = lit(f"deterministic_critical_hard_domain:{d}")
        rules.append(f"CASE WHEN {struct}.qc_domains.{d}.severity = 'critical' THEN {tag} END")
    return rules


def review_rules(df: DataFrame, soft: tuple[str, ...], mapped: bool = False) -> list[str]:
    """Reasons to review a case that has both reports."""
    rules = []
    for source in ("deterministic", "calibrated"):
        rec, risk = f"{source}.triage.recommendation", f"{source}.triage.risk_level"
        rec = f"lower({rec})" if mapped else rec
        rules.append(f"CASE WHEN {rec} = 'review' THEN '{source}_recommendation_review' END")
        risks = ", ".join(lit(r) for r in REVIEW_RISKS)
        rules.append(f"CASE WHEN {risk} IN ({risks}) THEN concat('{source}_', {risk}, '_risk') END")
        levels = ", ".join(lit(s) for s in REVIEW_SEVERITIES)
        for d in sorted(soft):
            severity = f"{source}.qc_domains.{d}.severity"
            rules.append(
                f"CASE WHEN {severity} IN ({levels}) THEN concat('{source}_soft_domain:{d}:', {severity}) END"
            )
    for source in ("deterministic", "calibrated"):
        rules.append(f"CASE WHEN {signal(df, source, *SIGNALS)} THEN '{source}_uncertainty' END")
    both = f"{signal(df, 'deterministic', 'evidence_disagreement')} OR {signal(df, 'calibrated', 'evidence_disagreement')}"
    rules.append(f"CASE WHEN {both} THEN 'evidence_disagreement' END")
    return rules


def missing_rules() -> list[str]:
    return [
        f"CASE WHEN {s} IS NULL THEN 'insufficient_evidence:missing_{s}_case' END"
        for s in ("deterministic", "calibrated")
    ]


def sorted_set(array: str) -> str:
    return f"array_sort(array_distinct({array}))"


def route(aligned: DataFrame, task_mode: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """Routing record per case (P9); narrow on aligned rows.

    ``aligned`` holds deterministic, calibrated and, where known, comparison and
    validation.  Precedence: hard failure, missing evidence, routed / not routed.
    """
    hard, soft = policy_domains(task_mode)
    names = aligned.columns
    hard_rules = deterministic_rules(aligned, hard)
    if "validation" in names:
        hard_rules = validation_rules() + hard_rules
    target, organ = "deterministic.target_presence", "deterministic.measurements.pancreas_present"
    if task_mode == "pancreas_only":
        empty = f"{target}.expected_presence = 'required' AND ({target}.annotation_presence = 'absent' OR NOT {organ})"
        hard_rules.append(f"CASE WHEN {empty} THEN 'deterministic_required_pancreas_mask_missing_or_empty' END")
    differs = disagrees()
    if "comparison" in names:
        differs += " OR coalesce(comparison.changed, false)"
        if has_field(aligned.schema, "comparison.evidence_disagreement"):
            differs += " OR coalesce(comparison.evidence_disagreement, false)"
    reasons = [f"CASE WHEN {differs} THEN 'deterministic_calibrated_disagreement' END"]
    reasons += review_rules(aligned, soft)
    if "comparison" in names:
        reasons.append(f"CASE WHEN {signal(aligned, 'comparison', *SIGNALS)} THEN 'comparison_uncertainty' END")
    if task_mode == "pancreas_only":
        partial = f"{target}.observed_presence = 'partial' AND {target}.visible_target_annotation_status = 'uncertain'"
        reasons.append(f"CASE WHEN {partial} THEN 'partial_visible_target_annotation_uncertain' END")
    df = project(
        aligned,
        {
            "__hard": compact(hard_rules),
            "__missing": compact(missing_rules()),
            "__reasons": sorted_set(compact(reasons)),
            # The status asks for no list, and lists nobody asks for are not built.
            "__failed": some(hard_rules),
            "__lacking": some(missing_rules()),
            "__reasoned": some(reasons),
        },
    )
    hard_failure, complete = "__failed", "NOT __lacking"
    live = f"NOT {hard_failure} AND {complete}"
    none = "CAST(array() AS ARRAY<STRING>)"
    df = project(
        df,
        {
            "status": case(
                [
                    (hard_failure, "'hard_failure'"),
                    ("__lacking", "'insufficient_evidence'"),
                    ("__reasoned", "'routed'"),
                ],
                "'not_routed'",
            ),
            "route_to_review": f"{live} AND __reasoned",
            "route_reasons": f"CASE WHEN {live} THEN __reasons ELSE {none} END",
        },
    )
    rules = f"concat(__hard, CASE WHEN {hard_failure} THEN {none} ELSE __missing END, route_reasons)"
    own = {
        "status": "status",
        "route_to_review": "route_to_review",
        "route_reasons": "route_reasons",
        "deterministic_recommendation": "deterministic.triage.recommendation",
        "calibrated_recommendation": "calibrated.triage.recommendation",
        "dataset_validation_status": "validation.status" if "validation" in names else "CAST(NULL AS STRING)",
        "dataset_validation_omit_from_training": "validation.omit_from_training"
        if "validation" in names
        else "CAST(NULL AS BOOLEAN)",
        "primary_domain": "coalesce(deterministic.primary_issue.domain, calibrated.primary_issue.domain)",
        "hard_failure": hard_failure,
        "evidence_status": f"CASE WHEN {complete} THEN 'complete' ELSE 'insufficient_evidence' END",
        "policy_version": lit(ROUTING_POLICY_VERSION),
        "policy_rules_triggered": sorted_set(rules),
    }
    return project(df, own, ["case_id", *keep])


def with_routing(aligned: DataFrame, task_mode: str | None) -> DataFrame:
    """Aligned rows plus their routing record as a struct; still narrow."""
    inputs = [c for c in aligned.columns if c != "case_id"]
    routed = route(aligned, task_mode, keep=inputs)
    fields = [c for c in routed.columns if c != "case_id" and c not in inputs]
    return routed.select("case_id", *inputs, F.struct(*fields).alias("routing"))


def routing_summary(routing: DataFrame) -> DataFrame:
    """Queue counts, one row (A3)."""
    return routing.agg(
        F.count("*").alias("n_cases"),
        F.count_if("route_to_review").alias("n_routed"),
        F.count_if(~F.col("route_to_review")).alias("n_not_routed"),
        F.count_if("hard_failure").alias("n_hard_failures"),
        F.count_if(F.col("evidence_status") == "insufficient_evidence").alias("n_insufficient_evidence"),
    )


def csv_rows(table: DataFrame) -> DataFrame:
    """List columns as ``;``-joined text, ready for a CSV writer."""
    out = []
    for f in table.schema.fields:
        column = F.col(f.name)
        out.append(F.concat_ws(";", column).alias(f.name) if f.dataType.typeName() == "array" else column)
    return table.select(*out)
