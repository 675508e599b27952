"""Audit metrics of a run.

A metric is two counts.  All counts of a run come from one conditional aggregate
over aligned rows (one row per case), so the audit is a single pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import ACTIONS, DEFAULT_HARD_DOMAINS
from caseward.functions.sql import case, lit

# Actions that count as keeping a case, and required decision fields.
KEEP_ACTIONS = ("keep", "keep_with_metadata_warning")
FINAL_FIELDS = (
    "final_decision",
    "decision_basis",
    "hard_failure",
    "requires_human_review",
    "deterministic_recommendation",
    "calibrated_recommendation",
)


@dataclass(frozen=True)
class Metric:
    """Numerator and denominator as SQL over a one-row table of counts."""

    name: str
    numerator: str
    denominator: str
    rule: bool = False
    eligible: str | None = None
    missing: str = "0"
    excluded: str = "0"


def metric_table(counts: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Metric envelopes as rows (M1): zero denominators are not applicable."""
    rows = []
    for m in metrics:
        den = f"CAST({m.denominator} AS BIGINT)"
        num = f"CAST({m.numerator} AS DOUBLE)"
        good = f"CASE WHEN {num} = {den} THEN 'passed' ELSE 'failed' END" if m.rule else "'available'"
        fields = {
            "metric": lit(m.name),
            "value": f"CASE WHEN {den} > 0 THEN {num} / {den} END",
            "numerator": num,
            "denominator": den,
            "status": f"CASE WHEN {den} = 0 THEN 'not_applicable' ELSE {good} END",
            "eligible_n": f"CAST({m.eligible or f'{m.denominator} + {m.missing}'} AS BIGINT)",
            "missing_n": f"CAST({m.missing} AS BIGINT)",
            "excluded_n": f"CAST({m.excluded} AS BIGINT)",
        }
        rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
    return counts.selectExpr(f"explode(array({', '.join(rows)})) AS m").select("m.*")


def counted(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """One row with the number of rows meeting each condition."""
    return df.agg(*[F.count_if(F.expr(sql)).alias(name) for name, sql in conditions.items()])


def hard_failure() -> str:
    """Is the case a hard failure by decision, deterministic report or validation (M6)?"""
    domain = "deterministic.primary_issue.domain"
    severity = case(
        [(f"{domain} = {lit(d)}", f"deterministic.qc_domains.{d}.severity") for d in DEFAULT_HARD_DOMAINS]
    )
    return (
        "(coalesce(final.hard_failure, false)"
        " OR coalesce(deterministic.triage.recommendation = 'omit_from_training', false)"
        f" OR coalesce(({severity}) = 'critical', false)"
        " OR coalesce(validation.omit_from_training, false) OR coalesce(validation.status = 'invalid', false))"
    )


def evidence_stability(comparison: DataFrame) -> DataFrame:
    """Sensitivity, agreement and mean score shift (M3)."""
    both = "recommendation_deterministic IS NOT NULL AND recommendation_calibrated IS NOT NULL"
    shift = F.abs(F.col("score_calibrated") - F.col("score_deterministic"))
    counts = comparison.agg(
        F.count("*").alias("n"),
        F.count_if(F.expr(both)).alias("paired"),
        F.count_if(F.expr(f"{both} AND changed")).alias("changed"),
        F.count_if(F.expr(f"{both} AND recommendation_deterministic = recommendation_calibrated")).alias("agreed"),
        F.count(shift).alias("shifts"),
        F.coalesce(F.sum(shift), F.lit(0.0)).alias("shift_sum"),
    )
    return metric_table(
        counts,
        [
            Metric("calibration_sensitivity_rate", "changed", "paired", eligible="n", missing="n - paired"),
            Metric("agreement_rate", "agreed", "paired", eligible="n", missing="n - paired"),
            Metric("mean_absolute_score_shift", "shift_sum", "shifts", eligible="n", missing="n - shifts"),
        ],
    )


ROUTED = "coalesce(routing.route_to_review, false)"
REVIEW = "coalesce(final.final_decision = 'review' OR final.requires_human_review, false)"


def routing_behavior(aligned: DataFrame) -> DataFrame:
    """Agreement of review actions and the review queue, both ways (M5)."""
    hard = hard_failure()
    counts = counted(
        aligned,
        {
            "review": REVIEW,
            "routed": ROUTED,
            "both": f"{REVIEW} AND {ROUTED}",
            "routed_no_final": f"{ROUTED} AND final IS NULL",
            "records": "routing IS NOT NULL",
            "consistent": "routing IS NOT NULL AND ((routing.status = 'routed') = routing.route_to_review)",
            "hard": hard,
            "hard_routed": f"{hard} AND {ROUTED}",
        },
    )
    return metric_table(
        counts,
        [
            Metric("review_action_queue_consistency", "both", "review", True, "review", "review - both"),
            Metric("review_queue_action_consistency", "both", "routed", True, "routed", "routed_no_final"),
            Metric("routing_record_consistency", "consistent", "records", True),
            Metric("hard_failure_queue_exclusion", "hard - hard_routed", "hard", True),
        ],
    )


def policy_safety(aligned: DataFrame) -> DataFrame:
    """Hard failures are never kept and carry their basis (M6)."""
    hard = hard_failure()
    seen = f"{hard} AND final IS NOT NULL"
    keeps = ", ".join(lit(a) for a in KEEP_ACTIONS)
    counts = counted(
        aligned,
        {
            "hard": hard,
            "seen": seen,
            "preserved": f"{seen} AND final.final_decision NOT IN ({keeps})",
            "based": f"{seen} AND final.decision_basis = 'deterministic_hard_failure'",
        },
    )
    return metric_table(
        counts,
        [
            Metric("hard_failure_preservation", "preserved", "seen", True, "hard", "hard - seen"),
            Metric("hard_failure_basis_consistency", "based", "seen", True, "hard", "hard - seen"),
        ],
    )


def artifact_integrity(aligned: DataFrame, reference: str, others: tuple[str, ...]) -> DataFrame:
    """Case-set match against the reference artifact and required decision fields (M2)."""
    conditions = {"n_final": "final IS NOT NULL"}
    for name in others:
        conditions[f"diff_{name}"] = f"({reference} IS NULL) <> ({name} IS NULL)"
    for f in FINAL_FIELDS:
        conditions[f"has_{f}"] = f"final.{f} IS NOT NULL"
    counts = counted(aligned, conditions)
    matching = " + ".join(f"CAST(diff_{n} = 0 AS INT)" for n in others)
    fields = " + ".join(f"has_{f}" for f in FINAL_FIELDS)
    total = f"n_final * {len(FINAL_FIELDS)}"
    return metric_table(
        counts,
        [
            Metric("case_id_set_match", matching, str(len(others)), True),
            Metric("required_final_fields_present", fields, total, True, total, f"{total} - ({fields})"),
        ],
    )


def artifact_availability(artifacts: DataFrame) -> DataFrame:
    """Required artifacts present and provided artifacts loadable (M2).

    ``artifacts``: one row per artifact slot (required, provided, loaded).
    """
    counts = counted(
        artifacts,
        {
            "required_n": "required",
            "required_ok": "required AND provided AND loaded",
            "provided_n": "provided",
            "provided_ok": "provided AND loaded",
        },
    )
    return metric_table(
        counts,
        [
            Metric("required_artifacts_present", "required_ok", "required_n", True, "required_n", "required_n - required_ok"),
            Metric("provided_artifacts_load_rate", "provided_ok", "provided_n", True, "provided_n", "provided_n - provided_ok"),
        ],
    )


def explanation_validity(records: DataFrame, reference: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """Coverage, id validity, non-interference and reference validity of records (M4).

    ``records``: case_id, payload (JSON text) and evidence_references, an array of
    structs (artifact_type, case_pointer); ``reference``: the known cases.
    """
    from caseward.operators.align import align
    from caseward.operators.claims import forbidden_keys

    encoded = "replace(replace(case_id, '~', '~0'), '/', '~1')"
    pointer = (
        "coalesce(r.artifact_type, '') <> '' AND (r.case_pointer IS NULL"
        f" OR r.case_pointer = concat('/data/cases/', {encoded})"
        " OR r.case_pointer RLIKE '^/data/all_cases/[0-9]+$')"
    )
    marked = records.selectExpr(
        "case_id",
        f"size({forbidden_keys('payload', tokens)}) = 0 AS clean",
        "coalesce(size(evidence_references), 0) AS n_refs",
        f"coalesce(size(filter(evidence_references, r -> {pointer})), 0) AS n_valid",
    )
    both = align(record=marked, known=reference.selectExpr("case_id", "true AS here"))
    counts = both.agg(
        F.count_if(F.expr("known IS NOT NULL")).alias("known"),
        F.count_if(F.expr("record IS NOT NULL")).alias("records"),
        F.count_if(F.expr("known IS NOT NULL AND record IS NOT NULL")).alias("covered"),
        F.count_if(F.expr("record.clean")).alias("clean"),
        F.count_if(F.expr("record.n_refs = 0")).alias("bare"),
        F.coalesce(F.sum("record.n_refs"), F.lit(0)).alias("refs"),
        F.coalesce(F.sum("record.n_valid"), F.lit(0)).alias("valid"),
    )
    return metric_table(
        counts,
        [
            Metric("case_coverage", "covered", "known", False, "known", "known - covered", "records - covered"),
            Metric("case_id_validity", "covered", "records", True, excluded="records - covered"),
            Metric("decision_non_interference", "clean", "records", True),
            Metric("evidence_reference_validity", "valid", "refs", True, excluded="bare"),
        ],
    )


def task_pair_consistency(pairs: DataFrame) -> DataFrame:
    """Share of task pairs that are consistent (M7).

    ``pairs``: consistent (nullable), expected_decision, observed_decision.
    """
    verdict = (
        "coalesce(consistent, CASE WHEN expected_decision IS NOT NULL AND observed_decision IS NOT NULL"
        " THEN expected_decision = observed_decision END)"
    )
    counts = counted(pairs, {"n": "true", "judged": f"{verdict} IS NOT NULL", "good": verdict})
    return metric_table(counts, [Metric("pair_consistency", "good", "judged", False, "n", "n - judged")])


ELIGIBLE = "labels.expected_action IS NOT NULL AND NOT coalesce(labels.excluded, false)"


def golden_validation(aligned: DataFrame) -> DataFrame:
    """Agreement of human labels and final decisions."""
    label, final = "labels.expected_action", "final.final_decision"
    compared = f"{ELIGIBLE} AND {final} IS NOT NULL"
    conditions = {
        "finals": "final IS NOT NULL",
        "eligible": ELIGIBLE,
        "excluded": "coalesce(labels.excluded, false)",
        "covered": f"{ELIGIBLE} AND final IS NOT NULL",
        "compared": compared,
        "agreed": f"{compared} AND {label} = {final}",
        "unsafe": f"{compared} AND {label} = 'reject' AND {final} IN ('keep', 'warning')",
    }
    for a in ACTIONS:
        conditions[f"want_{a}"] = f"{ELIGIBLE} AND {label} = {lit(a)}"
        conditions[f"pair_{a}"] = f"{compared} AND {label} = {lit(a)}"
        conditions[f"same_{a}"] = f"{compared} AND {label} = {lit(a)} AND {final} = {lit(a)}"
    metrics = [
        Metric(
            "label_coverage", "covered", "finals", False, "finals", "finals - covered", "excluded + eligible - covered"
        ),
        Metric("overall_agreement", "agreed", "compared", False, "eligible", "eligible - compared", "excluded"),
        *[
            Metric(f"agreement_{a}", f"same_{a}", f"pair_{a}", False, f"want_{a}", f"want_{a} - pair_{a}")
            for a in ACTIONS
        ],
        Metric("unsafe_keep_rate", "unsafe", "pair_reject", False, "want_reject", "want_reject - pair_reject"),
        Metric("review_coverage", "same_review", "pair_review", False, "want_review", "want_review - pair_review"),
    ]
    return metric_table(counted(aligned, conditions), metrics)


def confusion_matrix(aligned: DataFrame) -> DataFrame:
    """Expected against observed action, zero-filled."""
    rows = aligned.filter(f"{ELIGIBLE} AND final.final_decision IS NOT NULL")
    counts = rows.groupBy(F.col("labels.expected_action").alias("expected")).agg(
        *[F.count_if(F.col("final.final_decision") == a).alias(a) for a in ACTIONS]
    )
    frame = rows.sparkSession.createDataFrame([(a,) for a in ACTIONS], "expected string")
    return frame.join(counts, "expected", "left").na.fill(0, list(ACTIONS))


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels per reviewer and expected action."""
    return labels.groupBy("reviewer_id", "expected_action").agg(F.count("*").alias("n"))


def audit_report(
    aligned: DataFrame,
    comparison: DataFrame,
    explanations: DataFrame | None = None,
    pairs: DataFrame | None = None,
    tokens: tuple[str, ...] = (),
) -> DataFrame:
    """All metrics of a run in one long table (M9).

    ``explanations`` are the records of M4 (judged by ``tokens``), ``pairs`` those of
    M7; a run without them has no such section.
    """
    parts = {
        "artifact_integrity": artifact_integrity(aligned, "validation", ("deterministic", "calibrated", "routing", "final")),
        "evidence_stability": evidence_stability(comparison),
        "routing_behavior": routing_behavior(aligned),
        "policy_safety": policy_safety(aligned),
        "golden_validation": golden_validation(aligned),
    }
    if explanations is not None:
        parts["explanation_validity"] = explanation_validity(explanations, aligned.select("case_id"), tokens)
    if pairs is not None:
        parts["task_pair_consistency"] = task_pair_consistency(pairs)
    out = None
    for section, table in parts.items():
        table = table.select(F.lit(section).alias("section"), "*")
        out = table if out is None else out.unionByName(table)
    return out


def expectation_differences(observed: DataFrame, expected: dict[str, float]) -> DataFrame:
    """Named figures that differ from the published ones.

    ``observed`` is a long table (name, value); figures missing on one side count.
    """
    spark = observed.sparkSession
    stated = spark.createDataFrame([(k, float(v)) for k, v in expected.items()], "name string, expected double")
    joined = observed.select("name", F.col("value").cast("double").alias("value")).join(stated, "name", "full_outer")
    return joined.filter(~F.col("value").eqNullSafe(F.col("expected")))
