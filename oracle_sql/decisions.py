"""SQL of comparison, routing and final decisions over the derived reports."""

from __future__ import annotations

from caseward.sources.derived_reports import REPORT_LAYERS
from oracle_sql.qc import DOMAINS, layer, query

SOFT = {
    "pancreas_only": ("attenuation_integrity", "fov_integrity", "metadata_completeness", "pancreas_context"),
    "pancreas_lesion": (
        "attenuation_integrity", "fov_integrity", "lesion_burden", "metadata_completeness", "pancreas_context",
    ),
    "pancreas_lesion_subregions": (
        "attenuation_integrity", "fov_integrity", "lesion_burden", "metadata_completeness", "pancreas_context",
        "region_consistency",
    ),
}
HARD = {
    "pancreas_only": ("geometry_integrity",),
    "pancreas_lesion": ("geometry_integrity", "lesion_localization"),
    "pancreas_lesion_subregions": ("geometry_integrity", "lesion_localization"),
}
RANK = "CASE {x} WHEN 'keep' THEN 0 WHEN 'keep_with_metadata_warning' THEN 0 WHEN 'review' THEN 1 WHEN 'exclude' THEN 2 WHEN 'omit_from_training' THEN 3 ELSE -1 END"
RISK = "CASE {x} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE -1 END"
ACTION = (
    "CASE {x} WHEN 'keep' THEN 'keep' WHEN 'keep_with_metadata_warning' THEN 'warning' WHEN 'keep_with_warning' THEN 'warning'"
    " WHEN 'warning' THEN 'warning' WHEN 'review' THEN 'review' WHEN 'exclude' THEN 'reject' WHEN 'omit_from_training' THEN 'reject'"
    " WHEN 'reject' THEN 'reject' ELSE 'insufficient_evidence' END"
)


def report_ctes() -> list[str]:
    a, b = REPORT_LAYERS
    det = ["det_rec", "det_risk", "det_score", "det_dom", *[f"det_{d}" for d in DOMAINS], "annotation", "observed",
           "completeness", "organ", "visible", "readable", "unsure", "conflict"]
    cal = ["cal_rec", "cal_risk", "cal_score", "cal_dom", *[f"cal_{d}" for d in DOMAINS], "cal_unsure"]
    blank = [f"CASE WHEN has_det THEN {c} END AS {c}" for c in det]
    blank += [f"CASE WHEN has_cal THEN {c} END AS {c}" for c in cal]
    blank += ["CASE WHEN has_det THEN blocking ELSE false END AS blocking"]
    blank += [f"CASE WHEN has_val THEN {c} END AS {c}" for c in ("val_status", "val_omit")]
    return [
        layer("ra", "orders", a),
        layer("rb", "ra", b),
        f"al AS (SELECT k, case_id, has_det, has_cal, has_cmp, has_val, {', '.join(blank)} FROM rb)",
    ]


def change(a: str, b: str, rank: str) -> str:
    x, y = rank.format(x=a), rank.format(x=b)
    return f"CASE WHEN {y} > {x} THEN 'escalated' WHEN {y} < {x} THEN 'deescalated' ELSE 'unchanged' END"


def comparison_cte(source: str = "al") -> str:
    a, b = "coalesce(det_rec, 'unknown')", "coalesce(cal_rec, 'unknown')"
    r, s = "coalesce(det_risk, 'unknown')", "coalesce(cal_risk, 'unknown')"
    return f"""cm AS (SELECT *, {a} AS recommendation_deterministic, {b} AS recommendation_calibrated,
      {change(a, b, RANK)} AS recommendation_change, {r} AS risk_deterministic, {s} AS risk_calibrated,
      {change(r, s, RISK)} AS risk_change, det_score AS score_deterministic, cal_score AS score_calibrated,
      cal_score - det_score AS score_delta, det_dom AS domain_deterministic, cal_dom AS domain_calibrated,
      ({a} <> {b} OR {r} <> {s} OR det_dom IS DISTINCT FROM cal_dom OR coalesce(abs(cal_score - det_score) >= 1, false)) AS changed
      FROM {source})"""


COMPARISON = (
    "recommendation_deterministic, recommendation_calibrated, recommendation_change, risk_deterministic, risk_calibrated,"
    " risk_change, score_deterministic, score_calibrated, score_delta, domain_deterministic, domain_calibrated, changed"
)
DIFFERS = (
    "(coalesce(det_rec <> cal_rec, false) OR coalesce(det_risk <> cal_risk, false) OR coalesce(det_dom <> cal_dom, false)"
    " OR coalesce(abs(cal_score - det_score) >= 1, false))"
)
SIGNAL = "coalesce(lower({x}) IN ('true', 'yes', 'uncertain'), false)"


def rule_list(items: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in items) + "], lambda x: x IS NOT NULL)"


def review_items(mode: str) -> list[tuple[str, str]]:
    out = []
    for side, name in (("det", "deterministic"), ("cal", "calibrated")):
        out.append((f"{side}_rec = 'review'", f"'{name}_recommendation_review'"))
        out.append((f"{side}_risk IN ('medium', 'high', 'critical')", f"'{name}_' || {side}_risk || '_risk'"))
        for d in SOFT[mode]:
            out.append((f"{side}_{d} IN ('moderate_warning', 'high_warning', 'critical')", f"'{name}_soft_domain:{d}:' || {side}_{d}"))
    out.append((SIGNAL.format(x="unsure"), "'deterministic_uncertainty'"))
    out.append((SIGNAL.format(x="cal_unsure"), "'calibrated_uncertainty'"))
    out.append((SIGNAL.format(x="conflict"), "'evidence_disagreement'"))
    return out


def hard_items(mode: str) -> list[tuple[str, str]]:
    out = [
        ("val_omit", "'dataset_validation_omit_from_training'"),
        ("lower(trim(val_status)) = 'invalid'", "'dataset_validation_status_invalid'"),
        ("det_rec = 'omit_from_training'", "'deterministic_omit_from_training'"),
    ]
    return out + [(f"det_{d} = 'critical'", f"'deterministic_critical_hard_domain:{d}'") for d in HARD[mode]]


MISSING = [
    ("NOT has_det", "'insufficient_evidence:missing_deterministic_case'"),
    ("NOT has_cal", "'insufficient_evidence:missing_calibrated_case'"),
]


def routing_ctes(mode: str) -> list[str]:
    """Routing over cm; rows without a comparison still have both reports."""
    hard = hard_items(mode)
    reasons = [(f"{DIFFERS} OR (has_cmp AND changed)", "'deterministic_calibrated_disagreement'")] + review_items(mode)
    if mode == "pancreas_only":
        hard = hard + [("annotation IS NOT NULL AND (annotation = 'absent' OR organ = false)",
                        "'deterministic_required_pancreas_mask_missing_or_empty'")]
        reasons.append(("observed = 'partial' AND completeness = 'uncertain'", "'partial_visible_target_annotation_uncertain'"))
    return [
        f"w0 AS (SELECT *, {rule_list(hard)} AS hard, {rule_list(MISSING)} AS missing,"
        f" list_sort(list_distinct({rule_list(reasons)})) AS reasons FROM cm)",
        """w1 AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'hard_failure' WHEN len(missing) > 0 THEN 'insufficient_evidence'
             WHEN len(reasons) > 0 THEN 'routed' ELSE 'not_routed' END AS status,
             CASE WHEN len(hard) > 0 OR len(missing) > 0 THEN [] ELSE reasons END AS route_reasons FROM w0)""",
        """wr AS (SELECT *, status = 'routed' AS route_to_review,
             list_sort(list_distinct(list_concat(list_concat(hard, CASE WHEN len(hard) > 0 THEN [] ELSE missing END), route_reasons))) AS rules
           FROM w1)""",
    ]


def composed_ctes(mode: str) -> list[str]:
    own = review_items(mode) + [(DIFFERS, "'deterministic_calibrated_disagreement'")]
    return [
        f"d0 AS (SELECT *, {rule_list(hard_items(mode))} AS h, {rule_list(own)} AS own, {ACTION.format(x='cal_rec')} AS mapped FROM wr)",
        """d1 AS (SELECT *, CASE WHEN len(h) > 0 THEN 'reject' WHEN len(missing) > 0 THEN 'insufficient_evidence'
             WHEN route_to_review OR len(own) > 0 THEN 'review' ELSE mapped END AS final_decision FROM d0)""",
        """dd AS (SELECT *, CASE WHEN len(h) > 0 THEN 'deterministic_hard_failure'
             WHEN final_decision = 'insufficient_evidence' THEN 'insufficient_evidence'
             WHEN route_to_review OR len(own) > 0 THEN 'review_routing' ELSE 'calibrated_qc' END AS decision_basis,
             list_sort(list_distinct(CASE WHEN len(h) > 0 THEN h WHEN len(missing) > 0 THEN missing
               WHEN route_to_review OR len(own) > 0 THEN list_concat(CASE WHEN route_to_review THEN rules ELSE [] END, own)
               ELSE list_concat(['calibrated_recommendation_mapped:' || coalesce(cal_rec, 'None') || '->' || mapped],
                 CASE WHEN mapped = 'insufficient_evidence' THEN ['insufficient_evidence:unrecognized_calibrated_recommendation'] ELSE [] END)
               END)) AS decision_rules FROM d1)""",
    ]


def policy_ctes() -> list[str]:
    low = lambda s: " OR ".join(f"coalesce({s}_{d} = 'low_warning', false)" for d in DOMAINS)
    return [
        f"""x0 AS (SELECT *, coalesce(det_rec = 'omit_from_training', false) OR blocking AS block,
            CASE WHEN has_det THEN det_geometry_integrity <> 'critical' END AS gvalid,
            CASE annotation WHEN 'present' THEN true WHEN 'absent' THEN false ELSE organ END AS mask,
            annotation IS NOT NULL AS target_ok,
            {ACTION.format(x='det_rec')} = 'warning' OR {low('det')} AS dmild,
            {ACTION.format(x='cal_rec')} = 'warning' OR {low('cal')} AS cmild FROM wr)""",
        "x1 AS (SELECT *, coalesce(readable, CASE WHEN has_det THEN NOT block END) AS img FROM x0)",
        """pd AS (SELECT *, CASE
            WHEN coalesce(val_omit, false) OR coalesce(lower(trim(val_status)) = 'invalid', false) OR block THEN 'VP-001'
            WHEN img = false THEN 'VP-002' WHEN gvalid = false THEN 'VP-003' WHEN observed = 'absent' THEN 'VP-004'
            WHEN mask = false THEN 'VP-005' WHEN completeness = 'incomplete' THEN 'VP-006'
            WHEN NOT has_det OR NOT has_cal OR visible IS NULL OR NOT target_ok THEN 'VP-007'
            WHEN observed = 'uncertain' THEN 'VP-008' WHEN observed = 'partial' AND completeness = 'uncertain' THEN 'VP-009'
            WHEN route_to_review THEN 'VP-010'
            WHEN has_cmp AND (recommendation_change <> 'unchanged' OR risk_change <> 'unchanged') THEN 'VP-011'
            WHEN observed = 'partial' AND completeness = 'complete' AND gvalid THEN 'VP-012'
            WHEN dmild OR cmild THEN 'VP-013'
            WHEN img AND gvalid AND observed = 'present' AND mask AND completeness = 'complete' THEN 'VP-014' END AS rule
          FROM x1)""",
        """pf AS (SELECT *, CASE WHEN rule <= 'VP-006' THEN 'reject' WHEN rule IN ('VP-007', 'VP-008') THEN 'insufficient_evidence'
            WHEN rule <= 'VP-011' THEN 'review' WHEN rule <= 'VP-013' THEN 'warning' WHEN rule = 'VP-014' THEN 'keep'
            ELSE 'insufficient_evidence' END AS final_decision FROM pd)""",
        """pz AS (SELECT *, CASE WHEN rule <= 'VP-006' THEN 'deterministic_hard_failure'
            WHEN final_decision = 'insufficient_evidence' THEN 'insufficient_evidence' WHEN final_decision = 'review' THEN 'review_routing'
            ELSE 'calibrated_qc' END AS decision_basis FROM pf)""",
    ]


def base(mode: str) -> list[str]:
    return report_ctes() + [comparison_cte()] + routing_ctes(mode)


__all__ = ["query", "base", "report_ctes"]
