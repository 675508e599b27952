"""Claims, audits, review sampling, lookups and cross-task analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseward.config import DOMAINS, TASK_MODES, TASK_NOTATION, TASK_PROFILES
from caseward.functions.sql import project, rows_where
from caseward.operators import analysis as an
from caseward.operators import audit as au
from caseward.operators import claims as cl
from caseward.operators import compare as cp
from caseward.operators import grounding as gr
from caseward.operators import lookups as lk
from caseward.operators import review as rv
from caseward.operators import routing as rt
from caseward.operators import decisions as dc
from caseward.operators.align import align
from caseward.sources import derived_reports as dr
from caseward.sources.shared import small_methods, stored, stored_rules
from oracle_sql import decisions as od
from oracle_sql.qc import query

from catalog.base import joined, register
from catalog.decisions import FULL, LESION, NOT_COMPARED, ORGAN, aligned, comparison
from catalog.validation import CASE, keys

NUM = "CAST(substring(case_id, 2) AS BIGINT)"


def full_run(spark, sf, mode, labels=False):
    """Aligned rows with routing and final decision structs, all narrow after one shuffle."""
    parts = dict(
        deterministic=dr.deterministic_reports(spark, sf),
        calibrated=dr.calibrated_reports(spark, sf),
        validation=dr.validation_rows(spark, sf),
    )
    if labels:
        parts["labels"] = human_labels(spark, sf)
    rows = cp.with_comparison(align(**parts), NOT_COMPARED)
    return dc.with_decision(rt.with_routing(rows, mode), mode)


def human_labels(spark, sf):
    """Labels for some cases, some excluded, from the key."""
    return keys(spark, sf).filter("k % 6 = 1").selectExpr(
        "case_id",
        "CASE k % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'warning' WHEN 2 THEN 'review' WHEN 3 THEN 'reject' ELSE 'insufficient_evidence' END"
        " AS expected_action",
        "concat('reviewer_', CAST(k % 3 AS STRING)) AS reviewer_id",
        "k % 35 = 1 AS excluded",
    )


# -- claims ----------------------------------------------------------------------------------
def snaps(spark, sf):
    return cl.snapshots(aligned(spark, sf))


_ABN = "list_filter([" + ", ".join(
    f"CASE WHEN det_{d} NOT IN ('normal', 'not_applicable') THEN '{d}=' || det_{d} END" for d in sorted(DOMAINS)
) + "], lambda x: x IS NOT NULL)"


@register(
    "r01_evidence_snapshot",
    query(
        od.report_ctes(),
        "SELECT case_id, CASE WHEN has_det THEN 'available' ELSE 'missing' END AS availability, det_rec AS reported_recommendation,"
        f" det_risk AS risk_level, det_score AS score, det_dom AS primary_domain, array_to_string({_ABN}, '|') AS abnormal FROM al",
    ),
)
def r01(spark, sf):
    rows = aligned(spark, sf)
    return project(
        rows, {**cl.snapshot_columns("deterministic"), "abnormal": joined(cl.abnormal_domains("deterministic"))}, ["case_id"]
    )


_CONFLICT = (
    "list_filter([CASE WHEN b AND det_rec IS DISTINCT FROM cal_rec THEN 'reported_recommendation' END,"
    " CASE WHEN b AND det_risk IS DISTINCT FROM cal_risk THEN 'risk_level' END,"
    " CASE WHEN b AND det_score IS DISTINCT FROM cal_score THEN 'score' END,"
    " CASE WHEN b AND det_dom IS DISTINCT FROM cal_dom THEN 'primary_domain' END], lambda x: x IS NOT NULL)"
)
CONFLICT_CTES = od.report_ctes() + [
    od.comparison_cte(),
    "y0 AS (SELECT *, has_det AND has_cal AS b, has_cmp AND (has_det OR has_cal) AS c FROM cm)",
    f"y1 AS (SELECT *, {_CONFLICT} AS conflicts FROM y0)",
    "y2 AS (SELECT *, list_filter([CASE WHEN NOT has_det THEN 'missing_deterministic_case' END,"
    " CASE WHEN NOT has_cal THEN 'missing_calibrated_case' END, CASE WHEN NOT c THEN 'missing_comparison_case' END,"
    " CASE WHEN len(conflicts) > 0 THEN 'deterministic_calibrated_conflict' END,"
    " CASE WHEN c AND changed <> (len(conflicts) > 0) THEN 'comparison_alignment_inconsistency' END,"
    " CASE WHEN k % 139 = 4 THEN 'case_not_declared_in_context' END], lambda x: x IS NOT NULL) AS codes FROM y1)",
]


@register(
    "r02_conflict_summary",
    query(
        CONFLICT_CTES,
        "SELECT case_id, array_to_string(conflicts, '|') AS conflicts, array_to_string(codes, '|') AS uncertainty,"
        " CASE WHEN NOT has_det AND NOT has_cal THEN 'insufficient_evidence' WHEN len(codes) > 0 THEN 'partial' ELSE 'complete' END AS status FROM y2",
    ),
)
def r02(spark, sf):
    table = cl.conflict_summary(snaps(spark, sf), declared=f"{NUM} % 139 <> 4")
    return table.selectExpr(
        "case_id", f"{joined('conflicts')} AS conflicts", f"{joined('uncertainty')} AS uncertainty", "status"
    )


@register(
    "j05_conflict_alignment",
    query(CONFLICT_CTES, "SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT has_det AND NOT has_cal THEN 'insufficient_evidence'"
          " WHEN len(codes) > 0 THEN 'partial' ELSE 'complete' END AS status FROM y2) GROUP BY 1"),
)
def j05(spark, sf):
    return r02(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@register(
    "r03_identity_alignment",
    f"""SELECT {CASE} AS run_key, array_to_string(list_sort(list_filter([
        CASE WHEN k % 11 = 3 THEN 'calibrated_dataset_name_mismatch:other!=set' END,
        CASE WHEN k % 7 = 2 THEN 'deterministic_run_id_mismatch:x!=' || {CASE} END,
        CASE WHEN k % 13 = 5 THEN 'deterministic_task_mode_mismatch:pancreas_only!=pancreas_lesion' END], lambda x: x IS NOT NULL)), '|') AS issues
        FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 7 = 2 OR k % 11 = 3 OR k % 13 = 5""",
)
def r03(spark, sf):
    base = keys(spark, sf)
    contexts = base.selectExpr(
        "case_id AS run_key", "case_id AS run_id", "'set' AS dataset_name", "'pancreas_lesion' AS task_mode"
    )
    det = base.selectExpr(
        "case_id AS run_key",
        "'deterministic' AS source",
        "CASE WHEN k % 7 = 2 THEN 'x' ELSE case_id END AS run_id",
        "'set' AS dataset_name",
        "CASE WHEN k % 13 = 5 THEN 'pancreas_only' ELSE 'pancreas_lesion' END AS task_mode",
    )
    cal = base.selectExpr(
        "case_id AS run_key",
        "'calibrated' AS source",
        "CASE WHEN k % 7 = 2 THEN NULL ELSE case_id END AS run_id",
        "CASE WHEN k % 11 = 3 THEN 'other' ELSE 'set' END AS dataset_name",
        "'pancreas_lesion' AS task_mode",
    )
    return cl.identity_issues(contexts, det.unionByName(cal)).select(
        "run_key", F.array_join("issues", "|").alias("issues")
    )


def reasoning(spark, sf):
    """Reasoning records that misreport a score or hide conflicts on some keys; some are missing."""
    table = cl.conflict_summary(snaps(spark, sf)).filter(f"{NUM} % 119 <> 7")
    return table.withColumn(
        "deterministic",
        F.col("deterministic").withField(
            "score", F.expr(f"CASE WHEN {NUM} % 83 = 5 THEN deterministic.score + 1 ELSE deterministic.score END")
        ),
    ).withColumn("conflicts", F.expr(f"CASE WHEN {NUM} % 7 = 1 THEN CAST(array() AS ARRAY<STRING>) ELSE conflicts END"))


_BAD = "(k % 83 = 5 AND has_det AND det_score IS NOT NULL)"
_CHECKED = "(CASE WHEN has_det THEN 5 ELSE 1 END + CASE WHEN has_cal THEN 5 ELSE 1 END + CASE WHEN c THEN 5 ELSE 1 END)"
_AUDIT = f"""SELECT case_id, CASE WHEN r THEN {_CHECKED} - {_BAD}::INT ELSE 0 END AS n_supported, CASE WHEN r THEN {_BAD}::INT ELSE 0 END AS n_unsupported,
  CASE WHEN r AND k % 7 = 1 THEN array_to_string(list_sort(conflicts), '|') ELSE '' END AS omitted_conflicts,
  array_to_string(list_filter([CASE WHEN NOT r THEN 'missing_reasoning_case' END, CASE WHEN NOT has_det THEN 'missing_deterministic_evidence_case' END,
    CASE WHEN NOT has_cal THEN 'missing_calibrated_evidence_case' END, CASE WHEN NOT c THEN 'missing_comparison_evidence_case' END],
    lambda x: x IS NOT NULL), '|') AS evidence_gaps,
  CASE WHEN NOT r OR NOT has_det OR NOT has_cal OR {_BAD} THEN 'high' WHEN NOT c OR (k % 7 = 1 AND len(conflicts) > 0) THEN 'medium' ELSE 'none' END AS severity,
  CASE WHEN r AND has_det AND has_cal AND c THEN 'complete' ELSE 'audit_limited' END AS status
  FROM (SELECT *, k % 119 <> 7 AS r FROM y2)"""


@register("r04_claim_audit", query(CONFLICT_CTES, _AUDIT))
def r04(spark, sf):
    table = cl.claim_audit(reasoning(spark, sf), snaps(spark, sf))
    return table.selectExpr(
        "case_id",
        "n_supported",
        "n_unsupported",
        f"{joined('omitted_conflicts')} AS omitted_conflicts",
        f"{joined('evidence_gaps')} AS evidence_gaps",
        "severity",
        "status",
    )


def payloads(spark, sf):
    return keys(spark, sf).selectExpr(
        "k",
        "case_id",
        "concat('{\"summary\":{\"', CASE k % 6 WHEN 1 THEN 'new_Decision' WHEN 2 THEN 'blocked' WHEN 3 THEN 'traction' WHEN 4 THEN 'route_hint'"
        " ELSE 'note' END, '\":\"decision: keep\"},', CASE k % 7 WHEN 1 THEN '\"text\":\"says \\\\\"route\\\\\": yes\"'"
        " WHEN 2 THEN '\"list\":[{\"deep\":{\"Decision_x\" : 1}}]' WHEN 3 THEN '\"ro\\\\u0075te\":2' ELSE '\"n\":1' END, '}') AS payload",
    )


@register(
    "r05_forbidden_fields",
    f"SELECT {CASE} AS case_id, array_to_string(list_sort(list_filter([CASE o_orderkey % 6 WHEN 1 THEN 'new_decision' WHEN 2 THEN 'blocked' WHEN 4 THEN 'route_hint' END,"
    " CASE o_orderkey % 7 WHEN 2 THEN 'decision_x' WHEN 3 THEN 'route' END], lambda x: x IS NOT NULL)), '|') AS found FROM orders",
)
def r05(spark, sf):
    return payloads(spark, sf).selectExpr(
        "case_id", f"{joined(cl.forbidden_keys('payload', cl.CRITIQUE_TOKENS, cl.FORBIDDEN_NAMES))} AS found"
    )


DECIDED = od.base(LESION) + od.composed_ctes(LESION)


@register(
    "r06_compact_evidence",
    query(
        DECIDED,
        "SELECT case_id, final_decision AS final_action, decision_basis, route_to_review, coalesce(cal_risk, det_risk) AS risk_level,"
        " CASE WHEN det_score IS NOT NULL THEN det_score END AS score, CASE WHEN len(route_reasons) > 0 THEN array_to_string(route_reasons, '|')"
        " ELSE array_to_string(decision_rules, '|') END AS route_reasons, coalesce(organ::VARCHAR, '') AS pancreas_presence,"
        " CASE WHEN len(missing) = 0 THEN 'complete' ELSE 'insufficient_evidence' END AS evidence_status, false AS leaks_path FROM dd",
    ),
)
def r06(spark, sf):
    rows = with_measurements(full_run(spark, sf, LESION))
    table = gr.compact_evidence(rows, LESION)
    return table.selectExpr(
        "case_id",
        "final_action",
        "decision_basis",
        "route_to_review",
        "risk_level",
        "CAST(score AS DOUBLE) AS score",
        f"{joined('route_reasons')} AS route_reasons",
        "pancreas_presence",
        "evidence_status",
        "leaks_path",
    )


def with_measurements(rows):
    """Foreign reports lack lesion measures; they read as null."""
    m = F.col("deterministic.measurements")
    m = m.withField("lesion_present", F.lit(None).cast("boolean")).withField("lesion_volume_mm3", F.lit(None).cast("double"))
    return rows.withColumn("deterministic", F.col("deterministic").withField("measurements", m))


def responses(spark, sf):
    """Response texts with one planted fault per key class."""
    body = (
        "concat('{\"case_id\":\"', CASE WHEN v = 1 THEN 'Cz' ELSE case_id END, '\",\"evidence_summary\":\"score ', CAST(k % 97 AS STRING),"
        " CASE v WHEN 2 THEN ' and 123456' WHEN 3 THEN ' see /home/x' WHEN 4 THEN ' looks malignant' WHEN 5 THEN ' should be reject'"
        " WHEN 6 THEN ' with made_up_flag' WHEN 7 THEN ' visualization due to noise' WHEN 8 THEN ' fov_integrity 250' ELSE '' END,"
        " '\",\"reason_for_review_or_action\":', CASE v WHEN 14 THEN '7' WHEN 15 THEN '\"keep [A]\"' WHEN 16 THEN concat('\"keep', char(27), '[A\"') ELSE '\"keep\"' END, ',\"unresolved_items\":', CASE v WHEN 17 THEN '[5]' ELSE '[]' END, ',\"possible_consistency_questions\":[\"why?\"],\"limitations\":[],',"
        " CASE WHEN v = 9 THEN '\"score_override\":1,' ELSE '' END,"
        " '\"explicit_statement_that_deterministic_policy_is_authoritative\":\"', CASE WHEN v = 10 THEN 'no statement' ELSE"
        " 'The deterministic policy is authoritative' END, '\"}', CASE v WHEN 18 THEN ' and more' ELSE '' END)"
    )
    # Ids in letters: digits of an id would count as numbers the evidence does not hold.
    named = keys(spark, sf).selectExpr("k", "translate(case_id, '0123456789', 'abcdefghij') AS case_id", "k % 19 AS v")
    return named.selectExpr(
        "case_id",
        f"CASE v WHEN 11 THEN '' WHEN 12 THEN 'not json' WHEN 13 THEN '{{\"case_id\":\"x\"}}' ELSE {body} END AS raw_response",
        "'keep' AS final_action",
        "concat('fov_integrity ', case_id) AS evidence_text",
        "array(CAST(k % 97 AS STRING)) AS evidence_numbers",
    )


R7_SQL = f"""SELECT translate({CASE}, '0123456789', 'abcdefghij') AS case_id, CASE o_orderkey % 19 WHEN 1 THEN 'changed_case_id' WHEN 2 THEN 'unsupported_number' WHEN 3 THEN 'path'
        WHEN 4 THEN 'medical_claim' WHEN 5 THEN 'other_action' WHEN 6 THEN 'unsupported_identifier' WHEN 7 THEN 'causal_claim'
        WHEN 9 THEN 'wrong_keys' WHEN 10 THEN 'no_authority_statement' WHEN 11 THEN 'empty' WHEN 12 THEN 'not_json' WHEN 13 THEN 'wrong_keys' WHEN 14 THEN 'blank_text_field' WHEN 16 THEN 'terminal_text' WHEN 17 THEN 'bad_list_field' WHEN 18 THEN 'not_json' END AS violation
        FROM orders"""


@register("r07_response_grounding", R7_SQL)
def r07(spark, sf):
    return gr.check_responses(responses(spark, sf))


@register(
    "r08_reported_responses",
    f"SELECT case_id, violation, violation IS NULL AS usable, CASE WHEN violation IS NULL THEN 'response' ELSE 'fallback' END AS reported FROM ({R7_SQL})",
)
def r08_reported(spark, sf):
    """Responses that hold stand; for the others the template of their evidence is reported."""
    checked = gr.check_responses(responses(spark, sf))
    rows = with_measurements(full_run(spark, sf, LESION))
    return gr.report_responses(checked, gr.fallback_explanations(gr.compact_evidence(rows, LESION)))


@register(
    "r08_template_fallback",
    query(
        DECIDED,
        "SELECT case_id, 'Task tau_L: main domain ' || coalesce(det_dom, cal_dom, 'none') || ', final action ' || final_decision || '.' AS evidence_summary,"
        " 'The deterministic policy is authoritative; this text is not binding.' AS statement FROM dd",
    ),
)
def r08(spark, sf):
    rows = with_measurements(full_run(spark, sf, LESION))
    table = gr.fallback_explanations(gr.compact_evidence(rows, LESION))
    return table.select("case_id", "evidence_summary", "statement")


# -- audits ----------------------------------------------------------------------------------
HARD_SQL = (
    "(coalesce(len(h) > 0, false) OR coalesce(det_rec = 'omit_from_training', false) OR coalesce(CASE det_dom WHEN 'geometry_integrity'"
    " THEN det_geometry_integrity WHEN 'lesion_localization' THEN det_lesion_localization END = 'critical', false)"
    " OR coalesce(val_omit, false) OR coalesce(val_status = 'invalid', false))"
)


def metric_sql(counts: str, rows: list[tuple]) -> str:
    """(name, num, den, rule, eligible, missing, excluded) rows over one row of counts."""
    parts = []
    for name, num, den, rule, eligible, missing, excluded in rows:
        good = f"CASE WHEN ({num}) = ({den}) THEN 'passed' ELSE 'failed' END" if rule else "'available'"
        parts.append(
            f"SELECT '{name}' AS metric, CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den}) END AS value, ({num})::DOUBLE AS numerator,"
            f" ({den})::BIGINT AS denominator, CASE WHEN ({den}) = 0 THEN 'not_applicable' ELSE {good} END AS status,"
            f" ({eligible or den})::BIGINT AS eligible_n, ({missing})::BIGINT AS missing_n, ({excluded})::BIGINT AS excluded_n FROM {counts}"
        )
    return " UNION ALL ".join(parts)


RB_CTE = f"""rbc AS (SELECT count(*) FILTER (final_decision = 'review') AS review, count(*) FILTER (route_to_review) AS routed,
  count(*) FILTER (final_decision = 'review' AND route_to_review) AS both_n, count(*) AS records,
  count(*) FILTER ({HARD_SQL}) AS hard, count(*) FILTER ({HARD_SQL} AND route_to_review) AS hard_routed,
  count(*) FILTER ({HARD_SQL} AND final_decision NOT IN ('keep', 'keep_with_metadata_warning')) AS preserved,
  count(*) FILTER ({HARD_SQL} AND decision_basis = 'deterministic_hard_failure') AS based FROM dd)"""
RB_ROWS = [
    ("review_action_queue_consistency", "both_n", "review", True, "review", "review - both_n", "0"),
    ("review_queue_action_consistency", "both_n", "routed", True, "routed", "0", "0"),
    ("routing_record_consistency", "records", "records", True, None, "0", "0"),
    ("hard_failure_queue_exclusion", "hard - hard_routed", "hard", True, None, "0", "0"),
]
PS_ROWS = [
    ("hard_failure_preservation", "preserved", "hard", True, "hard", "0", "0"),
    ("hard_failure_basis_consistency", "based", "hard", True, "hard", "0", "0"),
]
ES_CTE = """esc AS (SELECT count(*) AS n, count(*) FILTER (changed) AS ch, count(*) FILTER (recommendation_deterministic = recommendation_calibrated) AS ag,
  count(score_delta) AS sn, coalesce(sum(abs(score_delta)), 0) AS ss FROM cm WHERE has_cmp AND (has_det OR has_cal))"""
ES_ROWS = [
    ("calibration_sensitivity_rate", "ch", "n", False, "n", "0", "0"),
    ("agreement_rate", "ag", "n", False, "n", "0", "0"),
    ("mean_absolute_score_shift", "ss", "sn", False, "n", "n - sn", "0"),
]


@register("m03_evidence_stability", query(od.base(LESION) + [ES_CTE], metric_sql("esc", ES_ROWS)))
def m03(spark, sf):
    return au.evidence_stability(comparison(spark, sf))


@register("m05_routing_behavior", query(DECIDED + [RB_CTE], metric_sql("rbc", RB_ROWS)))
def m05(spark, sf):
    return au.routing_behavior(full_run(spark, sf, LESION))


@register("m06_policy_safety", query(DECIDED + [RB_CTE], metric_sql("rbc", PS_ROWS)))
def m06(spark, sf):
    return au.policy_safety(full_run(spark, sf, LESION))


AI_CTE = """aic AS (SELECT count(*) AS n, count(*) FILTER (has_val <> has_det) AS a, count(*) FILTER (has_val <> has_cal) AS b,
  count(*) FILTER (NOT has_val) AS c, count(det_rec) AS dr, count(cal_rec) AS cr FROM dd)"""
AI_ROWS = [
    ("case_id_set_match", "(a = 0)::INT + (b = 0)::INT + 2 * (c = 0)::INT", "4", True, None, "0", "0"),
    ("required_final_fields_present", "4 * n + dr + cr", "6 * n", True, "6 * n", "2 * n - dr - cr", "0"),
]


@register("m02_artifact_integrity", query(DECIDED + [AI_CTE], metric_sql("aic", AI_ROWS)))
def m02(spark, sf):
    return au.artifact_integrity(
        full_run(spark, sf, LESION), "validation", ("deterministic", "calibrated", "routing", "final")
    )


@register(
    "m01_metric_envelope",
    "WITH c AS (SELECT count(*) FILTER (k % 3 <> 0) AS required_n, count(*) FILTER (k % 3 <> 0 AND k % 10 <> 4 AND k % 17 <> 2) AS required_ok,"
    " count(*) FILTER (k % 10 <> 4) AS provided_n, count(*) FILTER (k % 10 <> 4 AND k % 17 <> 2) AS provided_ok FROM (SELECT o_orderkey AS k FROM orders)) "
    + metric_sql(
        "c",
        [
            ("required_artifacts_present", "required_ok", "required_n", True, "required_n", "required_n - required_ok", "0"),
            ("provided_artifacts_load_rate", "provided_ok", "provided_n", True, "provided_n", "provided_n - provided_ok", "0"),
        ],
    ),
)
def m01(spark, sf):
    slots = keys(spark, sf).selectExpr("k % 3 <> 0 AS required", "k % 10 <> 4 AS provided", "k % 17 <> 2 AS loaded")
    return au.artifact_availability(slots)


EV_COUNTS = (
    "SELECT count(*) FILTER (k % 19 <> 3) AS known, count(*) FILTER (k % 23 <> 4) AS records, count(*) FILTER (k % 19 <> 3 AND k % 23 <> 4) AS covered,"
    " count(*) FILTER (k % 23 <> 4 AND k % 6 NOT IN (1, 2, 4) AND k % 7 NOT IN (2, 3)) AS clean, count(*) FILTER (k % 23 <> 4 AND k % 5 = 0) AS bare,"
    " 2 * count(*) FILTER (k % 23 <> 4 AND k % 5 <> 0) AS refs, count(*) FILTER (k % 23 <> 4 AND k % 5 <> 0 AND k % 13 <> 1)"
    " + count(*) FILTER (k % 23 <> 4 AND k % 5 <> 0 AND k % 29 <> 2) AS valid FROM (SELECT o_orderkey AS k FROM orders)"
)
EV_ROWS = [
    ("case_coverage", "covered", "known", False, "known", "known - covered", "records - covered"),
    ("case_id_validity", "covered", "records", True, None, "0", "records - covered"),
    ("decision_non_interference", "clean", "records", True, None, "0", "0"),
    ("evidence_reference_validity", "valid", "refs", True, None, "0", "bare"),
]


@register("m04_explanation_validity", f"WITH c AS ({EV_COUNTS}) " + metric_sql("c", EV_ROWS))
def m04(spark, sf):
    return au.explanation_validity(explanations(spark, sf), keys(spark, sf).filter("k % 19 <> 3").select("case_id"), cl.CRITIQUE_TOKENS)


def explanations(spark, sf):
    return payloads(spark, sf).filter("k % 23 <> 4").selectExpr(
        "case_id",
        "payload",
        "CASE WHEN k % 5 <> 0 THEN array(named_struct('artifact_type', 'qc', 'case_pointer', concat('/data/cases/',"
        " CASE WHEN k % 13 = 1 THEN 'other' ELSE case_id END)), named_struct('artifact_type', CASE WHEN k % 29 = 2 THEN '' ELSE 'cmp' END,"
        " 'case_pointer', '/data/all_cases/7')) END AS evidence_references",
    )


TP_COUNTS = (
    "SELECT count(*) AS n, count(*) FILTER (k % 5 <> 0 OR k % 7 <> 0) AS judged, count(*) FILTER (CASE WHEN k % 5 <> 0 THEN k % 3 = 0"
    " WHEN k % 7 <> 0 THEN k % 2 = 0 ELSE false END) AS good FROM (SELECT o_orderkey AS k FROM orders)"
)
TP_ROWS = [("pair_consistency", "good", "judged", False, "n", "n - judged", "0")]


@register("m07_task_pairs", f"WITH c AS ({TP_COUNTS}) " + metric_sql("c", TP_ROWS))
def m07(spark, sf):
    return au.task_pair_consistency(task_pairs(spark, sf))


def task_pairs(spark, sf):
    return keys(spark, sf).selectExpr(
        "CASE WHEN k % 5 <> 0 THEN k % 3 = 0 END AS consistent",
        "CASE WHEN k % 7 <> 0 THEN 'keep' END AS expected_decision",
        "CASE WHEN k % 2 = 0 THEN 'keep' ELSE 'review' END AS observed_decision",
    )


GOLD = [
    """gl AS (SELECT *, k % 6 = 1 AND k % 35 = 1 AS ex, CASE WHEN k % 6 = 1 AND k % 35 <> 1 THEN CASE k % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'warning'
         WHEN 2 THEN 'review' WHEN 3 THEN 'reject' ELSE 'insufficient_evidence' END END AS want FROM dd)""",
    """gc AS (SELECT count(*) AS finals, count(want) AS eligible, count(*) FILTER (ex) AS excluded, count(*) FILTER (want = final_decision) AS agreed,
         count(*) FILTER (want = 'reject' AND final_decision IN ('keep', 'warning')) AS unsafe, """
    + ", ".join(
        f"count(*) FILTER (want = '{a}') AS w_{a}, count(*) FILTER (want = '{a}' AND final_decision = '{a}') AS s_{a}" for a in rv.ACTIONS
    )
    + " FROM gl)",
]
GOLD_ROWS = (
    [
        ("label_coverage", "eligible", "finals", False, "finals", "finals - eligible", "excluded"),
        ("overall_agreement", "agreed", "eligible", False, "eligible", "0", "excluded"),
    ]
    + [(f"agreement_{a}", f"s_{a}", f"w_{a}", False, f"w_{a}", "0", "0") for a in rv.ACTIONS]
    + [
        ("unsafe_keep_rate", "unsafe", "w_reject", False, "w_reject", "0", "0"),
        ("review_coverage", "s_review", "w_review", False, "w_review", "0", "0"),
    ]
)


@register("m08_golden_validation", query(DECIDED + GOLD, metric_sql("gc", GOLD_ROWS)))
def m08(spark, sf):
    return au.golden_validation(full_run(spark, sf, LESION, labels=True))


def _section(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS section, * FROM ({sql})"


# All cases of the run are known here, whatever their key.
EV_RUN = "evc AS (" + EV_COUNTS.replace("k % 19 <> 3", "true") + ")"


@register(
    "m09_audit_report",
    query(
        DECIDED + GOLD + [RB_CTE, ES_CTE, AI_CTE, EV_RUN, f"tpc AS ({TP_COUNTS})"],
        " UNION ALL ".join(
            _section(n, metric_sql(c, r))
            for n, c, r in (
                ("artifact_integrity", "aic", AI_ROWS),
                ("evidence_stability", "esc", ES_ROWS),
                ("routing_behavior", "rbc", RB_ROWS),
                ("policy_safety", "rbc", PS_ROWS),
                ("golden_validation", "gc", GOLD_ROWS),
                ("explanation_validity", "evc", EV_ROWS),
                ("task_pair_consistency", "tpc", TP_ROWS),
            )
        ),
    ),
)
def m09(spark, sf):
    run = stored(full_run(spark, sf, LESION, labels=True), "run")
    return au.audit_report(run, comparison(spark, sf), explanations(spark, sf), task_pairs(spark, sf), cl.CRITIQUE_TOKENS)


@register(
    "a13_confusion_matrix",
    query(
        DECIDED + GOLD,
        "SELECT a.expected, "
        + ", ".join(f"count(*) FILTER (final_decision = '{x}') AS {x}" for x in rv.ACTIONS)
        + " FROM (VALUES "
        + ", ".join(f"('{x}')" for x in rv.ACTIONS)
        + ") a(expected) LEFT JOIN gl ON want = a.expected GROUP BY 1",
    ),
)
def a13(spark, sf):
    return au.confusion_matrix(stored(full_run(spark, sf, LESION, labels=True)))


@register(
    "a12_label_counts",
    """SELECT 'reviewer_' || (o_orderkey % 3) AS reviewer_id, CASE o_orderkey % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'warning' WHEN 2 THEN 'review'
       WHEN 3 THEN 'reject' ELSE 'insufficient_evidence' END AS expected_action, count(*) AS n FROM orders WHERE o_orderkey % 6 = 1 GROUP BY 1, 2""",
)
def a12(spark, sf):
    return au.label_counts(human_labels(spark, sf))


@register(
    "j07_label_agreement",
    query(DECIDED + GOLD, "SELECT case_id, want AS expected_action, final_decision, want = final_decision AS agrees FROM gl WHERE want IS NOT NULL"),
)
def j07(spark, sf):
    rows = stored(full_run(spark, sf, LESION, labels=True)).filter(au.ELIGIBLE)
    return rows.selectExpr(
        "case_id",
        "labels.expected_action",
        "final.final_decision",
        "labels.expected_action = final.final_decision AS agrees",
    )


# -- review sampling ---------------------------------------------------------------------------
POOL = od.base(ORGAN) + od.policy_ctes() + [
    """pool AS (SELECT case_id, k, final_decision AS action, coalesce(det_dom, cal_dom) AS pdom, rule,
         list_sort(list_distinct(['domain:' || coalesce(det_dom, cal_dom, 'none'), 'target_presence:' || coalesce(observed, 'unknown'),
           'annotation_presence:' || coalesce(annotation, 'unknown'), 'annotation_status:' || coalesce(completeness, 'unknown'), 'policy:' || rule])) AS tokens,
         CASE observed WHEN 'uncertain' THEN 8 WHEN 'partial' THEN 5 ELSE 0 END + CASE WHEN completeness = 'uncertain' THEN 3 ELSE 0 END
         + CASE WHEN coalesce(det_dom, cal_dom) IS NULL THEN 0 WHEN coalesce(det_dom, cal_dom) = 'metadata_completeness' THEN 1 ELSE 4 END
         + CASE coalesce(cal_risk, det_risk) WHEN 'medium' THEN 3 WHEN 'high' THEN 6 WHEN 'critical' THEN 8 ELSE 0 END
         + CASE WHEN val_status <> 'valid' OR val_omit THEN 8 ELSE 0 END + 1 AS edge, sha256('20260722:' || case_id) AS key
       FROM pz WHERE has_det AND has_val AND k % 59 <> 9 AND rule IS NOT NULL)""",
]


def matched_run(spark, sf):
    """A stored run; a case without a policy rule stops the sampling."""
    run = stored_rules(full_run(spark, sf, ORGAN), "run")
    left = dc.unmatched(run.filter("final IS NOT NULL").selectExpr("case_id", "final.matched_rule AS matched_rule")).first()
    if left is not None:
        raise ValueError(f"no policy rule for case {left['case_id']}")
    return run


def matched_pool(spark, sf):
    return rv.candidates(matched_run(spark, sf))


@register(
    "h01_feature_tokens",
    query(POOL, "SELECT case_id, action, array_to_string(tokens, '|') AS tokens, edge, key FROM pool"),
)
def h01(spark, sf):
    return matched_pool(spark, sf).selectExpr("case_id", "action", f"{joined('tokens')} AS tokens", "edge", "key")


@register("j06_sampling_join", query(POOL, "SELECT action, count(*) AS n FROM pool GROUP BY 1"))
def j06(spark, sf):
    return h01(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


def package(spark, sf):
    hashes = {"final": "f", "validation": "v", "deterministic": "d"}
    identity = {"run_id": "run_1", "dataset_name": "orders", "task_mode": ORGAN}
    return rv.build_package(matched_run(spark, sf), TASK_PROFILES[ORGAN]["required_masks"], identity, hashes)


def _draw(name: str, source: str, most: str, covered: str) -> str:
    """A recursive step for each drawn case: most new tokens, then edge score, then key."""
    return f"""{name} AS (SELECT 0 AS n, CAST([] AS VARCHAR[]) AS chosen, {covered} AS covered UNION ALL
      SELECT n + 1, list_append(any_value(chosen), arg_min(case_id, r)), list_distinct(list_concat(any_value(covered), arg_min(tokens, r)))
      FROM (SELECT s.n, s.chosen, s.covered, p.case_id, p.tokens, printf('%03d|%04d|%s',
              CAST(100 - len(list_filter(p.tokens, lambda t : NOT list_contains(s.covered, t))) AS INT), CAST(1000 - p.edge AS INT), p.key) AS r
            FROM {name} s, {source} p WHERE s.n < {most} AND NOT list_contains(s.chosen, p.case_id)) GROUP BY n)"""


_NO_TOKENS = "CAST([] AS VARCHAR[])"
_STRATA = {**rv.QUOTAS, "reject": rv.REJECT_QUOTA}
_PICKED = [
    *[f"pool_{x} AS (SELECT case_id, tokens, edge, key FROM pool WHERE action = '{x}')" for x in _STRATA],
    *[_draw(f"draw_{x}", f"pool_{x}", str(n), _NO_TOKENS) for x, n in _STRATA.items()],
    "quota AS ("
    + " UNION ALL ".join(f"SELECT 'quota:{x}' AS stage, arg_max(chosen, n) AS chosen, arg_max(covered, n) AS covered FROM draw_{x}" for x in _STRATA)
    + ")",
    "picked AS (SELECT stage, unnest(chosen) AS case_id FROM quota)",
    "pool_rest AS (SELECT case_id, tokens, edge, key FROM pool WHERE case_id NOT IN (SELECT case_id FROM picked))",
    _draw("draw_rest", "pool_rest", "(SELECT 60 - count(*) FROM picked)", "(SELECT list_distinct(flatten(list(covered))) FROM quota)"),
    "chosen AS (SELECT stage, case_id FROM picked UNION ALL SELECT 'diverse_edge_fill', unnest(c) FROM (SELECT arg_max(chosen, n) AS c FROM draw_rest))",
    "numbered AS (SELECT *, 'R' || lpad(CAST(row_number() OVER (ORDER BY sha256('20260723:' || case_id)) AS VARCHAR), 3, '0') AS review_id FROM chosen)",
    """package AS (SELECT sha256('{"case_ids":[' || string_agg('"' || case_id || '"', ',' ORDER BY case_id)
      || '],"inputs":{"deterministic":"d","final":"f","validation":"v"},"seed":20260722}') AS package_id FROM chosen)""",
]


def picked_sql(select: str) -> str:
    return query(POOL, "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + ",\n".join(_PICKED) + "\n" + select


@register(
    "h02_review_package",
    picked_sql(
        """SELECT package_id, review_id, case_id, stage AS selection_stage, action AS system_action, coalesce(pdom, '') AS primary_domain,
          '["' || p.rule || '"]' AS policy_rules_triggered, coalesce(observed, '') AS target_observed_presence, coalesce(annotation, '') AS target_annotation_presence,
          coalesce(completeness, '') AS visible_target_annotation_status, coalesce(det_rec, '') AS deterministic_recommendation,
          coalesce(det_risk, '') AS deterministic_risk_level, det_score AS deterministic_score, coalesce(val_status, '') AS dataset_validation_status,
          'run_1' AS source_run_id, 'orders' AS dataset_name, 'pancreas_only' AS task_mode, '20260722' AS selection_seed, 'f' AS final_decisions_sha256,
          'v' AS dataset_validation_sha256, 'd' AS deterministic_evidence_sha256
        FROM numbered JOIN pool p USING (case_id) JOIN pz USING (case_id), package"""
    ),
)
def h02(spark, sf):
    return package(spark, sf)[1]


@register(
    "s13_reviewer_rows",
    picked_sql(
        """SELECT review_id, case_id, '/data/images/' || case_id || '_0000.nii.gz' AS image_path,
          '{"pancreas_mask":"/data/labels/' || case_id || '/segmentations/pancreas.nii.gz"}' AS mask_paths,
          '' AS annotation_completeness, '' AS expected_action, '' AS reviewer_id, '' AS confidence, '' AS rationale FROM numbered"""
    ),
)
def s13(spark, sf):
    return package(spark, sf)[0]


@register("p12_unmatched_cases", query(od.base(ORGAN) + od.policy_ctes(), "SELECT case_id FROM pz WHERE rule IS NULL"))
def p12_unmatched(spark, sf):
    run = full_run(spark, sf, ORGAN)
    return dc.unmatched(rows_where(run, "final IS NOT NULL", {"case_id": "case_id", "matched_rule": "final.matched_rule"}))


@register(
    "w01_contenders",
    query(
        POOL + [
            "c1 AS (SELECT *, row_number() OVER (PARTITION BY action, tokens ORDER BY edge DESC, key) AS a,"
            " row_number() OVER (PARTITION BY action ORDER BY edge DESC, key) AS b FROM pool)"
        ],
        "SELECT case_id, action, edge FROM c1 WHERE a = 1 OR b <= 60",
    ),
)
def w01(spark, sf):
    """The candidates a selection of 60 can draw: best per token set and top 60 per action."""
    pool = stored(matched_pool(spark, sf), "pool")
    return rv.contenders(pool, list(rv.ACTIONS)).select("case_id", "action", "edge")


@register(
    "w02_blinded_order",
    f"SELECT {CASE} AS case_id, 'R' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS review_id FROM"
    f" (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('20260723:' || {CASE})) AS n FROM orders)",
)
def w02(spark, sf):
    """Blinded numbering of all orders; a package numbers its 60 cases in the same way."""
    return rv.review_ids(keys(spark, sf).select("case_id"))


@register(
    "h03_review_import",
    """SELECT 'R' || k AS review_id, unnest(list_filter([CASE WHEN NOT r THEN 'missing_review' END, CASE WHEN NOT f THEN 'unexpected_review' END,
       CASE WHEN r AND k % 61 = 3 THEN 'duplicate_review' END, CASE WHEN f AND k % 97 = 11 THEN 'duplicate_reference' END,
       CASE WHEN r AND (k % 61 = 3 OR k % 101 = 12) THEN 'duplicate_review_case' END, CASE WHEN f AND (k % 97 = 11 OR k % 101 = 12) THEN 'duplicate_reference_case' END,
       CASE WHEN k % 101 = 12 THEN 'blank_case_id' END, CASE WHEN k % 67 = 4 AND k % 101 <> 12 AND r AND f THEN 'case_mismatch' END,
       CASE WHEN k % 71 = 5 AND r THEN 'annotation_completeness' END, CASE WHEN k % 73 = 6 AND r THEN 'expected_action' END,
       CASE WHEN k % 79 = 7 AND r THEN 'reviewer_id' END, CASE WHEN k % 83 IN (8, 9) AND r THEN 'confidence' END,
       CASE WHEN k % 89 = 10 AND r THEN 'rationale' END], lambda x: x IS NOT NULL)) AS violation
       FROM (SELECT o_orderkey AS k, o_orderkey % 53 <> 1 AS r, o_orderkey % 59 <> 2 AS f FROM orders) WHERE r OR f""",
)
def h03(spark, sf):
    base = keys(spark, sf)
    reviews = base.filter("k % 53 <> 1").selectExpr(
        "k",
        "concat(' R', CAST(k AS STRING)) AS review_id",
        "CASE WHEN k % 101 = 12 THEN ' ' WHEN k % 67 = 4 THEN concat('other', CAST(k AS STRING)) ELSE case_id END AS case_id",
        "CASE WHEN k % 71 = 5 THEN 'partly' ELSE ' Complete ' END AS annotation_completeness",
        "CASE WHEN k % 73 = 6 THEN NULL ELSE 'KEEP' END AS expected_action",
        "CASE WHEN k % 79 = 7 THEN ' ' ELSE 'r1' END AS reviewer_id",
        "CASE k % 83 WHEN 8 THEN '1.5' WHEN 9 THEN 'high' ELSE '0.5' END AS confidence",
        "CASE WHEN k % 89 = 10 THEN '' ELSE 'ok' END AS rationale",
    )
    reviews = reviews.unionByName(reviews.filter("k % 61 = 3"))
    reference = base.filter("k % 59 <> 2").selectExpr("k", "concat('R', CAST(k AS STRING)) AS review_id", "CASE WHEN k % 101 = 12 THEN NULL ELSE case_id END AS case_id")
    return rv.import_violations(reviews, reference.unionByName(reference.filter("k % 97 = 11")))


# -- lookups ----------------------------------------------------------------------------------
@register(
    "h04_case_resolution",
    f"SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 6 <> 5 THEN {CASE} END AS case_id FROM orders",
)
def h04(spark, sf):
    queries = keys(spark, sf).selectExpr(
        "k AS query_id",
        "CASE k % 6 WHEN 0 THEN lower(case_id) WHEN 1 THEN CAST(k AS STRING) WHEN 2 THEN concat('/x/', case_id, '_0000.nii.gz')"
        " WHEN 3 THEN concat('c_', CAST(k AS STRING)) WHEN 4 THEN concat(' C', CAST(k AS STRING), '.nii ') ELSE 'zzz' END AS value",
    )
    return lk.resolve(queries, keys(spark, sf).select("case_id"), "C")


@register(
    "h05_case_detail",
    query(
        DECIDED,
        "SELECT case_id, final_decision, decision_basis, val_status AS validation_status, observed AS observed_presence,"
        " det_rec AS deterministic_recommendation, det_score AS deterministic_score, cal_rec AS calibrated_recommendation,"
        " cal_score AS calibrated_score, route_to_review, status AS routing_status FROM dd",
    ),
)
def h05(spark, sf):
    return lk.case_detail(full_run(spark, sf, LESION))


@register(
    "w07_capped_listing",
    query(
        DECIDED,
        "SELECT case_id, (SELECT count(*) FROM dd WHERE final_decision = 'review') AS count,"
        " (SELECT count(*) FROM dd WHERE final_decision = 'review') > 50 AS truncated FROM dd WHERE final_decision = 'review'"
        " ORDER BY case_id LIMIT 50",
    ),
)
def w07(spark, sf):
    decided = stored(dc.decide(rt.with_routing(aligned(spark, sf), LESION), LESION))
    return lk.listing(decided, "final_decision = 'review'")


@register(
    "h07_selection_lookup",
    picked_sql(f"SELECT o.case_id, c.case_id IS NOT NULL AS selected, stage AS selection_stratum FROM (SELECT {CASE} AS case_id FROM orders) o LEFT JOIN chosen c USING (case_id)"),
)
def h07(spark, sf):
    """Every case with its stratum in the package; only the drawn 60 carry one."""
    return lk.selection_lookup(keys(spark, sf), package(spark, sf)[1])


@register(
    "h09_resource_availability",
    query(
        od.report_ctes(),
        "SELECT case_id, r AS resource, CASE WHEN r = 'image' THEN CASE WHEN k % 59 = 9 THEN NULL ELSE '/data/images/' || case_id || '_0000.nii.gz' END"
        " WHEN r = 'pancreas_mask' THEN '/data/labels/' || case_id || '/segmentations/pancreas.nii.gz'"
        " ELSE '/data/labels/' || case_id || '/segmentations/pancreatic_lesion.nii.gz' END AS path,"
        " CASE WHEN r = 'image' THEN k % 59 <> 9 AND k % 3 <> 0 WHEN r = 'pancreas_mask' THEN k % 4 <> 0 ELSE false END AS available"
        " FROM al, (VALUES ('image'), ('pancreas_mask'), ('lesion_mask')) v(r) WHERE has_val",
    ),
)
def h09(spark, sf):
    base = keys(spark, sf)
    files = base.filter("k % 3 <> 0").selectExpr("concat('/data/images/', case_id, '_0000.nii.gz') AS path").unionByName(
        base.filter("k % 4 <> 0").selectExpr("concat('/data/labels/', case_id, '/segmentations/pancreas.nii.gz') AS path")
    )
    return lk.resource_availability(dr.validation_rows(spark, sf), files, TASK_PROFILES[LESION]["required_masks"])


# -- cross-task analysis -------------------------------------------------------------------------
def runs(spark, sf):
    """Decisions of all three task profiles, long; every profile reads the same aligned rows."""
    rows = aligned(spark, sf)
    out = None
    for mode in TASK_MODES:
        hidden = [d for d in DOMAINS if d not in TASK_PROFILES[mode]["active_domains"]]
        severities = ", ".join(
            f"'{d}', " + ("'not_applicable'" if d in hidden else f"coalesce(deterministic.qc_domains.{d}.severity, 'normal')")
            for d in DOMAINS
        )
        picked = rt.with_routing(rows, mode).selectExpr(
            "*", "routing.route_to_review AS routed", f"named_struct({severities}) AS severities"
        )
        part = dc.decide(picked, mode, ["routed", "severities"]).selectExpr(
            "case_id",
            f"'{TASK_NOTATION[mode]}' AS profile",
            "final_decision AS action",
            "decision_basis AS basis",
            "hard_failure",
            "primary_domain",
            "routed",
            "severities",
        )
        out = part if out is None else out.unionByName(part)
    return out


def wide(spark, sf):
    """Profiles side by side, read back as the stored artifact the analysis starts from."""
    return stored_rules(an.side_by_side(runs(spark, sf)))


def _suffix(ctes: list[str], tag: str, known: set[str]) -> list[str]:
    import re

    names = [re.match(r"(\w+)", c).group(1) for c in ctes]
    out = []
    for c in ctes:
        for n in names:
            if n not in known:
                c = re.sub(rf"\b{n}\b(?=( AS |\)|$| |,))", f"{n}{tag}", c)
        out.append(c)
    return out


def _runs_ctes() -> list[str]:
    shared = od.report_ctes() + [od.comparison_cte()]
    known = {"ra", "rb", "al", "cm"}
    parts = list(shared)
    for tag, mode, final, table in (("_p", ORGAN, od.policy_ctes(), "pz"), ("_l", LESION, od.composed_ctes(LESION), "dd"), ("_s", FULL, od.composed_ctes(FULL), "dd")):
        chain = od.routing_ctes(mode) + final
        parts += _suffix(chain, tag, known)
        hard = "coalesce(rule <= 'VP-006', false)" if table == "pz" else "len(h) > 0"
        parts.append(
            f"t{tag} AS (SELECT case_id, final_decision AS action, decision_basis AS basis, {hard} AS hard, route_to_review AS routed,"
            f" coalesce(det_dom, cal_dom) AS dom FROM {table}{tag})"
        )
    sev = ", ".join(f"coalesce(det_{d}, 'normal') AS v_{d}" for d in DOMAINS)
    parts.append(f"sv AS (SELECT case_id AS sc, {sev} FROM al)")
    parts.append(
        "wd AS (SELECT p.case_id, p.action AS pa, l.action AS la, s.action AS sa, p.basis AS pb, l.basis AS lb, s.basis AS sb, p.hard AS ph, l.hard AS lh,"
        " s.hard AS sh, p.routed AS pr, l.routed AS lr, s.routed AS sr, p.action = l.action AND l.action = s.action AS stable, sv.*"
        " FROM t_p p JOIN t_l l ON l.case_id = p.case_id JOIN t_s s ON s.case_id = p.case_id JOIN sv ON sc = p.case_id)"
    )
    return parts


RUNS = _runs_ctes()


@register(
    "a15_decision_stability",
    query(
        RUNS,
        "SELECT count(*) AS aligned, count(*) FILTER (stable) AS stable, count(*) FILTER (NOT stable) AS changed, count(*) FILTER (pa <> la) AS changed_tau_P_tau_L,"
        " count(*) FILTER (pa <> sa) AS changed_tau_P_tau_S, count(*) FILTER (la <> sa) AS changed_tau_L_tau_S FROM wd",
    ),
)
def a15(spark, sf):
    return an.stability(wide(spark, sf))


@register(
    "a15_transition_matrix",
    query(
        RUNS,
        " UNION ALL ".join(
            f"SELECT '{n}' AS pair, {a} AS source, {b} AS target, count(*) AS n FROM wd GROUP BY 2, 3"
            for n, a, b in (("tau_P_to_tau_L", "pa", "la"), ("tau_P_to_tau_S", "pa", "sa"), ("tau_L_to_tau_S", "la", "sa"))
        ),
    ),
)
def a15m(spark, sf):
    return an.transition_matrix(wide(spark, sf))


@register(
    "a14_domain_prevalence",
    query(
        RUNS,
        " UNION ALL ".join(
            f"SELECT '{d}' AS domain, count(*) FILTER (stable AND v_{d} NOT IN ('normal', 'not_applicable')) AS stable_n,"
            f" count(*) FILTER (NOT stable AND v_{d} NOT IN ('normal', 'not_applicable')) AS changing_n,"
            f" 100e0 * count(*) FILTER (stable AND v_{d} NOT IN ('normal', 'not_applicable')) / count(*) FILTER (stable) AS stable_percent,"
            f" 100e0 * count(*) FILTER (NOT stable AND v_{d} NOT IN ('normal', 'not_applicable')) / count(*) FILTER (NOT stable) AS changing_percent FROM wd"
            for d in DOMAINS
        ),
    ),
)
def a14(spark, sf):
    return an.domain_prevalence(wide(spark, sf))


def _mechanism_sql() -> str:
    out = []
    active = {"p": TASK_PROFILES[ORGAN]["active_domains"], "l": TASK_PROFILES[LESION]["active_domains"], "s": TASK_PROFILES[FULL]["active_domains"]}
    for n, a, b in (("tau_P_to_tau_L", "p", "l"), ("tau_P_to_tau_S", "p", "s"), ("tau_L_to_tau_S", "l", "s")):
        items = [
            f"CASE WHEN NOT {a}r AND {b}r THEN 'routing: entered review' END",
            f"CASE WHEN {a}r AND NOT {b}r THEN 'routing: left review' END",
            f"CASE WHEN {a}b <> {b}b THEN 'basis: ' || {a}b || ' -> ' || {b}b END",
            f"CASE WHEN {a}h AND NOT {b}h THEN 'status: left hard failure' END",
        ]
        items += [
            f"CASE WHEN v_{d} <> 'not_applicable' THEN 'task-relevant domain: {d}' END"
            for d in DOMAINS
            if d not in active[a] and d in active[b]
        ]
        out.append(f"SELECT '{n}' AS pair, unnest([{', '.join(items)}]) AS mechanism FROM wd WHERE {a}a <> {b}a")
    return f"SELECT pair, mechanism, count(*) AS n FROM ({' UNION ALL '.join(out)}) WHERE mechanism IS NOT NULL GROUP BY 1, 2"


@register("a16_change_mechanisms", query(RUNS, _mechanism_sql()))
def a16(spark, sf):
    return an.change_mechanisms(wide(spark, sf))


def profile_table(spark, sf):
    """Every profile's own run over the derived cases, side by side."""
    from caseward.plans.profiles import profile_runs
    from caseward.sources.derived import case_summary

    cases = stored_rules(case_summary(spark, sf), "cases")
    with small_methods(spark):
        return stored(an.side_by_side(profile_runs(cases, dr.validation_rows(spark, sf))), "profiles")


@register("a14_profile_prevalence")
def a14p(spark, sf):
    return an.domain_prevalence(profile_table(spark, sf))


@register("a15_profile_stability")
def a15p(spark, sf):
    return an.stability(profile_table(spark, sf))


@register("a15_profile_transitions")
def a15pt(spark, sf):
    return an.transition_matrix(profile_table(spark, sf))


@register("a16_profile_mechanisms")
def a16p(spark, sf):
    return an.change_mechanisms(profile_table(spark, sf))


PUBLISHED = {"aligned": 1.0, "changed": -1.0, "published_only": 3.0}


@register(
    "m10_reproduction_checks",
    query(
        RUNS,
        """SELECT coalesce(o.name, e.name) AS name, o.value, e.expected FROM (SELECT unnest(['aligned', 'stable', 'changed', 'unaligned']) AS name,
             unnest([count(*), count(*) FILTER (stable), count(*) FILTER (NOT stable), 0])::DOUBLE AS value FROM wd) o
           FULL JOIN (VALUES """
        + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in {**PUBLISHED, "unaligned": 0.0}.items())
        + ") e(name, expected) ON o.name = e.name WHERE o.value IS DISTINCT FROM e.expected",
    ),
)
def m10(spark, sf):
    """Figures that differ from published ones, are missing there, or only there; equal ones do not appear."""
    figures = a15(spark, sf).selectExpr(
        "stack(4, 'aligned', CAST(aligned AS DOUBLE), 'stable', CAST(stable AS DOUBLE), 'changed', CAST(changed AS DOUBLE), 'unaligned', 0D) AS (name, value)"
    )
    return au.expectation_differences(figures, {**PUBLISHED, "unaligned": 0.0})


# -- joins and the whole run ---------------------------------------------------------------------
@register(
    "j01_metadata_lookup",
    f"SELECT {CASE} AS case_id, c_mktsegment AS manufacturer FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 1)"
    " ON o_custkey = c_custkey",
)
def j01(spark, sf):
    """Metadata of each case by key; Spark broadcasts the metadata only while it is small."""
    from caseward.sources.derived import read_table, dealt

    cases = dealt(read_table(spark, sf, "orders")).selectExpr(
        "concat('C', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS case_id", "o_custkey AS key"
    )
    meta = read_table(spark, sf, "customer").filter("c_custkey % 4 <> 1")
    meta = meta.selectExpr("c_custkey AS key", "c_mktsegment AS manufacturer")
    return cases.join(meta, "key", "left").select("case_id", "manufacturer")


@register(
    "j04_decision_alignment",
    query(
        DECIDED,
        "SELECT case_id, has_det AS has_deterministic, has_cal AS has_calibrated, has_val AS has_validation, final_decision FROM dd",
    ),
)
def j04(spark, sf):
    return full_run(spark, sf, LESION).selectExpr(
        "case_id",
        "deterministic IS NOT NULL AS has_deterministic",
        "calibrated IS NOT NULL AS has_calibrated",
        "validation IS NOT NULL AS has_validation",
        "final.final_decision",
    )


@register("c25_run_decisions")
def whole_run(spark, sf):
    """Final actions of a whole run over the derived cases: calibrate, judge twice, route, decide."""
    from caseward.config import Settings
    from caseward.plans.run import run
    from caseward.sources.derived import case_summary

    table = run(case_summary(spark, sf), dr.validation_rows(spark, sf), Settings(LESION))
    return table.groupBy("final.final_decision", "final.decision_basis").agg(F.count("*").alias("n"))
