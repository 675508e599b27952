"""Comparison, routing, policy and final decisions over derived reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseward.config import VISIBLE_PANCREAS_POLICY, policy_domains
from caseward.functions.sql import project
from caseward.operators import compare as cp
from caseward.operators import decisions as dc
from caseward.operators import routing as rt
from caseward.operators.align import align
from caseward.sources import derived_reports as dr
from caseward.sources.shared import stored
from oracle_sql import decisions as od
from oracle_sql.qc import query

from catalog.base import joined, register

FULL, LESION, ORGAN = "pancreas_lesion_subregions", "pancreas_lesion", "pancreas_only"


#: Cases that the comparison artifact of the derived run leaves out.
NOT_COMPARED = "CAST(substring(case_id, 2) AS BIGINT) % 109 = 3"


def comparison(spark, sf):
    """Stored comparison rows; some cases are missing from the artifact."""
    rows = cp.compare(dr.deterministic_reports(spark, sf), dr.calibrated_reports(spark, sf))
    return rows.filter(f"NOT ({NOT_COMPARED})")


def aligned(spark, sf):
    rows = align(
        deterministic=dr.deterministic_reports(spark, sf),
        calibrated=dr.calibrated_reports(spark, sf),
        validation=dr.validation_rows(spark, sf),
    )
    return cp.with_comparison(rows, NOT_COMPARED)


def routed(spark, sf, mode):
    return rt.with_routing(aligned(spark, sf), mode)


def decisions(spark, sf, mode):
    return dc.decide(routed(spark, sf, mode), mode)


def stored_decisions(spark, sf, mode):
    """Decisions as the artifact a run leaves behind; lookups read this, not the rules."""
    return stored(decisions(spark, sf, mode))


BOTH = "WHERE has_det OR has_cal"


@register("p04_qc_comparison", query(od.report_ctes() + [od.comparison_cte()], f"SELECT case_id, {od.COMPARISON} FROM cm {BOTH}"))
def p04(spark, sf):
    return cp.compare(dr.deterministic_reports(spark, sf), dr.calibrated_reports(spark, sf))


@register(
    "j02_case_union",
    query(od.report_ctes(), f"SELECT case_id, has_det AS has_deterministic, has_cal AS has_calibrated FROM al {BOTH}"),
)
def j02(spark, sf):
    both = align(deterministic=dr.deterministic_reports(spark, sf), calibrated=dr.calibrated_reports(spark, sf))
    return both.selectExpr(
        "case_id", "deterministic IS NOT NULL AS has_deterministic", "calibrated IS NOT NULL AS has_calibrated"
    )


@register(
    "j03_four_way_alignment",
    query(
        od.report_ctes(),
        "SELECT case_id, has_det AS has_deterministic, has_cal AS has_calibrated,"
        " has_cmp AND (has_det OR has_cal) AS has_comparison, has_val AS has_validation FROM al",
    ),
)
def j03(spark, sf):
    return aligned(spark, sf).selectExpr(
        "case_id", *[f"{n} IS NOT NULL AS has_{n}" for n in ("deterministic", "calibrated", "comparison", "validation")]
    )


@register(
    "a01_recommendation_transitions",
    query(
        od.report_ctes() + [od.comparison_cte()],
        "SELECT recommendation_deterministic || '->' || recommendation_calibrated AS transition, count(*) AS n"
        f" FROM cm {BOTH} GROUP BY 1",
    ),
)
def a01(spark, sf):
    return cp.transitions(p04(spark, sf))


@register(
    "a01_domain_transitions",
    query(
        od.report_ctes() + [od.comparison_cte()],
        "SELECT coalesce(det_dom, 'none') || '->' || coalesce(cal_dom, 'none') AS transition, count(*) AS n"
        f" FROM cm {BOTH} AND det_dom IS DISTINCT FROM cal_dom GROUP BY 1".replace("has_det OR has_cal", "(has_det OR has_cal)"),
    ),
)
def a01d(spark, sf):
    return cp.domain_transitions(p04(spark, sf))


@register(
    "a02_change_counts",
    query(
        od.report_ctes() + [od.comparison_cte()],
        "SELECT count(*) AS n_cases_compared, count(*) FILTER (changed) AS n_changed_cases,"
        " count(*) FILTER (recommendation_deterministic <> recommendation_calibrated) AS n_recommendation_changes,"
        f" count(*) FILTER (risk_deterministic <> risk_calibrated) AS n_risk_changes FROM cm {BOTH}",
    ),
)
def a02(spark, sf):
    return cp.comparison_summary(p04(spark, sf))


@register(
    "p05_hard_failure_rules",
    query(od.base(LESION), f"SELECT case_id, array_to_string({od.rule_list(od.hard_items(LESION))}, '|') AS rules FROM cm"),
)
def p05(spark, sf):
    df = aligned(spark, sf)
    rules = rt.validation_rules() + rt.deterministic_rules(df, policy_domains(LESION)[0])
    return df.selectExpr("case_id", f"{joined(rt.compact(rules))} AS rules")


_P6 = " UNION ALL ".join(
    f"SELECT '{m}' AS task_mode, '{kind}' AS kind, d AS domain, count(*) FILTER (sev = 'critical') AS n_critical"
    f" FROM long WHERE d IN ({', '.join(repr(d) for d in ds)}) GROUP BY d"
    for m in (ORGAN, LESION, FULL)
    for kind, ds in (("hard", od.HARD[m]), ("soft", od.SOFT[m]))
)


@register(
    "p06_domain_split",
    query(
        od.report_ctes()
        + [
            "long AS ("
            + " UNION ALL ".join(f"SELECT '{d}' AS d, det_{d} AS sev FROM al WHERE has_det" for d in od.DOMAINS)
            + ")"
        ],
        _P6,
    ),
)
def p06(spark, sf):
    from caseward.config import DOMAINS, TASK_MODES

    counts = dr.deterministic_reports(spark, sf).agg(
        *[F.count_if(F.col(f"qc_domains.{d}.severity") == "critical").alias(d) for d in DOMAINS]
    )
    rows = ", ".join(
        f"named_struct('task_mode', '{m}', 'kind', '{kind}', 'domain', '{d}', 'n_critical', {d})"
        for m in TASK_MODES
        for kind, ds in zip(("hard", "soft"), policy_domains(m))
        for d in ds
    )
    return counts.selectExpr(f"explode(array({rows})) AS r").select("r.*")


@register(
    "p07_signal_test",
    query(
        od.report_ctes(),
        f"SELECT case_id, {od.SIGNAL.format(x='unsure')} AS uncertain, {od.SIGNAL.format(x='conflict')} AS conflict"
        " FROM al WHERE has_det",
    ),
)
def p07(spark, sf):
    df = dr.deterministic_reports(spark, sf).select("case_id", F.struct("uncertainty", "evidence_disagreement").alias("r"))
    return df.selectExpr(
        "case_id",
        f"{rt.signal(df, 'r', *rt.SIGNALS)} AS uncertain",
        f"{rt.signal(df, 'r', 'evidence_disagreement')} AS conflict",
    )


@register("p08_disagreement", query(od.report_ctes(), f"SELECT case_id, {od.DIFFERS} AS disagrees FROM al {BOTH}"))
def p08(spark, sf):
    both = align(deterministic=dr.deterministic_reports(spark, sf), calibrated=dr.calibrated_reports(spark, sf))
    return both.selectExpr("case_id", f"{cp.disagrees()} AS disagrees")


def _routing_query(mode: str, slug: str) -> None:
    @register(
        f"p09_review_routing_{slug}",
        query(
            od.base(mode),
            "SELECT case_id, status, route_to_review, array_to_string(route_reasons, '|') AS route_reasons, len(hard) > 0 AS hard_failure,"
            " CASE WHEN len(missing) = 0 THEN 'complete' ELSE 'insufficient_evidence' END AS evidence_status,"
            " coalesce(det_dom, cal_dom) AS primary_domain, array_to_string(rules, '|') AS rules FROM wr",
        ),
    )
    def run(spark, sf):
        return rt.route(aligned(spark, sf), mode).selectExpr(
            "case_id",
            "status",
            "route_to_review",
            f"{joined('route_reasons')} AS route_reasons",
            "hard_failure",
            "evidence_status",
            "primary_domain",
            f"{joined('policy_rules_triggered')} AS rules",
        )


_routing_query(ORGAN, "organ")
_routing_query(FULL, "subregions")


@register(
    "a03_routing_summary",
    query(
        od.base(FULL),
        "SELECT count(*) AS n_cases, count(*) FILTER (route_to_review) AS n_routed, count(*) FILTER (NOT route_to_review) AS n_not_routed,"
        " count(*) FILTER (len(hard) > 0) AS n_hard_failures, count(*) FILTER (len(missing) > 0) AS n_insufficient_evidence FROM wr",
    ),
)
def a03(spark, sf):
    return rt.routing_summary(rt.route(aligned(spark, sf), FULL))


@register(
    "s11_queue_csv_rows",
    query(
        od.base(FULL),
        "SELECT case_id, status, route_to_review, array_to_string(route_reasons, ';') AS route_reasons, det_rec AS deterministic_recommendation,"
        " cal_rec AS calibrated_recommendation, val_status AS dataset_validation_status, val_omit AS dataset_validation_omit_from_training,"
        " coalesce(det_dom, cal_dom) AS primary_domain, len(hard) > 0 AS hard_failure,"
        " CASE WHEN len(missing) = 0 THEN 'complete' ELSE 'insufficient_evidence' END AS evidence_status, 'v1.0' AS policy_version,"
        " array_to_string(rules, ';') AS policy_rules_triggered FROM wr",
    ),
)
def s11(spark, sf):
    return rt.csv_rows(rt.route(aligned(spark, sf), FULL))


@register(
    "p10_composed_decision",
    query(
        od.base(LESION) + od.composed_ctes(LESION),
        "SELECT case_id, final_decision, decision_basis, len(h) > 0 AS hard_failure, final_decision = 'review' AS requires_human_review,"
        " coalesce(cal_risk, det_risk) AS risk_level, coalesce(det_dom, cal_dom) AS primary_domain,"
        " array_to_string(decision_rules, '|') AS rules FROM dd",
    ),
)
def p10(spark, sf):
    return decisions(spark, sf, LESION).selectExpr(
        "case_id",
        "final_decision",
        "decision_basis",
        "hard_failure",
        "requires_human_review",
        "risk_level",
        "primary_domain",
        f"{joined('policy_rules_triggered')} AS rules",
    )


@register(
    "p11_policy_context",
    query(
        od.base(ORGAN) + od.policy_ctes(),
        """SELECT case_id, coalesce(val_omit, false) AS omitted, coalesce(lower(trim(val_status)) = 'invalid', false) AS invalid,
          has_det AS det_present, block AS blocking, img AS image_readable, has_det AS geometry_complete, gvalid AS geometry_valid,
          has_det AND visible IS NOT NULL AS fov_complete, dmild AS det_mild, cmild AS cal_mild, target_ok AS evidence_complete,
          mask AS mask_present, coalesce(mask, false) AND coalesce(gvalid, false) AS mask_valid, route_to_review,
          has_cmp AND recommendation_change <> 'unchanged' AND (has_det OR has_cal) AS recommendation_changed FROM pz""",
    ),
)
def p11(spark, sf):
    ctx = dc.policy_context(routed(spark, sf, ORGAN))
    d = "ctx.deterministic"
    return project(
        ctx,
        {
            "omitted": "ctx.validation.omit_from_training",
            "invalid": "ctx.validation.status_invalid",
            "det_present": f"{d}.present",
            "blocking": f"{d}.blocking_processing_error",
            "image_readable": f"{d}.image_readable",
            "geometry_complete": f"{d}.geometry.complete",
            "geometry_valid": f"{d}.geometry.valid",
            "fov_complete": f"{d}.fov.complete",
            "det_mild": f"{d}.non_blocking_warning",
            "cal_mild": "ctx.calibrated.non_blocking_warning",
            "evidence_complete": f"{d}.target.evidence_complete",
            "mask_present": f"{d}.target.mask_present",
            "mask_valid": f"{d}.target.mask_valid",
            "route_to_review": "ctx.routing.route_to_review",
            "recommendation_changed": "ctx.comparison.recommendation_changed",
        },
        ["case_id"],
    )


POLICY_SQL = (
    "SELECT case_id, final_decision, decision_basis, rule AS matched_rule, coalesce(rule <= 'VP-006', false) AS hard_failure FROM pz"
)


@register("p12_first_match_policy", query(od.base(ORGAN) + od.policy_ctes(), POLICY_SQL))
def p12(spark, sf):
    return decisions(spark, sf, ORGAN).select(
        "case_id", "final_decision", "decision_basis", "matched_rule", "hard_failure"
    )


@register(
    "a04_decision_counts",
    query(
        od.base(FULL) + od.composed_ctes(FULL),
        "SELECT final_decision, decision_basis, count(*) AS n, count(*) FILTER (final_decision = 'review') AS n_review_required,"
        " count(*) FILTER (len(h) > 0) AS n_hard_failures FROM dd GROUP BY 1, 2",
    ),
)
def a04(spark, sf):
    return dc.decision_counts(decisions(spark, sf, FULL))


@register(
    "v09_decision_recomputation",
    query(
        od.base(ORGAN) + od.policy_ctes(),
        """SELECT case_id, unnest(CASE WHEN k % 137 = 13 THEN ['missing_decision'] ELSE list_filter([CASE WHEN k % 139 = 14 THEN 'duplicate_decision' END,
             CASE WHEN st <> final_decision THEN 'changed_action' END, CASE WHEN k % 131 = 12 THEN 'changed_rule' END,
             CASE WHEN k % 131 = 12 THEN 'unknown_rule' END, CASE WHEN k % 131 <> 12 AND k % 149 = 15 THEN 'wrong_rule_name' END,
             CASE WHEN k % 131 <> 12 AND st <> final_decision THEN 'wrong_rule_action' END], lambda x : x IS NOT NULL) END) AS violation
           FROM (SELECT *, CASE WHEN k % 127 = 11 THEN 'keep' ELSE final_decision END AS st FROM pz)""",
    ),
)
def v09(spark, sf):
    """Stored decisions, tampered with on some keys, against those decided again from the inputs."""
    k = "CAST(substring(case_id, 2) AS BIGINT)"
    names = dc.rule_table(VISIBLE_PANCREAS_POLICY, 1)
    tampered = stored_decisions(spark, sf, ORGAN).selectExpr(
        "case_id",
        f"CASE WHEN {k} % 127 = 11 THEN 'keep' ELSE final_decision END AS final_decision",
        f"CASE WHEN {k} % 131 = 12 THEN 'VP-999' ELSE matched_rule END AS matched_rule",
        f"CASE WHEN {k} % 149 = 15 THEN 'other' ELSE {names}[matched_rule] END AS rule_name",
    ).filter(f"{k} % 137 <> 13")
    tampered = tampered.unionByName(tampered.filter(f"{k} % 139 = 14"))
    return dc.decision_violations(tampered, decisions(spark, sf, ORGAN))


@register(
    "h06_cases_by_rule",
    query(
        od.base(ORGAN) + od.policy_ctes(),
        "SELECT rule, final_decision AS action, count(*) AS n FROM pz WHERE rule IS NOT NULL GROUP BY 1, 2",
    ),
)
def h06(spark, sf):
    """Cases per policy rule, with the action the rule stands for."""
    actions = {r[0]: r[2] for r in VISIBLE_PANCREAS_POLICY["rules"]}
    counts = stored_decisions(spark, sf, ORGAN).filter("matched_rule IS NOT NULL").groupBy("matched_rule").agg(F.count("*").alias("n"))
    action = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in actions.items())
    return counts.selectExpr("matched_rule AS rule", f"CASE matched_rule {action} END AS action", "n")
