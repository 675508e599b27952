"""Decisions that ask for no rule list do not build the lists, and agree with them."""

import pytest

from caseward.config import DOMAINS
from caseward.operators.decisions import decide
from caseward.operators.routing import route, with_routing


def report(severity, risk):
    domains = ", ".join(f"'{d}', named_struct('severity', {severity}, 'enabled', true)" for d in DOMAINS)
    return (
        f"named_struct('triage', named_struct('recommendation', rec, 'risk_level', {risk}, 'score', 1D),"
        f" 'primary_issue', named_struct('domain', CAST(NULL AS STRING)), 'qc_domains', named_struct({domains}),"
        " 'target_presence', named_struct('expected_presence', 'required', 'annotation_presence', 'present',"
        " 'observed_presence', 'present', 'visible_target_annotation_status', 'complete'),"
        " 'measurements', named_struct('pancreas_present', true, 'partial_visibility_likely', false))"
    )


def aligned(spark):
    rows = [("a", "keep", "normal", "low"), ("b", "review", "normal", "low"), ("c", "keep", "critical", "high"), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "case_id string, rec string, sev string, risk string")
    sides = [f"CASE WHEN rec IS NOT NULL THEN {report('sev', 'risk')} END AS {s}" for s in ("deterministic", "calibrated")]
    return df.selectExpr("case_id", *sides)


@pytest.mark.parametrize("mode", ["pancreas_lesion", "pancreas_lesion_subregions"])
def test_unread_rule_lists_are_not_built(spark, mode):
    picked = with_routing(aligned(spark), mode).selectExpr("*", "routing.route_to_review AS routed")
    outcome = decide(picked, mode, ["routed"]).select("case_id", "final_decision", "decision_basis", "hard_failure", "routed")
    assert "array_sort" not in outcome._jdf.queryExecution().optimizedPlan().toString()
    got = {r["case_id"]: tuple(r)[1:] for r in outcome.collect()}
    assert got == {
        "a": ("keep", "calibrated_qc", False, False),
        "b": ("review", "review_routing", False, True),
        "c": ("reject", "deterministic_hard_failure", True, False),
        "d": ("insufficient_evidence", "insufficient_evidence", False, False),
    }


def test_status_agrees_with_the_lists(spark):
    for r in route(aligned(spark), "pancreas_lesion").collect():
        assert r["route_to_review"] == (r["status"] == "routed") == (len(r["route_reasons"]) > 0)
        assert r["hard_failure"] == any(x.startswith("deterministic_critical_hard_domain") for x in r["policy_rules_triggered"])
