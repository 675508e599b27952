"""Hand-made rows for rules the derived tables cannot reach."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from caseward.config import THRESHOLDS, Settings
from caseward.operators import decisions as dc
from caseward.operators.flags import evidence, raise_flags
from caseward.operators.report import qc_report
from caseward.operators.scoring import first_pass, overlap_penalty

CASE = """case_id string, image struct<shape_zyx:array<int>,spacing_xyz_mm:array<double>>,
 metadata struct<sex:string,age:int,ct_phase:string,manufacturer:string>,
 pancreas struct<volume_mm3:double,bounding_box_zyx:array<array<int>>>,
 lesions struct<n_lesions:int,total_volume_mm3:double>,
 quality_control struct<pancreas_mask_empty:boolean,lesion_mask_empty:boolean,total_overlap_rate_vs_lesion:double,
   lesion_annotation_evidence:struct<status:string>>,
 case_status struct<omit_from_training:boolean,error_type:string>"""


def case(spark, cid="a", organ=50000.0, lesion=1000.0, overlap=0.9, status="lesion_present", meta=("F", 50, "Venous", "X"), omit=False):
    row = (
        cid,
        ([60, 512, 512], [0.8, 0.8, 2.5]),
        meta,
        (organ, [[20, 100, 100], [40, 300, 300]] if organ else None),
        (1 if lesion else 0, lesion),
        (not organ, not lesion, overlap, (status,)),
        (omit, "image_read_error" if omit else None),
    )
    return spark.createDataFrame([row], CASE)


@pytest.mark.parametrize(
    "overlap, expected",
    [(0.8, 0), (0.62, 22), (0.5, 36), (0.45, 42), (0.3, 60), (0.15, 72), (0.05, 81), (0.01, 85), (None, 45)],
)
def test_overlap_penalty(spark, overlap, expected):
    df = spark.createDataFrame([(overlap, True, True)], "overlap_rate_vs_lesion double, lesion_present boolean, pancreas_present boolean")
    assert df.selectExpr(f"{overlap_penalty()} AS p").first()["p"] == expected


def test_overlap_penalty_is_monotone(spark):
    df = spark.range(0, 101).selectExpr("id / 100D AS overlap_rate_vs_lesion", "true AS lesion_present", "true AS pancreas_present")
    values = [r[0] for r in df.selectExpr(f"{overlap_penalty()} AS p", "overlap_rate_vs_lesion AS o").orderBy("o").select("p").collect()]
    assert values == sorted(values, reverse=True)


def test_clean_case_is_kept(spark):
    row = qc_report(case(spark), Settings("pancreas_lesion")).first()
    assert (row["triage"]["recommendation"], row["triage"]["risk_level"]) == ("keep", "low")


def test_negative_needs_annotation_evidence(spark):
    """Absence without annotation evidence is critical, confirmed absence is not."""
    open_case = qc_report(case(spark, lesion=0.0, overlap=None, status=None), Settings("pancreas_lesion")).first()
    confirmed = qc_report(case(spark, lesion=0.0, overlap=None, status="confirmed_absent"), Settings("pancreas_lesion")).first()
    assert open_case["triage"]["recommendation"] == "exclude"
    assert confirmed["triage"]["recommendation"] == "keep"


def test_missing_organ_is_excluded_in_organ_task(spark):
    row = qc_report(case(spark, organ=0.0), Settings("pancreas_only")).first()
    assert row["triage"]["recommendation"] == "exclude"
    assert row["target_presence"]["observed_presence"] == "uncertain"


def test_omitted_case_changes_between_passes(spark):
    first = first_pass(case(spark, omit=True), Settings("pancreas_lesion")).first()
    final = qc_report(case(spark, omit=True), Settings("pancreas_lesion")).first()
    assert (first["first_recommendation"], first["first_risk"]) == ("omit_from_training", "critical")
    assert (final["triage"]["recommendation"], final["triage"]["risk_level"]) == ("exclude", "high")


def test_strict_overlap_band(spark):
    """Reachable only when the strict limit exceeds the minimum."""
    limits = {**THRESHOLDS, "MIN_LESION_PANCREAS_OVERLAP": 0.5, "STRICT_LESION_PANCREAS_OVERLAP": 0.95}
    st = Settings("pancreas_lesion", limits)
    row = raise_flags(evidence(case(spark), st), st).first()
    assert row["f__lesion_overlap_strict_fail"] == 2 and row["f__lesion_partial_outside"] == 1


def test_age_zero_counts_as_missing(spark):
    st = Settings("pancreas_lesion")
    row = evidence(case(spark, meta=("", 0, "Venous", "X")), st).first()
    assert row["n_missing_metadata"] == 2


CTX = """validation struct<omit_from_training:boolean,status_invalid:boolean>,
 deterministic struct<present:boolean,blocking_processing_error:boolean,image_readable:boolean,
  geometry:struct<complete:boolean,valid:boolean,hard_failure:boolean>,fov:struct<complete:boolean>,non_blocking_warning:boolean,
  target:struct<evidence_complete:boolean,expected_presence:string,observed_presence:string,visible_target_annotation_status:string,
   mask_present:boolean,mask_empty:boolean,mask_valid:boolean>>,
 calibrated struct<present:boolean,non_blocking_warning:boolean>,
 comparison struct<recommendation_changed:boolean,risk_level_changed:boolean>, routing struct<route_to_review:boolean>"""


def context(spark, **changes):
    base = {
        "validation": {"omit_from_training": False, "status_invalid": False},
        "deterministic": {
            "present": True,
            "blocking_processing_error": False,
            "image_readable": True,
            "geometry": {"complete": True, "valid": True, "hard_failure": False},
            "fov": {"complete": True},
            "non_blocking_warning": False,
            "target": {
                "evidence_complete": True,
                "expected_presence": "required",
                "observed_presence": "present",
                "visible_target_annotation_status": "complete",
                "mask_present": True,
                "mask_empty": False,
                "mask_valid": True,
            },
        },
        "calibrated": {"present": True, "non_blocking_warning": False},
        "comparison": {"recommendation_changed": False, "risk_level_changed": False},
        "routing": {"route_to_review": False},
    }
    for path, value in changes.items():
        node = base
        *parents, leaf = path.split("__")
        for p in parents:
            node = node[p]
        node[leaf] = value
    df = spark.createDataFrame([(json.dumps(base),)], "t string")
    return df.select(F.from_json("t", _parse_datatype_string(CTX)).alias("ctx"))


@pytest.mark.parametrize(
    "changes, rule, action",
    [
        ({}, "VP-014", "keep"),
        ({"validation__omit_from_training": True}, "VP-001", "reject"),
        ({"deterministic__image_readable": False}, "VP-002", "reject"),
        ({"deterministic__geometry__valid": False}, "VP-003", "reject"),
        ({"deterministic__target__observed_presence": "absent"}, "VP-004", "reject"),
        ({"deterministic__target__mask_empty": True}, "VP-005", "reject"),
        ({"deterministic__target__visible_target_annotation_status": "incomplete"}, "VP-006", "reject"),
        ({"calibrated__present": False}, "VP-007", "insufficient_evidence"),
        ({"deterministic__target__observed_presence": "uncertain"}, "VP-008", "insufficient_evidence"),
        (
            {
                "deterministic__target__observed_presence": "partial",
                "deterministic__target__visible_target_annotation_status": "uncertain",
            },
            "VP-009",
            "review",
        ),
        ({"routing__route_to_review": True}, "VP-010", "review"),
        ({"comparison__risk_level_changed": True}, "VP-011", "review"),
        ({"deterministic__target__observed_presence": "partial"}, "VP-012", "warning"),
        ({"calibrated__non_blocking_warning": True}, "VP-013", "warning"),
        ({"deterministic__target__mask_valid": False}, None, "insufficient_evidence"),
    ],
)
def test_policy_rules(spark, changes, rule, action):
    row = dc.first_match_policy(context(spark, **changes)).first()
    assert (row["rule_id"], row["action"]) == (rule, action)


def test_policy_operators(spark):
    df = context(spark)
    leaf = lambda *c: dc.condition_sql(df, c)
    values = df.selectExpr(
        leaf("routing.route_to_review", "not_equals", True),
        leaf("routing.unknown", "equals", None),
        leaf("routing.unknown", "exists", False),
        leaf("deterministic.target.observed_presence", "in", ["present"]),
        leaf("deterministic.target.observed_presence", "not_in", ["present"]),
        leaf("deterministic.present", "truthy"),
        leaf("deterministic.present", "falsy"),
        leaf("not", ("deterministic.present", "falsy")),
    ).first()
    assert list(values) == [True, False, True, True, False, True, False, True]


def test_bad_policies_are_rejected():
    good = dc.VISIBLE_PANCREAS_POLICY
    with pytest.raises(ValueError):
        dc.check_policy({**good, "evaluation": "all"})
    with pytest.raises(ValueError):
        dc.check_policy({**good, "rules": good["rules"] + (good["rules"][0],)})
    with pytest.raises(ValueError):
        dc.check_policy({**good, "roots": ("validation",)})
