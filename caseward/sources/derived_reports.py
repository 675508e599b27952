"""QC reports, validation rows and review rows derived from the given order table.

Stands in for reports of other producers: every state the routing and decision
rules know (missing sides, signals, unreadable images, odd spellings) occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseward.config import DOMAINS
from caseward.functions.sql import project
from caseward.sources.derived import _project, read_table, dealt

SEVERITY_OF = (
    "CASE ({h}) % 29 WHEN 0 THEN 'critical' WHEN 1 THEN 'high_warning' WHEN 2 THEN 'moderate_warning' WHEN 3 THEN"
    " 'low_warning' WHEN 4 THEN 'low_warning' WHEN 5 THEN 'not_applicable' ELSE 'normal' END"
)
DOMAIN_OF = "CASE {x} " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS)) + " END"
LAYER_A = {
    "k": "o_orderkey",
    "case_id": "concat('C', lpad(CAST(o_orderkey AS STRING), 8, '0'))",
    "has_det": "o_orderkey % 103 <> 1",
    "has_cal": "o_orderkey % 107 <> 2",
    "has_cmp": "o_orderkey % 109 <> 3",
    "has_val": "o_orderkey % 113 <> 3",
    "det_rec": "CASE o_orderkey % 20 WHEN 3 THEN 'review' WHEN 4 THEN 'keep_with_metadata_warning' WHEN 5 THEN"
    " 'keep_with_metadata_warning' WHEN 6 THEN 'review' WHEN 8 THEN 'exclude' WHEN 9 THEN 'omit_from_training' ELSE 'keep' END",
    "det_risk": "CASE o_orderkey % 18 WHEN 4 THEN 'medium' WHEN 5 THEN 'high' ELSE 'low' END",
    "det_score": "CASE WHEN o_orderkey % 211 <> 9 THEN CAST((o_orderkey * 7) % 101 AS DOUBLE) END",
    "det_dom": DOMAIN_OF.format(x="o_orderkey % 11"),
    **{
        f"det_{d}": SEVERITY_OF.format(h=f"o_orderkey * {2 * i + 3} + o_orderkey % {31 + 2 * i}")
        for i, d in enumerate(DOMAINS)
    },
    "annotation": "CASE WHEN o_orderkey % 157 = 3 THEN NULL WHEN o_orderkey % 27 = 0 THEN 'absent' ELSE 'present' END",
    "observed": "CASE WHEN o_orderkey % 157 = 3 THEN NULL WHEN o_orderkey % 54 = 0 THEN 'absent' WHEN o_orderkey % 27 = 0"
    " THEN 'uncertain' WHEN o_orderkey % 11 = 2 THEN 'partial' ELSE 'present' END",
    "completeness": "CASE WHEN o_orderkey % 157 = 3 THEN NULL WHEN o_orderkey % 37 = 1 THEN 'incomplete'"
    " WHEN o_orderkey % 27 = 0 OR o_orderkey % 22 = 2 THEN 'uncertain' ELSE 'complete' END",
    "organ": "CASE WHEN o_orderkey % 167 = 6 THEN NULL ELSE o_orderkey % 27 <> 0 END",
    "visible": "CASE WHEN o_orderkey % 163 = 5 THEN NULL ELSE o_orderkey % 11 = 2 END",
    "readable": "CASE WHEN o_orderkey % 149 = 7 THEN false END",
    "blocking": "o_orderkey % 151 = 8",
    "unsure": "CASE WHEN o_orderkey % 71 = 3 THEN 'Yes' WHEN o_orderkey % 71 = 4 THEN 'no' END",
    "conflict": "CASE WHEN o_orderkey % 73 = 4 THEN 'true' END",
    "cal_unsure": "CASE WHEN o_orderkey % 79 = 5 THEN 'uncertain' END",
    "val_status": "CASE WHEN o_orderkey % 43 = 1 THEN 'invalid' WHEN o_orderkey % 131 = 2 THEN ' Invalid' ELSE 'valid' END",
    "val_omit": "o_orderkey % 43 = 1 AND o_orderkey % 2 = 0",
}
LAYER_B = {
    "*": "*",
    "cal_rec": "CASE WHEN k % 13 = 5 THEN CASE k % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'review' WHEN 2 THEN 'exclude'"
    " ELSE 'unheard_of' END ELSE det_rec END",
    "cal_risk": "CASE WHEN k % 17 = 4 THEN 'high' ELSE det_risk END",
    "cal_score": "CASE WHEN k % 19 = 6 THEN det_score + 3 WHEN k % 23 = 1 THEN det_score + 0.5e0 ELSE det_score END",
    "cal_dom": f"CASE WHEN k % 29 = 3 THEN {DOMAIN_OF.format(x='k % 7')} ELSE det_dom END",
    **{
        f"cal_{d}": f"CASE WHEN k % 31 = {i} THEN 'moderate_warning' ELSE det_{d} END" for i, d in enumerate(DOMAINS)
    },
}
REPORT_LAYERS = (LAYER_A, LAYER_B)


def report_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat report columns of both variants, one row per order."""
    df = dealt(read_table(spark, sf_dir, "orders").select("o_orderkey"))
    for layer in REPORT_LAYERS:
        df = _project(df, layer)
    return df


def _report(keys: DataFrame, side: str) -> DataFrame:
    domains = ", ".join(
        f"'{d}', named_struct('component_score', {len(d)}, 'severity', {side}_{d}, 'enabled', {side}_{d} <> 'not_applicable')"
        for d in DOMAINS
    )
    columns = {
        "triage": f"named_struct('recommendation', {side}_rec, 'risk_level', {side}_risk, 'score', {side}_score)",
        "primary_issue": f"named_struct('domain', {side}_dom)",
        "qc_domains": f"named_struct({domains})",
        "target_presence": "CASE WHEN annotation IS NOT NULL THEN named_struct('expected_presence', 'required',"
        " 'annotation_presence', annotation, 'observed_presence', observed,"
        " 'visible_target_annotation_status', completeness) END",
        "measurements": "named_struct('pancreas_present', organ, 'partial_visibility_likely', visible)",
    }
    if side == "det":
        columns |= {
            "image_readable": "readable",
            "blocking_processing_error": "blocking",
            "uncertainty": "unsure",
            "evidence_disagreement": "conflict",
        }
    else:
        columns |= {"uncertain": "cal_unsure"}
    return project(keys.filter(f"has_{side}"), columns, ["case_id"])


def deterministic_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(report_keys(spark, sf_dir), "det")


def calibrated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(report_keys(spark, sf_dir), "cal")


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset-validation rows with the image path and mask paths of the case."""
    keys = report_keys(spark, sf_dir).filter("has_val")
    return keys.selectExpr(
        "case_id",
        "val_status AS status",
        "val_omit AS omit_from_training",
        "CASE WHEN k % 59 = 9 THEN NULL ELSE concat('/data/images/', case_id, '_0000.nii.gz') END AS image_path",
        "concat('/data/labels/', case_id, '/segmentations') AS segmentation_dir",
    )
