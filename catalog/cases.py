"""Case assessment: flags, components, severities, reports and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseward.config import DOMAINS, FLAG_DOMAINS, SUBCHECKS, TASK_MODES, Settings
from caseward.functions.sql import project, severity_text
from caseward.operators import calibrate as cal
from caseward.operators import flags as fl
from caseward.operators import overview as ov
from caseward.operators import report as rp
from caseward.operators import scoring as sc
from caseward.operators.task import restrict_to_task, task_mode_evidence
from caseward.sources.derived import case_summary
from oracle_sql import qc

from catalog.base import joined, register

FULL = "pancreas_lesion_subregions"
LESION = "pancreas_lesion"
ORGAN = "pancreas_only"


def cases(spark: SparkSession, sf: str, mode: str = FULL) -> DataFrame:
    return restrict_to_task(case_summary(spark, sf), mode)


def evidence(spark, sf, mode=FULL):
    return fl.evidence(cases(spark, sf, mode), Settings(mode))


def flagged(spark, sf, mode=FULL):
    return fl.raise_flags(evidence(spark, sf, mode), Settings(mode))


def scored(spark, sf, mode=FULL, version="hybrid"):
    return sc.scored_cases(cases(spark, sf, mode), Settings(mode, score_version=version))


def first(spark, sf, mode=FULL):
    return sc.first_pass(cases(spark, sf, mode), Settings(mode))


def assessed(spark, sf, mode=FULL):
    return rp.assess(cases(spark, sf, mode), Settings(mode))


def _sql(mode: str, upto: str, select: str, score: str = "hybrid") -> str:
    return qc.query(qc.chain(mode, upto, score), select)


# -- flag rules: one query per rule group, flags as severity numbers ---------------------
FLAG_QUERIES = {
    "f01_omitted_case": (FULL, ["omit_from_training"]),
    "f04_negative_confirmation": (
        LESION,
        [
            "lesion_annotation_insufficient_evidence",
            "confirmed_negative_lesion",
            "unconfirmed_negative_lesion",
            "lesion_mask_empty",
        ],
    ),
    "f05_missing_required_target": (ORGAN, ["required_target_missing"]),
    "f06_unvalidatable_lesion": (LESION, ["lesion_no_anatomical_validation", "pancreas_mask_empty"]),
    "f07_overlap_bands": (
        FULL,
        [
            "lesion_overlap_critical_fail",
            "lesion_outside_pancreas",
            "lesion_overlap_strict_fail",
            "lesion_partial_outside",
        ],
    ),
    "f08_annotation_hints": (FULL, ["pancreas_hole_annotation_suspected", "lesion_in_subregion_spillover"]),
    "f10_subregion_applicability": (FULL, ["subregions_not_applicable", "subregions_expected_but_missing"]),
    "f11_region_empty": (FULL, ["head_region_empty", "body_region_empty", "tail_region_empty"]),
    "f12_region_sum_error": (
        FULL,
        ["incomplete_anatomical_coverage", "region_sum_error_critical", "region_sum_error_warning"],
    ),
    "f13_region_pair_overlap": (FULL, ["head_body_overlap", "head_tail_overlap", "body_tail_overlap"]),
    "f15_pancreas_volume": (FULL, ["very_small_pancreas", "small_pancreas", "large_pancreas"]),
    "f16_lesion_volume": (FULL, ["very_small_lesion", "very_large_lesion"]),
    "f17_lesion_pancreas_ratio": (FULL, ["high_lesion_pancreas_ratio"]),
    "f19_spacing": (FULL, ["invalid_spacing"]),
    "f20_shape": (FULL, ["shape_mismatch"]),
    "f21_missing_metadata": (FULL, ["missing_metadata"]),
    "f22_hu_plausibility": (FULL, ["suspicious_hu_distribution", "attenuation_rule_disagreement"]),
}


def _flag_query(name: str, mode: str, tags: list[str]) -> None:
    sql = _sql(mode, "fl", "SELECT case_id, " + ", ".join(f"g_{t} AS {t}" for t in tags) + " FROM fl")

    @register(name, sql)
    def run(spark, sf):
        return flagged(spark, sf, mode).selectExpr("case_id", *[f"f__{t} AS {t}" for t in tags])


for _name, (_mode, _tags) in FLAG_QUERIES.items():
    _flag_query(_name, _mode, _tags)


@register(
    "f02_presence",
    _sql(LESION, "fl", "SELECT case_id, organ AS pancreas_present, lesion AS lesion_present FROM fl"),
)
def f02(spark, sf):
    return evidence(spark, sf, LESION).select("case_id", "pancreas_present", "lesion_present")


@register("f03_overlap_reference", _sql(FULL, "fl", "SELECT case_id, ov AS overlap_rate FROM fl"))
def f03(spark, sf):
    return evidence(spark, sf).selectExpr("case_id", "overlap_rate_vs_lesion AS overlap_rate")


@register(
    "f09_partial_visibility",
    _sql(
        FULL,
        "fl",
        "SELECT case_id, t_zmin AS touches_z_min, t_zmax AS touches_z_max, t_ymin AS touches_y_min, t_ymax AS touches_y_max,"
        " t_xmin AS touches_x_min, t_xmax AS touches_x_max, cover AS region_coverage_ratio, nreg AS n_regions,"
        " partial AS partial_visibility_likely, trunc AS anatomical_truncation_suspected FROM fl",
    ),
)
def f09(spark, sf):
    return evidence(spark, sf).select(
        "case_id",
        *fl.TOUCHES,
        "region_coverage_ratio",
        "n_regions",
        "partial_visibility_likely",
        "anatomical_truncation_suspected",
    )


@register(
    "f14_subregion_status",
    _sql(
        FULL,
        "fl",
        """SELECT case_id, CASE WHEN omitted OR NOT organ THEN 'not_applicable' WHEN NOT found THEN 'skipped_no_data'
           WHEN g_region_sum_error_critical = 3 THEN 'failed'
           WHEN greatest(g_region_sum_error_warning, g_incomplete_anatomical_coverage, g_head_region_empty, g_body_region_empty,
                g_tail_region_empty, g_head_body_overlap, g_head_tail_overlap, g_body_tail_overlap) = 2 THEN 'warning'
           ELSE 'passed' END AS subregion_status FROM fl""",
    ),
)
def f14(spark, sf):
    return flagged(spark, sf).select("case_id", "subregion_status")


@register(
    "f18_multifocal_region_overlap",
    _sql(
        FULL,
        "fl",
        "SELECT case_id, coalesce(n_les, 0) * les_h AS head_mm3, coalesce(n_les, 0) * les_b AS body_mm3,"
        " coalesce(n_les, 0) * les_t AS tail_mm3 FROM fl",
    ),
)
def f18(spark, sf):
    return evidence(spark, sf).selectExpr(
        "case_id", *[f"{r}_lesion_mm3 AS {r}_mm3" for r in ("head", "body", "tail")]
    )


@register("f23_sample_type", _sql(ORGAN, "c4", "SELECT case_id, sample AS sample_type FROM c4"))
def f23(spark, sf):
    return flagged(spark, sf, ORGAN).select("case_id", "sample_type")


@register(
    "f24_task_reasons",
    _sql(
        LESION,
        "fl",
        """SELECT case_id, CASE WHEN omitted THEN 'case_omitted'
             WHEN NOT lesion THEN CASE WHEN organ THEN 'organ_without_lesion' ELSE 'background_negative' END
               || CASE WHEN ann = 'confirmed_absent' THEN '|absence_confirmed' ELSE '|absence_needs_confirmation' END
             WHEN NOT organ THEN 'lesion_location_not_checkable' WHEN ov IS NULL THEN 'overlap_not_computed'
             WHEN ov >= 0.7e0 THEN 'overlap_good' ELSE CASE WHEN ov >= 0.8e0 THEN 'overlap_moderate' ELSE 'overlap_below_minimum' END
           END AS reasons FROM fl""",
    ),
)
def f24(spark, sf):
    return flagged(spark, sf, LESION).selectExpr("case_id", f"{joined(fl.task_reasons(Settings(LESION)))} AS reasons")


_MODE_SQL = """SELECT count(*) FILTER (pvol > 0) AS n_pancreas,
  count(*) FILTER (pvol > 0 AND (head_v > 0 OR body_v > 0 OR tail_v > 0)) AS n_subregions,
  CASE WHEN count(*) FILTER (pvol > 0 AND (head_v > 0 OR body_v > 0 OR tail_v > 0)) >= 0.01e0 * count(*) FILTER (pvol > 0)
    AND count(*) FILTER (pvol > 0) > 0 THEN 'pancreas_lesion_subregions' ELSE 'pancreas_lesion' END AS task_mode FROM layer6"""


@register("f25_task_mode_detection", qc.query(qc.cases_ctes(), _MODE_SQL))
def f25(spark, sf):
    return task_mode_evidence(case_summary(spark, sf))


@register(
    "a17_task_mode_ratio",
    qc.query(
        qc.cases_ctes(),
        "SELECT count(*) FILTER (pvol > 0 AND (head_v > 0 OR body_v > 0 OR tail_v > 0))"
        " / count(*) FILTER (pvol > 0) AS subregion_ratio FROM layer6",
    ),
)
def a17(spark, sf):
    return task_mode_evidence(case_summary(spark, sf)).selectExpr("n_subregions / n_pancreas AS subregion_ratio")


# -- components and scores ----------------------------------------------------------------
COMPONENT_QUERIES = {
    "c01_overlap_penalty": ("lesion_localization", LESION),
    "c02_geometry_penalty": ("geometry_integrity", FULL),
    "c04_fov_penalty": ("fov_integrity", FULL),
    "c05_lesion_size_penalty": ("lesion_burden", FULL),
    "c06_pancreas_context_penalty": ("pancreas_context", ORGAN),
    "c07_metadata_penalty": ("metadata_completeness", FULL),
    "c08_attenuation_penalty": ("attenuation_integrity", FULL),
}


def _component_query(name: str, domain: str, mode: str) -> None:
    @register(name, _sql(mode, "c4", f"SELECT case_id, c_{domain} AS penalty FROM c4"))
    def run(spark, sf):
        return sc.add_components(flagged(spark, sf, mode), Settings(mode)).selectExpr(
            "case_id", f"c__{domain} AS penalty"
        )


for _name, (_domain, _mode) in COMPONENT_QUERIES.items():
    _component_query(_name, _domain, _mode)


@register("c03_region_penalty", _sql(FULL, "c4", "SELECT case_id, raw AS region_raw FROM c4"))
def c03(spark, sf):
    return sc.add_components(flagged(spark, sf), Settings(FULL)).select("case_id", "region_raw")


_COMPONENTS = ", ".join(f"c_{d} AS {d}" for d in DOMAINS)


@register("c09_component_vector", _sql(LESION, "c4", f"SELECT case_id, {_COMPONENTS} FROM c4"))
def c09(spark, sf):
    return scored(spark, sf, LESION).selectExpr("case_id", *[f"c__{d} AS {d}" for d in DOMAINS])


@register("c10_additive_score", _sql(FULL, "c4", "SELECT case_id, score FROM c4", "v2"))
def c10(spark, sf):
    return scored(spark, sf, FULL, "v2").select("case_id", "score")


@register(
    "c11_hybrid_score",
    _sql(
        FULL,
        "c4",
        "SELECT case_id, score, sw AS secondary_weighted_sum, sr AS fallback_secondary_sum_raw,"
        " c_lesion_localization = 0 AS fallback_active FROM c4",
    ),
)
def c11(spark, sf):
    terms = sc.hybrid_terms(Settings(FULL))
    names = ("secondary_weighted_sum", "fallback_secondary_sum_raw", "fallback_active")
    return project(scored(spark, sf), {n: terms[n] for n in names}, ["case_id", "score"])


def _levels(prefix: str) -> str:
    return ", ".join(f"{qc.sev(prefix + d)} AS {d}" for d in DOMAINS)


@register("c12_domain_severity", _sql(FULL, "f3", f"SELECT case_id, {_levels('p_')} FROM f3"))
def c12(spark, sf):
    return project(first(spark, sf), {d: severity_text(f"p__{d}") for d in DOMAINS}, ["case_id"])


@register(
    "j11_range_lookup",
    qc.query(
        qc.chain(FULL, "c4")
        + [
            "ladder(domain, lo, hi, severity) AS (VALUES "
            + ", ".join(
                f"('{d}', {lo}, {hi}, '{s}')"
                for d, (a, b, c, e) in qc.LADDERS.items()
                for lo, hi, s in (
                    (-1, a, "normal"),
                    (a, b, "low_warning"),
                    (b, c, "moderate_warning"),
                    (c, e, "high_warning"),
                    (e, 1000, "critical"),
                )
            )
            + ")",
            "long AS ("
            + " UNION ALL ".join(f"SELECT case_id, '{d}' AS domain, c_{d} AS score FROM c4" for d in qc.LADDERS)
            + ")",
        ],
        "SELECT l.case_id, l.domain, l.score, s.severity FROM long l JOIN ladder s"
        " ON s.domain = l.domain AND l.score >= s.lo AND l.score < s.hi",
    ),
)
def j11(spark, sf):
    """Score to ladder step as generated ``CASE`` text instead of a range join."""
    st = Settings(FULL)
    rows = ", ".join(
        f"named_struct('domain', '{d}', 'score', c__{d}, 'severity', "
        f"{severity_text(sc.ladder_level(f'c__{d}', st.ladders[d]))})"
        for d in DOMAINS[:-1]
    )
    return scored(spark, sf).selectExpr("case_id", f"explode(array({rows})) AS r").select("case_id", "r.*")


@register(
    "c13_profile_recommendation",
    _sql(FULL, "f3", "SELECT case_id, prof1 AS recommendation, drv1 AS driving_domain FROM f3"),
)
def c13(spark, sf):
    return first(spark, sf).selectExpr(
        "case_id", "profile_recommendation AS recommendation", "profile_driver AS driving_domain"
    )


@register("c14_scalar_recommendation", _sql(LESION, "c4", "SELECT case_id, scalar AS recommendation FROM c4"))
def c14(spark, sf):
    return scored(spark, sf, LESION).selectExpr("case_id", "scalar_recommendation AS recommendation")


@register(
    "c15_merged_recommendation",
    _sql(
        LESION,
        "f3",
        f"SELECT case_id, {qc.merge_sql('prof1', 'scalar')} AS recommendation FROM f3",
    ),
)
def c15(spark, sf):
    return project(
        first(spark, sf, LESION),
        {"recommendation": sc.merged("profile_recommendation", "scalar_recommendation")},
        ["case_id"],
    )


@register("c16_risk_level", _sql(FULL, "f3", "SELECT case_id, risk1 AS risk_level FROM f3"))
def c16(spark, sf):
    return first(spark, sf).selectExpr("case_id", "first_risk AS risk_level")


@register(
    "c17_domain_verdict",
    _sql(
        FULL,
        "rp",
        "SELECT case_id, "
        + ", ".join(
            f"CASE WHEN on_{d} THEN {qc.verdict(d, 'd_' + d, 'rec2')} ELSE 'not_applicable' END AS {d}" for d in DOMAINS
        )
        + " FROM rp",
    ),
)
def c17(spark, sf):
    return assessed(spark, sf).selectExpr("case_id", *[f"v__{d} AS {d}" for d in DOMAINS])


@register("c18_negative_override", _sql(LESION, "f3", "SELECT case_id, sample AS sample_type, rec1 AS recommendation FROM f3"))
def c18(spark, sf):
    return first(spark, sf, LESION).selectExpr("case_id", "sample_type", "first_recommendation AS recommendation")


@register("c19_rank_hint", _sql(FULL, "f3", "SELECT case_id, hint1 AS rank_hint FROM f3"))
def c19(spark, sf):
    return first(spark, sf).selectExpr("case_id", "first_rank_hint AS rank_hint")


@register("c20_dominant_failure_mode", _sql(FULL, "c4", "SELECT case_id, dominant AS failure_mode FROM c4"))
def c20(spark, sf):
    return scored(spark, sf).selectExpr("case_id", "dominant_failure_mode AS failure_mode")


@register(
    "c21_risk_interpretation",
    _sql(
        LESION,
        "c4",
        """SELECT case_id,
          CASE WHEN omitted THEN NULL WHEN NOT lesion THEN 'not_applicable' WHEN NOT organ THEN 'cannot_evaluate'
            WHEN c_lesion_localization = 0 THEN 'normal' WHEN c_lesion_localization <= 25 THEN 'minor'
            WHEN c_lesion_localization <= 45 THEN 'moderate' WHEN c_lesion_localization <= 65 THEN 'high'
            WHEN c_lesion_localization <= 80 THEN 'very_high' ELSE 'catastrophic' END AS spatial_plausibility,
          CASE WHEN omitted THEN NULL WHEN NOT lesion THEN 'not_applicable' WHEN c_lesion_burden = 0 THEN 'normal'
            WHEN c_lesion_burden <= 10 THEN 'minor' WHEN c_lesion_burden <= 15 THEN 'moderate' ELSE 'high'
            END AS anatomical_burden_plausibility,
          CASE WHEN omitted THEN 'severe' WHEN c_geometry_integrity = 0 THEN 'normal' WHEN c_geometry_integrity <= 25 THEN 'minor'
            WHEN c_geometry_integrity <= 50 THEN 'moderate' ELSE 'severe' END AS geometry_integrity,
          CASE WHEN omitted THEN NULL WHEN c_region_consistency = 0 THEN 'normal' WHEN c_region_consistency <= 5 THEN 'minor'
            WHEN c_region_consistency <= 10 THEN 'moderate' ELSE 'high' END AS anatomical_region_integrity,
          CASE WHEN omitted THEN NULL WHEN NOT lesion THEN 'not_applicable' WHEN med IS NULL THEN 'not_computed'
            WHEN g_suspicious_hu_distribution > 0 THEN 'warning' WHEN att = 'Hypo' THEN 'normal'
            WHEN att = 'Hyper' THEN 'informational' WHEN att = 'Iso' THEN 'normal' ELSE 'unknown' END AS attenuation_plausibility
          FROM c4""",
    ),
)
def c21(spark, sf):
    return project(scored(spark, sf, LESION), sc.risk_interpretation(Settings(LESION)), ["case_id"])


@register("c22_decision_hint", _sql(LESION, "f3", "SELECT case_id, decision AS decision_hint FROM f3"))
def c22(spark, sf):
    return first(spark, sf, LESION).select("case_id", "decision_hint")


_SUB_LONG = " UNION ALL ".join(
    f"SELECT case_id, '{d}' AS domain, '{s}' AS subcheck, {qc.sev('s_' + s)} AS severity FROM rp"
    for d, names in SUBCHECKS.items()
    for s in names
)


@register("c23_subchecks", _sql(FULL, "rp", _SUB_LONG))
def c23(spark, sf):
    return rp.subchecks_long(rp.add_subchecks(scored(spark, sf), Settings(FULL)))


@register("c24_escalated_severity", _sql(LESION, "rp", f"SELECT case_id, {_levels('d_')} FROM rp"))
def c24(spark, sf):
    return project(assessed(spark, sf, LESION), {d: severity_text(f"d__{d}") for d in DOMAINS}, ["case_id"])


def _final_query(mode: str, slug: str) -> None:
    sql = _sql(
        mode,
        "rp",
        "SELECT case_id, score, rec2 AS recommendation, risk2 AS risk_level, hint2 AS rank_hint FROM rp",
    )

    @register(f"c25_report_{slug}", sql)
    def run(spark, sf):
        return rp.qc_report(cases(spark, sf, mode), Settings(mode)).select(
            "case_id", "triage.score", "triage.recommendation", "triage.risk_level", "triage.rank_hint"
        )


for _mode, _slug in zip(TASK_MODES, ("organ", "lesion", "subregions")):
    _final_query(_mode, _slug)


@register(
    "c26_primary_issue",
    _sql(FULL, "rp", "SELECT case_id, dom2 AS domain, fail2 AS failure_mode, sub2 AS subcheck FROM rp"),
)
def c26(spark, sf):
    return rp.qc_report(cases(spark, sf), Settings(FULL)).select("case_id", "primary_issue.*")


_TAG_SQL = (
    "SELECT case_id, array_to_string(list_distinct_ordered, '|') AS tags FROM (SELECT case_id, list_filter(["
    "'pancreas_lesion_subregions', 'primary_target_lesion', sample || '_case',"
    " CASE WHEN NOT lesion AND NOT omitted THEN CASE WHEN ann = 'confirmed_absent' THEN 'confirmed_negative_lesion'"
    " ELSE 'unconfirmed_negative_lesion' END END, rec2, risk2 || '_risk', 'primary_' || dom2, fail2,"
    " CASE WHEN ov >= 0.9e0 THEN 'excellent_overlap' WHEN ov >= 0.7e0 THEN 'good_overlap' WHEN ov > 0 THEN 'poor_overlap'"
    " WHEN ov = 0 AND lesion THEN 'zero_overlap' END, "
    + ", ".join(f"CASE WHEN d_{d} > 1 THEN '{d}_' || {qc.sev('d_' + d)} END" for d in DOMAINS)
    + ", CASE WHEN att IN ('Hypo', 'Hyper', 'Iso') THEN 'tumor_' || lower(att) END,"
    " CASE WHEN NOT reg_on OR NOT found THEN NULL WHEN g_region_sum_error_critical = 3 THEN 'subregion_failed'"
    " WHEN greatest(g_region_sum_error_warning, g_incomplete_anatomical_coverage, g_head_region_empty, g_body_region_empty,"
    " g_tail_region_empty, g_head_body_overlap, g_head_tail_overlap, g_body_tail_overlap) = 2 THEN 'subregion_inconsistency' END,"
    " CASE WHEN sus THEN 'suspicious_hu' END, CASE WHEN trunc THEN 'fov_truncated' END],"
    " lambda x: x IS NOT NULL) AS list_distinct_ordered FROM rp)"
)


@register("c27_retrieval_tags", _sql(FULL, "rp", _TAG_SQL))
def c27(spark, sf):
    return project(assessed(spark, sf), {"tags": joined(rp.retrieval_tags(Settings(FULL)))}, ["case_id"])


@register(
    "c28_target_presence",
    _sql(
        ORGAN,
        "rp",
        """SELECT case_id, 'pancreas' AS target, 'primary_target' AS role, 'required' AS expected_presence,
           CASE WHEN organ THEN 'present' ELSE 'absent' END AS annotation_presence,
           CASE WHEN NOT organ THEN 'uncertain' WHEN partial THEN 'partial' ELSE 'present' END AS observed_presence,
           CASE WHEN organ AND NOT partial THEN 'complete' ELSE 'uncertain' END AS visible_target_annotation_status FROM rp""",
    ),
)
def c28(spark, sf):
    return rp.qc_report(cases(spark, sf, ORGAN), Settings(ORGAN)).select("case_id", "target_presence.*")


@register(
    "c29_measurements",
    _sql(
        FULL,
        "rp",
        """SELECT case_id, organ AS pancreas_present, lesion AS lesion_present, vol AS pancreas_volume_mm3, les AS lesion_volume_mm3,
          ov AS overlap_rate_vs_lesion, CASE WHEN organ THEN partial END AS partial_visibility_likely,
          CASE WHEN organ THEN trunc END AS anatomical_truncation_suspected, cover AS region_coverage_ratio,
          err AS region_relative_error, CASE WHEN organ AND lesion AND les > 0 THEN les / vol END AS lesion_pancreas_ratio,
          CASE WHEN lesion AND n_les * (les_h + les_b + les_t) > 0 THEN n_les * les_h END AS head_lesion_overlap_mm3,
          CASE WHEN hole THEN true END AS hole_annotation_detected, CASE WHEN radd THEN true END AS regions_added_overlap,
          CASE WHEN NOT omitted AND nmiss > 0 THEN array_to_string(list_filter([CASE WHEN coalesce(sex, '') = '' THEN 'sex' END,
            CASE WHEN coalesce(age, 0) = 0 THEN 'age' END, CASE WHEN phase IS NULL THEN 'ct_phase' END,
            CASE WHEN maker IS NULL THEN 'manufacturer' END], lambda x: x IS NOT NULL), '|') END AS missing_metadata_fields
          FROM rp""",
    ),
)
def c29(spark, sf):
    report = rp.qc_report(cases(spark, sf), Settings(FULL)).select("case_id", "measurements.*")
    return report.select(
        "case_id",
        "pancreas_present",
        "lesion_present",
        "pancreas_volume_mm3",
        "lesion_volume_mm3",
        "overlap_rate_vs_lesion",
        "partial_visibility_likely",
        "anatomical_truncation_suspected",
        "region_coverage_ratio",
        "region_relative_error",
        "lesion_pancreas_ratio",
        "head_lesion_overlap_mm3",
        "hole_annotation_detected",
        "regions_added_overlap",
        F.array_join("missing_metadata_fields", "|").alias("missing_metadata_fields"),
    )


@register(
    "v05_case_invariants",
    _sql(
        FULL,
        "f3",
        """SELECT case_id, unnest(list_filter([CASE WHEN k % 61 = 5 THEN 'score_mismatch' END,
           CASE WHEN k % 67 = 6 AND dominant <> 'none' THEN 'failure_mode_mismatch' END, CASE WHEN k % 71 = 7 THEN 'hint_prefix' END,
           CASE WHEN k % 73 = 8 AND worst1 <= 2 THEN 'metadata_only_high_risk' END,
           CASE WHEN k % 79 = 9 THEN 'unknown_component_key' END], lambda x: x IS NOT NULL)) AS violation FROM f3""",
    ),
)
def v05(spark, sf):
    """Violations of stored QC cases; some rows are broken on purpose from their key."""
    rows = first(spark, sf).selectExpr(
        "case_id",
        "CAST(substring(case_id, 2) AS BIGINT) AS k",
        "score",
        "first_risk",
        "dominant_failure_mode",
        "first_failure_mode",
        "decision_hint",
        "first_recommendation",
        "first_domain",
        *[f"p__{d}" for d in DOMAINS],
    )
    pairs = ", ".join(f"'{d}', {severity_text(f'p__{d}')}" for d in DOMAINS)
    keys = ", ".join(f"'{d}'" for d in DOMAINS)
    stored = rows.selectExpr(
        "case_id",
        "score",
        "CASE WHEN k % 61 = 5 THEN score + 1 ELSE score END AS triage_score",
        "nullif(dominant_failure_mode, 'none') AS dominant_failure_mode",
        "CASE WHEN k % 67 = 6 THEN 'other' ELSE first_failure_mode END AS failure_mode",
        "CASE WHEN k % 71 = 7 THEN 'wrong' ELSE decision_hint END AS decision_hint",
        "first_recommendation AS recommendation",
        "CASE WHEN k % 73 = 8 THEN 'high' ELSE first_risk END AS risk_level",
        "nullif(first_domain, 'scalar_score') AS primary_domain",
        f"map({pairs}) AS domains",
        f"CASE WHEN k % 79 = 9 THEN array('geometry') ELSE array({keys}) END AS component_keys",
    )
    return stored.selectExpr("case_id", f"explode({sc.case_violations()}) AS violation")


# -- report sinks -------------------------------------------------------------------------
_FLAT_SQL = (
    "SELECT case_id, score AS triage_score, risk1 AS risk_level, rec1 AS recommendation, dom1 AS primary_issue_domain,"
    " fail1 AS primary_issue_failure_mode, "
    + ", ".join(
        f"c_{d} AS {d}_score, {qc.sev('p_' + d)} AS {d}_severity, CASE WHEN omitted THEN"
        f" '{'exclude' if d == 'geometry_integrity' else 'keep'}' ELSE {qc.verdict(d, 'p_' + d, 'rec1')} END AS {d}_verdict"
        for d in DOMAINS
        if d != "region_consistency"
    )
    + ", CASE WHEN NOT organ AND NOT omitted THEN 0 ELSE c_region_consistency END AS region_consistency_score,"
    " CASE WHEN NOT organ AND NOT omitted THEN 'not_applicable' ELSE "
    + qc.sev("p_region_consistency")
    + " END AS region_consistency_severity, CASE WHEN omitted THEN 'keep' WHEN NOT organ THEN 'not_applicable' ELSE "
    + qc.verdict("region_consistency", "p_region_consistency", "rec1")
    + " END AS region_consistency_verdict,"
    " organ::INT AS pancreas_present, lesion::INT AS lesion_present, vol AS pancreas_volume_mm3, les AS lesion_volume_mm3,"
    " ov AS overlap_rate_vs_lesion, "
    + " + ".join(f"(g_{t} > 1)::INT" for t in FLAG_DOMAINS)
    + " AS n_conflicts, err AS region_relative_error, cover AS region_coverage_ratio,"
    " CASE WHEN organ THEN partial::INT END AS partial_visibility_likely,"
    " CASE WHEN organ THEN trunc::INT END AS anatomical_truncation_suspected,"
    " CASE WHEN sz IS NOT NULL THEN 0.8e0 END AS spacing_x, CASE WHEN sz IS NOT NULL THEN 0.8e0 END AS spacing_y, sz AS spacing_z,"
    " hu_status AS hu_statistics_status, tmed AS tumor_median_hu, tmean AS tumor_mean_hu, tstd AS tumor_std_hu,"
    " pmed AS pancreas_median_hu, pstd AS pancreas_std_hu, delta AS delta_hu_tumor_vs_pancreas, z AS z_score_hu,"
    " att AS tumor_attenuation, rule AS attenuation_rule_used,"
    " (NOT omitted AND lesion AND g_suspicious_hu_distribution > 0)::INT AS hu_suspicious, "
    + ", ".join(f"(g_{t} > 0)::INT AS tag_{t}" for t in FLAG_DOMAINS)
    + " FROM f3"
)


@register("s10_flat_report", _sql(FULL, "f3", _FLAT_SQL))
def s10(spark, sf):
    return rp.flat_report(first(spark, sf))


@register(
    "s12_debug_records",
    _sql(
        FULL,
        "f3",
        "SELECT case_id, score, risk1 AS risk_level, sw AS secondary_weighted_sum, c_lesion_localization = 0 AS fallback_active, "
        + ", ".join(f"CAST(c_{d} AS DOUBLE) AS {d}" for d in DOMAINS)
        + " FROM f3",
    ),
)
def s12(spark, sf):
    """The fields of the debug records, read back from their JSON texts."""
    records = rp.debug_records(first(spark, sf), Settings(FULL))
    fields = "score INT, risk_level STRING, score_components MAP<STRING, DOUBLE>, scoring_details STRUCT<secondary_weighted_sum: DOUBLE, fallback_active: BOOLEAN>"
    return records.selectExpr("case_id", f"from_json(record, '{fields}') AS r").selectExpr(
        "case_id", "r.score", "r.risk_level", "r.scoring_details.*", *[f"r.score_components['{d}'] AS {d}" for d in DOMAINS]
    )


# -- calibration ---------------------------------------------------------------------------
def calibration_ctes(mode: str = FULL) -> list[str]:
    present = "NOT coalesce(l_empty, false) AND (coalesce(n_les, 0) > 0 OR coalesce(lv, 0) > 0)"
    organ = "(NOT coalesce(p_empty, false) AND coalesce(pvol, 0) > 0)"
    return qc.cases_ctes() + [
        qc.task_cte(mode),
        f"""k0 AS (SELECT *, {organ} AS organ, {present} AS lesion, coalesce(declared, r_total) AS ov,
             omitted OR coalesce(p_aff, false) OR coalesce(l_aff, false) OR coalesce(sz > 10, false) AS geo FROM cs)""",
        """k1 AS (SELECT *,
             CASE WHEN coalesce(zmin <= 2 OR zmax >= nz - 3 OR ymin <= 2 OR ymax >= 509 OR xmin <= 2 OR xmax >= 509, false)
               THEN 1 ELSE 0 END AS q_fov_integrity,
             CASE WHEN organ AND pvol < 10000 THEN 20 WHEN organ AND pvol < 20000 THEN 10 WHEN organ AND pvol > 200000 THEN 5
               WHEN NOT organ AND lesion THEN 5 ELSE 0 END AS q_pancreas_context,
             CASE WHEN lesion AND lv > 0 THEN least(20, 15 * (lv < 10)::INT + 15 * (lv > 200000)::INT
               + 10 * (CASE WHEN organ THEN lv / pvol > 0.8e0 ELSE false END)::INT) ELSE 0 END AS q_lesion_burden,
             lesion AND (ov IS NULL OR ov < 0.8e0) AS low_ov
           FROM k0)""",
        "k2 AS (SELECT *, NOT omitted AND NOT geo AND organ AND NOT low_ov AS clean FROM k1)",
    ]


def calibrated_ladder_ctes(mode: str = FULL) -> list[str]:
    """Calibrated steps per domain as single-row CTEs k_fov_integrity, ..."""
    rules = {
        "fov_integrity": ((0.75, 0.90, 0.97, 0.99), ((1, 3), (4, 8), (8, 12), (12, 15)), (1, 4, 8, 12)),
        "pancreas_context": ((0.5, 0.75, 0.9, 0.99), ((1, 5), (8, 12), (15, 19), (20, 20)), (1, 8, 15, 20)),
        "lesion_burden": ((0.5, 0.75, 0.9, 0.99), ((1, 5), (8, 12), (15, 19), (20, 20)), (1, 8, 15, 20)),
    }
    out = []
    for d, (pct, guard, base) in rules.items():
        if mode == ORGAN and d == "lesion_burden":
            out.append(f"k_{d} AS (SELECT {base[0]} AS s1, {base[1]} AS s2, {base[2]} AS s3, {base[3]} AS s4, 0 AS n,"
                       " 'not_calibratable_for_task' AS status)")
            continue
        q = ", ".join(
            f"round_even(least({g[1]}, greatest({g[0]}, quantile_cont(q_{d}::DOUBLE, {p}) FILTER (clean AND q_{d} > 0))), 0)::INT AS a{i}"
            for i, (p, g) in enumerate(zip(pct, guard), 1)
        )
        out.append(f"m_{d} AS (SELECT {q}, count(*) FILTER (clean AND q_{d} > 0) AS n, count(*) FILTER (clean) AS ref, count(*) AS total FROM k2)")
        out.append(f"n_{d} AS (SELECT *, a1 AS b1, greatest(a1, a2) AS b2, greatest(a1, a2, a3) AS b3, greatest(a1, a2, a3, a4) AS b4,"
                   f" ref >= 100 AND ref >= 0.15e0 * total AS enough FROM m_{d})")
        out.append(f"o_{d} AS (SELECT *, least(b3, b4 - 1) AS u3 FROM n_{d})")
        out.append(f"v_{d} AS (SELECT *, least(b2, u3 - 1) AS u2 FROM o_{d})")
        out.append(
            f"k_{d} AS (SELECT CASE WHEN enough AND n > 0 THEN greatest(0, least(b1, u2 - 1)) ELSE {base[0]} END AS s1,"
            f" CASE WHEN enough AND n > 0 THEN greatest(0, u2) ELSE {base[1]} END AS s2,"
            f" CASE WHEN enough AND n > 0 THEN greatest(0, u3) ELSE {base[2]} END AS s3,"
            f" CASE WHEN enough AND n > 0 THEN greatest(0, b4) ELSE {base[3]} END AS s4, n,"
            f" CASE WHEN NOT enough THEN 'kept_deterministic' WHEN n = 0 THEN 'skipped_no_values' ELSE 'calibrated' END AS status FROM v_{d})"
        )
    return out


@register(
    "p01_reference_clean",
    qc.query(
        calibration_ctes(),
        "SELECT case_id, array_to_string(list_filter([CASE WHEN omitted THEN 'omitted' END, CASE WHEN geo THEN 'geometry_failure' END,"
        " CASE WHEN NOT organ THEN 'pancreas_absent' END, CASE WHEN low_ov THEN 'low_lesion_overlap' END],"
        " lambda x: x IS NOT NULL), '|') AS reasons FROM k2",
    ),
)
def p01(spark, sf):
    return cal.calibration_scores(cases(spark, sf), Settings(FULL)).select(
        "case_id", F.array_join("exclusion_reasons", "|").alias("reasons")
    )


@register(
    "p02_calibration_scores",
    qc.query(
        calibration_ctes(),
        "SELECT case_id, q_fov_integrity AS fov_integrity, q_pancreas_context AS pancreas_context,"
        " q_lesion_burden AS lesion_burden FROM k2",
    ),
)
def p02(spark, sf):
    return cal.calibration_scores(cases(spark, sf), Settings(FULL)).drop("exclusion_reasons")


@register(
    "a05_exclusion_reasons",
    qc.query(
        calibration_ctes(),
        "SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN omitted THEN 'omitted' END, CASE WHEN geo THEN 'geometry_failure' END,"
        " CASE WHEN NOT organ THEN 'pancreas_absent' END, CASE WHEN low_ov THEN 'low_lesion_overlap' END]) AS reason FROM k2)"
        " WHERE reason IS NOT NULL GROUP BY reason",
    ),
)
def a05(spark, sf):
    return cal.exclusion_counts(cal.calibration_scores(cases(spark, sf), Settings(FULL)))


@register(
    "a06_percentiles",
    qc.query(
        calibration_ctes(),
        " UNION ALL ".join(
            f"SELECT '{d}' AS domain, count(*) AS n, "
            + ", ".join(f"quantile_cont(q_{d}::DOUBLE, {p}) AS p{int(p * 100)}" for p in (0.5, 0.75, 0.9, 0.99))
            + f" FROM k2 WHERE clean AND q_{d} > 0"
            for d in ("fov_integrity", "pancreas_context", "lesion_burden")
        ),
    ),
)
def a06(spark, sf):
    scores = cal.calibration_scores(cases(spark, sf), Settings(FULL)).filter(F.size("exclusion_reasons") == 0)
    rows = scores.selectExpr(
        "stack(3, 'fov_integrity', fov_integrity, 'pancreas_context', pancreas_context, 'lesion_burden', lesion_burden)"
        " AS (domain, score)"
    ).filter("score > 0")
    return rows.groupBy("domain").agg(
        F.count("*").alias("n"), *[F.percentile("score", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.75, 0.9, 0.99)]
    )


_LADDER_SELECT = " UNION ALL ".join(
    f"SELECT '{d}' AS domain, status, n AS n_values, s1 AS low_warning, s2 AS moderate_warning, s3 AS high_warning,"
    f" s4 AS critical FROM k_{d}"
    for d in ("fov_integrity", "pancreas_context", "lesion_burden")
)


def _calibration_query(mode: str, name: str) -> None:
    @register(name, qc.query(calibration_ctes(mode) + calibrated_ladder_ctes(mode), _LADDER_SELECT))
    def run(spark, sf):
        return cal.calibration_table(cases(spark, sf, mode), Settings(mode)).drop(
            "total_cases", "reference_cases", "changed"
        )


_calibration_query(FULL, "p03_calibrated_thresholds")
_calibration_query(ORGAN, "w03_monotone_ladder")


# -- overviews -----------------------------------------------------------------------------
_TAG_LONG = " UNION ALL ".join(f"SELECT '{t}' AS tag, sum((g_{t} > 0)::INT)::BIGINT AS n FROM fl" for t in FLAG_DOMAINS)


@register("a07_tag_counts", _sql(FULL, "fl", f"SELECT tag, n FROM ({_TAG_LONG}) WHERE n > 0"))
def a07(spark, sf):
    return ov.tag_counts(flagged(spark, sf))


@register(
    "a07_score_distribution",
    _sql(
        FULL,
        "c4",
        "SELECT count(*) AS n, min(score) AS min_score, max(score) AS max_score, avg(score) AS mean_score,"
        " median(score) AS median_score FROM c4 WHERE score > 0",
    ),
)
def a07s(spark, sf):
    return ov.score_distribution(scored(spark, sf))


_ISSUES = {
    "empty_pancreas": ["pancreas_mask_empty"],
    "lesion_overlap": ["lesion_outside_pancreas", "lesion_partial_outside", "lesion_overlap_critical_fail"],
    "region_sum": ["region_sum_error_critical", "region_sum_error_warning"],
    "missing_region": ["head_region_empty", "body_region_empty", "tail_region_empty"],
    "pancreas_volume": ["very_small_pancreas", "small_pancreas"],
}


@register(
    "a08_overview",
    _sql(
        FULL,
        "f3",
        """SELECT count(*) AS total, count(*) FILTER (omitted) AS omitted, count(*) FILTER (sample = 'positive') AS positives,
          count(*) FILTER (sample = 'negative') AS negatives, count(*) FILTER (sample = 'positive' AND NOT organ) AS not_validatable,
          count(*) FILTER (decision = 'keep_positive') AS keep_positive, count(*) FILTER (decision = 'review_positive') AS review_positive,
          count(*) FILTER (risk1 = 'high') AS high_risk, count(*) FILTER (risk1 = 'medium') AS medium_risk,
          count(*) FILTER (risk1 = 'low') AS low_risk, count(*) FILTER (risk1 = 'critical') AS critical_risk, """
        + ", ".join(
            f"count(*) FILTER ({' OR '.join(f'g_{t} > 0' for t in tags)}) AS {name}" for name, tags in _ISSUES.items()
        )
        + " FROM f3",
    ),
)
def a08(spark, sf):
    return ov.overview(first(spark, sf))


@register(
    "a09_attenuation_distribution",
    qc.query(
        qc.cases_ctes(),
        "SELECT att AS tumor_attenuation, count(*) AS n FROM layer6 GROUP BY att",
    ),
)
def a09(spark, sf):
    return ov.attenuation_distribution(cases(spark, sf))


_SHIFT = " UNION ALL ".join(
    f"SELECT '{name}' AS attribute, coalesce(nullif({c}, ''), 'unknown') AS value, count(*) AS n,"
    f" count(*) / (SELECT count(*) FROM layer6) AS share FROM layer6 GROUP BY 2"
    for name, c in (("ct_phase", "phase"), ("site_nationality", "site"), ("manufacturer", "maker"))
)


@register("a10_domain_shift", qc.query(qc.cases_ctes(), _SHIFT))
def a10(spark, sf):
    return ov.domain_shift(cases(spark, sf))


@register("w08_share_of_total", qc.query(qc.cases_ctes(), f"SELECT attribute, sum(share) AS share FROM ({_SHIFT}) GROUP BY 1"))
def w08(spark, sf):
    return ov.domain_shift(cases(spark, sf)).groupBy("attribute").agg(F.sum("share").alias("share"))


@register(
    "a11_training_summary",
    _sql(
        FULL,
        "f3",
        """SELECT count(*) AS total, count(*) FILTER (risk1 = 'high') AS high_risk, count(*) FILTER (risk1 = 'medium') AS medium_risk,
          count(*) - count(*) FILTER (risk1 IN ('high', 'medium')) AS clean,
          count(*) FILTER (g_pancreas_mask_empty > 0) AS empty_pancreas,
          count(*) FILTER (g_lesion_outside_pancreas > 0 OR g_lesion_partial_outside > 0) AS lesion_mismatch,
          count(*) FILTER (g_region_sum_error_critical > 0 OR g_region_sum_error_warning > 0) AS region_inconsistent FROM f3""",
    ),
)
def a11(spark, sf):
    return ov.training_summary(first(spark, sf))


@register(
    "w06_tag_order",
    _sql(FULL, "fl", f"SELECT row_number() OVER (ORDER BY n DESC, tag) AS position, tag, n FROM ({_TAG_LONG}) WHERE n > 0"),
)
def w06(spark, sf):
    return ov.tag_order(flagged(spark, sf))


# -- named filters (H8) --------------------------------------------------------------------
FILTER_SQL = {
    "warning": "any_flag = 2",
    "high_risk": "risk1 = 'high'",
    "medium_risk": "risk1 = 'medium'",
    "pancreas_mask_empty": "g_pancreas_mask_empty > 0",
    "region_error": "g_region_sum_error_critical > 0 OR g_region_sum_error_warning > 0 OR g_incomplete_anatomical_coverage > 0",
    "partial_coverage": "g_incomplete_anatomical_coverage > 0",
    "small_pancreas": "g_very_small_pancreas > 0 OR g_small_pancreas > 0",
    "missing_region": "g_head_region_empty > 0 OR g_body_region_empty > 0 OR g_tail_region_empty > 0",
    "lesion_outside": "g_lesion_outside_pancreas > 0 OR g_lesion_partial_outside > 0 OR g_lesion_overlap_critical_fail > 0",
    "no_anatomical_val": "sample = 'positive' AND NOT organ",
    "positives": "sample = 'positive'",
    "negatives": "sample = 'negative'",
    "hypoattenuating": "att = 'Hypo'",
    "hyperattenuating": "att = 'Hyper'",
    "isoattenuating": "att = 'Iso'",
    "suspicious_hu": "NOT omitted AND lesion AND g_suspicious_hu_distribution > 0",
    "unreadable": "omitted",
}


@register(
    "h08_named_filters",
    _sql(
        FULL,
        "f3",
        " UNION ALL ".join(
            f"SELECT '{name}' AS filter, case_id, score, risk1 AS risk_level, decision AS decision_hint FROM f3 WHERE {cond}"
            for name, cond in FILTER_SQL.items()
        ),
    ),
)
def h08(spark, sf):
    return ov.all_filters(first(spark, sf))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    report = rp.qc_report(cases(spark, sf), Settings(FULL))
    return report.groupBy("triage.recommendation", "triage.risk_level").agg(F.count("*").alias("n"))
