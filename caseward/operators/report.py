"""Second pass: sub-checks, escalated severities and the final triage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseward.config import (
    DOMAINS,
    FAILURE_MODES,
    FLAG_DOMAINS,
    REGIONS,
    STRUCTURAL_DOMAINS,
    SUBCHECK_LESION_MAX_MM3,
    SUBCHECK_LESION_MIN_MM3,
    SUBCHECKS,
    Settings,
    primary_target,
    training_objective,
)
from caseward.functions.sql import case, compact, either, largest, lit, project, severity_text, total
from caseward.operators.flags import (
    CRITICAL,
    EMPTY_TAGS,
    PAIR_TAGS,
    TOUCHES,
    WARNING,
    flag_array,
    missing_metadata_fields,
)
from caseward.operators.scoring import (
    CRIT,
    HIGH,
    LEVEL,
    LOW,
    MODERATE,
    NORMAL,
    add_first_triage,
    gate,
    hybrid_terms,
    merged,
    rank_hint,
    risk_interpretation,
    risk_of,
    scored_cases,
    verdict,
)

NA = 0


def subcheck_levels(settings: Settings) -> dict[str, dict[str, str]]:
    """Severity level of every sub-check."""
    fov = settings.fov_policy
    ov, vol, les = "overlap_rate_vs_lesion", "pancreas_volume_mm3", "lesion_volume_mm3"
    ratio = f"({les} / {vol})"
    missing = either(*[f"f__{t} = {WARNING}" for t in EMPTY_TAGS])
    raw, capped = "region_raw", "c__region_consistency"
    hu = "coalesce(tumor_median_hu, nullif(tumor_mean_hu, 0D))"
    negative = "hu_statistics_status IN ('pancreas_only_negative_case', 'no_pancreas_no_lesion_negative_case')"

    def when(condition: str, level: int) -> str:
        return case([(condition, level)], str(NORMAL))

    # The cut-offs of the sub-checks.
    return {
        "geometry_integrity": {
            "affine_alignment": when("pancreas_affine_mismatch OR lesion_affine_mismatch", HIGH),
            "spacing": case(
                [(f"f__invalid_spacing = {CRITICAL}", HIGH), ("f__invalid_spacing > 0", MODERATE)], str(NORMAL)
            ),
            "shape": when("f__shape_mismatch > 0", HIGH),
            "direction_cosines": when("error_type = 'non_orthonormal_direction_cosines'", CRIT),
        },
        "lesion_localization": {
            "overlap": case(
                [
                    ("NOT lesion_present", NA),
                    ("NOT pancreas_present", HIGH),
                    (f"{ov} IS NULL", MODERATE),
                    (f"{ov} >= 0.8D", NORMAL),
                    (f"{ov} >= 0.55D", LOW),
                    (f"{ov} >= 0.25D", MODERATE),
                    (f"{ov} >= 0.05D", HIGH),
                ],
                str(CRIT),
            ),
            "pancreas_presence_context": when("lesion_present AND NOT pancreas_present", HIGH),
        },
        "lesion_burden": {
            "lesion_volume": case(
                [
                    ("NOT lesion_present", NA),
                    (f"{les} < {lit(SUBCHECK_LESION_MIN_MM3)}", MODERATE),
                    (f"{les} > {lit(SUBCHECK_LESION_MAX_MM3)}", HIGH),
                ],
                str(NORMAL),
            ),
            "lesion_pancreas_ratio": case(
                [
                    (f"NOT lesion_present OR {vol} <= 0", NA),
                    (f"{ratio} > 1.5D", HIGH),
                    (f"{ratio} > 0.8D", MODERATE),
                    (f"{ratio} > 0.4D", LOW),
                ],
                str(NORMAL),
            ),
        },
        "pancreas_context": {
            "organ_presence": f"CASE WHEN pancreas_present THEN {NORMAL} ELSE {NA} END",
            "organ_volume": case(
                [
                    ("NOT pancreas_present", NA),
                    (f"{vol} < 10000", HIGH),
                    (f"{vol} < 25000", MODERATE),
                    (f"{vol} > 250000", MODERATE),
                ],
                str(NORMAL),
            ),
        },
        "fov_integrity": {
            "border_touching": when("any_border_touch", LEVEL[fov["border_touching_severity"]]),
            "anatomical_coverage": case(
                [
                    (missing, LEVEL[fov["missing_region_severity"]]),
                    ("f__incomplete_anatomical_coverage > 0", LEVEL[fov["incomplete_coverage_severity"]]),
                ],
                str(NORMAL),
            ),
            "truncation": when("anatomical_truncation_suspected", LEVEL[fov["truncation_severity"]]),
        },
        "region_consistency": {
            "task_mode_applicability": f"CASE WHEN subregion_enabled THEN {NORMAL} ELSE {NA} END",
            "subregion_volume_sum": case(
                [
                    ("NOT subregion_enabled", NA),
                    (f"{raw} = 0 AND {capped} = 0", NORMAL),
                    (f"{raw} >= 30", HIGH),
                    (f"{raw} >= 15", MODERATE),
                ],
                str(LOW),
            ),
            "subregion_overlap": case(
                [
                    ("NOT subregion_enabled", NA),
                    (either(*[f"{t}_mm3 > 0" for t in PAIR_TAGS]), MODERATE),
                ],
                str(NORMAL),
            ),
            # Kept as observed: this sub-check never reports a missing region.
            "missing_subregions": f"CASE WHEN subregion_enabled THEN {NORMAL} ELSE {NA} END",
        },
        "attenuation_integrity": {
            "hu_distribution": case(
                [
                    (negative, NA),
                    ("NOT suspicious_hu_distribution", NORMAL),
                    (f"{hu} IS NULL OR isnan({hu})", MODERATE),
                    (f"{hu} < -500 OR {hu} > 1000", CRIT),
                    (f"{hu} < -300 OR {hu} > 600", HIGH),
                ],
                str(MODERATE),
            ),
            "attenuation_class": case(
                [("tumor_attenuation IS NULL OR tumor_attenuation = 'Not applicable'", NA)], str(NORMAL)
            ),
            "rule_disagreement": when("rule_disagreement", LOW),
        },
        "metadata_completeness": {"fields": when("NOT omitted AND n_missing_metadata > 0", LOW)},
    }


def add_subchecks(scored: DataFrame, settings: Settings) -> DataFrame:
    levels = subcheck_levels(settings)
    return project(scored, {f"s__{d}__{name}": sql for d in DOMAINS for name, sql in levels[d].items()})


def worst_subcheck(domain: str) -> str:
    return largest([f"s__{domain}__{s}" for s in SUBCHECKS[domain]])


def final_level(domain: str, settings: Settings) -> str:
    """Domain severity after sub-check escalation."""
    if domain in settings.disabled_domains:
        return str(NA)
    level = f"greatest(p__{domain}, {worst_subcheck(domain)})"
    if domain == "metadata_completeness":
        return f"least({level}, {LOW})"
    if domain == "region_consistency":
        return f"CASE WHEN subregion_enabled THEN {level} ELSE {NA} END"
    return level


def worst_subcheck_name(domain: str) -> str:
    """Name of the worst sub-check, first in declared order on ties."""
    worst = worst_subcheck(domain)
    names = SUBCHECKS[domain]
    return case([(f"s__{domain}__{s} = {worst}", lit(s)) for s in names[:-1]], lit(names[-1]))


def domain_enabled(domain: str, settings: Settings) -> str:
    if domain in settings.disabled_domains:
        return "false"
    return "subregion_enabled" if domain == "region_consistency" else "true"


def finalize(checked: DataFrame, settings: Settings) -> DataFrame:
    """Final severities ``d__<domain>``, triage and primary issue.

    Final values replace the first-pass ones for every later stage.
    """
    df = project(checked, {f"d__{d}": final_level(d, settings) for d in DOMAINS})
    profile, driver = gate("d__", settings)
    df = project(
        df,
        {
            "final_profile": profile,
            "final_driver": driver,
            "final_worst": largest([f"d__{d}" for d in STRUCTURAL_DOMAINS]),
            **{
                f"e__{d}": f"CASE WHEN {domain_enabled(d, settings)} THEN c__{d} ELSE 0 END" for d in DOMAINS
            },
        },
    )
    rec = merged("final_profile", "scalar_recommendation")
    if settings.task_mode == "pancreas_only":
        rec = f"CASE WHEN NOT pancreas_present THEN 'exclude' ELSE {rec} END"
    df = project(df, {"recommendation": rec, "risk_level": risk_of("final_worst")})
    # Without a driver, a case that is not kept is charged to its largest enabled component.
    share = {d: f"CASE WHEN d__{d} > {NA} THEN e__{d} ELSE -1 END" for d in DOMAINS}
    top = largest(list(share.values()))
    pick = case([(f"{top} < 0", "NULL"), *[(f"({share[d]}) = {top}", lit(d)) for d in DOMAINS]])
    driver = case(
        [
            ("final_driver IS NOT NULL", "final_driver"),
            ("recommendation NOT IN ('keep', 'keep_with_metadata_warning')", pick),
        ]
    )
    df = project(df, {"rank_hint": rank_hint("recommendation", "final_worst"), "issue_driver": driver})
    mode_of = case([(f"issue_driver = {lit(d)}", lit(FAILURE_MODES[d])) for d in DOMAINS], "first_failure_mode")
    df = project(df, {"primary_domain": "coalesce(issue_driver, first_domain)", "failure_mode": mode_of})
    return project(
        df,
        {
            "primary_subcheck": case([(f"primary_domain = {lit(d)}", worst_subcheck_name(d)) for d in DOMAINS]),
            **{
                f"v__{d}": case(
                    [(f"NOT {domain_enabled(d, settings)}", "'not_applicable'")],
                    verdict(d, f"d__{d}", "recommendation"),
                )
                for d in DOMAINS
            },
        },
    )


def assess(cases: DataFrame, settings: Settings) -> DataFrame:
    """Both passes over a case table: one chain of narrow projections."""
    checked = add_subchecks(scored_cases(cases, settings), settings)
    return finalize(add_first_triage(checked, settings), settings)


def target_presence(settings: Settings) -> dict[str, str]:
    """Organ presence as annotated and as observed."""
    organ, partial = "pancreas_present", "partial_visibility_likely"
    return {
        "target": "'pancreas'",
        "role": lit("primary_target" if settings.task_mode == "pancreas_only" else "context"),
        "expected_presence": "'required'",
        "annotation_presence": case([(organ, "'present'")], "'absent'"),
        "observed_presence": case([(f"NOT {organ}", "'uncertain'"), (partial, "'partial'")], "'present'"),
        "visible_target_annotation_status": case([(f"{organ} AND NOT {partial}", "'complete'")], "'uncertain'"),
    }


def retrieval_tags(settings: Settings) -> str:
    """Ordered distinct retrieval tags."""
    ov = "overlap_rate_vs_lesion"
    absent = "NOT lesion_present AND NOT omitted" if settings.task_mode != "pancreas_only" else "false"
    items = [
        lit(settings.task_mode),
        lit(f"primary_target_{primary_target(settings.task_mode)}"),
        "concat(sample_type, '_case')",
        "CASE WHEN sample_type = 'missing_required_target' THEN 'required_target_missing' END",
        case(
            [
                (f"NOT ({absent})", "NULL"),
                ("annotation_status = 'confirmed_absent'", "'confirmed_negative_lesion'"),
            ],
            "'unconfirmed_negative_lesion'",
        ),
        "recommendation",
        "concat(risk_level, '_risk')",
        "concat('primary_', primary_domain)",
        "failure_mode",
        case(
            [
                (f"{ov} >= 0.9D", "'excellent_overlap'"),
                (f"{ov} >= 0.7D", "'good_overlap'"),
                (f"{ov} > 0", "'poor_overlap'"),
                (f"{ov} = 0 AND lesion_present", "'zero_overlap'"),
            ]
        ),
        *[
            f"CASE WHEN d__{d} > {NORMAL} THEN concat({lit(d + '_')}, {severity_text(f'd__{d}')}) END" for d in DOMAINS
        ],
        "CASE WHEN tumor_attenuation NOT IN ('Not applicable', 'Unknown', '')"
        " THEN concat('tumor_', lower(tumor_attenuation)) END",
        case(
            [
                ("subregion_status = 'warning'", "'subregion_inconsistency'"),
                ("subregion_status = 'failed'", "'subregion_failed'"),
            ]
        ),
        "CASE WHEN suspicious_hu_distribution THEN 'suspicious_hu' END",
        "CASE WHEN anatomical_truncation_suspected THEN 'fov_truncated' END",
    ]
    return f"array_distinct({compact(items)})"


def measurements() -> dict[str, str]:
    """Primary measurements and the secondary ones that say something."""
    organ = "pancreas_present"
    spread = "lesion_present AND (" + " OR ".join(f"{r}_lesion_mm3 <> 0" for r in REGIONS) + ")"
    touches = ", ".join(f"{lit(t)}, {t}" for t in TOUCHES)
    return {
        "pancreas_present": "pancreas_present",
        "lesion_present": "lesion_present",
        "pancreas_volume_mm3": "pancreas_volume_mm3",
        "lesion_volume_mm3": "lesion_volume_mm3",
        "overlap_rate_vs_lesion": "overlap_rate_vs_lesion",
        "border_touching": f"CASE WHEN {organ} THEN named_struct({touches}) END",
        "partial_visibility_likely": f"CASE WHEN {organ} THEN partial_visibility_likely END",
        "anatomical_truncation_suspected": f"CASE WHEN {organ} THEN anatomical_truncation_suspected END",
        "region_coverage_ratio": "region_coverage_ratio",
        "region_relative_error": "region_relative_error",
        **{f"{t}_mm3": f"{t}_mm3" for t in PAIR_TAGS},
        "lesion_pancreas_ratio": f"CASE WHEN {organ} AND lesion_present AND lesion_volume_mm3 > 0"
        " THEN lesion_volume_mm3 / pancreas_volume_mm3 END",
        **{f"{r}_lesion_overlap_mm3": f"CASE WHEN {spread} THEN {r}_lesion_mm3 END" for r in REGIONS},
        "hole_annotation_detected": "CASE WHEN hole_annotation_detected THEN true END",
        "regions_added_overlap": "CASE WHEN regions_added_overlap THEN true END",
        "spacing_xyz_mm": "spacing_xyz_mm",
        "shape_zyx": "shape_zyx",
        "missing_metadata_fields": f"CASE WHEN NOT omitted AND n_missing_metadata > 0 THEN {missing_metadata_fields()} END",
    }


def struct_of(columns: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{lit(k)}, {v}" for k, v in columns.items()) + ")"


def report_columns(settings: Settings) -> dict[str, str]:
    """Columns of the nested QC report, except the case id."""
    version = "hybrid-additive-geometry-multiplicative-secondary" if settings.score_version == "hybrid" else "v2"
    domains = {
        d: struct_of(
            {
                "component_score": f"e__{d}",
                "severity": severity_text(f"d__{d}"),
                "verdict": f"v__{d}",
                "enabled": domain_enabled(d, settings),
            }
        )
        for d in DOMAINS
    }
    return {
        "task_mode": lit(settings.task_mode),
        "training_objective": lit(training_objective(settings.task_mode)),
        "sample_type": "sample_type",
        "triage": struct_of(
            {
                "score": "score",
                "rank_hint": "rank_hint",
                "risk_level": "risk_level",
                "recommendation": "recommendation",
                "score_version": lit(version),
            }
        ),
        "primary_issue": struct_of(
            {"domain": "primary_domain", "failure_mode": "failure_mode", "subcheck": "primary_subcheck"}
        ),
        "qc_domains": struct_of(domains),
        "target_presence": struct_of(target_presence(settings)),
        "measurements": struct_of(measurements()),
    }


def case_report(assessed: DataFrame, settings: Settings) -> DataFrame:
    """Nested QC report, the contract every later stage reads."""
    return project(assessed, report_columns(settings), ["case_id"])


def qc_report(cases: DataFrame, settings: Settings) -> DataFrame:
    """Case summary in, QC report out (the whole two-pass assessment)."""
    return case_report(assess(cases, settings), settings)


def report_pair(cases: DataFrame, deterministic: Settings, calibrated: Settings) -> DataFrame:
    """Both variants of every case in one row (case_id, deterministic, calibrated).

    Only the severity ladders differ between the variants, so evidence, flags,
    components and sub-checks are computed once and nothing is joined.
    """
    shared = add_subchecks(scored_cases(cases, deterministic), deterministic)
    first = finalize(add_first_triage(shared, deterministic), deterministic)
    # Reports are built from flat columns at the end, so that Spark drops the fields nobody reads.
    own = [c for c in first.columns if c not in shared.columns]
    packed = project(first, {f"first__{c}": f"`{c}`" for c in own}, shared.columns)
    second = finalize(add_first_triage(packed, calibrated), calibrated)
    held = [*shared.columns, *[f"first__{c}" for c in own]]
    judged = project(second, {"calibrated": struct_of(report_columns(calibrated))}, held)
    both = project(judged, {c: f"`first__{c}`" for c in own}, [*shared.columns, "calibrated"])
    return both.selectExpr("case_id", f"{struct_of(report_columns(deterministic))} AS deterministic", "calibrated")


def for_decision(source: str) -> str:
    """The report as a struct of the fields that comparison, routing and decision read."""
    domains = {d: struct_of({f: f"{source}.qc_domains.{d}.{f}" for f in ("severity", "enabled")}) for d in DOMAINS}
    seen = ("pancreas_present", "border_touching", "partial_visibility_likely", "anatomical_truncation_suspected")
    return struct_of(
        {
            "triage": struct_of({f: f"{source}.triage.{f}" for f in ("score", "risk_level", "recommendation")}),
            "primary_issue": struct_of({"domain": f"{source}.primary_issue.domain"}),
            "qc_domains": struct_of(domains),
            "target_presence": f"{source}.target_presence",
            "measurements": struct_of({f: f"{source}.measurements.{f}" for f in seen}),
        }
    )


def domains_long(reports: DataFrame) -> DataFrame:
    """One row per case and domain; narrow explode of the domain struct."""
    fields = ("component_score", "severity", "verdict", "enabled")
    rows = ", ".join(
        struct_of({"domain": lit(d), **{f: f"qc_domains.{d}.{f}" for f in fields}}) for d in DOMAINS
    )
    exploded = reports.selectExpr("case_id", f"explode(array({rows})) AS row")
    return exploded.selectExpr("case_id", "row.domain", *[f"row.{f}" for f in fields])


def subchecks_long(checked: DataFrame) -> DataFrame:
    """One row per case, domain and sub-check (C23, long form)."""
    rows = ", ".join(
        struct_of({"domain": lit(d), "subcheck": lit(s), "level": f"s__{d}__{s}"}) for d in DOMAINS for s in SUBCHECKS[d]
    )
    exploded = checked.selectExpr("case_id", f"explode(array({rows})) AS row")
    return exploded.selectExpr("case_id", "row.domain", "row.subcheck", f"{severity_text('row.level')} AS severity")


HU_COLUMNS = (
    "tumor_median_hu",
    "tumor_mean_hu",
    "tumor_std_hu",
    "pancreas_median_hu",
    "pancreas_std_hu",
    "delta_hu_tumor_vs_pancreas",
    "z_score_hu",
    "tumor_attenuation",
    "attenuation_rule_used",
)


def flat_report(passed: DataFrame) -> DataFrame:
    """Flat first-pass sink: triage, domain columns, evidence, HU and a 0/1 column per tag.

    The flags already are columns, so the one-hot block needs neither a pivot nor
    a scan for the distinct tags.
    """
    columns = {
        "triage_score": "score",
        "risk_level": "first_risk",
        "recommendation": "first_recommendation",
        "primary_issue_domain": "first_domain",
        "primary_issue_failure_mode": "first_failure_mode",
    }
    for d in DOMAINS:
        opinion = case(
            [("omitted", lit("exclude" if d == "geometry_integrity" else "keep"))],
            verdict(d, f"p__{d}", "first_recommendation"),
        )
        score, severity = f"c__{d}", severity_text(f"p__{d}")
        if d == "region_consistency":
            off = "NOT subregion_enabled AND NOT omitted"
            score, severity, opinion = (
                case([(off, value)], sql)
                for value, sql in ((0, score), ("'not_applicable'", severity), ("'not_applicable'", opinion))
            )
        columns |= {f"{d}_score": score, f"{d}_severity": severity, f"{d}_verdict": opinion}
    columns |= {
        "pancreas_present": "CAST(pancreas_present AS INT)",
        "lesion_present": "CAST(lesion_present AS INT)",
        "pancreas_volume_mm3": "pancreas_volume_mm3",
        "lesion_volume_mm3": "lesion_volume_mm3",
        "overlap_rate_vs_lesion": "overlap_rate_vs_lesion",
        "n_conflicts": total([f"CAST(f__{t} > 1 AS INT)" for t in FLAG_DOMAINS]),
        "region_relative_error": "region_relative_error",
        "region_coverage_ratio": "region_coverage_ratio",
        "partial_visibility_likely": "CASE WHEN pancreas_present THEN CAST(partial_visibility_likely AS INT) END",
        "anatomical_truncation_suspected": "CASE WHEN pancreas_present"
        " THEN CAST(anatomical_truncation_suspected AS INT) END",
        **{f"spacing_{a}": f"get(spacing_xyz_mm, {i})" for i, a in enumerate("xyz")},
        "hu_statistics_status": "hu_statistics_status",
        **{n: f"hu_statistics.{n}" for n in HU_COLUMNS},
        "hu_suspicious": "CAST(suspicious_hu_distribution AS INT)",
        **{f"tag_{t}": f"CAST(f__{t} > 0 AS INT)" for t in FLAG_DOMAINS},
    }
    return project(passed, columns, ["case_id"])


def debug_records(passed: DataFrame, settings: Settings) -> DataFrame:
    """JSON text per case with components, flags and score terms."""
    record = {
        "score": "score",
        "risk_level": "first_risk",
        "score_components": struct_of({**{d: f"c__{d}" for d in DOMAINS}, "region_raw": "region_raw"}),
        "flags": flag_array(),
        "scoring_details": struct_of(hybrid_terms(settings)),
        "risk_interpretation": struct_of(risk_interpretation(settings)),
    }
    return project(passed, {"record": f"to_json({struct_of(record)})"}, ["case_id"])
