"""Penalty components, scores, severities and the first-pass triage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseward.config import (
    COMPONENT_CAPS,
    COMPONENT_ORDER,
    DOMAINS,
    FAILURE_MODES,
    FLAG_DOMAINS,
    REGIONS,
    STRUCTURAL_DOMAINS,
    Settings,
)
from caseward.functions.sql import case, compact, largest, lit, project, total
from caseward.operators.flags import CRITICAL, PAIR_TAGS, WARNING, evidence, raise_flags

NORMAL, LOW, MODERATE, HIGH, CRIT = 1, 2, 3, 4, 5
LEVEL = {"normal": 1, "low_warning": 2, "moderate_warning": 3, "high_warning": 4, "critical": 5}


def points(tag: str, value: int) -> str:
    return f"CASE WHEN f__{tag} > 0 THEN {value} ELSE 0 END"


def overlap_penalty(overlap: str = "overlap_rate_vs_lesion") -> str:
    """Monotone localisation penalty (C1); ``rint`` rounds half to even."""
    ov = f"least(1D, greatest(0D, {overlap}))"
    penalty = case(
        [
            ("NOT lesion_present", "0D"),
            ("NOT pancreas_present", "40D"),
            (f"{overlap} IS NULL", "45D"),
            (f"{ov} >= 0.8D", "0D"),
            (f"{ov} < 0.05D", "85D"),
            (f"{ov} < 0.3D", f"rint(60 + 25 * (0.3D - {ov}) / 0.3D)"),
        ],
        f"rint(60 * (0.8D - {ov}) / 0.5D)",
    )
    return f"CAST({penalty} AS INT)"


def region_raw(settings: Settings) -> str:
    """Uncapped region-consistency penalty."""
    err, pts = "coalesce(region_relative_error, 0D)", settings.region_points
    critical = f"least(rint(10 + 20 * greatest({err} - 0.25D, 0D) / 0.75D), 30D)"
    warning = f"greatest(1D, least(rint(10 * {err} / 0.25D), 10D))"
    terms = [
        f"CASE WHEN f__region_sum_error_critical > 0 THEN {critical} ELSE 0D END",
        f"CASE WHEN f__region_sum_error_warning > 0 THEN {warning} ELSE 0D END",
        *[points(t, 5) for t in PAIR_TAGS],
        points("incomplete_anatomical_coverage", int(pts["incomplete_anatomical_coverage"])),
        points("subregions_expected_but_missing", int(pts["subregions_expected_but_missing"])),
        *[
            f"CASE WHEN f__{r}_region_empty = {WARNING} THEN {int(pts['missing_subregion'])} ELSE 0 END" for r in REGIONS
        ],
    ]
    return f"CAST({total(terms)} AS INT)"


def component_rules(settings: Settings) -> dict[str, str]:
    """Penalty of each domain (C1-C8) before the task's zero mask."""
    cap, fov = COMPONENT_CAPS, settings.fov_points
    size = case(
        [
            ("f__very_small_pancreas > 0", 20),
            ("f__small_pancreas > 0", 10),
            ("f__large_pancreas > 0", 5),
        ],
        "0",
    )
    spacing = case([(f"f__invalid_spacing = {CRITICAL}", 40), ("f__invalid_spacing > 0", 20)], "0")
    region_cap = str(cap["region_consistency"])
    if settings.task_mode != "pancreas_lesion_subregions":
        region_cap = f"CASE WHEN lesion_present THEN 0 ELSE {region_cap} END"
    burden = total(
        [
            points("very_small_lesion", 15),
            points("very_large_lesion", 15),
            points("high_lesion_pancreas_ratio", 10),
        ]
    )
    context = total(
        [
            size,
            points("required_target_missing", 20),
            "CASE WHEN f__pancreas_mask_empty > 0 AND lesion_present THEN 5 ELSE 0 END",
        ]
    )
    view = total(
        [
            f"CASE WHEN any_border_touch THEN {int(fov['border_touching'])} ELSE 0 END",
            f"CASE WHEN partial_visibility_likely THEN {int(fov['partial_visibility_likely'])} ELSE 0 END",
            f"CASE WHEN anatomical_truncation_suspected THEN {int(fov['anatomical_truncation_suspected'])} ELSE 0 END",
        ]
    )
    metadata = f"least(CAST(rint(10 * n_missing_metadata / 4) AS INT), {cap['metadata_completeness']})"
    return {
        "geometry_integrity": f"least({points('shape_mismatch', 40)} + {spacing}, {cap['geometry_integrity']})",
        "lesion_localization": overlap_penalty(),
        "lesion_burden": f"least({burden}, {cap['lesion_burden']})",
        "pancreas_context": f"least({context}, {cap['pancreas_context']})",
        "fov_integrity": f"least({view}, {cap['fov_integrity']})",
        "region_consistency": f"least(region_raw, {region_cap})",
        "attenuation_integrity": points("suspicious_hu_distribution", cap["attenuation_integrity"]),
        "metadata_completeness": f"CASE WHEN f__missing_metadata > 0 THEN {metadata} ELSE 0 END",
    }


def add_components(flagged: DataFrame, settings: Settings) -> DataFrame:
    """Component penalties ``c__<domain>`` and the uncapped ``region_raw``."""
    df = project(flagged, {"region_raw": region_raw(settings)})
    rules = component_rules(settings)
    columns = {}
    for d in DOMAINS:
        value = "0" if d in settings.disabled_domains else rules[d]
        # An unreadable case carries its whole penalty in the geometry component.
        columns[f"c__{d}"] = f"CASE WHEN omitted THEN {100 if d == 'geometry_integrity' else 0} ELSE {value} END"
    return project(df, columns)


def hybrid_terms(settings: Settings) -> dict[str, str]:
    """Terms of the hybrid score (C11), summed in a fixed component order."""
    alpha, beta = settings.number("HYBRID_ALPHA", 0.4), settings.number("HYBRID_BETA", 1.5)
    weights = settings.secondary_weights
    weighted = total([f"{lit(w)} * c__{d}" for d, w in weights.items()])
    raw = total([f"{lit(w)} * {'region_raw' if d == 'region_consistency' else f'c__{d}'}" for d, w in weights.items()])
    amplifier = f"(1D + {lit(alpha)} * {weighted} / 100D)"
    fallback = f"CASE WHEN c__lesion_localization = 0 THEN {lit(beta)} * {raw} ELSE 0D END"
    return {
        "secondary_weighted_sum": weighted,
        "secondary_amplifier": amplifier,
        "fallback_active": "(c__lesion_localization = 0)",
        "fallback_secondary_sum_raw": raw,
        "fallback_term": fallback,
        "raw_score_before_clamp": f"(c__geometry_integrity + c__lesion_localization * {amplifier} + {fallback})",
    }


def add_score(scored: DataFrame, settings: Settings) -> DataFrame:
    """Scalar score: hybrid (C11) or additive."""
    if settings.score_version == "hybrid":
        score = f"CAST(least(rint({hybrid_terms(settings)['raw_score_before_clamp']}), 100D) AS INT)"
    else:
        score = f"least({total([f'c__{d}' for d in DOMAINS])}, 100)"
    return project(scored, {"score": f"CASE WHEN omitted THEN 100 ELSE {score} END"})


def ladder_level(score: str, ladder: tuple[int, int, int, int]) -> str:
    """Severity level of a score on one ladder; highest step first."""
    low, moderate, high, critical = ladder
    steps = [(critical, CRIT), (high, HIGH), (moderate, MODERATE), (low, LOW)]
    return case([(f"{score} >= {bound}", level) for bound, level in steps], str(NORMAL))


def domain_level(domain: str, settings: Settings) -> str:
    """First-pass severity level of a domain: ladder, forced up by a CRITICAL flag."""
    forced = largest([f"f__{t}" for t, d in FLAG_DOMAINS.items() if d == domain]) + f" = {CRITICAL}"
    if domain == "metadata_completeness":
        return case([(f"c__{domain} > 0 OR {forced}", LEVEL[settings.metadata_max_severity])], str(NORMAL))
    return f"CASE WHEN {forced} THEN {CRIT} ELSE {ladder_level(f'c__{domain}', settings.ladders[domain])} END"


def gate(prefix: str, settings: Settings) -> tuple[str, str]:
    """(recommendation, driving domain) of a severity profile (C13): first match wins."""
    hard = ("geometry_integrity", "lesion_localization")
    soft = tuple(d for d in STRUCTURAL_DOMAINS if d not in hard)
    meta = "metadata_completeness"
    steps = [(d, CRIT, "exclude") for d in hard]
    steps += [(d, CRIT, "review") for d in soft]
    steps += [(d, HIGH, "review") for d in STRUCTURAL_DOMAINS]
    steps += [(d, MODERATE, "review") for d in STRUCTURAL_DOMAINS]
    steps += [(meta, LOW, settings.metadata_recommendation)]
    steps += [(d, LOW, "keep") for d in DOMAINS]
    return (
        case([(f"{prefix}{d} = {level}", lit(rec)) for d, level, rec in steps], "'keep'"),
        case([(f"{prefix}{d} = {level}", lit(d)) for d, level, _ in steps]),
    )


def scalar_recommendation(settings: Settings) -> str:
    """Recommendation from the score alone, with the CRITICAL-flag safety net (C14)."""
    lim = settings.limits
    return case(
        [
            (f"score > {lit(lim['score_review'])}", "'exclude'"),
            (f"score > {lit(lim['score_keep'])} OR worst_flag = {CRITICAL}", "'review'"),
        ],
        "'keep'",
    )


def merged(profile: str, scalar: str) -> str:
    """The scalar recommendation wins only when strictly more severe."""
    rank = lambda x: f"CASE {x} WHEN 'review' THEN 1 WHEN 'exclude' THEN 2 ELSE 0 END"
    return f"CASE WHEN {rank(scalar)} > {rank(profile)} THEN {scalar} ELSE {profile} END"


def risk_of(worst: str) -> str:
    return case([(f"{worst} >= {HIGH}", "'high'"), (f"{worst} >= {MODERATE}", "'medium'")], "'low'")


def rank_hint(recommendation: str, worst: str) -> str:
    return case(
        [
            (f"{recommendation} = 'exclude'", "'omit'"),
            (f"{recommendation} = 'keep_with_metadata_warning'", "'metadata_warning'"),
            (f"{worst} >= {HIGH}", "'priority_review'"),
            (f"{recommendation} = 'review'", "'review'"),
            (f"{worst} = {LOW}", "'low_priority'"),
        ],
        "'routine'",
    )


def verdict(domain: str, level: str, recommendation: str) -> str:
    """Domain-local verdict (C17)."""
    if domain == "metadata_completeness":
        kept = "'keep_with_metadata_warning'"
        return case([(f"{recommendation} = {kept}", kept)], "'keep'")
    return case([(f"{level} = {CRIT}", "'exclude'"), (f"{level} >= {MODERATE}", "'review'")], "'keep'")


def dominant_failure_mode() -> str:
    """Label of the largest component, first in component order on ties (C20)."""
    top = largest([f"c__{d}" for d in COMPONENT_ORDER])
    return case(
        [(f"{top} = 0", "'none'"), *[(f"c__{d} = {top}", lit(FAILURE_MODES[d])) for d in COMPONENT_ORDER]]
    )


def first_pass(cases: DataFrame, settings: Settings) -> DataFrame:
    """Evidence, flags, components, score and first-pass triage of every case.

    One chain of narrow projections.  Severity levels are ``p__<domain>``.
    """
    return add_first_triage(scored_cases(cases, settings), settings)


def scored_cases(cases: DataFrame, settings: Settings) -> DataFrame:
    """The part of the assessment that no severity ladder touches."""
    flagged = raise_flags(evidence(cases, settings), settings)
    scored = add_score(add_components(flagged, settings), settings)
    others = largest([f"f__{t}" for t in FLAG_DOMAINS if t != "pancreas_mask_empty"])
    # The worst flag besides the empty organ decides the override of negatives.
    df = project(scored, {"worst_other_flag": others, "dominant_failure_mode": dominant_failure_mode()})
    df = project(df, {"worst_flag": "greatest(worst_other_flag, f__pancreas_mask_empty)"})
    return project(df, {"scalar_recommendation": scalar_recommendation(settings)})


def add_first_triage(scored: DataFrame, settings: Settings) -> DataFrame:
    df = project(scored, {f"p__{d}": domain_level(d, settings) for d in DOMAINS})
    profile, driver = gate("p__", settings)
    df = project(
        df,
        {
            "profile_recommendation": profile,
            "profile_driver": driver,
            "first_worst": largest([f"p__{d}" for d in STRUCTURAL_DOMAINS]),
        },
    )
    rec = merged("profile_recommendation", "scalar_recommendation")
    if settings.task_mode == "pancreas_only":
        rec = f"CASE WHEN NOT pancreas_present THEN 'exclude' ELSE {rec} END"
    else:
        # A negative whose only non-INFO flag is the empty organ stays usable.
        usable = f"sample_type = 'negative' AND worst_other_flag <= 1 AND ({rec}) = 'exclude'"
        rec = f"CASE WHEN {usable} THEN 'keep' ELSE {rec} END"
    df = project(df, {"first_recommendation": f"CASE WHEN omitted THEN 'omit_from_training' ELSE {rec} END"})
    rec = "first_recommendation"
    prefix = f"CASE WHEN {rec} = 'omit_from_training' THEN 'omit' ELSE {rec} END"
    return project(
        df,
        {
            "first_risk": f"CASE WHEN omitted THEN 'critical' ELSE {risk_of('first_worst')} END",
            "first_rank_hint": f"CASE WHEN omitted THEN 'omit' ELSE {rank_hint(rec, 'first_worst')} END",
            "first_domain": f"coalesce(profile_driver, CASE WHEN {rec} NOT IN ('keep', 'keep_with_metadata_warning')"
            " THEN 'scalar_score' END)",
            "first_failure_mode": "nullif(dominant_failure_mode, 'none')",
            "decision_hint": f"CASE WHEN omitted THEN 'omit_from_training' ELSE concat_ws('_', {prefix}, sample_type) END",
        },
    )


def risk_interpretation(settings: Settings) -> dict[str, str]:
    """Severity labels of the five plausibility dimensions."""
    only = settings.task_mode == "pancreas_only"
    no_lesion = "true" if only else "NOT lesion_present"
    ov, burden = "c__lesion_localization", "c__lesion_burden"
    geometry, region = "c__geometry_integrity", "c__region_consistency"
    labels = {
        "spatial_plausibility": case(
            [
                (no_lesion, "'not_applicable'"),
                ("NOT pancreas_present", "'cannot_evaluate'"),
                (f"{ov} = 0", "'normal'"),
                (f"{ov} <= 25", "'minor'"),
                (f"{ov} <= 45", "'moderate'"),
                (f"{ov} <= 65", "'high'"),
                (f"{ov} <= 80", "'very_high'"),
            ],
            "'catastrophic'",
        ),
        "anatomical_burden_plausibility": case(
            [
                (no_lesion, "'not_applicable'"),
                (f"{burden} = 0", "'normal'"),
                (f"{burden} <= 10", "'minor'"),
                (f"{burden} <= 15", "'moderate'"),
            ],
            "'high'",
        ),
        "geometry_integrity": case(
            [(f"{geometry} = 0", "'normal'"), (f"{geometry} <= 25", "'minor'"), (f"{geometry} <= 50", "'moderate'")],
            "'severe'",
        ),
        "anatomical_region_integrity": case(
            [(f"{region} = 0", "'normal'"), (f"{region} <= 5", "'minor'"), (f"{region} <= 10", "'moderate'")], "'high'"
        ),
        "attenuation_plausibility": case(
            [
                (no_lesion, "'not_applicable'"),
                ("tumor_median_hu IS NULL", "'not_computed'"),
                ("suspicious_hu_distribution", "'warning'"),
                ("tumor_attenuation = 'Hypo'", "'normal'"),
                ("tumor_attenuation = 'Hyper'", "'informational'"),
                ("tumor_attenuation = 'Iso'", "'normal'"),
            ],
            "'unknown'",
        ),
    }
    return {
        name: f"CASE WHEN omitted THEN {lit('severe') if name == 'geometry_integrity' else 'NULL'} ELSE {label} END"
        for name, label in labels.items()
    }


def case_violations() -> str:
    """Codes of the consistency rules a stored QC case breaks (V5).

    Reads columns score, triage_score, dominant_failure_mode, failure_mode,
    decision_hint, recommendation, risk_level, primary_domain, domains (map of
    domain to severity) and component_keys; clean cases give an empty array.
    """
    prefix = "CASE WHEN recommendation = 'omit_from_training' THEN 'omit' ELSE recommendation END"
    known = f"array({', '.join(lit(d) for d in DOMAINS)})"
    structural = " OR ".join(
        f"coalesce(domains[{lit(d)}], 'normal') NOT IN ('normal', 'low_warning')" for d in STRUCTURAL_DOMAINS
    )
    rules = {
        "score_mismatch": "score <> triage_score",
        "failure_mode_mismatch": "dominant_failure_mode <> failure_mode",
        "hint_prefix": f"NOT startswith(decision_hint, {prefix})",
        "metadata_only_high_risk": f"risk_level = 'high' AND cardinality(domains) > 0 AND NOT ({structural})",
        "unknown_domain_key": f"size(array_except(map_keys(domains), {known})) > 0",
        "unknown_primary_domain": f"NOT array_contains({known}, primary_domain)",
        "unknown_component_key": f"size(array_except(component_keys, {known})) > 0",
    }
    return compact([f"CASE WHEN {cond} THEN {lit(code)} END" for code, cond in rules.items()])
