"""Evidence and flag rules of one case.

Every rule is a narrow projection: no shuffle, no Python.  A flag is an integer
column ``f__<tag>`` (0 absent, 1 INFO, 2 WARNING, 3 CRITICAL), so later stages
read plain integers and Catalyst drops the flags nobody asks for.  The ordered
flag array is only assembled on output (:func:`flag_array`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseward.config import (
    BORDER_MARGIN_VOXELS,
    FLAG_DOMAINS,
    FLAG_LEVELS,
    METADATA_FIELDS,
    PARTIAL_PANCREAS_VOLUME_MM3,
    REGION_PAIRS,
    REGIONS,
    TUMOR_HU_RANGE,
    Settings,
)
from caseward.functions.sql import case, compact, either, field, has_field, largest, lit, project, total

INFO, WARNING, CRITICAL = 1, 2, 3
TOUCHES = tuple(f"touches_{axis}_{end}" for axis in "zyx" for end in ("min", "max"))
SUPPORTS = ("pancreas_total", "regions_union", "combined_pancreas", "combined_filled_pancreas")
PAIR_TAGS = tuple(f"{a}_{b}_overlap" for a, b in REGION_PAIRS)
EMPTY_TAGS = tuple(f"{r}_region_empty" for r in REGIONS)


def border_touch(shape: str, box: str, margin: int) -> dict[str, str]:
    """Six conditions: does the inclusive bounding box come within ``margin`` of a face?"""
    out = {}
    for i, axis in enumerate("zyx"):
        out[f"touches_{axis}_min"] = f"coalesce({box}[0][{i}] <= {margin}, false)"
        out[f"touches_{axis}_max"] = f"coalesce({box}[1][{i}] >= {shape}[{i}] - {1 + margin}, false)"
    return out


def overlap_rate(cases: DataFrame) -> str:
    """Rate of the declared overlap reference, else the total rate."""
    analysis = "quality_control.lesion_overlap_analysis"
    reference = f"coalesce({field(cases, f'{analysis}.overlap_reference_used_for_qc', 'string')}, 'combined_filled_pancreas')"
    declared = case(
        [(f"{reference} = {lit(s)}", field(cases, f"{analysis}.{s}.overlap_rate_vs_lesion")) for s in SUPPORTS]
    )
    return f"coalesce({declared}, {field(cases, 'quality_control.total_overlap_rate_vs_lesion')})"


def missing_metadata(name: str) -> str:
    """An empty text or a zero age counts as missing."""
    return f"({name} IS NULL OR {name} = {'0' if name == 'age' else lit('')})"


def evidence(cases: DataFrame, settings: Settings) -> DataFrame:
    """Numeric and boolean evidence of each case, flat."""
    mode = settings.task_mode

    def number(path: str) -> str:
        return f"coalesce({field(cases, path)}, 0D)"

    def truth(path: str) -> str:
        return f"coalesce({field(cases, path, 'boolean')}, false)"

    quality, analysis = "quality_control", "quality_control.lesion_overlap_analysis"
    status = field(cases, f"{quality}.lesion_annotation_evidence.status", "string")
    tumor = number("lesions.total_volume_mm3")
    count = f"coalesce({field(cases, 'lesions.n_lesions', 'int')}, 0)"
    by_mask = f"NOT ({truth(f'{quality}.lesion_mask_empty')} OR ({count} = 0 AND {tumor} = 0))"
    lesion = by_mask
    if mode != "pancreas_only":
        lesion = case(
            [(f"{status} = 'lesion_present'", "true"), (f"{status} IN ('confirmed_absent', 'insufficient_evidence')", "false")],
            by_mask,
        )

    def lesion_sum(region: str) -> str:
        path = f"lesions.per_lesion.overlap_with_regions.{region}.volume_mm3"
        if not has_field(cases.schema, path):
            return "0D"
        step = f"acc + coalesce(x.overlap_with_regions.{region}.volume_mm3, 0D)"
        return f"coalesce(aggregate(lesions.per_lesion, 0D, (acc, x) -> {step}), 0D)"

    median = field(cases, "hu_statistics.tumor_median_hu")
    first = {
        "omitted": truth("case_status.omit_from_training"),
        "error_type": field(cases, "case_status.error_type", "string"),
        "pancreas_volume_mm3": number("pancreas.volume_mm3"),
        "lesion_volume_mm3": tumor,
        "annotation_status": status,
        "annotation_source": field(cases, f"{quality}.lesion_annotation_evidence.selected_source", "string"),
        "pancreas_present": f"NOT {truth(f'{quality}.pancreas_mask_empty')} AND {number('pancreas.volume_mm3')} > 0",
        "lesion_present": lesion,
        "overlap_rate_vs_lesion": overlap_rate(cases),
        "hole_annotation_detected": truth(f"{analysis}.hole_filling_changed_overlap"),
        "regions_added_overlap": truth(f"{analysis}.regions_added_overlap"),
        **{f"region_{r}_volume_mm3": number(f"pancreas.regions.{r}.volume_mm3") for r in REGIONS},
        "covered_mm3": total([number(f"pancreas.regions.{r}.overlap_with_pancreas_mm3") for r in REGIONS]),
        "relative_error": number("pancreas.region_consistency.relative_error_vs_pancreas"),
        **{f"{t}_any_mm3": number(f"pancreas.region_consistency.{t}_mm3") for t in PAIR_TAGS},
        "spacing_xyz_mm": field(cases, "image.spacing_xyz_mm", "array<double>"),
        "shape_zyx": field(cases, "image.shape_zyx", "array<int>"),
        "bounding_box_zyx": field(cases, "pancreas.bounding_box_zyx", "array<array<int>>"),
        **{f"{r}_lesion_mm3": lesion_sum(r) for r in REGIONS},
        **{m: field(cases, f"metadata.{m}", "int" if m == "age" else "string") for m in METADATA_FIELDS},
        "pancreas_affine_mismatch": truth("geometry.summary.pancreas_affine_mismatch"),
        "lesion_affine_mismatch": truth("geometry.summary.lesion_affine_mismatch"),
        "tumor_median_hu": f"CASE WHEN {median} <> 0 THEN {median} END",
        "tumor_mean_hu": field(cases, "hu_statistics.tumor_mean_hu"),
        "summary_suspicious_hu": truth("hu_statistics.suspicious_hu_distribution"),
        "rule_disagreement": truth("hu_statistics.attenuation_rule_disagreement"),
        "tumor_attenuation": field(cases, "hu_statistics.tumor_attenuation", "string"),
        "hu_statistics_status": field(cases, "hu_statistics.hu_statistics_status", "string"),
    }
    keep = ["case_id"] + [n for n in ("hu_statistics",) if n in cases.columns]
    df = project(cases, first, keep)
    found = either(*[f"region_{r}_volume_mm3 > 0" for r in REGIONS]) if mode == "pancreas_lesion_subregions" else "false"
    touches = border_touch("shape_zyx", "bounding_box_zyx", BORDER_MARGIN_VOXELS)
    df = project(
        df,
        {
            "use_regions": found,
            "regions_checked": f"pancreas_present AND {found}",
            "n_regions": total([f"CAST(region_{r}_volume_mm3 > 0 AS INT)" for r in REGIONS]),
            "n_missing_metadata": total([f"CAST({missing_metadata(m)} AS INT)" for m in METADATA_FIELDS]),
            **{t: f"pancreas_present AND {touches[t]}" for t in TOUCHES},
        },
    )
    df = project(df, {"any_border_touch": either(*TOUCHES)})
    small = f"pancreas_volume_mm3 < {lit(PARTIAL_PANCREAS_VOLUME_MM3)}"
    return project(
        df,
        {
            "region_coverage_ratio": "CASE WHEN regions_checked THEN bround(covered_mm3 / pancreas_volume_mm3, 4) END",
            "partial_visibility_likely": f"any_border_touch OR (regions_checked AND n_regions < 3 AND {small})",
            "anatomical_truncation_suspected": "regions_checked AND any_border_touch AND n_regions < 3",
            "region_relative_error": "CASE WHEN regions_checked THEN relative_error END",
            **{f"{t}_mm3": f"CASE WHEN regions_checked THEN {t}_any_mm3 END" for t in PAIR_TAGS},
        },
        [n for n in df.columns if n not in ("covered_mm3", "relative_error") and not n.endswith("_any_mm3")],
    )


def flag_rules(settings: Settings) -> dict[str, list[tuple[str, int]]]:
    """Tag -> ordered (condition, severity); the first true condition counts."""
    mode = settings.task_mode
    lim = {k: lit(v) for k, v in settings.limits.items()}
    lesion_task = mode != "pancreas_only"
    ov, vol, les = "overlap_rate_vs_lesion", "pancreas_volume_mm3", "lesion_volume_mm3"
    absent = "NOT lesion_present"
    confirmed = "coalesce(annotation_status = 'confirmed_absent', false)"
    rated = f"lesion_present AND pancreas_present AND {ov} IS NOT NULL"
    below = f"{rated} AND {ov} < {lim['overlap_min']}"
    far = f"{ov} < {lim['overlap_critical']}"
    between = f"{rated} AND {ov} >= {lim['overlap_min']} AND {ov} < {lim['overlap_strict']}"
    too_far = f"regions_checked AND region_relative_error > {lim['region_error_critical']}"
    drift = f"region_relative_error > {lim['region_error_warning']}"
    measured = f"lesion_present AND {les} > 0"
    low, high = (lit(v) for v in TUMOR_HU_RANGE)
    implausible = f"lesion_present AND tumor_median_hu IS NOT NULL AND NOT (tumor_median_hu BETWEEN {low} AND {high})"
    ratio = "array_max(spacing_xyz_mm) / (array_min(spacing_xyz_mm) + 1e-9D)"
    rules: dict[str, list[tuple[str, int]]] = {
        "subregions_not_applicable": [],
        "subregions_expected_but_missing": [],
        "incomplete_anatomical_coverage": [(f"{too_far} AND partial_visibility_likely", WARNING)],
        "region_sum_error_critical": [(f"{too_far} AND NOT partial_visibility_likely", CRITICAL)],
        "region_sum_error_warning": [(f"regions_checked AND NOT ({too_far}) AND {drift}", WARNING)],
        "very_small_pancreas": [(f"pancreas_present AND {vol} < {lim['pancreas_critical']}", CRITICAL)],
        "small_pancreas": [
            (f"pancreas_present AND {vol} >= {lim['pancreas_critical']} AND {vol} < {lim['pancreas_small']}", WARNING)
        ],
        "large_pancreas": [(f"pancreas_present AND {vol} > {lim['pancreas_large']}", WARNING)],
        "very_small_lesion": [(f"{measured} AND {les} < {lim['lesion_min']}", WARNING)],
        "very_large_lesion": [(f"{measured} AND {les} > {lim['lesion_max']}", WARNING)],
        "high_lesion_pancreas_ratio": [
            (f"pancreas_present AND {measured} AND {les} / {vol} > {lim['lesion_pancreas_ratio']}", WARNING)
        ],
        "invalid_spacing": [
            ("array_min(spacing_xyz_mm) <= 0 OR array_max(spacing_xyz_mm) > 10", CRITICAL),
            (f"size(spacing_xyz_mm) >= 2 AND {ratio} > 5", WARNING),
        ],
        "shape_mismatch": [("array_min(shape_zyx) < 10", CRITICAL)],
        "missing_metadata": [("n_missing_metadata > 0", INFO)],
        "suspicious_hu_distribution": [(implausible, WARNING), ("lesion_present AND summary_suspicious_hu", INFO)],
        "attenuation_rule_disagreement": [("lesion_present AND rule_disagreement", INFO)],
    }
    if mode == "pancreas_lesion_subregions":
        rules["subregions_expected_but_missing"] = [("pancreas_present AND NOT use_regions", WARNING)]
    else:
        rules["subregions_not_applicable"] = [("pancreas_present", INFO)]
    if lesion_task:
        rules |= {
            "lesion_annotation_insufficient_evidence": [
                (f"{absent} AND annotation_status = 'insufficient_evidence'", CRITICAL)
            ],
            "confirmed_negative_lesion": [(f"{absent} AND {confirmed}", INFO)],
            "unconfirmed_negative_lesion": [(f"{absent} AND NOT {confirmed}", CRITICAL)],
            "lesion_mask_empty": [(absent, INFO)],
            "lesion_no_anatomical_validation": [("lesion_present AND NOT pancreas_present", WARNING)],
            "pancreas_hole_annotation_suspected": [(f"{rated} AND hole_annotation_detected", INFO)],
            "lesion_in_subregion_spillover": [(f"{rated} AND regions_added_overlap", INFO)],
            "lesion_overlap_critical_fail": [(f"{below} AND {far}", CRITICAL), (below, WARNING)],
            "lesion_outside_pancreas": [(f"{below} AND {far}", INFO)],
            "lesion_overlap_strict_fail": [(between, WARNING)],
            "lesion_partial_outside": [(f"({below} AND NOT {far}) OR ({between})", INFO)],
            "pancreas_mask_empty": [
                ("NOT pancreas_present AND lesion_present", CRITICAL),
                ("NOT pancreas_present", INFO),
            ],
        }
    else:
        rules["required_target_missing"] = [("NOT pancreas_present", CRITICAL)]
    for r in REGIONS:
        empty = f"regions_checked AND region_{r}_volume_mm3 = 0"
        rules[f"{r}_region_empty"] = [(f"{empty} AND partial_visibility_likely", INFO), (empty, WARNING)]
    for t in PAIR_TAGS:
        rules[t] = [(f"regions_checked AND {t}_mm3 > 0", WARNING)]
    return rules


def raise_flags(ev: DataFrame, settings: Settings) -> DataFrame:
    """Add one severity integer per flag tag to the evidence."""
    rules = flag_rules(settings)
    columns = {}
    for tag in FLAG_DOMAINS:
        if tag == "omit_from_training":
            columns[f"f__{tag}"] = f"CASE WHEN omitted THEN {CRITICAL} ELSE 0 END"
            continue
        steps = [("omitted", 0)] + [(f"({cond})", level) for cond, level in rules.get(tag, [])]
        columns[f"f__{tag}"] = case(steps, "0") if len(steps) > 1 else "0"
    df = project(ev, columns)
    regional = largest(
        [
            f"f__{t}"
            for t in (
                "region_sum_error_critical",
                "region_sum_error_warning",
                "incomplete_anatomical_coverage",
                *EMPTY_TAGS,
                *PAIR_TAGS,
            )
        ]
    )
    enabled = "NOT omitted AND pancreas_present" if settings.task_mode == "pancreas_lesion_subregions" else "false"
    return project(
        df,
        {
            "suspicious_hu_distribution": "NOT omitted AND lesion_present AND f__suspicious_hu_distribution > 0",
            "subregion_enabled": enabled,
            "subregion_status": case(
                [
                    (f"NOT ({enabled})", "'not_applicable'"),
                    ("NOT use_regions", "'skipped_no_data'"),
                    (f"{regional} = {CRITICAL}", "'failed'"),
                    (f"{regional} = {WARNING}", "'warning'"),
                ],
                "'passed'",
            ),
            "sample_type": sample_type(settings),
        },
    )


def sample_type(settings: Settings) -> str:
    """Sample type relative to the training target."""
    if settings.task_mode == "pancreas_only":
        return case([("omitted", "'omitted'"), ("pancreas_present", "'positive'")], "'missing_required_target'")
    return case([("omitted", "'omitted'"), ("lesion_present", "'positive'")], "'negative'")


def task_reasons(settings: Settings) -> str:
    """Codes that explain the task-level reading of a case (F24), in order."""
    ov, lim = "overlap_rate_vs_lesion", settings.limits
    if settings.task_mode == "pancreas_only":
        main = case([("pancreas_present", "'required_target_annotated'")], "'required_target_missing'")
        return f"CASE WHEN omitted THEN array('case_omitted') ELSE array({main}) END"
    main = case(
        [
            ("NOT lesion_present AND NOT pancreas_present", "'background_negative'"),
            ("NOT lesion_present", "'organ_without_lesion'"),
            ("NOT pancreas_present", "'lesion_location_not_checkable'"),
            (f"{ov} IS NULL", "'overlap_not_computed'"),
            (f"{ov} >= {lit(lim['overlap_strict'])}", "'overlap_good'"),
            (f"{ov} >= {lit(lim['overlap_min'])}", "'overlap_moderate'"),
        ],
        "'overlap_below_minimum'",
    )
    extra = case(
        [
            ("lesion_present", "NULL"),
            ("annotation_status = 'confirmed_absent'", "'absence_confirmed'"),
        ],
        "'absence_needs_confirmation'",
    )
    return f"CASE WHEN omitted THEN array('case_omitted') ELSE {compact([main, extra])} END"


def missing_metadata_fields() -> str:
    return compact([f"CASE WHEN {missing_metadata(m)} THEN {lit(m)} END" for m in METADATA_FIELDS])


def _flag_value(tag: str) -> str:
    """The number a flag is about, where there is one."""
    if tag.startswith("lesion_overlap") or tag in ("lesion_outside_pancreas", "lesion_partial_outside"):
        return "overlap_rate_vs_lesion"
    if tag.startswith("region_sum_error") or tag == "incomplete_anatomical_coverage":
        return "region_relative_error"
    if tag in PAIR_TAGS:
        return f"{tag}_mm3"
    if tag in ("very_small_pancreas", "small_pancreas", "large_pancreas"):
        return "pancreas_volume_mm3"
    if tag in ("very_small_lesion", "very_large_lesion"):
        return "lesion_volume_mm3"
    if tag == "high_lesion_pancreas_ratio":
        return "lesion_volume_mm3 / pancreas_volume_mm3"
    if tag == "missing_metadata":
        return "CAST(n_missing_metadata AS DOUBLE)"
    if tag == "suspicious_hu_distribution":
        return "tumor_median_hu"
    return "CAST(NULL AS DOUBLE)"


def flag_array() -> str:
    """Ordered array of structs (severity, tag, value) of the raised flags."""
    items = []
    for tag in FLAG_DOMAINS:
        severity = case([(f"f__{tag} = {i + 1}", lit(s)) for i, s in enumerate(FLAG_LEVELS)])
        body = f"named_struct('severity', {severity}, 'tag', {lit(tag)}, 'value', {_flag_value(tag)})"
        items.append(f"CASE WHEN f__{tag} > 0 THEN {body} END")
    return compact(items)


def flags_long(flagged: DataFrame) -> DataFrame:
    """Long flag table (case_id, severity, tag, value); narrow explode."""
    exploded = flagged.selectExpr("case_id", f"explode({flag_array()}) AS flag")
    return exploded.selectExpr("case_id", "flag.severity", "flag.tag", "flag.value")
