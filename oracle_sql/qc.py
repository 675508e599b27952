"""SQL of the case assessment: evidence, flags, components, both passes."""

from __future__ import annotations

from caseward.sources.derived import BASE, LAYERS, LINE_TOTALS

DOMAINS = (
    "geometry_integrity lesion_localization lesion_burden pancreas_context fov_integrity"
    " region_consistency attenuation_integrity metadata_completeness"
).split()


def layer(name: str, source: str, columns: dict[str, str]) -> str:
    items = ", ".join("*" if k == "*" else f"{v} AS {k}" for k, v in columns.items())
    return f"{name} AS (SELECT {items} FROM {source})"


def cases_ctes() -> list[str]:
    lines = ", ".join(f"{v} AS {k}" for k, v in LINE_TOTALS.items())
    parts = [
        f"lines AS (SELECT l_orderkey, {lines} FROM lineitem GROUP BY l_orderkey)",
        "joined AS (SELECT * FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey"
        " LEFT JOIN customer ON o_custkey = c_custkey)",
        layer("base", "joined", BASE),
    ]
    source = "base"
    for i, columns in enumerate(LAYERS, 1):
        parts.append(layer(f"layer{i}", source, columns))
        source = f"layer{i}"
    return parts


def task_cte(mode: str) -> str:
    """Case columns as the task sees them."""
    if mode == "pancreas_lesion_subregions":
        return (
            "cs AS (SELECT *, CASE WHEN pvol <> 0 THEN abs(head_v + body_v + tail_v - pvol) / pvol END AS rel,"
            " CASE WHEN ref_key = 'regions_union' THEN r_regions ELSE r_filled END AS declared FROM layer6)"
        )
    nulls = {c: "NULL::DOUBLE" for c in "head_v body_v tail_v head_o body_o tail_o hb ht bt".split()}
    extra = {"rel": "NULL::DOUBLE", "declared": "r_filled"}
    if mode == "pancreas_only":
        nulls |= {c: "NULL::DOUBLE" for c in "lv tmed tmean tstd delta z".split()}
        nulls |= {
            "n_les": "NULL::INT",
            "l_empty": "NULL::BOOLEAN",
            "r_total": "NULL::DOUBLE",
            "ann": "NULL::VARCHAR",
            "hole": "NULL::BOOLEAN",
            "radd": "NULL::BOOLEAN",
            "l_aff": "CASE WHEN omitted THEN NULL ELSE false END",
            "hu_status": "CASE WHEN omitted THEN NULL WHEN pvol > 0 THEN 'pancreas_only_negative_case'"
            " ELSE 'no_pancreas_no_lesion_negative_case' END",
            "att": "CASE WHEN omitted THEN 'Unknown' ELSE 'Not applicable' END",
            "datt": "CASE WHEN omitted THEN 'Unknown' ELSE 'Not applicable' END",
            "rule": "CASE WHEN omitted THEN 'unknown' ELSE 'not_applicable_negative_case' END",
            "disag": "false",
            "susp": "false",
            "les_h": "0e0",
            "les_b": "0e0",
            "les_t": "0e0",
        }
        extra["declared"] = "NULL::DOUBLE"
    swap = ", ".join(f"{v} AS {k}" for k, v in nulls.items())
    more = ", ".join(f"{v} AS {k}" for k, v in extra.items())
    return f"cs AS (SELECT * REPLACE ({swap}), {more} FROM layer6)"


def evidence_ctes(mode: str) -> list[str]:
    sub = mode == "pancreas_lesion_subregions"
    by_mask = "NOT (coalesce(l_empty, false) OR (coalesce(n_les, 0) = 0 AND coalesce(lv, 0) = 0))"
    lesion = (
        by_mask
        if mode == "pancreas_only"
        else f"CASE ann WHEN 'lesion_present' THEN true WHEN 'confirmed_absent' THEN false"
        f" WHEN 'insufficient_evidence' THEN false ELSE {by_mask} END"
    )
    found = "coalesce(head_v, 0) > 0 OR coalesce(body_v, 0) > 0 OR coalesce(tail_v, 0) > 0"
    return [
        f"""e1 AS (SELECT *,
            coalesce(pvol, 0) AS vol, coalesce(lv, 0) AS les,
            NOT coalesce(p_empty, false) AND coalesce(pvol, 0) > 0 AS organ,
            {lesion} AS lesion,
            coalesce(declared, r_total) AS ov,
            {'(' + found + ')' if sub else 'false'} AS found,
            (coalesce(head_v, 0) > 0)::INT + (coalesce(body_v, 0) > 0)::INT + (coalesce(tail_v, 0) > 0)::INT AS nreg,
            (coalesce(sex, '') = '')::INT + (coalesce(age, 0) = 0)::INT + (coalesce(phase, '') = '')::INT
              + (coalesce(maker, '') = '')::INT AS nmiss
          FROM cs)""",
        """e2 AS (SELECT *,
            organ AND coalesce(zmin <= 3, false) AS t_zmin, organ AND coalesce(zmax >= nz - 4, false) AS t_zmax,
            organ AND coalesce(ymin <= 3, false) AS t_ymin, organ AND coalesce(ymax >= 508, false) AS t_ymax,
            organ AND coalesce(xmin <= 3, false) AS t_xmin, organ AND coalesce(xmax >= 508, false) AS t_xmax,
            organ AND found AS checked, nullif(tmed, 0) AS med
          FROM e1)""",
        "e3 AS (SELECT *, t_zmin OR t_zmax OR t_ymin OR t_ymax OR t_xmin OR t_xmax AS touch FROM e2)",
        """e4 AS (SELECT *,
            touch OR (checked AND nreg < 3 AND vol < 30000) AS partial,
            checked AND touch AND nreg < 3 AS trunc,
            CASE WHEN checked THEN round_even((coalesce(head_o, 0) + coalesce(body_o, 0) + coalesce(tail_o, 0)) / vol, 4) END AS cover,
            CASE WHEN checked THEN coalesce(rel, 0) END AS err,
            CASE WHEN checked THEN coalesce(hb, 0) END AS o_hb, CASE WHEN checked THEN coalesce(ht, 0) END AS o_ht,
            CASE WHEN checked THEN coalesce(bt, 0) END AS o_bt
          FROM e3)""",
    ]




def flag_sql(mode: str) -> dict[str, str]:
    """Tag -> severity number (0 none, 1 INFO, 2 WARNING, 3 CRITICAL)."""
    lesion_task = mode != "pancreas_only"
    sub = mode == "pancreas_lesion_subregions"
    r = "lesion AND organ AND ov IS NOT NULL"
    f = {
        "omit_from_training": "CASE WHEN omitted THEN 3 ELSE 0 END",
        "lesion_annotation_insufficient_evidence": "CASE WHEN NOT lesion AND ann = 'insufficient_evidence' THEN 3 ELSE 0 END",
        "required_target_missing": "0" if lesion_task else "CASE WHEN organ THEN 0 ELSE 3 END",
        "confirmed_negative_lesion": "CASE WHEN NOT lesion AND ann = 'confirmed_absent' THEN 1 ELSE 0 END",
        "unconfirmed_negative_lesion": "CASE WHEN NOT lesion AND coalesce(ann, '') <> 'confirmed_absent' THEN 3 ELSE 0 END",
        "lesion_mask_empty": "CASE WHEN lesion THEN 0 ELSE 1 END",
        "lesion_no_anatomical_validation": "CASE WHEN lesion AND NOT organ THEN 2 ELSE 0 END",
        "pancreas_hole_annotation_suspected": f"CASE WHEN {r} AND hole THEN 1 ELSE 0 END",
        "lesion_in_subregion_spillover": f"CASE WHEN {r} AND radd THEN 1 ELSE 0 END",
        "lesion_overlap_critical_fail": f"CASE WHEN {r} AND ov < 0.8e0 THEN CASE WHEN ov < 0.8e0 * 0.2e0 THEN 3 ELSE 2 END ELSE 0 END",
        "lesion_outside_pancreas": f"CASE WHEN {r} AND ov < 0.8e0 AND ov < 0.8e0 * 0.2e0 THEN 1 ELSE 0 END",
        "lesion_overlap_strict_fail": "0",
        "lesion_partial_outside": f"CASE WHEN {r} AND ov < 0.8e0 AND ov >= 0.8e0 * 0.2e0 THEN 1 ELSE 0 END",
        "pancreas_mask_empty": "CASE WHEN organ THEN 0 WHEN lesion THEN 3 ELSE 1 END",
        "subregions_not_applicable": "0" if sub else "CASE WHEN organ THEN 1 ELSE 0 END",
        "subregions_expected_but_missing": "CASE WHEN organ AND NOT found THEN 2 ELSE 0 END" if sub else "0",
        "head_region_empty": "CASE WHEN checked AND head_v = 0 THEN CASE WHEN partial THEN 1 ELSE 2 END ELSE 0 END",
        "body_region_empty": "CASE WHEN checked AND body_v = 0 THEN CASE WHEN partial THEN 1 ELSE 2 END ELSE 0 END",
        "tail_region_empty": "CASE WHEN checked AND tail_v = 0 THEN CASE WHEN partial THEN 1 ELSE 2 END ELSE 0 END",
        "incomplete_anatomical_coverage": "CASE WHEN checked AND err > 0.45e0 AND partial THEN 2 ELSE 0 END",
        "region_sum_error_critical": "CASE WHEN checked AND err > 0.45e0 AND NOT partial THEN 3 ELSE 0 END",
        "region_sum_error_warning": "CASE WHEN checked AND err <= 0.45e0 AND err > 0.45e0 / 3 THEN 2 ELSE 0 END",
        "head_body_overlap": "CASE WHEN o_hb > 0 THEN 2 ELSE 0 END",
        "head_tail_overlap": "CASE WHEN o_ht > 0 THEN 2 ELSE 0 END",
        "body_tail_overlap": "CASE WHEN o_bt > 0 THEN 2 ELSE 0 END",
        "very_small_pancreas": "CASE WHEN organ AND vol < 10000 THEN 3 ELSE 0 END",
        "small_pancreas": "CASE WHEN organ AND vol >= 10000 AND vol < 20000 THEN 2 ELSE 0 END",
        "large_pancreas": "CASE WHEN organ AND vol > 200000 THEN 2 ELSE 0 END",
        "very_small_lesion": "CASE WHEN lesion AND les > 0 AND les < 10 THEN 2 ELSE 0 END",
        "very_large_lesion": "CASE WHEN lesion AND les > 200000 THEN 2 ELSE 0 END",
        "high_lesion_pancreas_ratio": "CASE WHEN organ AND lesion AND les > 0 AND les / vol > 0.8e0 THEN 2 ELSE 0 END",
        "invalid_spacing": "CASE WHEN sz <= 0 OR sz > 10 THEN 3 WHEN greatest(0.8e0, sz) / (least(0.8e0, sz) + 1e-9) > 5 THEN 2 ELSE 0 END",
        "shape_mismatch": "CASE WHEN nz < 10 THEN 3 ELSE 0 END",
        "missing_metadata": "CASE WHEN nmiss > 0 THEN 1 ELSE 0 END",
        "suspicious_hu_distribution": "CASE WHEN lesion AND (med < -200 OR med > 400) THEN 2 WHEN lesion AND susp THEN 1 ELSE 0 END",
        "attenuation_rule_disagreement": "CASE WHEN lesion AND disag THEN 1 ELSE 0 END",
    }
    if not lesion_task:
        for tag in list(f):
            if tag.startswith(("lesion_", "confirmed_", "unconfirmed_", "pancreas_hole", "pancreas_mask")):
                f[tag] = "0"
    return f


TAG_DOMAIN = {
    "geometry_integrity": ("invalid_spacing", "shape_mismatch"),
    "lesion_localization": (
        "lesion_annotation_insufficient_evidence",
        "unconfirmed_negative_lesion",
        "lesion_overlap_critical_fail",
        "pancreas_mask_empty",
    ),
    "lesion_burden": (),
    "pancreas_context": ("required_target_missing", "very_small_pancreas"),
    "fov_integrity": (),
    "region_consistency": ("region_sum_error_critical",),
    "attenuation_integrity": (),
    "metadata_completeness": (),
}
LADDERS = {
    "geometry_integrity": (1, 20, 35, 40),
    "lesion_localization": (1, 15, 35, 40),
    "lesion_burden": (1, 8, 15, 20),
    "pancreas_context": (1, 8, 15, 20),
    "fov_integrity": (1, 4, 8, 12),
    "region_consistency": (1, 5, 10, 15),
    "attenuation_integrity": (1, 5, 10, 15),
}
WEIGHTS = {
    "pancreas_only": (0.0, 1.0, 1.0, 0.0, 0.5, 0.5),
    "pancreas_lesion": (1.0, 0.8, 1.0, 0.0, 0.5, 0.4),
    "pancreas_lesion_subregions": (0.8, 0.6, 1.0, 1.2, 0.5, 0.4),
}
OFF = {
    "pancreas_only": ("lesion_localization", "lesion_burden", "region_consistency"),
    "pancreas_lesion": ("region_consistency",),
    "pancreas_lesion_subregions": (),
}
FAILURES = {
    "geometry_integrity": "geometry_integrity_failure",
    "lesion_localization": "lesion_localization_failure",
    "lesion_burden": "lesion_burden_abnormality",
    "pancreas_context": "pancreas_context_issue",
    "fov_integrity": "fov_integrity_issue",
    "region_consistency": "anatomical_region_inconsistency",
    "metadata_completeness": "missing_metadata",
    "attenuation_integrity": "suspicious_attenuation",
}
TIE_ORDER = (
    "geometry_integrity lesion_localization lesion_burden pancreas_context fov_integrity"
    " region_consistency metadata_completeness attenuation_integrity"
).split()


def flag_cte(mode: str) -> str:
    cols = []
    for tag, sql in flag_sql(mode).items():
        cols.append(f"{sql} AS g_{tag}" if tag == "omit_from_training" else f"CASE WHEN omitted THEN 0 ELSE {sql} END AS g_{tag}")
    return f"fl AS (SELECT *, {', '.join(cols)} FROM e4)"


def component_ctes(mode: str, score: str = "hybrid") -> list[str]:
    comp = {
        "geometry_integrity": "least(80, CASE WHEN g_shape_mismatch > 0 THEN 40 ELSE 0 END"
        " + CASE g_invalid_spacing WHEN 3 THEN 40 WHEN 2 THEN 20 ELSE 0 END)",
        "lesion_localization": "CASE WHEN NOT lesion THEN 0 WHEN NOT organ THEN 40 WHEN ov IS NULL THEN 45"
        " WHEN ov >= 0.8e0 THEN 0 WHEN ov < 0.05e0 THEN 85"
        " WHEN ov < 0.3e0 THEN round_even(60 + 25 * (0.3e0 - ov) / 0.3e0, 0)"
        " ELSE round_even(60 * (0.8e0 - ov) / 0.5e0, 0) END",
        "lesion_burden": "least(20, 15 * (g_very_small_lesion > 0)::INT + 15 * (g_very_large_lesion > 0)::INT"
        " + 10 * (g_high_lesion_pancreas_ratio > 0)::INT)",
        "pancreas_context": "least(20, CASE WHEN g_very_small_pancreas > 0 THEN 20 WHEN g_small_pancreas > 0 THEN 10"
        " WHEN g_large_pancreas > 0 THEN 5 ELSE 0 END + 20 * (g_required_target_missing > 0)::INT"
        " + 5 * (g_pancreas_mask_empty > 0 AND lesion)::INT)",
        "fov_integrity": "least(15, touch::INT + 2 * partial::INT + 8 * trunc::INT)",
        "region_consistency": "least(raw, 10)"
        if mode == "pancreas_lesion_subregions"
        else "CASE WHEN lesion THEN 0 ELSE least(raw, 10) END",
        "attenuation_integrity": "10 * (g_suspicious_hu_distribution > 0)::INT",
        "metadata_completeness": "CASE WHEN g_missing_metadata > 0 THEN least(10, round_even(10 * nmiss / 4e0, 0)) ELSE 0 END",
    }
    cols = []
    for d in DOMAINS:
        value = "0" if d in OFF[mode] else comp[d]
        cols.append(f"CASE WHEN omitted THEN {100 if d == 'geometry_integrity' else 0} ELSE {value} END::INT AS c_{d}")
    burden, context, fov, region, meta, att = WEIGHTS[mode]
    names = ("lesion_burden", "pancreas_context", "fov_integrity", "region_consistency", "metadata_completeness", "attenuation_integrity")
    weights = dict(zip(names, (burden, context, fov, region, meta, att)))
    s = " + ".join(f"{w!r}e0 * c_{d}" for d, w in weights.items())
    raw = " + ".join(f"{w!r}e0 * {'raw' if d == 'region_consistency' else 'c_' + d}" for d, w in weights.items())
    worst = ", ".join(f"g_{t}" for t in flag_sql(mode) if t != "pancreas_mask_empty")
    if score == "hybrid":
        number = (
            "least(100, round_even(c_geometry_integrity + c_lesion_localization * (1 + 0.4e0 * sw / 100)"
            " + CASE WHEN c_lesion_localization = 0 THEN 1.5e0 * sr ELSE 0 END, 0))"
        )
    else:
        number = "least(100, " + " + ".join(f"c_{d}" for d in DOMAINS) + ")"
    top = "greatest(" + ", ".join(f"c_{d}" for d in DOMAINS) + ")"
    dominant = "CASE WHEN top = 0 THEN 'none' " + " ".join(f"WHEN c_{d} = top THEN '{FAILURES[d]}'" for d in TIE_ORDER) + " END"
    return [
        f"""c0 AS (SELECT *, (
            CASE WHEN g_region_sum_error_critical > 0 THEN least(30, round_even(10 + 20 * greatest(err - 0.25e0, 0) / 0.75e0, 0)) ELSE 0 END
          + CASE WHEN g_region_sum_error_warning > 0 THEN greatest(1, least(10, round_even(10 * err / 0.25e0, 0))) ELSE 0 END
          + 5 * ((g_head_body_overlap > 0)::INT + (g_head_tail_overlap > 0)::INT + (g_body_tail_overlap > 0)::INT)
          + 6 * (g_incomplete_anatomical_coverage > 0)::INT + 10 * (g_subregions_expected_but_missing > 0)::INT
          + 4 * ((g_head_region_empty = 2)::INT + (g_body_region_empty = 2)::INT + (g_tail_region_empty = 2)::INT))::INT AS raw
          FROM fl)""",
        f"c1 AS (SELECT *, {', '.join(cols)} FROM c0)",
        f"c2 AS (SELECT *, {s} AS sw, {raw} AS sr, {top} AS top, greatest({worst}) AS other_flag FROM c1)",
        f"""c3 AS (SELECT *, CASE WHEN omitted THEN 100 ELSE {number} END::INT AS score,
            greatest(other_flag, g_pancreas_mask_empty) AS any_flag, {dominant} AS dominant,
            CASE WHEN omitted THEN 'omitted' {"WHEN organ THEN 'positive' ELSE 'missing_required_target'" if mode == 'pancreas_only' else "WHEN lesion THEN 'positive' ELSE 'negative'"} END AS sample
          FROM c2)""",
        """c4 AS (SELECT *, CASE WHEN score > 65 THEN 'exclude' WHEN score > 35 OR any_flag = 3 THEN 'review' ELSE 'keep' END AS scalar
          FROM c3)""",
    ]


def gate_sql(p: str) -> tuple[str, str]:
    order = []
    for d in ("geometry_integrity", "lesion_localization"):
        order.append((d, 5, "exclude"))
    for d in DOMAINS[2:7]:
        order.append((d, 5, "review"))
    for level in (4, 3):
        for d in DOMAINS[:7]:
            order.append((d, level, "review"))
    order.append(("metadata_completeness", 2, "keep_with_metadata_warning"))
    for d in DOMAINS:
        order.append((d, 2, "keep"))
    rec = "CASE " + " ".join(f"WHEN {p}{d} = {n} THEN '{r}'" for d, n, r in order) + " ELSE 'keep' END"
    drv = "CASE " + " ".join(f"WHEN {p}{d} = {n} THEN '{d}'" for d, n, _ in order) + " END"
    return rec, drv


def merge_sql(profile: str, scalar: str) -> str:
    return (
        f"CASE WHEN {scalar} = 'exclude' OR ({scalar} = 'review' AND {profile} NOT IN ('review', 'exclude'))"
        f" THEN {scalar} ELSE {profile} END"
    )


HINT = (
    "CASE WHEN {r} = 'exclude' THEN 'omit' WHEN {r} = 'keep_with_metadata_warning' THEN 'metadata_warning'"
    " WHEN {w} >= 4 THEN 'priority_review' WHEN {r} = 'review' THEN 'review' WHEN {w} = 2 THEN 'low_priority' ELSE 'routine' END"
)
RISK = "CASE WHEN {w} >= 4 THEN 'high' WHEN {w} = 3 THEN 'medium' ELSE 'low' END"


def first_pass_ctes(mode: str, ladders: dict | None = None, source: str = "c4", tag: str = "") -> list[str]:
    ladders = {**LADDERS, **(ladders or {})}
    levels = []
    for d in DOMAINS:
        if d == "metadata_completeness":
            levels.append(f"CASE WHEN c_{d} > 0 THEN 2 ELSE 1 END AS p_{d}")
            continue
        forced = " OR ".join(f"g_{t} = 3" for t in TAG_DOMAIN[d]) or "false"
        low, mod, high, crit = ladders[d]
        levels.append(
            f"CASE WHEN {forced} THEN 5 WHEN c_{d} >= {crit} THEN 5 WHEN c_{d} >= {high} THEN 4"
            f" WHEN c_{d} >= {mod} THEN 3 WHEN c_{d} >= {low} THEN 2 ELSE 1 END AS p_{d}"
        )
    rec, drv = gate_sql("p_")
    merged = merge_sql("prof1", "scalar")
    if mode == "pancreas_only":
        final = f"CASE WHEN omitted THEN 'omit_from_training' WHEN NOT organ THEN 'exclude' ELSE {merged} END"
    else:
        final = (
            f"CASE WHEN omitted THEN 'omit_from_training' WHEN sample = 'negative' AND other_flag <= 1"
            f" AND ({merged}) = 'exclude' THEN 'keep' ELSE {merged} END"
        )
    worst = "greatest(" + ", ".join(f"p_{d}" for d in DOMAINS[:7]) + ")"
    return [
        f"f0{tag} AS (SELECT *, {', '.join(levels)} FROM {source})",
        f"f1{tag} AS (SELECT *, {rec} AS prof1, {drv} AS drv1, {worst} AS worst1 FROM f0{tag})",
        f"f2{tag} AS (SELECT *, {final} AS rec1 FROM f1{tag})",
        f"""f3{tag} AS (SELECT *,
            CASE WHEN omitted THEN 'critical' ELSE {RISK.format(w='worst1')} END AS risk1,
            CASE WHEN omitted THEN 'omit' ELSE {HINT.format(r='rec1', w='worst1')} END AS hint1,
            coalesce(drv1, CASE WHEN rec1 NOT IN ('keep', 'keep_with_metadata_warning') THEN 'scalar_score' END) AS dom1,
            nullif(dominant, 'none') AS fail1,
            CASE WHEN omitted THEN 'omit_from_training' ELSE rec1 || '_' || sample END AS decision
          FROM f2{tag})""",
    ]


SUBCHECKS = {
    "geometry_integrity": ("affine_alignment", "spacing", "shape", "direction_cosines"),
    "lesion_localization": ("overlap", "pancreas_presence_context"),
    "lesion_burden": ("lesion_volume", "lesion_pancreas_ratio"),
    "pancreas_context": ("organ_presence", "organ_volume"),
    "fov_integrity": ("border_touching", "anatomical_coverage", "truncation"),
    "region_consistency": ("task_mode_applicability", "subregion_volume_sum", "subregion_overlap", "missing_subregions"),
    "attenuation_integrity": ("hu_distribution", "attenuation_class", "rule_disagreement"),
    "metadata_completeness": ("fields",),
}


def subcheck_cte(mode: str, source: str, tag: str = "") -> str:
    on = "(NOT omitted AND organ)" if mode == "pancreas_lesion_subregions" else "false"
    sus = "(NOT omitted AND lesion AND g_suspicious_hu_distribution > 0)"
    hu = "coalesce(med, nullif(tmean, 0))"
    s = {
        "affine_alignment": "CASE WHEN coalesce(p_aff, false) OR coalesce(l_aff, false) THEN 4 ELSE 1 END",
        "spacing": "CASE g_invalid_spacing WHEN 3 THEN 4 WHEN 2 THEN 3 ELSE 1 END",
        "shape": "CASE WHEN g_shape_mismatch > 0 THEN 4 ELSE 1 END",
        "direction_cosines": "CASE WHEN error_type = 'non_orthonormal_direction_cosines' THEN 5 ELSE 1 END",
        "overlap": "CASE WHEN NOT lesion THEN 0 WHEN NOT organ THEN 4 WHEN ov IS NULL THEN 3 WHEN ov >= 0.8e0 THEN 1"
        " WHEN ov >= 0.55e0 THEN 2 WHEN ov >= 0.25e0 THEN 3 WHEN ov >= 0.05e0 THEN 4 ELSE 5 END",
        "pancreas_presence_context": "CASE WHEN lesion AND NOT organ THEN 4 ELSE 1 END",
        "lesion_volume": "CASE WHEN NOT lesion THEN 0 WHEN les < 10 THEN 3 WHEN les > 200000 THEN 4 ELSE 1 END",
        "lesion_pancreas_ratio": "CASE WHEN NOT lesion OR vol = 0 THEN 0 WHEN les / vol > 1.5e0 THEN 4"
        " WHEN les / vol > 0.8e0 THEN 3 WHEN les / vol > 0.4e0 THEN 2 ELSE 1 END",
        "organ_presence": "CASE WHEN organ THEN 1 ELSE 0 END",
        "organ_volume": "CASE WHEN NOT organ THEN 0 WHEN vol < 10000 THEN 4 WHEN vol < 25000 OR vol > 250000 THEN 3 ELSE 1 END",
        "border_touching": "CASE WHEN touch THEN 2 ELSE 1 END",
        "anatomical_coverage": "CASE WHEN g_head_region_empty = 2 OR g_body_region_empty = 2 OR g_tail_region_empty = 2"
        " OR g_incomplete_anatomical_coverage > 0 THEN 3 ELSE 1 END",
        "truncation": "CASE WHEN trunc THEN 4 ELSE 1 END",
        "task_mode_applicability": f"CASE WHEN {on} THEN 1 ELSE 0 END",
        "subregion_volume_sum": f"CASE WHEN NOT {on} THEN 0 WHEN raw = 0 AND c_region_consistency = 0 THEN 1"
        " WHEN raw >= 30 THEN 4 WHEN raw >= 15 THEN 3 ELSE 2 END",
        "subregion_overlap": f"CASE WHEN NOT {on} THEN 0 WHEN o_hb > 0 OR o_ht > 0 OR o_bt > 0 THEN 3 ELSE 1 END",
        "missing_subregions": f"CASE WHEN {on} THEN 1 ELSE 0 END",
        "hu_distribution": "CASE WHEN hu_status IN ('pancreas_only_negative_case', 'no_pancreas_no_lesion_negative_case') THEN 0"
        f" WHEN NOT {sus} THEN 1 WHEN {hu} IS NULL THEN 3 WHEN {hu} < -500 OR {hu} > 1000 THEN 5"
        f" WHEN {hu} < -300 OR {hu} > 600 THEN 4 ELSE 3 END",
        "attenuation_class": "CASE WHEN att IS NULL OR att = 'Not applicable' THEN 0 ELSE 1 END",
        "rule_disagreement": "CASE WHEN disag THEN 2 ELSE 1 END",
        "fields": "CASE WHEN NOT omitted AND nmiss > 0 THEN 2 ELSE 1 END",
    }
    return (
        f"sc{tag} AS (SELECT *, {on} AS reg_on, {sus} AS sus, " + ", ".join(f"{v} AS s_{k}" for k, v in s.items()) + f" FROM {source})"
    )


def final_ctes(mode: str, source: str = "sc", tag: str = "") -> list[str]:
    levels, parts = [], []
    for d in DOMAINS:
        subs = ", ".join(f"s_{s}" for s in SUBCHECKS[d])
        if d in OFF[mode]:
            levels.append(f"0 AS d_{d}")
        elif d == "metadata_completeness":
            levels.append(f"least(2, greatest(p_{d}, {subs})) AS d_{d}")
        elif d == "region_consistency":
            levels.append(f"CASE WHEN reg_on THEN greatest(p_{d}, {subs}) ELSE 0 END AS d_{d}")
        else:
            levels.append(f"greatest(p_{d}, {subs}) AS d_{d}")
        on = "false" if d in OFF[mode] else "reg_on" if d == "region_consistency" else "true"
        parts.append(f"{on} AS on_{d}")
    rec, drv = gate_sql("d_")
    share = [f"CASE WHEN d_{d} > 0 AND on_{d} THEN c_{d} WHEN d_{d} > 0 THEN 0 ELSE -1 END AS h_{d}" for d in DOMAINS]
    top = "greatest(" + ", ".join(f"h_{d}" for d in DOMAINS) + ")"
    pick = "CASE " + " ".join(f"WHEN h_{d} = {top} THEN '{d}'" for d in DOMAINS) + " END"
    merged = merge_sql("prof2", "scalar")
    if mode == "pancreas_only":
        merged = f"CASE WHEN NOT organ THEN 'exclude' ELSE {merged} END"
    worst = "greatest(" + ", ".join(f"d_{d}" for d in DOMAINS[:7]) + ")"
    fail = "CASE drv3 " + " ".join(f"WHEN '{d}' THEN '{v}'" for d, v in FAILURES.items()) + " ELSE fail1 END"
    sub = []
    for d in DOMAINS:
        names = SUBCHECKS[d]
        top_sub = f"greatest({', '.join('s_' + n for n in names)})"
        sub.append(f"WHEN '{d}' THEN CASE " + " ".join(f"WHEN s_{n} = {top_sub} THEN '{n}'" for n in names) + " END")
    return [
        f"r0{tag} AS (SELECT *, {', '.join(levels)}, {', '.join(parts)} FROM {source})",
        f"r1{tag} AS (SELECT *, {rec} AS prof2, {drv} AS drv2, {worst} AS worst2, {', '.join(share)} FROM r0{tag})",
        f"r2{tag} AS (SELECT *, {merged} AS rec2, {RISK.format(w='worst2')} AS risk2 FROM r1{tag})",
        f"""r3{tag} AS (SELECT *, {HINT.format(r='rec2', w='worst2')} AS hint2,
            coalesce(drv2, CASE WHEN rec2 NOT IN ('keep', 'keep_with_metadata_warning') THEN {pick} END) AS drv3 FROM r2{tag})""",
        f"r4{tag} AS (SELECT *, coalesce(drv3, dom1) AS dom2, {fail} AS fail2 FROM r3{tag})",
        f"rp{tag} AS (SELECT *, CASE dom2 {' '.join(sub)} END AS sub2 FROM r4{tag})",
    ]


def chain(mode: str, upto: str = "rp", score: str = "hybrid") -> list[str]:
    ctes = cases_ctes() + [task_cte(mode)] + evidence_ctes(mode) + [flag_cte(mode)]
    if upto == "fl":
        return ctes
    ctes += component_ctes(mode, score)
    if upto == "c4":
        return ctes
    ctes += first_pass_ctes(mode)
    if upto == "f3":
        return ctes
    ctes.append(subcheck_cte(mode, "f3"))
    return ctes + final_ctes(mode)


def query(ctes: list[str], select: str) -> str:
    """One statement; materialised steps keep the planner from inlining the chain."""
    steps = [c if " AS MATERIALIZED (" in c else c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]
    return "WITH " + ",\n".join(steps) + "\n" + select


SEVERITY = "CASE {x} WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'normal' WHEN 2 THEN 'low_warning' WHEN 3 THEN 'moderate_warning' WHEN 4 THEN 'high_warning' WHEN 5 THEN 'critical' END"


def sev(x: str) -> str:
    return SEVERITY.format(x=x)


def verdict(d: str, level: str, rec: str) -> str:
    if d == "metadata_completeness":
        return f"CASE WHEN {rec} = 'keep_with_metadata_warning' THEN {rec} ELSE 'keep' END"
    return f"CASE WHEN {level} = 5 THEN 'exclude' WHEN {level} >= 3 THEN 'review' ELSE 'keep' END"
