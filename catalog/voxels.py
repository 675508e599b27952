"""Geometry and voxel measurements over derived volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseward.config import Settings
from caseward.functions.sql import project
from caseward.operators import components as cc
from caseward.operators import voxels as vx
from caseward.operators.assembly import assemble
from caseward.operators.task import restrict_to_task
from caseward.plans.run import run
from caseward.sources import derived_voxels as dv
from caseward.sources.derived import case_summary
from caseward.sources.shared import stored
from oracle_sql import voxels as vo
from oracle_sql.qc import cases_ctes, query, task_cte

from catalog.base import register

V = vo.voxel_ctes()
#: Smaller than the derived volumes, so that components and holes cross tiles.
TILE = 4


@register(
    "g01_direction_metrics",
    query(
        V,
        """SELECT case_id, resource, round_even(sqrt(2 * skew * skew + skew * skew * skew * skew), 8) AS orthogonality_error,
           1e0 AS determinant, 1e0 AS axis_norm_x, round_even(sqrt(1 + skew * skew), 6) AS axis_norm_y, 1e0 AS axis_norm_z,
           sqrt(2 * skew * skew + skew * skew * skew * skew) > 0.001e0 AS non_orthonormal FROM geo""",
    ),
)
def g01(spark, sf):
    return vx.direction_metrics(dv.geometry(spark, sf))


@register(
    "g02_geometry_comparison",
    query(
        V,
        """SELECT *, size_match AND spacing_match AND origin_match AND direction_match AS affine_match FROM (
           SELECT case_id, resource, nz = inz AS size_match, abs(isp - sp) <= 1e-4 + 1e-5 * abs(sp) AS spacing_match,
             abs(iox - ox) <= 1e-2 + 1e-5 * abs(ox) AS origin_match, abs(isk - skew) <= 1e-4 + 1e-5 * abs(skew) AS direction_match
           FROM geo JOIN img ON ic = case_id WHERE resource <> 'image' AND "exists" AND readable)""",
    ),
)
def g02(spark, sf):
    return vx.compare_geometry(dv.geometry(spark, sf))


@register("g03_voxel_volume", query(V, "SELECT ic AS case_id, vv3 AS voxel_mm3 FROM img"))
def g03(spark, sf):
    return vx.image_grid(dv.geometry(spark, sf)).select("case_id", "voxel_mm3")


def stats(spark, sf):
    return vx.mask_statistics(dv.voxels(spark, sf), dv.geometry(spark, sf))


_BOX = ", ".join(f"{a}_{e}" for a in "zyx" for e in ("min", "max"))


@register(
    "g04_mask_statistics",
    query(
        V + vo.mask_ctes(),
        "SELECT case_id, mask, round_even(s * vv3, 4) AS volume_mm3, round_even(cz, 4) AS centroid_z, round_even(cy, 4) AS centroid_y,"
        f" round_even(cx, 4) AS centroid_x, {_BOX} FROM ms",
    ),
)
def g04(spark, sf):
    return vx.mask_table(stats(spark, sf)).drop("world_x", "world_y", "world_z")


@register(
    "g05_world_centroid",
    query(
        V + vo.mask_ctes(),
        """SELECT case_id, mask, round_even(iox + (qx * 0.8e0 + isk * qy * 0.8e0), 4) AS world_x, round_even(-50 + qy * 0.8e0, 4) AS world_y,
           round_even(20 + qz * isp, 4) AS world_z
           FROM (SELECT *, round_even(cz, 4) AS qz, round_even(cy, 4) AS qy, round_even(cx, 4) AS qx FROM ms)""",
    ),
)
def g05(spark, sf):
    return vx.mask_table(stats(spark, sf)).select("case_id", "mask", "world_x", "world_y", "world_z")


@register(
    "g06_mask_overlap",
    query(
        V,
        f"""SELECT case_id, round_even(count(*) FILTER (lesion > 0 AND pancreas > 0) * any_value(vv3), 4) AS lesion_pancreas_mm3,
            round_even(count(*) FILTER (lesion > 0 AND {vo.REG}) * any_value(vv3), 4) AS lesion_regions_mm3,
            round_even(count(*) FILTER (lesion > 0 AND {vo.COM}) * any_value(vv3), 4) AS lesion_combined_mm3
            FROM vox JOIN img ON ic = case_id GROUP BY case_id""",
    ),
)
def g06(spark, sf):
    return project(
        stats(spark, sf),
        {f"{n}_mm3": vx.volume(f"{n}_n") for n in ("lesion_pancreas", "lesion_regions", "lesion_combined")},
        ["case_id"],
    )


@register(
    "g07_safe_rate",
    query(
        V,
        "SELECT case_id, CASE WHEN sum(lesion) > 0 THEN round_even(count(*) FILTER (lesion > 0 AND pancreas > 0) / sum(lesion)::DOUBLE, 6) END AS rate"
        " FROM vox JOIN img ON ic = case_id GROUP BY case_id",
    ),
)
def g07(spark, sf):
    return project(stats(spark, sf), {"rate": vx.rate("lesion_pancreas_n", "lesion_n")}, ["case_id"])


@register(
    "g08_connected_components",
    vo.recursive(
        V + vo.component_ctes(),
        "SELECT lab.case_id, key // 4096 AS z, (key // 64) % 64 AS y, key % 64 AS x, lesion_id FROM lab JOIN num USING (case_id, root)",
    ),
)
def g08(spark, sf):
    labelled = vx.lesion_components(dv.voxels(spark, sf), TILE)
    return labelled.join(cc.number_components(labelled), ["case_id", "root"]).drop("root")


_PER = """SELECT case_id, lesion_id, round_even(n * vv3, 4) AS volume_mm3, round_even(cz, 4) AS centroid_z, round_even(cy, 4) AS centroid_y,
  round_even(cx, 4) AS centroid_x, round_even(np * vv3, 4) AS overlap_with_pancreas_mm3, round_even(nh * vv3, 4) AS head_mm3,
  round_even(nb * vv3, 4) AS body_mm3, round_even(nt * vv3, 4) AS tail_mm3,
  round_even(round_even(np * vv3, 4) / round_even(n * vv3, 4), 6) AS overlap_rate_vs_lesion,
  CASE WHEN nh + nb + nt = 0 THEN NULL WHEN nh >= nb AND nh >= nt THEN 'head' WHEN nb >= nt THEN 'body' ELSE 'tail' END AS dominant_region
  FROM (SELECT l.case_id, lesion_id, any_value(vv3) AS vv3, count(*) AS n, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx,
    count(*) FILTER (%s) AS np, count(*) FILTER (head > 0) AS nh, count(*) FILTER (body > 0) AS nb, count(*) FILTER (tail > 0) AS nt
    FROM lab l JOIN num USING (case_id, root) JOIN vox v ON v.case_id = l.case_id AND v.z * 4096 + v.y * 64 + v.x = l.key
    JOIN img ON ic = l.case_id GROUP BY 1, 2)""" % vo.COM


@register("g09_per_lesion", vo.recursive(V + vo.component_ctes(), _PER))
def g09(spark, sf):
    table = vx.per_lesion(dv.voxels(spark, sf), dv.geometry(spark, sf), TILE)
    return table.select(
        "case_id",
        "lesion_id",
        "volume_mm3",
        "centroid_z",
        "centroid_y",
        "centroid_x",
        "overlap_with_pancreas_mm3",
        "head_mm3",
        "body_mm3",
        "tail_mm3",
        "overlap_rate_vs_lesion",
        "dominant_region",
    )


@register(
    "w04_lesion_numbering",
    vo.recursive(
        V + vo.component_ctes(),
        "SELECT case_id, lesion_id, count(*) AS n_voxels FROM lab JOIN num USING (case_id, root) GROUP BY 1, 2",
    ),
)
def w04(spark, sf):
    return g08(spark, sf).groupBy("case_id", "lesion_id").agg(F.count("*").alias("n_voxels"))


@register(
    "g10_support_masks",
    query(
        V,
        f"SELECT case_id, count(*) FILTER (pancreas > 0) AS n_total, count(*) FILTER ({vo.REG}) AS n_regions,"
        f" count(*) FILTER ({vo.COM}) AS n_combined FROM vox GROUP BY case_id",
    ),
)
def g10(spark, sf):
    count = lambda sql, name: F.count_if(F.expr(sql)).alias(name)
    return dv.voxels(spark, sf).groupBy("case_id").agg(
        count("pancreas > 0", "n_total"), count(vx.REGION_UNION, "n_regions"), count(vx.COMBINED, "n_combined")
    )


@register("g11_hole_filling", vo.recursive(V + vo.hole_ctes(), "SELECT case_id, z, y, x FROM hole"))
def g11(spark, sf):
    return vx.filled_support(dv.voxels(spark, sf), TILE)


_OVERLAP = f"""SELECT case_id, les AS lesion_mm3, a AS pancreas_total_mm3, b AS regions_union_mm3, c AS combined_pancreas_mm3,
  d AS combined_filled_mm3, round_even(a / les, 6) AS pancreas_total_rate, round_even(c / les, 6) AS combined_pancreas_rate,
  round_even(d / les, 6) AS combined_filled_rate,
  coalesce(round_even(d / les, 6), 0) - coalesce(round_even(c / les, 6), 0) > 0.1e0 AS hole_filling_changed_overlap,
  coalesce(round_even(c / les, 6), 0) - coalesce(round_even(a / les, 6), 0) > 0.1e0
    AND coalesce(rl, 0) > 0 AS regions_added_overlap, round_even(b / les, 6) AS regions_union_rate, coalesce(rl, 0) > 0 AS regions_available,
  CASE WHEN coalesce(rl, 0) > 0 THEN 'regions_union' ELSE 'combined_filled_pancreas' END AS overlap_reference
  FROM (SELECT v.case_id, nullif(round_even(count(*) FILTER (lesion > 0) * any_value(vv3), 4), 0) AS les,
    round_even(count(*) FILTER (lesion > 0 AND pancreas > 0) * any_value(vv3), 4) AS a,
    round_even(count(*) FILTER (lesion > 0 AND {vo.REG}) * any_value(vv3), 4) AS b,
    round_even(count(*) FILTER (lesion > 0 AND {vo.COM}) * any_value(vv3), 4) AS c,
    round_even(count(*) FILTER (lesion > 0 AND ({vo.COM} OR h.case_id IS NOT NULL)) * any_value(vv3), 4) AS d
    FROM vox v LEFT JOIN hole h ON h.case_id = v.case_id AND h.z = v.z AND h.y = v.y AND h.x = v.x JOIN img ON ic = v.case_id
    GROUP BY v.case_id) LEFT JOIN (SELECT case_id, count(*) AS rl FROM geo WHERE resource IN ('head', 'body', 'tail') AND "exists" AND readable
    GROUP BY case_id) USING (case_id)"""


@register("g12_overlap_analysis", vo.recursive(V + vo.hole_ctes(), _OVERLAP))
def g12(spark, sf):
    table = vx.overlap_analysis(dv.voxels(spark, sf), dv.geometry(spark, sf), tile=TILE)
    return table.withColumn("lesion_mm3", F.expr("nullif(lesion_mm3, 0)"))


_REGION = """SELECT case_id, round_even(sum(head) * v, 4) AS head_mm3, round_even(sum(body) * v, 4) AS body_mm3,
  round_even(sum(tail) * v, 4) AS tail_mm3, round_even(count(*) FILTER (head > 0 AND pancreas > 0) * v, 4) AS head_overlap_mm3,
  round_even(count(*) FILTER (tail > 0 AND pancreas > 0) * v, 4) AS tail_overlap_mm3,
  round_even(round_even(count(*) FILTER (head > 0 AND pancreas > 0) * v, 4) / round_even(sum(pancreas) * v, 4), 6) AS head_rate_vs_pancreas
  FROM (SELECT *, vv3 AS v FROM vox JOIN img ON ic = case_id) GROUP BY case_id, v"""


@register("g13_region_statistics", query(V, _REGION))
def g13(spark, sf):
    return vx.region_consistency(stats(spark, sf)).select(
        "case_id", "head_mm3", "body_mm3", "tail_mm3", "head_overlap_mm3", "tail_overlap_mm3", "head_rate_vs_pancreas"
    )


_CONSISTENCY = """SELECT case_id, round_even(s, 4) AS sum_regions_mm3, round_even(abs(s - p) / p, 6) AS relative_error_vs_pancreas,
  round_even(hb * v, 4) AS head_body_overlap_mm3, 0e0 AS head_tail_overlap_mm3, 0e0 AS body_tail_overlap_mm3,
  round_even(s / p, 6) AS region_coverage_ratio, 'present' AS subregion_status
  FROM (SELECT case_id, v, round_even(sum(head) * v, 4) + round_even(sum(body) * v, 4) + round_even(sum(tail) * v, 4) AS s,
    round_even(sum(pancreas) * v, 4) AS p, count(*) FILTER (head > 0 AND body > 0) AS hb
    FROM (SELECT *, vv3 AS v FROM vox JOIN img ON ic = case_id) GROUP BY case_id, v)"""


@register("g14_region_consistency", query(V, _CONSISTENCY))
def g14(spark, sf):
    return vx.region_consistency(stats(spark, sf)).select(
        "case_id",
        "sum_regions_mm3",
        "relative_error_vs_pancreas",
        "head_body_overlap_mm3",
        "head_tail_overlap_mm3",
        "body_tail_overlap_mm3",
        "region_coverage_ratio",
        "subregion_status",
    )


@register("g15_erosion", query(V + vo.core_ctes(), "SELECT case_id, z, y, x FROM core"))
def g15(spark, sf):
    return cc.erode(dv.voxels(spark, sf).filter("pancreas > 0 AND lesion = 0"), TILE)


def hu(spark, sf):
    return vx.hu_statistics(dv.voxels(spark, sf), TILE)


def _hu_select(prefix: str, name: str) -> str:
    return (
        f"SELECT case_id, {prefix}_n AS {name}_voxel_count, {prefix}_mean AS {name}_mean_hu, {prefix}_std AS {name}_std_hu, "
        + ", ".join(f"{prefix}_{k} AS {name}_{k}_hu" for k in ("p05", "p25", "median", "p75", "p95"))
        + " FROM h3"
    )


def _hu_columns(name: str) -> list[str]:
    return ["case_id", f"{name}_voxel_count", *[f"{name}_{k}_hu" for k in ("mean", "std", "p05", "p25", "median", "p75", "p95")]]


@register("g16_pancreas_hu", query(V + vo.hu_ctes(), _hu_select("p", "pancreas")))
def g16(spark, sf):
    return hu(spark, sf).select(_hu_columns("pancreas"))


@register("g17_tumor_hu", query(V + vo.hu_ctes(), _hu_select("t", "tumor")))
def g17(spark, sf):
    return hu(spark, sf).select(_hu_columns("tumor"))


@register(
    "g18_attenuation_class",
    query(
        V + vo.hu_ctes(),
        """SELECT case_id, delta AS delta_hu_tumor_vs_pancreas, zs AS z_score_hu,
          CASE WHEN t_n IS NULL THEN 'Not applicable' WHEN delta IS NULL THEN 'Unknown' ELSE coalesce(zl, dl) END AS tumor_attenuation,
          CASE WHEN t_n IS NULL THEN 'not_applicable_negative_case' WHEN delta IS NULL THEN 'unknown' WHEN zs IS NOT NULL THEN 'z_score'
            ELSE 'delta_hu_fallback' END AS attenuation_rule_used,
          CASE WHEN t_n IS NULL THEN 'Not applicable' WHEN delta IS NULL THEN 'Unknown' ELSE dl END AS delta_hu_attenuation,
          coalesce(zl <> dl, false) AS attenuation_rule_disagreement FROM h3""",
    ),
)
def g18(spark, sf):
    return hu(spark, sf).select(
        "case_id",
        "delta_hu_tumor_vs_pancreas",
        "z_score_hu",
        "tumor_attenuation",
        "attenuation_rule_used",
        "delta_hu_attenuation",
        "attenuation_rule_disagreement",
    )


@register(
    "g19_suspicious_distribution",
    query(
        V + vo.hu_ctes(),
        "SELECT case_id, CASE WHEN t_n IS NULL THEN false WHEN p_n IS NULL THEN true ELSE t_n < 10 OR p_n < 50 OR zs IS NULL"
        " OR abs(t_mean - t_median) > 50 END AS suspicious_hu_distribution FROM h3",
    ),
)
def g19(spark, sf):
    return hu(spark, sf).select("case_id", "suspicious_hu_distribution")


@register(
    "g20_hu_status",
    query(
        V + vo.hu_ctes(),
        "SELECT case_id, CASE WHEN t_n > 0 THEN 'full' WHEN p_n > 0 THEN 'pancreas_only_negative_case'"
        " ELSE 'no_pancreas_no_lesion_negative_case' END AS hu_statistics_status FROM h3",
    ),
)
def g20(spark, sf):
    return hu(spark, sf).select("case_id", "hu_statistics_status")


@register(
    "g21_task_mode_nulling",
    query(
        cases_ctes() + [task_cte("pancreas_only")],
        "SELECT case_id, pvol AS pancreas_mm3, head_v AS head_mm3, n_les AS n_lesions, lv AS lesion_mm3, tmed AS tumor_median_hu,"
        " att AS tumor_attenuation, hu_status AS hu_statistics_status FROM cs",
    ),
)
def g21(spark, sf):
    return restrict_to_task(case_summary(spark, sf), "pancreas_only").selectExpr(
        "case_id",
        "pancreas.volume_mm3 AS pancreas_mm3",
        "pancreas.regions.head.volume_mm3 AS head_mm3",
        "lesions.n_lesions",
        "lesions.total_volume_mm3 AS lesion_mm3",
        "hu_statistics.tumor_median_hu",
        "hu_statistics.tumor_attenuation",
        "hu_statistics.hu_statistics_status",
    )


def known_cases(spark, sf):
    """Discovered cases: one per image row, readable or not."""
    return dv.geometry(spark, sf).filter("resource = 'image'").selectExpr("case_id", "readable AS image_readable")


@register(
    "g22_case_assembly",
    vo.recursive(
        V + vo.component_ctes() + vo.hole_ctes() + vo.hu_ctes(),
        f"""SELECT g.case_id, NOT readable AS omitted, coalesce(m.n_lesions, 0) AS n_lesions, coalesce(p.pancreas_mm3, 0) AS pancreas_mm3, h3.p_median AS pancreas_median_hu,
           coalesce(p.lesion_mm3, 0) AS lesion_mm3, m.listing AS lesions, coalesce(p.head_mm3, 0) AS head_mm3, coalesce(p.tail_overlap_mm3, 0) AS tail_overlap_mm3, p.box,
           round_even(abs(p.head_mm3 + p.body_mm3 + p.tail_mm3 - p.pancreas_mm3) / nullif(p.pancreas_mm3, 0), 6) AS region_error, o.overlap_reference,
           o.combined_filled_rate, coalesce(o.hole_filling_changed_overlap, false) AS hole_filling_changed_overlap, g.nz AS slices
           FROM geo g
           LEFT JOIN (SELECT case_id, count(*) AS n_lesions, string_agg(lesion_id || ':' || printf('%.2f', volume_mm3) || ':' || coalesce(dominant_region, '-'), ' ' ORDER BY lesion_id) AS listing
             FROM ({_PER}) GROUP BY 1) m ON m.case_id = g.case_id
           LEFT JOIN (SELECT case_id, round_even(sum(pancreas) * any_value(vv3), 4) AS pancreas_mm3, round_even(sum(lesion) * any_value(vv3), 4) AS lesion_mm3,
               round_even(sum(head) * any_value(vv3), 4) AS head_mm3, round_even(sum(body) * any_value(vv3), 4) AS body_mm3, round_even(sum(tail) * any_value(vv3), 4) AS tail_mm3,
               round_even(count(*) FILTER (tail > 0 AND pancreas > 0) * any_value(vv3), 4) AS tail_overlap_mm3,
               concat_ws(',', min(z) FILTER (pancreas > 0), min(y) FILTER (pancreas > 0), min(x) FILTER (pancreas > 0),
                 max(z) FILTER (pancreas > 0), max(y) FILTER (pancreas > 0), max(x) FILTER (pancreas > 0)) AS box
             FROM vox JOIN img ON ic = case_id GROUP BY 1) p ON p.case_id = g.case_id
           LEFT JOIN ({_OVERLAP}) o ON o.case_id = g.case_id
           LEFT JOIN h3 ON h3.case_id = g.case_id WHERE resource = 'image'""",
    ),
)
def g22(spark, sf):
    table = measured_cases(spark, sf)
    return table.selectExpr(
        "case_id",
        "case_status.omit_from_training AS omitted",
        "lesions.n_lesions",
        "pancreas.volume_mm3 AS pancreas_mm3",
        "hu_statistics.pancreas_median_hu",
        "lesions.total_volume_mm3 AS lesion_mm3",
        "array_join(transform(lesions.per_lesion, l -> concat(l.lesion_id, ':', format_string('%.2f', l.volume_mm3), ':', coalesce(l.dominant_region, '-'))), ' ') AS lesions",
        "pancreas.regions.head.volume_mm3 AS head_mm3",
        "pancreas.regions.tail.overlap_with_pancreas_mm3 AS tail_overlap_mm3",
        "array_join(flatten(pancreas.bounding_box_zyx), ',') AS box",
        "pancreas.region_consistency.relative_error_vs_pancreas AS region_error",
        "quality_control.lesion_overlap_analysis.overlap_reference_used_for_qc AS overlap_reference",
        "quality_control.lesion_overlap_analysis.combined_filled_pancreas.overlap_rate_vs_lesion AS combined_filled_rate",
        "quality_control.lesion_overlap_analysis.hole_filling_changed_overlap",
        "image.shape_zyx[0] AS slices",
    )


def measured_cases(spark, sf):
    """Nested summaries measured from the voxels."""
    return assemble(known_cases(spark, sf), dv.voxels(spark, sf), dv.geometry(spark, sf), TILE)


@register("c25_measured_decisions")
def measured_decisions(spark, sf):
    """Final decision of every case, from its voxels: measure, calibrate, judge twice, route, decide."""
    cases = stored(measured_cases(spark, sf), "measured")
    checks = cases.selectExpr(
        "case_id",
        "CASE WHEN case_status.omit_from_training THEN 'invalid' ELSE 'valid' END AS status",
        "case_status.omit_from_training AS omit_from_training",
        "concat('/data/images/', case_id, '_0000.nii.gz') AS image_path",
        "concat('/data/labels/', case_id, '/segmentations') AS segmentation_dir",
    )
    return run(cases, checks, Settings("pancreas_lesion")).selectExpr("case_id", "final.final_decision", "final.decision_basis")


@register(
    "j10_neighbour_join",
    vo.recursive(
        V + vo.hole_ctes(),
        "SELECT case_id, count(*) AS n FROM vox v SEMI JOIN hole h ON h.case_id = v.case_id AND h.z = v.z AND h.y = v.y AND h.x = v.x"
        " WHERE lesion > 0 GROUP BY 1",
    ),
)
def j10(spark, sf):
    table = dv.voxels(spark, sf)
    lesion = table.filter("lesion > 0").select("case_id", "z", "y", "x")
    return lesion.join(vx.filled_support(table, TILE), ["case_id", "z", "y", "x"], "left_semi").groupBy("case_id").agg(
        F.count("*").alias("n")
    )
