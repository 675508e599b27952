"""Nested case summaries assembled from measured voxels.

``assemble`` measures every block once and joins the parts case by case: each part
has one row per case, so the joins carry no voxels.  The result has the shape that
the rule stages read (image, metadata, geometry, pancreas, lesions, quality_control,
hu_statistics, case_status); a whole run can start from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import METADATA_FIELDS, REGION_PAIRS, REGIONS
from caseward.operators.components import AXES, TILE
from caseward.operators.voxels import (
    compare_geometry,
    hu_statistics,
    mask_statistics,
    overlap_analysis,
    per_lesion,
    region_consistency,
)
from caseward.sources.shared import stored

#: Fields of the attenuation block, as the rules name them.
HU_FIELDS = (
    "hu_statistics_status",
    *[f"tumor_{k}" for k in ("mean_hu", "median_hu", "std_hu", "voxel_count")],
    *[f"pancreas_{k}" for k in ("median_hu", "std_hu", "voxel_count")],
    "delta_hu_tumor_vs_pancreas",
    "z_score_hu",
    "tumor_attenuation",
    "attenuation_rule_used",
    "delta_hu_attenuation",
    "attenuation_rule_disagreement",
    "suspicious_hu_distribution",
)


def struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def lesion_lists(voxels: DataFrame, geometry: DataFrame, tile: int = TILE, stats: DataFrame | None = None) -> DataFrame:
    """case_id, n_lesions, per_lesion: an array of lesion structs in the order of their numbers."""
    overlaps = struct({r: struct({"volume_mm3": f"{r}_mm3"}) for r in REGIONS})
    lesion = struct(
        {
            "lesion_id": "lesion_id",
            "volume_mm3": "volume_mm3",
            "centroid_zyx": f"array({', '.join(f'centroid_{a}' for a in AXES)})",
            "centroid_world_xyz": "array(world_x, world_y, world_z)",
            "overlap_with_pancreas_mm3": "overlap_with_pancreas_mm3",
            "overlap_rate_vs_lesion": "overlap_rate_vs_lesion",
            "overlap_rate_vs_pancreas": "overlap_rate_vs_pancreas",
            "dominant_region": "dominant_region",
            "overlap_with_regions": overlaps,
        }
    )
    rows = per_lesion(voxels, geometry, tile, stats).selectExpr("case_id", f"{lesion} AS lesion")
    lists = rows.groupBy("case_id").agg(F.array_sort(F.collect_list("lesion")).alias("per_lesion"))
    return lists.selectExpr("case_id", "size(per_lesion) AS n_lesions", "per_lesion")


def _grids(geometry: DataFrame) -> DataFrame:
    """Shape and spacing of the image, which masks lie off its grid, and which could be read: one row per case."""
    matches = compare_geometry(geometry).select("case_id", "resource", "affine_match")
    rows = geometry.join(matches, ["case_id", "resource"], "left")

    def of(resource: str, value: str):
        return F.max(F.when(F.col("resource") == resource, F.expr(value)))

    return rows.groupBy("case_id").agg(
        of("image", "reverse(size_xyz)").alias("shape_zyx"),
        of("image", "spacing_xyz").alias("spacing_xyz_mm"),
        *[of(m, "coalesce(NOT affine_match, false)").alias(f"{m}_mismatch") for m in ("pancreas", "lesion")],
        *[of(m, "exists AND readable").alias(f"{m}_loaded") for m in ("pancreas", "lesion")],
    )


def assemble(known: DataFrame, voxels: DataFrame, geometry: DataFrame, tile: int = TILE) -> DataFrame:
    """One nested summary for each known case (case_id, image_readable, and metadata fields where known).

    A case whose image cannot be read keeps its row, with null measures and the
    status ``omitted``; a case without labelled cells has zero volumes.
    """
    # Cells and measures are read many times over: both are made once and stored.
    voxels = stored(voxels, "voxels")
    ends = [f"pancreas_{a}{e}" for e in ("min", "max") for a in AXES]
    stats = mask_statistics(voxels, geometry)
    sums = [c for c in stats.columns if c.endswith(("_sum", "_n"))]
    stats = stored(stats.select("case_id", "voxel_mm3", "spacing_xyz", "origin_xyz", "direction", *sums, *ends), "statistics")
    boxes = stats.selectExpr("case_id", "round(lesion_sum * voxel_mm3, 4) AS lesion_total_mm3", *ends)
    parts = (
        boxes,
        region_consistency(stats),
        overlap_analysis(voxels, geometry, tile=tile, stats=stats),
        lesion_lists(voxels, geometry, tile, stats),
        hu_statistics(voxels, tile),
        _grids(geometry),
    )
    rows = known
    for part in parts:
        rows = rows.join(part, "case_id", "left")
    fields = {f: f"CAST({f} AS {'INT' if f == 'age' else 'STRING'})" if f in known.columns else f"CAST(NULL AS {'INT' if f == 'age' else 'STRING'})" for f in METADATA_FIELDS}
    box = "CASE WHEN pancreas_zmin IS NOT NULL THEN array(array({}), array({})) END".format(*[", ".join(f"pancreas_{a}{e}" for a in AXES) for e in ("min", "max")])
    region = {r: struct({"volume_mm3": f"coalesce({r}_mm3, 0D)", "overlap_with_pancreas_mm3": f"coalesce({r}_overlap_mm3, 0D)"}) for r in REGIONS}
    rate = lambda name: struct({"overlap_rate_vs_lesion": f"{name}_rate"})
    lesion_here = "coalesce(lesion_mm3, 0) > 0"
    usable = "coalesce(lesion_loaded, false) AND NOT coalesce(lesion_mismatch, true) AND image_readable"
    blocks = {
        "image": {"shape_zyx": "shape_zyx", "spacing_xyz_mm": "spacing_xyz_mm"},
        "metadata": fields,
        "geometry": {
            "summary": struct(
                {
                    "pancreas_affine_mismatch": "coalesce(pancreas_mismatch, false)",
                    "lesion_affine_mismatch": "coalesce(lesion_mismatch, false)",
                    "any_affine_mismatch": "coalesce(pancreas_mismatch, false) OR coalesce(lesion_mismatch, false)",
                }
            )
        },
        "pancreas": {
            "volume_mm3": "coalesce(pancreas_mm3, 0D)",
            "bounding_box_zyx": box,
            "regions": struct(region),
            "region_consistency": struct(
                {"relative_error_vs_pancreas": "relative_error_vs_pancreas"} | {f"{a}_{b}_overlap_mm3": f"coalesce({a}_{b}_overlap_mm3, 0D)" for a, b in REGION_PAIRS}
            ),
        },
        "lesions": {"n_lesions": "coalesce(n_lesions, 0)", "total_volume_mm3": "coalesce(lesion_total_mm3, 0D)", "per_lesion": "per_lesion"},
        "quality_control": {
            "pancreas_mask_empty": "coalesce(pancreas_mm3, 0) = 0",
            "lesion_mask_empty": f"NOT ({lesion_here})",
            "total_overlap_rate_vs_lesion": "pancreas_total_rate",
            "lesion_annotation_evidence": struct(
                {
                    "status": f"CASE WHEN NOT ({usable}) THEN 'insufficient_evidence' WHEN {lesion_here} THEN 'lesion_present' ELSE 'confirmed_absent' END",
                    "selected_source": f"CASE WHEN {usable} THEN 'separate_lesion_mask' END",
                }
            ),
            "lesion_overlap_analysis": struct(
                {
                    "overlap_reference_used_for_qc": "overlap_reference",
                    "pancreas_total": rate("pancreas_total"),
                    "regions_union": rate("regions_union"),
                    "combined_pancreas": rate("combined_pancreas"),
                    "combined_filled_pancreas": rate("combined_filled"),
                    "hole_filling_changed_overlap": "coalesce(hole_filling_changed_overlap, false)",
                    "regions_added_overlap": "coalesce(regions_added_overlap, false)",
                }
            ),
        },
        "hu_statistics": {"ct_phase": fields["ct_phase"]} | {f: f for f in HU_FIELDS},
        "case_status": {
            "omit_from_training": "NOT image_readable",
            "error_type": "CASE WHEN NOT image_readable THEN 'image_read_error' END",
            "omit_reason": "CASE WHEN NOT image_readable THEN 'ct_image_unreadable' END",
            "error_stage": "CASE WHEN NOT image_readable THEN 'read_ct_image' END",
        },
    }
    return rows.withColumn("image_readable", F.coalesce("image_readable", F.lit(False))).selectExpr("case_id", *[f"{struct(b)} AS {name}" for name, b in blocks.items()])
