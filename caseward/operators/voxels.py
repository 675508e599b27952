"""Measurements of sparse voxel masks.

``voxels`` has one row per cell that belongs to some mask: case_id, z, y, x, hu
and the label values pancreas, lesion, head, body, tail (0 is background).
``geometry`` has one row per case and resource.  All measures that are sums over
cells come from one conditional aggregate per case, combined map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseward.config import (
    GEOMETRY_RTOL,
    GEOMETRY_TOLERANCES,
    MIN_PANCREAS_VOXELS,
    MIN_TUMOR_VOXELS,
    ORTHONORMALITY_LIMIT,
    REGION_PAIRS,
    REGIONS,
)
from caseward.functions.batches import changes, whole_groups
from caseward.functions.sql import case, lit, project
from caseward.operators.components import AXES, TILE, TILES, enclosed_cells, in_tiles, label_components, number_components, surrounded, with_halo
from caseward.sources.shared import stored

MASKS = ("pancreas", "lesion", "head", "body", "tail")
REGION_UNION = "(head > 0 OR body > 0 OR tail > 0)"
COMBINED = f"(pancreas > 0 OR {REGION_UNION})"


def direction_metrics(geometry: DataFrame) -> DataFrame:
    """Orthogonality error, determinant and column norms of the direction matrix (G1)."""
    r = [[f"direction[{3 * i + j}]" for j in range(3)] for i in range(3)]
    gram = lambda a, b: "(" + " + ".join(f"{r[k][a]} * {r[k][b]}" for k in range(3)) + ")"
    error = " + ".join(
        f"pow({gram(a, b)} - {1 if a == b else 0}, 2)" for a in range(3) for b in range(3)
    )
    det = (
        f"{r[0][0]} * ({r[1][1]} * {r[2][2]} - {r[1][2]} * {r[2][1]})"
        f" - {r[0][1]} * ({r[1][0]} * {r[2][2]} - {r[1][2]} * {r[2][0]})"
        f" + {r[0][2]} * ({r[1][0]} * {r[2][1]} - {r[1][1]} * {r[2][0]})"
    )
    df = project(geometry, {"__error": f"sqrt({error})"}, ["case_id", "resource", "direction"])
    return project(
        df,
        {
            "orthogonality_error": "bround(__error, 8)",
            "determinant": f"bround({det}, 8)",
            **{f"axis_norm_{a}": f"bround(sqrt({gram(i, i)}), 6)" for i, a in enumerate("xyz")},
            "non_orthonormal": f"__error > {lit(ORTHONORMALITY_LIMIT)}",
        },
        ["case_id", "resource"],
    )


def close(kind: str, n: int) -> str:
    """Element-wise tolerance test; the relative part scales with the mask value."""
    atol = GEOMETRY_TOLERANCES[kind]
    name = kind if kind == "direction" else f"{kind}_xyz"
    return " AND ".join(
        f"abs(i_{name}[{i}] - m_{name}[{i}]) <= {lit(atol)} + {lit(GEOMETRY_RTOL)} * abs(m_{name}[{i}])" for i in range(n)
    )


def compare_geometry(geometry: DataFrame) -> DataFrame:
    """Do the masks lie on the image grid (G2)?  Four tests and their conjunction."""
    fields = ("size_xyz", "spacing_xyz", "origin_xyz", "direction")
    image = geometry.filter("resource = 'image'").select("case_id", *[F.col(f).alias(f"i_{f}") for f in fields])
    masks = geometry.filter("resource <> 'image' AND exists AND readable").select(
        "case_id", "resource", *[F.col(f).alias(f"m_{f}") for f in fields]
    )
    df = masks.join(image, "case_id")
    df = project(
        df,
        {
            "size_match": "i_size_xyz = m_size_xyz",
            "spacing_match": close("spacing", 3),
            "origin_match": close("origin", 3),
            "direction_match": close("direction", 9),
        },
        ["case_id", "resource"],
    )
    return project(df, {"affine_match": "size_match AND spacing_match AND origin_match AND direction_match"})


def image_grid(geometry: DataFrame) -> DataFrame:
    """Per case: voxel volume (G3), spacing, origin and direction of the image."""
    return geometry.filter("resource = 'image'").selectExpr(
        "case_id",
        "aggregate(spacing_xyz, 1D, (a, s) -> a * s) AS voxel_mm3",
        "spacing_xyz",
        "origin_xyz",
        "direction",
    )


def world(centroid: tuple[str, str, str]) -> dict[str, str]:
    """World coordinates of a (z, y, x) centroid."""
    z, y, x = centroid
    index = (x, y, z)
    return {
        f"world_{a}": "bround(origin_xyz[{i}] + {terms}, 4)".format(
            i=i, terms=" + ".join(f"direction[{3 * i + j}] * {index[j]} * spacing_xyz[{j}]" for j in range(3))
        )
        for i, a in enumerate("xyz")
    }


def mask_statistics(voxels: DataFrame, geometry: DataFrame) -> DataFrame:
    """Volume, centroid, bounding box and overlaps of every mask, one row per case.

    One scan, one map-side combined aggregate.  Volumes sum the label values,
    overlaps count positive cells, as the measured behaviour asks for.
    """
    aggregates = []
    for m in MASKS:
        inside = f"CASE WHEN {m} > 0 THEN {{}} END"
        aggregates.append(F.expr(f"sum({m})").alias(f"{m}_sum"))
        aggregates.append(F.expr(f"count_if({m} > 0)").alias(f"{m}_n"))
        for a in AXES:
            cell = inside.format(a)
            aggregates.append(F.expr(f"avg({cell})").alias(f"{m}_c{a}"))
            aggregates.append(F.expr(f"min({cell})").alias(f"{m}_{a}min"))
            aggregates.append(F.expr(f"max({cell})").alias(f"{m}_{a}max"))
    for a, b in REGION_PAIRS:
        aggregates.append(F.expr(f"count_if({a} > 0 AND {b} > 0)").alias(f"{a}_{b}_n"))
    for r in REGIONS:
        aggregates.append(F.expr(f"count_if({r} > 0 AND pancreas > 0)").alias(f"{r}_pancreas_n"))
    aggregates += [
        F.expr("count_if(lesion > 0 AND pancreas > 0)").alias("lesion_pancreas_n"),
        F.expr(f"count_if(lesion > 0 AND {REGION_UNION})").alias("lesion_regions_n"),
        F.expr(f"count_if(lesion > 0 AND {COMBINED})").alias("lesion_combined_n"),
    ]
    sums = voxels.groupBy("case_id").agg(*aggregates)
    # The grid table has one row per case; Spark broadcasts it only while it is small.
    return sums.join(image_grid(geometry), "case_id")


def volume(name: str) -> str:
    return f"bround({name} * voxel_mm3, 4)"


def rate(numerator: str, denominator: str) -> str:
    """Rate with six digits, null for a zero denominator."""
    return f"bround({numerator} / nullif({denominator}, 0), 6)"


def mask_table(stats: DataFrame) -> DataFrame:
    """One row per case and mask: volume, centroid, world centroid, bounding box."""
    rows = []
    for m in MASKS:
        fields = {
            "mask": lit(m),
            "volume_mm3": volume(f"{m}_sum"),
            **{f"centroid_{a}": f"bround({m}_c{a}, 4)" for a in AXES},
            **{f"{a}_{e}": f"{m}_{a}{e}" for a in AXES for e in ("min", "max")},
        }
        rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
    df = stats.selectExpr(
        "case_id", "spacing_xyz", "origin_xyz", "direction", f"explode(array({', '.join(rows)})) AS m"
    ).select("case_id", "spacing_xyz", "origin_xyz", "direction", "m.*")
    own = [c for c in df.columns if c not in ("spacing_xyz", "origin_xyz", "direction")]
    return project(df, world(("centroid_z", "centroid_y", "centroid_x")), own)


def region_consistency(stats: DataFrame) -> DataFrame:
    """Region sum, relative error, pair overlaps, coverage and status per case."""
    vol = {m: volume(f"{m}_sum") for m in MASKS}
    df = project(
        stats,
        {
            "pancreas_mm3": vol["pancreas"],
            **{f"{r}_mm3": vol[r] for r in REGIONS},
            **{f"{r}_overlap_mm3": volume(f"{r}_pancreas_n") for r in REGIONS},
            **{f"{a}_{b}_overlap_mm3": volume(f"{a}_{b}_n") for a, b in REGION_PAIRS},
        },
        ["case_id"],
    )
    df = project(df, {"region_sum": "(head_mm3 + body_mm3 + tail_mm3)"})
    return project(
        df,
        {
            **{f"{r}_rate_vs_pancreas": rate(f"{r}_overlap_mm3", "pancreas_mm3") for r in REGIONS},
            "sum_regions_mm3": "bround(region_sum, 4)",
            "relative_error_vs_pancreas": rate("abs(region_sum - pancreas_mm3)", "pancreas_mm3"),
            "region_coverage_ratio": f"CASE WHEN region_sum > 0 THEN {rate('region_sum', 'pancreas_mm3')} END",
            "subregion_status": "CASE WHEN region_sum > 0 THEN 'present' ELSE 'warning' END",
        },
        [c for c in df.columns if c != "region_sum"],
    )


def lesion_components(voxels: DataFrame, tile: int = 32) -> DataFrame:
    """Lesion cells with component root."""
    return label_components(voxels.filter("lesion > 0").select("case_id", *AXES), tile)


def per_lesion(voxels: DataFrame, geometry: DataFrame, tile: int = 32, stats: DataFrame | None = None) -> DataFrame:
    """Volume, centroid, overlaps and dominant region of every lesion component.

    ``stats``: ``mask_statistics`` of the same tables, where already measured.
    """
    flags = {"in_support": COMBINED, **{f"in_{r}": f"{r} > 0" for r in REGIONS}}
    lesion = voxels.filter("lesion > 0").selectExpr("case_id", *AXES, *[f"{sql} AS {name}" for name, sql in flags.items()])
    labelled = label_components(lesion, tile, tuple(flags))
    # One row per lesion, stored: its sums and its number.
    sums = stored(
        labelled.groupBy("case_id", "root").agg(
            F.count("*").alias("n"),
            *[F.avg(a).alias(f"c{a}") for a in AXES],
            F.expr("count_if(in_support)").alias("n_pancreas"),
            *[F.expr(f"count_if(in_{r})").alias(f"n_{r}") for r in REGIONS],
        ),
        "lesions",
    )
    if stats is None:
        stats = mask_statistics(voxels, geometry)
    cases = stats.select("case_id", "voxel_mm3", "spacing_xyz", "origin_xyz", "direction", F.col("pancreas_sum").alias("organ"))
    df = sums.join(number_components(sums), ["case_id", "root"]).join(cases, "case_id")
    df = project(
        df,
        {
            "volume_mm3": volume("n"),
            **{f"centroid_{a}": f"bround(c{a}, 4)" for a in AXES},
            "overlap_with_pancreas_mm3": volume("n_pancreas"),
            **{f"{r}_mm3": volume(f"n_{r}") for r in REGIONS},
            "organ_mm3": volume("organ"),
        },
        ["case_id", "lesion_id", "spacing_xyz", "origin_xyz", "direction", "n", "n_pancreas", "organ", "voxel_mm3"]
        + [f"n_{r}" for r in REGIONS]
        + [f"c{a}" for a in AXES],
    )
    top = "greatest(head_mm3, body_mm3, tail_mm3)"
    return project(
        df,
        {
            **world(("centroid_z", "centroid_y", "centroid_x")),
            "overlap_rate_vs_lesion": rate("overlap_with_pancreas_mm3", "volume_mm3"),
            "overlap_rate_vs_pancreas": rate("overlap_with_pancreas_mm3", "organ_mm3"),
            **{f"{r}_rate_vs_lesion": rate(f"{r}_mm3", "volume_mm3") for r in REGIONS},
            "dominant_region": case(
                [(f"{top} = 0", "NULL"), *[(f"{r}_mm3 = {top}", lit(r)) for r in REGIONS]]
            ),
        },
        ["case_id", "lesion_id", "volume_mm3", "centroid_z", "centroid_y", "centroid_x", "overlap_with_pancreas_mm3"]
        + [f"{r}_mm3" for r in REGIONS],
    )


def filled_support(voxels: DataFrame, tile: int = 32) -> DataFrame:
    """Enclosed background cells of the combined support."""
    return enclosed_cells(voxels.filter(COMBINED).select("case_id", *AXES), tile)


def overlap_analysis(
    voxels: DataFrame, geometry: DataFrame, subregions: bool = True, tile: int = 32, stats: DataFrame | None = None
) -> DataFrame:
    """Lesion overlap with four supports and the two gain flags.

    Regions are available when a region mask was loaded, even an empty one: the
    geometry rows tell, not the voxels.  ``stats``: ``mask_statistics`` of the same
    tables, where already measured.
    """
    if stats is None:
        stats = mask_statistics(voxels, geometry)
    loaded = geometry.filter(F.col("resource").isin(*REGIONS) & F.col("exists") & F.col("readable"))
    loaded = loaded.groupBy("case_id").agg(F.count("*").alias("n_region_masks"))
    # Only lesion cells outside the combined support can gain from filled holes.
    outside = voxels.filter(f"lesion > 0 AND NOT {COMBINED}").select("case_id", *AXES)
    gained = (
        outside.join(filled_support(voxels, tile), ["case_id", *AXES], "left_semi")
        .groupBy("case_id")
        .agg(F.count("*").alias("gained_n"))
    )
    df = stats.join(gained, "case_id", "left").join(loaded, "case_id", "left")
    df = project(
        df,
        {
            "lesion_mm3": volume("lesion_n"),
            "pancreas_total_mm3": volume("lesion_pancreas_n"),
            "regions_union_mm3": volume("lesion_regions_n"),
            "combined_pancreas_mm3": volume("lesion_combined_n"),
            "combined_filled_mm3": volume("(lesion_combined_n + coalesce(gained_n, 0))"),
            "regions_available": "coalesce(n_region_masks, 0) > 0" if subregions else "false",
        },
        ["case_id"],
    )
    supports = ("pancreas_total", "regions_union", "combined_pancreas", "combined_filled")
    df = project(df, {f"{s}_rate": rate(f"{s}_mm3", "lesion_mm3") for s in supports})
    return project(
        df,
        {
            "overlap_reference": "CASE WHEN regions_available THEN 'regions_union' ELSE 'combined_filled_pancreas' END",
            "hole_filling_changed_overlap": "coalesce(combined_filled_rate, 0) - coalesce(combined_pancreas_rate, 0) > 0.1D",
            "regions_added_overlap": "regions_available AND coalesce(combined_pancreas_rate, 0)"
            " - coalesce(pancreas_total_rate, 0) > 0.1D",
        },
    )


# -- attenuation -----------------------------------------------------------------------------
QUANTILES = ((5, "p05"), (25, "p25"), (50, "median"), (75, "p75"), (95, "p95"))


def hu_histogram(voxels: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells per case and HU value, for tumour, organ without tumour and its eroded core.

    Tiles with a halo of organ cells erode and count on their own: one shuffle of
    the voxels, none of the counts but their sums.  CT stores at most 16 bits per
    voxel, so a case has at most 65,536 values and everything after this aggregate is
    independent of the number of voxels.
    """
    counts = ["n_tumor", "n_organ", "n_core"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, TILES):
            tile = np.cumsum(changes(rows, TILES)) - 1
            organ = rows.column("n_organ").to_numpy() > 0
            core = np.zeros(rows.num_rows, np.int64)
            core[organ] = surrounded(np.stack([rows.column(a).to_numpy()[organ] for a in AXES], axis=1).astype(np.int64), tile[organ])
            table = pa.Table.from_batches([rows.select(["case_id", "hu", "n_tumor", "n_organ"]).append_column("n_core", pa.array(core)).filter(rows.column("own"))])
            sums = table.group_by(["case_id", "hu"]).aggregate([(c, "sum") for c in counts])
            for batch in sums.select(["case_id", "hu", *[f"{c}_sum" for c in counts]]).rename_columns(["case_id", "hu", *counts]).to_batches():
                yield batch

    cells = voxels.selectExpr(
        "case_id",
        *[f"CAST({a} AS INT) AS {a}" for a in AXES],
        "hu",
        "CAST(lesion > 0 AS BIGINT) AS n_tumor",
        "CAST(pancreas > 0 AND NOT lesion > 0 AS BIGINT) AS n_organ",
    ).na.fill(0, ["n_tumor", "n_organ"])
    dealt = in_tiles(with_halo(cells.filter("hu IS NOT NULL OR n_organ > 0"), "n_organ > 0", tile))
    parts = dealt.mapInArrow(run, f"case_id string, hu {dict(voxels.dtypes)['hu']}, n_tumor bigint, n_organ bigint, n_core bigint")
    return parts.groupBy("case_id", "hu").agg(*[F.sum(c).alias(c) for c in counts])


def _weighted(prefix: str, count: str) -> list:
    """Count, mean, population deviation and percentiles of a weighted histogram."""
    used = f"CASE WHEN {count} > 0 THEN {count} END"
    value = f"CASE WHEN {count} > 0 THEN hu END"
    shares = ", ".join(f"{p / 100}D" for p, _ in QUANTILES)
    return [
        F.expr(f"coalesce(sum({used}), 0)").alias(f"{prefix}_n"),
        F.expr(f"sum({used} * CAST(hu AS DOUBLE))").alias(f"{prefix}_s1"),
        F.expr(f"sum({used} * CAST(hu AS DOUBLE) * hu)").alias(f"{prefix}_s2"),
        F.expr(f"percentile({value}, array({shares}), coalesce({count}, 0))").alias(f"{prefix}_q"),
    ]


def _described(prefix: str, name: str) -> dict[str, str]:
    n, s1, s2 = f"{prefix}_n", f"{prefix}_s1", f"{prefix}_s2"
    return {
        f"{name}_voxel_count": f"nullif({n}, 0)",
        f"{name}_mean_hu": f"bround({s1} / {n}, 2)",
        f"{name}_std_hu": f"CASE WHEN {n} > 0 THEN"
        f" bround(sqrt(greatest(0D, {s2} / {n} - ({s1} / {n}) * ({s1} / {n}))), 2) END",
        **{f"{name}_{label}_hu": f"bround({prefix}_q[{i}], 2)" for i, (_, label) in enumerate(QUANTILES)},
    }


def hu_statistics(voxels: DataFrame, tile: int = TILE) -> DataFrame:
    """Robust HU statistics, attenuation class and suspicion per case."""
    # A case has at most 65,536 rows here: one shuffle by case serves all steps.
    case_rows = Window.partitionBy("case_id")
    histogram = hu_histogram(voxels, tile).filter("case_id IS NOT NULL")
    # The eroded core serves when large enough, else the whole organ without tumour.
    chosen = histogram.withColumn("core", F.sum("n_core").over(case_rows)).selectExpr(
        "case_id",
        "hu",
        "n_tumor",
        f"CASE WHEN core >= {MIN_PANCREAS_VOXELS} THEN n_core ELSE n_organ END AS n_ref",
    )
    bounds = F.expr("percentile(CASE WHEN n_ref > 0 THEN hu END, array(0.05D, 0.95D), n_ref)").over(case_rows)
    clipped = chosen.withColumn("b", bounds).selectExpr(
        "case_id", "hu", "n_tumor", "n_ref", "CASE WHEN hu BETWEEN b[0] AND b[1] THEN n_ref ELSE 0 END AS n_clip"
    )
    sums = clipped.groupBy("case_id").agg(
        *_weighted("t", "n_tumor"), *_weighted("r", "n_ref"), *_weighted("c", "n_clip")
    )
    use = f"c_n >= {MIN_PANCREAS_VOXELS}"
    picked = {f"p_{k}": f"CASE WHEN {use} THEN c_{k} ELSE r_{k} END" for k in ("n", "s1", "s2", "q")}
    df = project(sums, picked, ["case_id", "t_n", "t_s1", "t_s2", "t_q"])
    df = project(df, {**_described("t", "tumor"), **_described("p", "pancreas")}, ["case_id", "t_n", "p_n"])
    return classify_attenuation(df)


def classify_attenuation(stats: DataFrame) -> DataFrame:
    """Status, delta, z-score, labels and suspicion from the statistics."""
    df = project(stats, {"full": "t_n > 0", "paired": "t_n > 0 AND p_n > 0"})
    df = project(df, {"delta": "CASE WHEN paired THEN bround(tumor_median_hu - pancreas_median_hu, 2) END"})
    df = project(
        df,
        {
            "z_valid": "paired AND pancreas_std_hu > 0.001D AND pancreas_std_hu < 200",
            "delta_label": case([("delta < -10", "'Hypo'"), ("delta > 10", "'Hyper'")], "'Iso'"),
        },
    )
    df = project(df, {"z": "CASE WHEN z_valid THEN bround(delta / pancreas_std_hu, 4) END"})
    df = project(df, {"z_label": case([("z < -2", "'Hypo'"), ("z > 2", "'Hyper'")], "'Iso'")})
    names = [c for c in stats.columns if c not in ("t_n", "p_n")]
    return project(
        df,
        {
            "hu_statistics_status": case(
                [("full", "'full'"), ("p_n > 0", "'pancreas_only_negative_case'")],
                "'no_pancreas_no_lesion_negative_case'",
            ),
            "delta_hu_tumor_vs_pancreas": "delta",
            "z_score_hu": "z",
            "tumor_attenuation": case(
                [
                    ("NOT full", "'Not applicable'"),
                    ("NOT paired", "'Unknown'"),
                    ("z_valid", "z_label"),
                ],
                "delta_label",
            ),
            "attenuation_rule_used": case(
                [
                    ("NOT full", "'not_applicable_negative_case'"),
                    ("NOT paired", "'unknown'"),
                    ("z_valid", "'z_score'"),
                ],
                "'delta_hu_fallback'",
            ),
            "delta_hu_attenuation": case(
                [("NOT full", "'Not applicable'"), ("NOT paired", "'Unknown'")], "delta_label"
            ),
            "attenuation_rule_disagreement": "z_valid AND z_label <> delta_label",
            "suspicious_hu_distribution": case(
                [
                    ("NOT full", "false"),
                    ("NOT paired", "true"),
                ],
                f"t_n < {MIN_TUMOR_VOXELS} OR p_n < {MIN_PANCREAS_VOXELS} OR NOT z_valid"
                " OR abs(tumor_mean_hu - tumor_median_hu) > 50",
            ),
        },
        names,
    )


def summarize(cases: DataFrame, voxels: DataFrame, geometry: DataFrame, tile: int = 32) -> DataFrame:
    """One row per known case with all measured blocks.

    ``cases`` lists (case_id, image_readable, ...); cases without voxels keep
    their row with null measures, so the row count is preserved.
    """
    regions = region_consistency(mask_statistics(voxels, geometry))
    overlaps = overlap_analysis(voxels, geometry, tile=tile)
    lesions = number_components(lesion_components(voxels, tile)).groupBy("case_id").agg(
        F.max("lesion_id").alias("n_lesions")
    )
    attenuation = hu_statistics(voxels)
    out = cases
    for part in (regions, overlaps, lesions, attenuation):
        out = out.join(part, "case_id", "left")
    return out.withColumn("n_lesions", F.coalesce("n_lesions", F.lit(0)))
