"""Case tables derived from the given order, customer and line-item tables.

No imaging data exists in this environment, so every case is computed from one
order by plain arithmetic.  The arithmetic is kept as SQL text that Spark and
any ANSI engine read alike, in layers, each a projection of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "k": "o_orderkey",
    "price": "o_totalprice",
    "cents": "coalesce(cents, 0)",
    "rq": "coalesce(rq, 0e0)",
    "segment": "c_mktsegment",
    "nation": "c_nationkey",
    "priority": "o_orderpriority",
}
LINE_TOTALS = {
    "cents": "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)",
    "rq": "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0e0 END)",
}
LAYER_1 = {
    "k": "k",
    "cents": "cents",
    "case_id": "concat('C', lpad(CAST(k AS STRING), 8, '0'))",
    "omitted": "k % 97 = 13",
    "error_type": "CASE WHEN k % 97 = 13 THEN CASE k % 3 WHEN 0 THEN 'file_not_found'"
    " WHEN 1 THEN 'image_read_error' ELSE 'non_orthonormal_direction_cosines' END END",
    "nz": "CASE WHEN k % 97 = 13 THEN NULL WHEN k % 211 = 5 THEN 8 ELSE 40 + k % 200 END",
    "sz": "CASE WHEN k % 97 = 13 THEN NULL WHEN k % 301 = 7 THEN 12e0 WHEN k % 53 = 4 THEN 4.5e0"
    " ELSE 1e0 + (k % 6) * 0.5e0 END",
    "pvol": "CASE WHEN k % 97 = 13 THEN NULL WHEN k % 29 = 0 THEN 0e0 ELSE price / 2 END",
    "grow": "CASE k % 20 WHEN 1 THEN 1.6e0 WHEN 2 THEN 1.3e0 WHEN 3 THEN 2.2e0 WHEN 4 THEN 1.2e0"
    " ELSE 1e0 + (k % 9) / 100e0 END",
    "lv0": "CASE WHEN k % 7 = 0 THEN 0e0 WHEN k % 31 = 0 THEN 5e0 WHEN k % 61 = 1 THEN 210000e0 ELSE 800 * rq END",
    "ov0": "CASE WHEN k % 5 < 3 THEN 0.8e0 + ((k * 37) % 21) / 100e0 ELSE ((k * 37) % 101) / 100e0 END",
    "sex": "CASE WHEN k % 10 = 0 THEN NULL WHEN k % 100 = 50 THEN '' WHEN k % 2 = 0 THEN 'F' ELSE 'M' END",
    "age": "CAST(CASE WHEN k % 25 = 1 THEN 0 WHEN k % 33 = 1 THEN NULL ELSE 20 + k % 70 END AS INT)",
    "phase": "CASE priority WHEN '1-URGENT' THEN 'Arterial' WHEN '2-HIGH' THEN 'Venous'"
    " WHEN '3-MEDIUM' THEN 'Portal' WHEN '5-LOW' THEN 'Delayed' END",
    "maker": "CASE WHEN k % 50 = 9 THEN NULL ELSE segment END",
    "site": "CASE WHEN k % 19 = 5 THEN NULL ELSE concat('N', CAST(nation AS STRING)) END",
    "tmed0": "CASE k % 173 WHEN 2 THEN 450e0 + (k % 4) * 100e0 WHEN 3 THEN -250e0 - (k % 4) * 100e0"
    " WHEN 4 THEN 0e0 ELSE (cents % 30000) / 100e0 - 100e0 END",
    "pmed0": "80e0 + k % 40",
    "pstd0": "CASE WHEN k % 67 = 3 THEN 0e0 ELSE 10e0 + k % 25 END",
}
LAYER_2 = {
    "*": "*",
    "p_empty": "CASE WHEN omitted THEN NULL ELSE k % 29 = 0 END",
    "has_box": "NOT omitted AND k % 29 <> 0",
    "head_v": "CASE WHEN omitted THEN NULL WHEN k % 19 = 0 OR k % 37 = 0 THEN 0e0 ELSE pvol * 0.4e0 * grow END",
    "body_v": "CASE WHEN omitted THEN NULL WHEN k % 190 = 1 OR k % 37 = 0 THEN 0e0 ELSE pvol * 0.35e0 * grow END",
    "tail_v": "CASE WHEN omitted THEN NULL WHEN k % 23 = 0 OR k % 37 = 0 THEN 0e0 ELSE pvol * 0.25e0 * grow END",
    "hb": "CASE WHEN omitted THEN NULL WHEN k % 11 = 0 THEN pvol * 0.01e0 ELSE 0e0 END",
    "ht": "CASE WHEN omitted THEN NULL WHEN k % 121 = 1 THEN pvol * 0.01e0 ELSE 0e0 END",
    "bt": "CASE WHEN omitted THEN NULL WHEN k % 26 = 0 THEN pvol * 0.01e0 ELSE 0e0 END",
    "lv": "CASE WHEN omitted THEN NULL ELSE lv0 END",
    "n_les": "CASE WHEN omitted THEN NULL WHEN lv0 = 0 THEN 0 ELSE CAST(1 + k % 3 AS INT) END",
    "l_empty": "CASE WHEN omitted THEN NULL ELSE lv0 = 0 END",
    "ann": "CASE WHEN omitted OR k % 43 = 2 THEN NULL WHEN k % 41 = 1 THEN 'insufficient_evidence'"
    " WHEN lv0 > 0 THEN 'lesion_present' ELSE 'confirmed_absent' END",
    "has_les": "NOT omitted AND lv0 > 0",
    "p_aff": "CASE WHEN omitted THEN NULL ELSE k % 83 = 6 END",
    "l_aff": "CASE WHEN omitted THEN NULL ELSE k % 89 = 7 END",
    "hole": "CASE WHEN omitted THEN NULL ELSE k % 17 = 4 END",
    "radd": "CASE WHEN omitted THEN NULL ELSE k % 18 = 5 END",
    "ref_key": "CASE WHEN omitted THEN NULL WHEN k % 2 = 0 THEN 'regions_union' ELSE 'combined_filled_pancreas' END",
}
LAYER_3 = {
    "*": "*",
    "zmin": "CASE WHEN has_box THEN 2 + k % 31 END",
    "zmax": "CASE WHEN has_box THEN greatest(2 + k % 31, nz - 3 - k % 37) END",
    "ymin": "CASE WHEN has_box THEN CASE WHEN k % 107 = 5 THEN 1 ELSE 100 + k % 50 END END",
    "ymax": "CASE WHEN has_box THEN CASE WHEN k % 109 = 6 THEN 510 ELSE 300 + k % 100 END END",
    "xmin": "CASE WHEN has_box THEN CASE WHEN k % 101 = 3 THEN 2 ELSE 120 END END",
    "xmax": "CASE WHEN has_box THEN CASE WHEN k % 103 = 4 THEN 511 ELSE 400 END END",
    "head_o": "head_v * CASE WHEN k % 15 = 0 THEN 0.5e0 ELSE 0.96e0 END",
    "body_o": "body_v * 0.96e0",
    "tail_o": "tail_v * 0.96e0",
    "r_regions": "CASE WHEN has_les AND k % 47 <> 3 THEN ov0 END",
    "r_filled": "CASE WHEN has_les AND k % 47 <> 3 THEN least(1e0, ov0 + 0.02e0) END",
    "r_total": "CASE WHEN has_les AND k % 94 <> 3 THEN ov0 END",
    "les_h": "CASE WHEN has_les THEN 10e0 * (k % 4) ELSE 0e0 END",
    "les_b": "CASE WHEN has_les THEN 5e0 * (k % 3) ELSE 0e0 END",
    "les_t": "CASE WHEN has_les THEN 2e0 * (k % 5) ELSE 0e0 END",
    "hu_status": "CASE WHEN omitted THEN NULL WHEN has_les THEN 'full' WHEN k % 29 <> 0 THEN"
    " 'pancreas_only_negative_case' ELSE 'no_pancreas_no_lesion_negative_case' END",
    "tmed": "CASE WHEN has_les THEN tmed0 END",
    "tmean": "CASE WHEN has_les THEN tmed0 + k % 9 - 4 END",
    "tstd": "CASE WHEN has_les THEN 20e0 + k % 30 END",
    "tcount": "CASE WHEN has_les THEN 5 + k % 400 END",
    "pmed": "CASE WHEN has_box THEN pmed0 END",
    "pstd": "CASE WHEN has_box THEN pstd0 END",
    "pcount": "CASE WHEN has_box THEN 40 + k % 900 END",
    "paired": "has_les AND has_box",
    "delta0": "round(tmed0 - pmed0, 2)",
}
LAYER_4 = {
    "*": "*",
    "delta": "CASE WHEN paired THEN delta0 END",
    "z": "CASE WHEN paired AND pstd0 > 0 THEN delta0 / pstd0 END",
    "datt": "CASE WHEN has_les THEN CASE WHEN NOT has_box THEN 'Unknown' WHEN delta0 < -10 THEN 'Hypo'"
    " WHEN delta0 > 10 THEN 'Hyper' ELSE 'Iso' END WHEN omitted THEN 'Unknown' ELSE 'Not applicable' END",
    "susp": "has_les AND k % 59 = 8",
}
LAYER_5 = {
    "*": "*",
    "att": "CASE WHEN z IS NULL THEN datt WHEN z < -2 THEN 'Hypo' WHEN z > 2 THEN 'Hyper' ELSE 'Iso' END",
    "rule": "CASE WHEN z IS NOT NULL THEN 'z_score' WHEN paired THEN 'delta_hu_fallback' WHEN has_les OR omitted"
    " THEN 'unknown' ELSE 'not_applicable_negative_case' END",
}
LAYER_6 = {"*": "*", "disag": "coalesce(att <> datt, false)"}
LAYERS = (LAYER_1, LAYER_2, LAYER_3, LAYER_4, LAYER_5, LAYER_6)


def _project(df: DataFrame, layer: dict[str, str]) -> DataFrame:
    items = [f"{sql} AS {name}" for name, sql in layer.items() if name != "*"]
    return df.selectExpr(*(["*"] if "*" in layer else []), *items)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """Rows dealt out by key before narrow columns are widened to whole cases."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)


def case_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat case columns, one row per order."""
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(*[F.expr(sql).alias(name) for name, sql in LINE_TOTALS.items()])
    )
    orders = dealt(read_table(spark, sf_dir, "orders"))
    customers = read_table(spark, sf_dir, "customer")
    df = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
        customers, F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    df = _project(df, BASE)
    for layer in LAYERS:
        df = _project(df, layer)
    return df


def _region(name: str):
    return F.struct(F.col(f"{name}_v").alias("volume_mm3"), F.col(f"{name}_o").alias("overlap_with_pancreas_mm3"))


def nest_cases(flat: DataFrame) -> DataFrame:
    """Flat case columns as the nested case-summary contract."""
    c = F.col
    lesion = F.struct(
        *[
            F.struct(c(f"les_{r[0]}").alias("volume_mm3")).alias(r)
            for r in ("head", "body", "tail")
        ]
    )
    box = F.when(
        c("zmin").isNotNull(),
        F.array(F.array("zmin", "ymin", "xmin"), F.array("zmax", "ymax", "xmax")).cast("array<array<int>>"),
    )
    return flat.select(
        "k",
        "case_id",
        F.struct(
            F.when(c("nz").isNotNull(), F.array(c("nz"), F.lit(512), F.lit(512)).cast("array<int>")).alias("shape_zyx"),
            F.when(c("sz").isNotNull(), F.array(F.lit(0.8), F.lit(0.8), c("sz"))).alias("spacing_xyz_mm"),
        ).alias("image"),
        F.struct(
            c("sex"),
            c("age"),
            c("phase").alias("ct_phase"),
            c("maker").alias("manufacturer"),
            c("site").alias("site_nationality"),
        ).alias("metadata"),
        F.struct(
            F.struct(
                c("p_aff").alias("pancreas_affine_mismatch"),
                c("l_aff").alias("lesion_affine_mismatch"),
                (c("p_aff") | c("l_aff")).alias("any_affine_mismatch"),
            ).alias("summary")
        ).alias("geometry"),
        F.struct(
            c("pvol").alias("volume_mm3"),
            box.alias("bounding_box_zyx"),
            F.struct(_region("head").alias("head"), _region("body").alias("body"), _region("tail").alias("tail")).alias(
                "regions"
            ),
            F.struct(
                F.when(
                    c("pvol") != 0,
                    F.abs(c("head_v") + c("body_v") + c("tail_v") - c("pvol")) / c("pvol"),
                ).alias("relative_error_vs_pancreas"),
                c("hb").alias("head_body_overlap_mm3"),
                c("ht").alias("head_tail_overlap_mm3"),
                c("bt").alias("body_tail_overlap_mm3"),
            ).alias("region_consistency"),
        ).alias("pancreas"),
        F.struct(
            c("n_les").alias("n_lesions"),
            c("lv").alias("total_volume_mm3"),
            F.when(
                c("n_les") > 0,
                F.transform(
                    F.sequence(F.lit(1), c("n_les")),
                    lambda i: F.struct(i.alias("lesion_id"), lesion.alias("overlap_with_regions")),
                ),
            ).alias("per_lesion"),
        ).alias("lesions"),
        F.struct(
            c("p_empty").alias("pancreas_mask_empty"),
            c("l_empty").alias("lesion_mask_empty"),
            c("r_total").alias("total_overlap_rate_vs_lesion"),
            F.struct(
                c("ann").alias("status"),
                F.when(c("ann").isin("lesion_present", "confirmed_absent"), F.lit("separate_lesion_mask")).alias(
                    "selected_source"
                ),
            ).alias("lesion_annotation_evidence"),
            F.struct(
                c("ref_key").alias("overlap_reference_used_for_qc"),
                F.struct(c("r_total").alias("overlap_rate_vs_lesion")).alias("pancreas_total"),
                F.struct(c("r_regions").alias("overlap_rate_vs_lesion")).alias("regions_union"),
                F.struct(c("r_total").alias("overlap_rate_vs_lesion")).alias("combined_pancreas"),
                F.struct(c("r_filled").alias("overlap_rate_vs_lesion")).alias("combined_filled_pancreas"),
                c("hole").alias("hole_filling_changed_overlap"),
                c("radd").alias("regions_added_overlap"),
            ).alias("lesion_overlap_analysis"),
        ).alias("quality_control"),
        F.struct(
            c("phase").alias("ct_phase"),
            c("hu_status").alias("hu_statistics_status"),
            c("tmean").alias("tumor_mean_hu"),
            c("tmed").alias("tumor_median_hu"),
            c("tstd").alias("tumor_std_hu"),
            c("tcount").alias("tumor_voxel_count"),
            c("pmed").alias("pancreas_median_hu"),
            c("pstd").alias("pancreas_std_hu"),
            c("pcount").alias("pancreas_voxel_count"),
            c("delta").alias("delta_hu_tumor_vs_pancreas"),
            c("z").alias("z_score_hu"),
            c("att").alias("tumor_attenuation"),
            c("rule").alias("attenuation_rule_used"),
            c("datt").alias("delta_hu_attenuation"),
            c("disag").alias("attenuation_rule_disagreement"),
            c("susp").alias("suspicious_hu_distribution"),
        ).alias("hu_statistics"),
        F.struct(
            c("omitted").alias("omit_from_training"),
            c("error_type"),
            F.when(
                c("omitted"),
                F.when(c("error_type") == "file_not_found", "ct_image_missing")
                .when(c("error_type") == "image_read_error", "ct_image_unreadable")
                .otherwise("invalid_ct_geometry"),
            ).alias("omit_reason"),
            F.when(c("omitted"), F.lit("read_ct_image")).alias("error_stage"),
        ).alias("case_status"),
    )


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_cases(case_columns(spark, sf_dir))
