"""Task modes: which parts of a case a task looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseward.config import REGIONS
from caseward.functions.scalar import any_of, or_zero


def _null_fields(struct: str, names: list[str], df: DataFrame) -> Column:
    """Copy of a struct column with some fields set to null, types kept."""
    fields = df.schema[struct].dataType
    out = F.col(struct)
    for name in names:
        if name in fields.names:
            out = out.withField(name, F.lit(None).cast(fields[name].dataType))
    return out


def restrict_to_task(cases: DataFrame, task_mode: str) -> DataFrame:
    """Null what the task does not measure (G21); decided at plan time."""
    if task_mode == "pancreas_lesion_subregions":
        return cases
    out = cases.withColumn("pancreas", _null_fields("pancreas", ["regions", "region_consistency"], cases))
    if task_mode == "pancreas_lesion":
        analysis = F.col("quality_control.lesion_overlap_analysis").withField(
            "overlap_reference_used_for_qc",
            F.when(
                F.col("quality_control.lesion_overlap_analysis.overlap_reference_used_for_qc").isNotNull(),
                F.lit("combined_filled_pancreas"),
            ),
        )
        return out.withColumn(
            "quality_control", F.col("quality_control").withField("lesion_overlap_analysis", analysis)
        )
    has_organ = or_zero(F.col("pancreas.volume_mm3")) > 0
    omitted = F.coalesce(F.col("case_status.omit_from_training"), F.lit(False))
    tumor = [n for n in cases.schema["hu_statistics"].dataType.names if n.startswith("tumor_")]
    hu = _null_fields("hu_statistics", tumor + ["delta_hu_tumor_vs_pancreas", "z_score_hu"], cases)
    label = F.when(omitted, F.lit("Unknown")).otherwise(F.lit("Not applicable"))
    hu = (
        hu.withField(
            "hu_statistics_status",
            F.when(omitted, F.lit(None))
            .when(has_organ, F.lit("pancreas_only_negative_case"))
            .otherwise(F.lit("no_pancreas_no_lesion_negative_case")),
        )
        .withField("tumor_attenuation", label)
        .withField("delta_hu_attenuation", label)
        .withField(
            "attenuation_rule_used",
            F.when(omitted, F.lit("unknown")).otherwise(F.lit("not_applicable_negative_case")),
        )
        .withField("attenuation_rule_disagreement", F.lit(False))
        .withField("suspicious_hu_distribution", F.lit(False))
    )
    lesion_quality = [
        "lesion_mask_empty",
        "lesion_pancreas_overlap_exists",
        "total_overlap_lesion_pancreas_mm3",
        "total_overlap_rate_vs_lesion",
        "total_overlap_rate_vs_pancreas",
        "lesion_mask_affine_mismatch",
        "lesion_annotation_evidence",
        "lesion_overlap_analysis",
    ]
    # The lesion mask is not loaded, so its geometry cannot mismatch either.
    affine = F.col("geometry.summary").withField(
        "lesion_affine_mismatch", F.when(omitted, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    ).withField("any_affine_mismatch", F.col("geometry.summary.pancreas_affine_mismatch"))
    return (
        out.withColumn("lesions", _null_fields("lesions", ["n_lesions", "total_volume_mm3", "per_lesion"], cases))
        .withColumn("quality_control", _null_fields("quality_control", lesion_quality, cases))
        .withColumn("hu_statistics", hu)
        .withColumn("geometry", F.col("geometry").withField("summary", affine))
    )


def subregions_found() -> Column:
    return any_of([or_zero(F.col(f"pancreas.regions.{r}.volume_mm3")) > 0 for r in REGIONS])


def task_mode_evidence(cases: DataFrame) -> DataFrame:
    """One row: organ cases, organ cases with sub-regions and the detected mode."""
    organ = or_zero(F.col("pancreas.volume_mm3")) > 0
    counts = cases.agg(
        F.count_if(organ).alias("n_pancreas"),
        F.count_if(organ & subregions_found()).alias("n_subregions"),
    )
    detected = F.when(
        (F.col("n_pancreas") > 0) & (F.col("n_subregions") / F.col("n_pancreas") >= 0.01),
        "pancreas_lesion_subregions",
    ).otherwise("pancreas_lesion")
    return counts.withColumn("task_mode", detected)


def detect_task_mode(cases: DataFrame) -> str:
    """Detected mode as a plan-time literal: one two-count aggregate, one row."""
    return task_mode_evidence(cases).first()["task_mode"]


# What the legacy switch stands for.
LEGACY_MODES = {True: "pancreas_lesion_subregions", False: "pancreas_lesion"}


def effective_task_mode(thresholds: dict, cases: DataFrame | None = None) -> str:
    """The task mode of a run.

    The legacy switch is only a default for a mode that is not configured; ``auto``,
    or neither of them, asks the cases, and the full task stands where there are none.
    """
    switch = {"TASK_MODE": LEGACY_MODES[bool(thresholds["REQUIRE_SUBREGIONS"])]} if "REQUIRE_SUBREGIONS" in thresholds else {}
    named = str({"TASK_MODE": "auto", **switch, **thresholds}["TASK_MODE"]).strip().lower()
    if named != "auto":
        return named
    return LEGACY_MODES[True] if cases is None else detect_task_mode(cases)
