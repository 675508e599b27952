"""Dataset overviews and named case filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseward.config import FLAG_DOMAINS
from caseward.functions.sql import compact, lit

# Tags of each issue group.
ISSUE_GROUPS = {
    "empty_pancreas": ("pancreas_mask_empty",),
    "lesion_overlap": ("lesion_outside_pancreas", "lesion_partial_outside", "lesion_overlap_critical_fail"),
    "region_sum": ("region_sum_error_critical", "region_sum_error_warning"),
    "missing_region": ("head_region_empty", "body_region_empty", "tail_region_empty"),
    "pancreas_volume": ("very_small_pancreas", "small_pancreas"),
}


def any_tag(*tags: str) -> str:
    return " OR ".join(f"f__{t} > 0" for t in tags)


def tag_counts(flagged: DataFrame) -> DataFrame:
    """Cases per raised tag: one global aggregate over the flag columns, then unpivoted.

    Nothing is exploded before the aggregate, so the shuffle carries one row per task.
    """
    sums = flagged.agg(*[F.count_if(F.col(f"f__{t}") > 0).alias(t) for t in FLAG_DOMAINS])
    pairs = ", ".join(f"{lit(t)}, {t}" for t in FLAG_DOMAINS)
    return sums.selectExpr(f"stack({len(FLAG_DOMAINS)}, {pairs}) AS (tag, n)").filter("n > 0")


def tag_order(flagged: DataFrame) -> DataFrame:
    """Tags, most common first (W6); the ranked table has one row per tag."""
    order = Window.orderBy(F.desc("n"), "tag")
    return tag_counts(flagged).select(F.row_number().over(order).alias("position"), "tag", "n")


def score_distribution(scored: DataFrame) -> DataFrame:
    """Count, range, mean and median of the positive scores.

    Zeros are masked instead of filtered: a filter on a derived column would be
    pushed through the whole rule chain.  Scores are whole numbers up to 100.
    """
    positive = F.when(F.col("score") > 0, F.col("score"))
    return scored.agg(
        F.count(positive).alias("n"),
        F.min(positive).alias("min_score"),
        F.max(positive).alias("max_score"),
        F.avg(positive).alias("mean_score"),
        F.median(positive).alias("median_score"),
    )


def overview(passed: DataFrame) -> DataFrame:
    """Counts by sample type, hint, risk and issue group, one row."""
    count = lambda sql, name: F.count_if(F.expr(sql)).alias(name)
    return passed.agg(
        F.count("*").alias("total"),
        count("omitted", "omitted"),
        count("sample_type = 'positive'", "positives"),
        count("sample_type = 'negative'", "negatives"),
        count("sample_type = 'positive' AND NOT pancreas_present", "not_validatable"),
        count("decision_hint = 'keep_positive'", "keep_positive"),
        count("decision_hint IN ('review_positive', 'review_or_exclude_positive')", "review_positive"),
        *[count(f"first_risk = '{r}'", f"{r}_risk") for r in ("high", "medium", "low", "critical")],
        *[count(any_tag(*tags), name) for name, tags in ISSUE_GROUPS.items()],
    )


def attenuation_distribution(cases: DataFrame) -> DataFrame:
    """Cases per tumour attenuation label."""
    return cases.groupBy(F.col("hu_statistics.tumor_attenuation").alias("tumor_attenuation")).agg(
        F.count("*").alias("n")
    )


def domain_shift(cases: DataFrame) -> DataFrame:
    """Value distribution of acquisition attributes with shares.

    The window runs over the aggregated values, not over the cases.
    """
    names = ("ct_phase", "site_nationality", "manufacturer")
    pairs = ", ".join(f"'{n}', coalesce(nullif(metadata.{n}, ''), 'unknown')" for n in names)
    counts = (
        cases.selectExpr(f"stack({len(names)}, {pairs}) AS (attribute, value)")
        .groupBy("attribute", "value")
        .agg(F.count("*").alias("n"))
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("attribute")))


def training_summary(passed: DataFrame) -> DataFrame:
    """Counts behind the training and annotation summaries, one row."""
    count = lambda sql, name: F.count_if(F.expr(sql)).alias(name)
    return passed.agg(
        F.count("*").alias("total"),
        count("first_risk = 'high'", "high_risk"),
        count("first_risk = 'medium'", "medium_risk"),
        count("first_risk NOT IN ('high', 'medium')", "clean"),
        count(any_tag("pancreas_mask_empty"), "empty_pancreas"),
        count(any_tag("lesion_outside_pancreas", "lesion_partial_outside"), "lesion_mismatch"),
        count(any_tag("region_sum_error_critical", "region_sum_error_warning"), "region_inconsistent"),
    )


# Names and conditions of the filters.
FILTERS = {
    "warning": "worst_flag = 2",
    "high_risk": "first_risk = 'high'",
    "medium_risk": "first_risk = 'medium'",
    "pancreas_mask_empty": any_tag("pancreas_mask_empty"),
    "region_error": any_tag(
        "region_sum_error_critical", "region_sum_error_warning", "incomplete_anatomical_coverage"
    ),
    "partial_coverage": any_tag("incomplete_anatomical_coverage"),
    "small_pancreas": any_tag("very_small_pancreas", "small_pancreas"),
    "missing_region": any_tag("head_region_empty", "body_region_empty", "tail_region_empty"),
    "lesion_outside": any_tag("lesion_outside_pancreas", "lesion_partial_outside", "lesion_overlap_critical_fail"),
    "no_anatomical_val": "sample_type = 'positive' AND NOT pancreas_present",
    "positives": "sample_type = 'positive'",
    "negatives": "sample_type = 'negative'",
    "hypoattenuating": "tumor_attenuation = 'Hypo'",
    "hyperattenuating": "tumor_attenuation = 'Hyper'",
    "isoattenuating": "tumor_attenuation = 'Iso'",
    "suspicious_hu": "suspicious_hu_distribution",
    "unreadable": "omitted",
}
_LISTED = ("case_id", "score", "first_risk AS risk_level", "decision_hint")


def case_filter(passed: DataFrame, name: str) -> DataFrame:
    """Cases of one named filter (H8); meant for a stored first-pass table."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter: {name}")
    return passed.filter(FILTERS[name]).selectExpr(*_LISTED)


def all_filters(passed: DataFrame) -> DataFrame:
    """Every named filter in one scan: a case appears once per filter it meets."""
    names = compact([f"CASE WHEN {cond} THEN '{name}' END" for name, cond in FILTERS.items()])
    return passed.selectExpr(f"explode({names}) AS filter", *_LISTED)
