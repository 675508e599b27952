"""Case lookups over the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.functions.sql import compact, lit


def aliases(case_id: str, prefix: str) -> str:
    """Alias array of a case id: lower, stripped, and for numbered ids the number forms (H4)."""
    number = f"CAST(CAST(regexp_extract({case_id}, '(?i)^{prefix}[_-]?([0-9]+)$', 1) AS BIGINT) AS STRING)"
    numbered = f"{case_id} RLIKE '(?i)^{prefix}[_-]?[0-9]+$'"
    items = [
        f"lower({case_id})",
        f"regexp_replace(lower({case_id}), '[^a-z0-9]', '')",
        f"CASE WHEN {numbered} THEN {number} END",
        f"CASE WHEN {numbered} THEN concat({lit(prefix.lower())}, {number}) END",
        f"CASE WHEN {numbered} THEN concat({lit(prefix.lower())}, lpad({number}, 8, '0')) END",
    ]
    return f"array_distinct({compact(items)})"


def alias_table(cases: DataFrame, prefix: str) -> DataFrame:
    """Unambiguous aliases only: an alias shared by two cases is dropped."""
    pairs = cases.selectExpr("case_id", f"explode({aliases('case_id', prefix)}) AS alias")
    grouped = pairs.groupBy("alias").agg(F.min("case_id").alias("case_id"), F.max("case_id").alias("other"))
    return grouped.filter("case_id = other").select("alias", "case_id")


def resolve(queries: DataFrame, cases: DataFrame, prefix: str) -> DataFrame:
    """Case of each free-text reference (H4); unknown or ambiguous ones stay null.

    ``queries``: (query_id, value).  File suffixes and folders are stripped first.
    """
    name = "element_at(split(trim(value), '/'), -1)"
    bare = f"regexp_replace(regexp_replace({name}, '(?i)_0000\\\\.nii(\\\\.gz)?$', ''), '(?i)\\\\.nii(\\\\.gz)?$', '')"
    named = queries.selectExpr("query_id", f"{bare} AS raw")
    digits = f"regexp_extract(raw, '(?i)^(?:{prefix}[_-]?)?([0-9]+)$', 1)"
    whole = named.selectExpr(
        "query_id",
        f"CASE WHEN raw RLIKE '^[0-9]+$' THEN concat({lit(prefix.lower())}, {digits}) ELSE raw END AS form",
        "raw",
    )
    keys = whole.selectExpr(
        "query_id",
        f"explode(array_distinct(concat({aliases('raw', prefix)}, {aliases('form', prefix)}))) AS alias",
    )
    hits = keys.join(alias_table(cases, prefix), "alias").groupBy("query_id").agg(
        F.min("case_id").alias("case_id"), F.max("case_id").alias("other")
    )
    good = hits.filter("case_id = other").select("query_id", "case_id")
    return queries.select("query_id").join(good, "query_id", "left")


def listing(decisions: DataFrame, condition: str, shown: int = 50) -> DataFrame:
    """First cases by id with the full count and a truncation mark.

    The list is a distributed top-k; the count of the stored table is a plan-time literal.
    """
    hits = decisions.filter(condition).select("case_id")
    count = hits.count()
    return hits.orderBy("case_id").limit(shown).select(
        "case_id", F.lit(count).alias("count"), F.lit(count > shown).alias("truncated")
    )


def case_detail(aligned: DataFrame) -> DataFrame:
    """What is known of a case across artifacts (H5); filter by case id before or after."""
    return aligned.selectExpr(
        "case_id",
        "final.final_decision AS final_decision",
        "final.decision_basis AS decision_basis",
        "validation.status AS validation_status",
        "deterministic.target_presence.observed_presence AS observed_presence",
        "deterministic.triage.recommendation AS deterministic_recommendation",
        "deterministic.triage.score AS deterministic_score",
        "calibrated.triage.recommendation AS calibrated_recommendation",
        "calibrated.triage.score AS calibrated_score",
        "routing.route_to_review AS route_to_review",
        "routing.status AS routing_status",
    )


def compare_cases(details: DataFrame, left: str, right: str) -> DataFrame:
    """Two cases next to each other (H5)."""
    return details.filter(F.col("case_id").isin(left, right))


def selection_lookup(cases: DataFrame, system_rows: DataFrame) -> DataFrame:
    """Was a case drawn into the review package, and in which stratum (H7)?"""
    drawn = system_rows.select("case_id", "selection_stage")
    # A package has 60 rows by construction.
    joined = cases.select("case_id").join(F.broadcast(drawn), "case_id", "left")
    return joined.selectExpr("case_id", "selection_stage IS NOT NULL AS selected", "selection_stage AS selection_stratum")


def resource_availability(validation: DataFrame, files: DataFrame, masks: dict[str, str]) -> DataFrame:
    """Path and availability of image and masks per case (H9).

    ``files`` lists the existing paths; a semi-join-like left join marks them.
    """
    items = ["named_struct('resource', 'image', 'path', image_path)"]
    items += [
        f"named_struct('resource', '{name}', 'path', concat(segmentation_dir, '/{file}'))" for name, file in masks.items()
    ]
    wanted = validation.selectExpr("case_id", f"explode(array({', '.join(items)})) AS r").select("case_id", "r.*")
    present = files.select("path").distinct().withColumn("available", F.lit(True))
    return wanted.join(present, "path", "left").selectExpr(
        "case_id", "resource", "path", "coalesce(available, false) AS available"
    )
