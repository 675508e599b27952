"""Scans and sinks: case discovery, metadata, case maps, CSV contracts, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseward.config import LESION_TASK_MODES
from caseward.functions.sql import compact
from caseward.operators.align import latest_by

# Metadata columns of the source table and the names used here.
METADATA_COLUMNS = {
    "sex": "sex",
    "age": "age",
    "ct phase": "ct_phase",
    "manufacturer": "manufacturer",
    "manufacturer model": "manufacturer_model",
    "study type": "study_type",
    "site nationality": "site_nationality",
}
# Fields a confirmed-negative record must state.
CONFIRMATION_FIELDS = (
    "case_id",
    "task_mode",
    "lesion_status",
    "confirmed_by",
    "confirmation_date",
    "confirmation_source",
    "confirmation_scope",
)


def case_id_of(path: Column, suffix: str = "_0000.nii.gz") -> Column:
    """Case id of an image path: name minus the suffix, else minus .nii.gz, else the stem."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return (
        F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix)))
        .when(F.endswith(name, F.lit(".nii.gz")), F.substring(name, F.lit(1), F.length(name) - 7))
        .otherwise(stem)
    )


def discover(spark: SparkSession, folder: str, suffix: str = "_0000.nii.gz") -> DataFrame:
    """Files of a folder as (case_id, path, size_bytes); contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(case_id_of(F.col("path"), suffix).alias("case_id"), "path", F.col("length").alias("size_bytes"))


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files with size and SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return hashed(files)


def hashed(resources: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256) of resources (path, content), one row and at most 2 GB each."""
    return resources.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def metadata_rows(raw: DataFrame, key: str, order: str, columns: dict[str, str] = METADATA_COLUMNS) -> DataFrame:
    """Renamed metadata columns keyed by case (S2): blank keys go, the later duplicate wins, NaN is null."""
    out = []
    for source, name in columns.items():
        if source not in raw.columns:
            continue
        value = F.col(f"`{source}`")
        if raw.schema[source].dataType.typeName() in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(name))
    named = raw.select(F.trim(F.col(key)).alias("case_id"), F.col(order).alias("__order"), *out)
    named = named.filter("case_id IS NOT NULL AND case_id <> ''")
    return latest_by(named, ["case_id"], ["__order"]).drop("__order")


def case_map(texts: DataFrame, case_schema: T.StructType) -> DataFrame:
    """Cases of JSON documents in any of the four envelope shapes (S3).

    ``texts`` has one document per row (column ``text``).  The shape is read from
    the text itself; unknown keys of a flat map are parsed as cases.
    """
    maps = T.MapType(T.StringType(), case_schema)
    probe = T.StructType(
        [
            T.StructField("cases", T.StringType()),
            T.StructField("data", T.StringType()),
            T.StructField("metadata", T.StringType()),
        ]
    )
    outer = texts.select("text", F.from_json("text", probe).alias("o"))
    inner = outer.select(
        "text",
        "o",
        F.when(F.col("o.data").isNotNull() & F.col("o.metadata").isNotNull(), F.col("o.data")).alias("payload"),
    ).select("text", "o", "payload", F.from_json("payload", probe).alias("i"))
    body = F.coalesce(F.col("i.cases"), F.col("payload"), F.col("o.cases"), F.col("text"))
    return inner.select(F.explode(F.from_json(body, maps)).alias("case_id", "case"))


def record_collection(texts: DataFrame, keys: tuple[str, ...], row_schema: T.StructType) -> DataFrame:
    """Rows given as a map or as a list under one of several keys.

    The first key present in a document wins; list rows are keyed by case_id, else id.
    """
    raw = texts.select(
        F.coalesce(*[F.get_json_object("text", f"$.{k}") for k in keys]).alias("body")
    ).filter("body IS NOT NULL")
    as_map = raw.filter("startswith(body, '{')").select(
        F.explode(F.from_json("body", T.MapType(T.StringType(), row_schema))).alias("case_id", "row")
    )
    keyed = T.StructType(
        [T.StructField("case_id", T.StringType()), T.StructField("id", T.StringType())]
        + [f for f in row_schema.fields if f.name not in ("case_id", "id")]
    )
    as_list = raw.filter("startswith(body, '[')").select(F.explode(F.from_json("body", T.ArrayType(keyed))).alias("r"))
    fields = F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in row_schema.fields])
    as_list = as_list.select(F.coalesce("r.case_id", "r.id").alias("case_id"), fields.alias("row"))
    return as_map.unionByName(as_list).filter("case_id IS NOT NULL").select("case_id", "row.*")


def csv_violations(rows: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """Contract violations of a keyed table: missing columns, blank and duplicate keys."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    named = rows.select(F.trim(F.coalesce(F.col(key), F.lit(""))).alias("key"))
    return (
        named.groupBy("key")
        .agg(F.count("*").alias("n"))
        .filter("key = '' OR n > 1")
        .select("key", F.expr("CASE WHEN key = '' THEN 'blank_key' ELSE 'duplicate_key' END").alias("violation"), "n")
    )


def read_csv(spark: SparkSession, path: str, key: str, required: tuple[str, ...]) -> DataFrame:
    """CSV with header, UTF-8 (a byte-order mark is dropped), unique non-blank keys; fails closed."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if not csv_violations(rows, key, required).isEmpty():
        raise ValueError(f"{path}: blank or duplicate {key}")
    return rows


def confirmation_violations(records: DataFrame, known: DataFrame, task_mode: str) -> DataFrame:
    """Rules a confirmed-negative record breaks (S6): (case_id, violation).

    ``known`` is the case list of the run.  Duplicates are counted by key, and the
    known cases are matched in the same grouping, so one shuffle serves both.
    """
    if task_mode not in LESION_TASK_MODES:
        raise ValueError(f"confirmed negatives do not apply to {task_mode}")
    blank = " OR ".join(f"trim(coalesce({f}, '')) = ''" for f in CONFIRMATION_FIELDS)
    own = records.selectExpr(
        "trim(case_id) AS case_id",
        compact(
            [
                f"CASE WHEN {blank} THEN 'missing_field' END",
                f"CASE WHEN trim(task_mode) <> '{task_mode}' THEN 'task_mismatch' END",
                "CASE WHEN trim(lesion_status) <> 'confirmed_absent' THEN 'wrong_status' END",
            ]
        )
        + " AS codes",
        "1 AS n_records",
        "0 AS n_known",
    )
    listed = known.selectExpr("case_id", "CAST(array() AS ARRAY<STRING>) AS codes", "0 AS n_records", "1 AS n_known")
    row_level = own.select("case_id", F.explode("codes").alias("violation"))
    counts = own.unionByName(listed).groupBy("case_id").agg(
        F.sum("n_records").alias("n_records"), F.sum("n_known").alias("n_known")
    )
    case_level = counts.filter("n_records > 0").selectExpr(
        "case_id",
        "explode("
        + compact(
            [
                "CASE WHEN n_records > 1 THEN 'duplicate_case' END",
                "CASE WHEN n_known = 0 THEN 'unknown_case' END",
            ]
        )
        + ") AS violation",
    )
    return row_level.unionByName(case_level)


def write_artifact(
    data: DataFrame, folder: str, artifact_type: str, run_id: str, dataset: str, task_mode: str, created_at: str
) -> DataFrame:
    """Write an artifact as Parquet and append its envelope row.

    The artifact id hashes content and identity but no time stamp.  The id is
    computed from the written files, so the input is evaluated once.
    """
    from caseward.operators.calibrate import content_fingerprint

    spark = data.sparkSession
    path = f"{folder}/{run_id}/{artifact_type}"
    data.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    stable = [c for c in stored.columns if c not in ("created_at", "timestamp")]
    identity = F.concat_ws(":", F.lit(artifact_type), F.lit(run_id), F.lit(dataset), F.lit(task_mode), "content_hash")
    row = content_fingerprint(stored, stable).select(
        F.lit(artifact_type).alias("artifact_type"),
        F.lit(run_id).alias("run_id"),
        F.lit(dataset).alias("dataset_name"),
        F.lit(task_mode).alias("task_mode"),
        F.lit(path).alias("path"),
        "n_rows",
        F.col("content_hash").alias("sha256"),
        F.sha2(identity, 256).alias("artifact_id"),
        F.lit(created_at).alias("created_at"),
    )
    row.write.mode("append").parquet(f"{folder}/artifacts")
    return row


def run_manifest(artifacts: DataFrame) -> DataFrame:
    """Artifact roles of each run with path and hash.

    Of several artifacts of a role the last path stands.  Roles are aggregated first,
    so the list of a run is as short as the list of roles.
    """
    roles = artifacts.groupBy("run_id", "artifact_type").agg(
        F.count("*").alias("n"), F.max(F.struct("path", "sha256")).alias("last")
    )
    entry = F.struct("artifact_type", "last.path", "last.sha256")
    return roles.groupBy("run_id").agg(
        F.sum("n").alias("n_artifacts"), F.array_sort(F.collect_list(entry)).alias("artifacts")
    )


def latest_runs(artifacts: DataFrame) -> DataFrame:
    """Newest run per dataset and task."""
    return artifacts.groupBy("dataset_name", "task_mode").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
