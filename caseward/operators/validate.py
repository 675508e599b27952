"""Dataset and contract validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import LESION_TASK_MODES, TASK_PROFILES
from caseward.functions.sql import case, compact, lit, project

RESOURCES = ("image", "pancreas_mask", "lesion_mask", "pancreas_head", "pancreas_body", "pancreas_tail")


def resource_states(inventory: DataFrame) -> DataFrame:
    """One row per case with the state of each resource.

    ``inventory`` has (case_id, resource, exists, readable, geometry_valid,
    positive_voxels).  One aggregate replaces a cross join of cases and required
    masks with an anti-join.
    """
    aggregates = []
    for r in RESOURCES:
        here = F.col("resource") == r
        aggregates += [
            F.max(F.when(here, F.col("exists"))).alias(f"{r}_exists"),
            F.max(F.when(here & F.col("exists"), F.col("readable"))).alias(f"{r}_readable"),
            F.max(F.when(here & F.col("exists"), F.col("geometry_valid"))).alias(f"{r}_geometry"),
            F.max(F.when(here & F.col("exists"), F.col("positive_voxels"))).alias(f"{r}_voxels"),
        ]
    return inventory.groupBy("case_id").agg(*aggregates)


def lesion_evidence(task_mode: str) -> dict[str, str]:
    """Source state and status of the lesion annotation (V3), SQL over resource states."""
    if task_mode not in LESION_TASK_MODES:
        return {"lesion_source": "CAST(NULL AS STRING)", "lesion_status": "'not_applicable'"}
    readable = "coalesce(lesion_mask_readable, false)"
    grid = "coalesce(lesion_mask_geometry, false) AND coalesce(image_readable, false)"
    source = case(
        [
            ("NOT coalesce(lesion_mask_exists, false)", "'missing'"),
            (f"NOT {readable}", "'unreadable'"),
            (f"NOT ({grid})", "'geometry_mismatch'"),
        ],
        "'valid'",
    )
    status = case(
        [(f"({source}) <> 'valid'", "'insufficient_evidence'"), ("lesion_mask_voxels > 0", "'lesion_present'")],
        "'confirmed_absent'",
    )
    return {"lesion_source": source, "lesion_status": status}


def validate_cases(inventory: DataFrame, task_mode: str) -> DataFrame:
    """Status, omission and errors of every case that has an image (V1, V3)."""
    states = resource_states(inventory).filter("image_exists")
    df = project(states, lesion_evidence(task_mode))
    missing = []
    for key, name in TASK_PROFILES[task_mode]["required_masks"].items():
        absent = f"NOT coalesce({key}_exists, false)"
        if key == "lesion_mask" and task_mode in LESION_TASK_MODES:
            weak = "lesion_status NOT IN ('lesion_present', 'confirmed_absent')"
            missing.append(
                case([(absent, lit(name)), (weak, "'insufficient_lesion_annotation_evidence'")])
            )
        else:
            missing.append(f"CASE WHEN {absent} THEN {lit(name)} END")
    df = project(df, {"missing": compact(missing)})
    return project(
        df,
        {
            "status": "CASE WHEN size(missing) = 0 THEN 'valid' ELSE 'invalid' END",
            "omit_from_training": "size(missing) > 0",
            "errors": "CASE WHEN size(missing) > 0 THEN array(concat('missing_segmentations:', array_join(missing, ',')))"
            " ELSE CAST(array() AS ARRAY<STRING>) END",
            "lesion_source": "lesion_source",
            "lesion_status": "lesion_status",
        },
        ["case_id"],
    )


def orphan_labels(inventory: DataFrame) -> DataFrame:
    """Cases with labels but no image (V2), from the same grouping."""
    return resource_states(inventory).filter("NOT coalesce(image_exists, false)").select("case_id")


def validation_summary(validated: DataFrame) -> DataFrame:
    """Dataset status and counts, one row (V1)."""
    counts = validated.agg(
        F.count("*").alias("n_cases"), F.count_if(F.col("status") != "valid").alias("n_invalid_cases")
    )
    return counts.withColumn("status", F.expr("CASE WHEN n_invalid_cases = 0 THEN 'passed' ELSE 'failed' END"))


def case_status(images: DataFrame) -> DataFrame:
    """Success or error row per discovered case; no case is lost (V4).

    ``images`` has (case_id, exists, read_error); the error text decides the type.
    """
    # Error types and the texts that tell them.
    kind = case(
        [
            ("NOT exists", "'file_not_found'"),
            ("read_error IS NULL", "NULL"),
            ("lower(read_error) LIKE '%orthonormal%'", "'non_orthonormal_direction_cosines'"),
        ],
        "'image_read_error'",
    )
    df = project(images, {"error_type": kind}, ["case_id"])
    bad = "error_type IS NOT NULL"
    issues = case(
        [
            ("error_type IS NULL", "CAST(array() AS ARRAY<STRING>)"),
            ("error_type = 'file_not_found'", "array('ct_image_file_not_found')"),
            (
                "error_type = 'non_orthonormal_direction_cosines'",
                "array('non_orthonormal_direction_cosines', 'ct_image_unreadable_by_simpleitk')",
            ),
        ],
        "array('ct_image_unreadable_by_simpleitk')",
    )
    reason = case(
        [
            ("error_type = 'file_not_found'", "'ct_image_missing'"),
            ("error_type = 'non_orthonormal_direction_cosines'", "'invalid_ct_geometry'"),
            ("error_type = 'image_read_error'", "'ct_image_unreadable'"),
        ]
    )
    return project(
        df,
        {
            "processing_successful": f"NOT ({bad})",
            "omit_from_training": bad,
            "omit_category": f"CASE WHEN {bad} THEN 'blocking_geometry_error' END",
            "omit_reason": reason,
            "error_stage": f"CASE WHEN {bad} THEN 'read_ct_image' END",
            "blocking_issues": issues,
        },
    )


# -- contracts ---------------------------------------------------------------------------------
# Field contracts per artifact, (path, rule, argument).
CONTRACTS = {
    "golden_labels": (
        ("case_id", "required", None),
        ("review_id", "required", None),
        ("annotation_completeness", "enum", ("complete", "incomplete", "uncertain")),
        ("expected_action", "enum", ("keep", "warning", "review", "reject", "insufficient_evidence")),
        ("reviewer_id", "required", None),
        ("confidence", "range", (0.0, 1.0)),
        ("rationale", "required", None),
    ),
    "final_decisions": (
        ("final_decision", "enum", ("keep", "warning", "review", "reject", "insufficient_evidence")),
        ("decision_basis", "required", None),
        ("hard_failure", "present", None),
        ("requires_human_review", "present", None),
        ("policy_version", "required", None),
        ("policy_rules_triggered", "min_items", 1),
    ),
    "review_routing": (
        ("case_id", "required", None),
        ("route_to_review", "present", None),
        ("route_reasons", "present", None),
        ("hard_failure", "present", None),
    ),
    "target_presence": (
        ("target", "required", None),
        ("expected_presence", "enum", ("required", "optional", "unknown")),
        ("observed_presence", "enum", ("present", "absent", "partial", "uncertain")),
        ("confidence", "range", (0.0, 1.0)),
        ("evidence_sources", "min_items", 1),
        ("interpretation", "required", None),
    ),
    "confirmed_negative_lesions": (
        ("case_id", "required", None),
        ("task_mode", "enum", LESION_TASK_MODES),
        ("lesion_status", "enum", ("confirmed_absent",)),
        ("confirmed_by", "required", None),
        ("confirmation_date", "required", None),
        ("confirmation_source", "required", None),
        ("confirmation_scope", "required", None),
    ),
    "artifact_envelope": (
        ("artifact_type", "required", None),
        ("run_id", "required", None),
        ("dataset_name", "required", None),
        ("task_mode", "required", None),
        ("sha256", "pattern", "^[0-9a-f]{64}$"),
    ),
}


def broken(path: str, rule: str, argument: object) -> str:
    """Condition under which a value breaks its contract rule."""
    if rule == "present":
        return f"{path} IS NULL"
    if rule == "required":
        return f"coalesce({path}, '') = ''"
    if rule == "enum":
        return f"coalesce({path} NOT IN ({', '.join(lit(v) for v in argument)}), true)"
    if rule == "range":
        return f"coalesce(NOT ({path} BETWEEN {lit(argument[0])} AND {lit(argument[1])}), true)"
    if rule == "min_items":
        return f"coalesce(size({path}), 0) < {argument}"
    if rule == "pattern":
        return f"NOT coalesce({path} RLIKE {lit(argument)}, false)"
    raise ValueError(f"unknown contract rule: {rule}")


def contract_violations(rows: DataFrame, artifact: str, key: str = "case_id") -> DataFrame:
    """(artifact, key, path, rule) of every broken field rule (V6); narrow."""
    items = [
        f"CASE WHEN {broken(path, rule, argument)} THEN named_struct('path', '{path}', 'rule', '{rule}') END"
        for path, rule, argument in CONTRACTS[artifact]
    ]
    exploded = rows.selectExpr(key, f"explode({compact(items)}) AS v")
    return exploded.selectExpr(f"'{artifact}' AS artifact", key, "v.path", "v.rule")


def case_set_differences(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Cases missing from or unexpected in ``other``, and duplicates (V7, J9); one shuffle."""
    both = reference.select("case_id", F.lit(1).alias("r"), F.lit(0).alias("o")).unionByName(
        other.select("case_id", F.lit(0).alias("r"), F.lit(1).alias("o"))
    )
    counts = both.groupBy("case_id").agg(F.sum("r").alias("r"), F.sum("o").alias("o"))
    problem = F.expr(
        "CASE WHEN o = 0 THEN 'missing' WHEN r = 0 THEN 'unexpected' WHEN o > 1 THEN 'duplicate' END"
    )
    return counts.select("case_id", problem.alias("problem")).filter("problem IS NOT NULL")


def identity_differences(left: DataFrame, right: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields that two artifacts state differently for the same case (V7)."""
    pairs = left.select("case_id", *[F.col(f).alias(f"l_{f}") for f in fields]).join(
        right.select("case_id", *[F.col(f).alias(f"r_{f}") for f in fields]), "case_id"
    )
    items = [f"CASE WHEN NOT (l_{f} <=> r_{f}) THEN '{f}' END" for f in fields]
    return pairs.selectExpr("case_id", f"explode({compact(items)}) AS field")


def hash_violations(artifacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Stored input hashes that do not match the artifact they name (V8).

    ``artifacts``: (run_id, artifact_type, file_name, sha256); ``inputs``: (run_id,
    owner, artifact_type, path, sha256).  Within its run an input means the artifact
    of its type and file name, else the only one of its type; where the run has no
    artifact of that type, the only one of its file name.
    """
    def one(*keys: str) -> DataFrame:
        name = "_".join(("by", *keys))
        groups = artifacts.groupBy("run_id", *keys).agg(F.count("*").alias(f"n_{name}"), F.max("sha256").alias(name))
        return groups.withColumn(name, F.when(F.col(f"n_{name}") == 1, F.col(name)))

    found = inputs.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    for keys in (("artifact_type", "file_name"), ("artifact_type",), ("file_name",)):
        found = found.join(one(*keys), ["run_id", *keys], "left")
    no_type = F.col("n_by_artifact_type").isNull()
    actual = F.coalesce("by_artifact_type_file_name", "by_artifact_type", F.when(no_type, F.col("by_file_name")))
    problem = F.when(F.coalesce(F.col("sha256"), F.lit("")) == "", "missing_hash").when(
        F.col("sha256") != actual, "hash_mismatch"
    )
    return (
        found.filter(actual.isNotNull()).select("run_id", "owner", "artifact_type", problem.alias("problem")).filter("problem IS NOT NULL")
    )


def run_context(cases: DataFrame, run_id: str, dataset: str, task_mode: str) -> DataFrame:
    """Frozen snapshot row of a run: identity, case count and case-list hash."""
    from caseward.operators.calibrate import fingerprint_of

    listed = fingerprint_of(cases.select(F.col("case_id").alias("text")))
    return listed.select(
        F.lit(run_id).alias("run_id"),
        F.lit(dataset).alias("dataset_name"),
        F.lit(task_mode).alias("task_mode"),
        F.col("n_rows").alias("n_cases"),
        F.col("content_hash").alias("case_list_hash"),
        F.lit("valid").alias("validation_status"),
    )
