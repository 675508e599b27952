"""Sources, validation and contracts over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseward.operators import calibrate as cal
from caseward.operators import validate as vd
from caseward.sources import readers as rd
from caseward.sources.derived import read_table, dealt

from catalog.base import register

K = "o_orderkey"
CASE = "'C' || lpad(o_orderkey::VARCHAR, 8, '0')"


def keys(spark, sf):
    return dealt(read_table(spark, sf, "orders").select(K)).selectExpr(
        "o_orderkey AS k", "concat('C', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS case_id"
    )


def inventory(spark, sf):
    items = ", ".join(f"named_struct('i', {i}, 'resource', '{r}')" for i, r in enumerate(vd.RESOURCES))
    rows = keys(spark, sf).selectExpr("k", "case_id", f"explode(array({items})) AS r").selectExpr(
        "k", "case_id", "r.i AS i", "r.resource AS resource"
    )
    return rows.filter("NOT (i = 0 AND k % 89 = 4)").selectExpr(
        "case_id",
        "resource",
        "i = 0 OR (k * (i + 5)) % 53 <> i AS exists",
        "k % 61 <> i AS readable",
        "k % 67 <> i + 2 AS geometry_valid",
        "CASE WHEN k % 5 = 0 THEN 0 ELSE k % 1000 + 1 END AS positive_voxels",
    )


def _inv_sql() -> list[str]:
    names = ", ".join(f"({i}, '{r}')" for i, r in enumerate(vd.RESOURCES))
    return [
        f"""inv AS (SELECT {CASE} AS case_id, o_orderkey AS k, i, resource, i = 0 OR (o_orderkey * (i + 5)) % 53 <> i AS ex,
            o_orderkey % 61 <> i AS rd, o_orderkey % 67 <> i + 2 AS gv,
            CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 1000 + 1 END AS pv
            FROM orders, (VALUES {names}) r(i, resource) WHERE NOT (i = 0 AND o_orderkey % 89 = 4))""",
        """st AS (SELECT case_id, bool_or(i = 0) AS img, bool_or(i = 0 AND rd) AS img_rd, bool_or(i = 1 AND ex) AS pan,
            bool_or(i = 2 AND ex) AS les, bool_or(i = 2 AND ex AND rd) AS les_rd, bool_or(i = 2 AND ex AND gv) AS les_gv,
            max(CASE WHEN i = 2 AND ex THEN pv END) AS les_pv, bool_or(i = 3 AND ex) AS hd, bool_or(i = 4 AND ex) AS bd,
            bool_or(i = 5 AND ex) AS tl FROM inv GROUP BY case_id)""",
        """s2 AS (SELECT *, CASE WHEN NOT les THEN 'missing' WHEN NOT les_rd THEN 'unreadable' WHEN NOT les_gv OR NOT img_rd
            THEN 'geometry_mismatch' ELSE 'valid' END AS src FROM st WHERE img)""",
        """s3 AS (SELECT *, CASE WHEN src <> 'valid' THEN 'insufficient_evidence' WHEN les_pv > 0 THEN 'lesion_present'
            ELSE 'confirmed_absent' END AS lst FROM s2)""",
    ]


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


_V1 = """SELECT case_id, CASE WHEN len(m) = 0 THEN 'valid' ELSE 'invalid' END AS status, len(m) > 0 AS omit_from_training,
  CASE WHEN len(m) > 0 THEN 'missing_segmentations:' || array_to_string(m, ',') ELSE '' END AS errors FROM (
  SELECT case_id, list_filter([CASE WHEN NOT pan THEN 'pancreas.nii.gz' END,
    CASE WHEN NOT les THEN 'pancreatic_lesion.nii.gz' WHEN src <> 'valid' THEN 'insufficient_lesion_annotation_evidence' END,
    CASE WHEN NOT hd THEN 'pancreas_head.nii.gz' END, CASE WHEN NOT bd THEN 'pancreas_body.nii.gz' END,
    CASE WHEN NOT tl THEN 'pancreas_tail.nii.gz' END], lambda x: x IS NOT NULL) AS m FROM s3)"""
FULL = "pancreas_lesion_subregions"


@register("v01_required_resources", _with(_inv_sql(), _V1))
def v01(spark, sf):
    return vd.validate_cases(inventory(spark, sf), FULL).select(
        "case_id", "status", "omit_from_training", F.array_join("errors", "|").alias("errors")
    )


@register(
    "v01_dataset_status",
    _with(
        _inv_sql(),
        f"SELECT count(*) AS n_cases, count(*) FILTER (status <> 'valid') AS n_invalid_cases,"
        f" CASE WHEN count(*) FILTER (status <> 'valid') = 0 THEN 'passed' ELSE 'failed' END AS status FROM ({_V1})",
    ),
)
def v01s(spark, sf):
    return vd.validation_summary(vd.validate_cases(inventory(spark, sf), FULL))


@register("v02_orphan_labels", _with(_inv_sql(), "SELECT case_id FROM st WHERE NOT img"))
def v02(spark, sf):
    return vd.orphan_labels(inventory(spark, sf))


@register("v03_lesion_evidence", _with(_inv_sql(), "SELECT case_id, src AS lesion_source, lst AS lesion_status FROM s3"))
def v03(spark, sf):
    return vd.validate_cases(inventory(spark, sf), "pancreas_lesion").select("case_id", "lesion_source", "lesion_status")


@register(
    "v04_case_status",
    f"""SELECT *, error_type IS NULL AS processing_successful, error_type IS NOT NULL AS omit_from_training,
        CASE error_type WHEN 'file_not_found' THEN 'ct_image_missing' WHEN 'image_read_error' THEN 'ct_image_unreadable'
          WHEN 'non_orthonormal_direction_cosines' THEN 'invalid_ct_geometry' END AS omit_reason,
        CASE error_type WHEN 'file_not_found' THEN 'ct_image_file_not_found' WHEN 'image_read_error' THEN 'ct_image_unreadable_by_simpleitk'
          WHEN 'non_orthonormal_direction_cosines' THEN 'non_orthonormal_direction_cosines|ct_image_unreadable_by_simpleitk' ELSE '' END AS blocking_issues
        FROM (SELECT {CASE} AS case_id, CASE WHEN o_orderkey % 23 = 4 THEN 'file_not_found' WHEN o_orderkey % 29 = 5
          THEN 'non_orthonormal_direction_cosines' WHEN o_orderkey % 31 = 6 THEN 'image_read_error' END AS error_type FROM orders)""",
)
def v04(spark, sf):
    images = keys(spark, sf).selectExpr(
        "case_id",
        "k % 23 <> 4 AS exists",
        "CASE WHEN k % 29 = 5 THEN 'ITK: No Orthonormal definition found' WHEN k % 31 = 6 THEN 'truncated file' END AS read_error",
    )
    return vd.case_status(images).select(
        "case_id",
        "error_type",
        "processing_successful",
        "omit_from_training",
        "omit_reason",
        F.array_join("blocking_issues", "|").alias("blocking_issues"),
    )


@register(
    "v06_contract_validation",
    f"""SELECT 'golden_labels' AS artifact, {CASE} AS case_id, unnest([CASE WHEN k % 11 = 1 THEN 'annotation_completeness' END,
        CASE WHEN k % 13 = 2 THEN 'expected_action' END, CASE WHEN k % 17 = 3 THEN 'reviewer_id' END, CASE WHEN k % 19 IN (4, 5) THEN 'confidence' END,
        CASE WHEN k % 23 = 6 THEN 'rationale' END]) AS path,
        unnest([CASE WHEN k % 11 = 1 THEN 'enum' END, CASE WHEN k % 13 = 2 THEN 'enum' END, CASE WHEN k % 17 = 3 THEN 'required' END,
        CASE WHEN k % 19 IN (4, 5) THEN 'range' END, CASE WHEN k % 23 = 6 THEN 'required' END]) AS rule
        FROM (SELECT *, o_orderkey AS k FROM orders) QUALIFY path IS NOT NULL""".replace("SELECT 'golden", "SELECT * FROM (SELECT 'golden").replace(
        " QUALIFY path IS NOT NULL", ") WHERE path IS NOT NULL"
    ),
)
def v06(spark, sf):
    labels = keys(spark, sf).selectExpr(
        "case_id",
        "concat('R', CAST(k AS STRING)) AS review_id",
        "CASE WHEN k % 11 = 1 THEN 'partly' ELSE 'complete' END AS annotation_completeness",
        "CASE WHEN k % 13 = 2 THEN NULL ELSE 'keep' END AS expected_action",
        "CASE WHEN k % 17 = 3 THEN '' ELSE 'r1' END AS reviewer_id",
        "CASE k % 19 WHEN 4 THEN 1.5D WHEN 5 THEN NULL ELSE 0.5D END AS confidence",
        "CASE WHEN k % 23 = 6 THEN NULL ELSE 'seen' END AS rationale",
    )
    return vd.contract_violations(labels, "golden_labels")


@register(
    "v07_case_set_alignment",
    f"""SELECT {CASE} AS case_id, CASE WHEN o_orderkey % 41 = 3 THEN 'missing' WHEN o_orderkey % 43 = 5 THEN 'unexpected'
        ELSE 'duplicate' END AS problem FROM orders
        WHERE (o_orderkey % 41 = 3 AND o_orderkey % 43 <> 5) OR (o_orderkey % 43 = 5 AND o_orderkey % 41 <> 3)
          OR (o_orderkey % 47 = 7 AND o_orderkey % 41 <> 3 AND o_orderkey % 43 <> 5)""",
)
def v07(spark, sf):
    base = keys(spark, sf)
    other = base.filter("k % 41 <> 3")
    other = other.unionByName(other.filter("k % 47 = 7 AND k % 43 <> 5"))
    return vd.case_set_differences(base.filter("k % 43 <> 5"), other)


@register("j09_semi_anti", "SELECT " + CASE + " AS case_id FROM orders WHERE o_orderkey % 41 = 3 AND o_orderkey % 2 = 0")
def j09(spark, sf):
    """Known cases (semi) that the other side lacks (anti)."""
    base = keys(spark, sf)
    known = base.filter("k % 2 = 0").select("case_id")
    return base.join(known, "case_id", "left_semi").join(base.filter("k % 41 <> 3"), "case_id", "left_anti").select("case_id")


@register(
    "v08_provenance_hashes",
    "SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 101 = 3 THEN 'hash_mismatch' ELSE 'missing_hash' END AS problem"
    " FROM orders WHERE o_orderkey > 0 AND (o_orderkey % 101 = 3 OR o_orderkey % 103 = 4)",
)
def v08(spark, sf):
    """Five artifacts of a run, some of one type; every second input states no known type."""
    base = keys(spark, sf).selectExpr("*", "concat('run_', CAST(k div 5 AS STRING)) AS run_id", "concat('file_', CAST(k % 5 AS STRING), '.json') AS file_name")
    artifacts = base.selectExpr("run_id", "concat('type_', CAST(k % 3 AS STRING)) AS artifact_type", "file_name", "sha2(case_id, 256) AS sha256")
    inputs = base.filter("k > 0").selectExpr(
        "run_id",
        "k AS owner",
        "CASE WHEN k % 2 = 0 THEN concat('type_', CAST(k % 3 AS STRING)) ELSE 'unknown' END AS artifact_type",
        "concat('/runs/', file_name) AS path",
        "CASE WHEN k % 101 = 3 THEN sha2('other', 256) WHEN k % 103 = 4 THEN NULL ELSE sha2(case_id, 256) END AS sha256",
    )
    return vd.hash_violations(artifacts, inputs).select("owner", "problem")


@register(
    "v07_identity_differences",
    f"SELECT {CASE} AS case_id, unnest(list_filter([CASE WHEN o_orderkey % 11 = 2 THEN 'run_id' END, CASE WHEN o_orderkey % 13 = 3 THEN 'dataset_name' END,"
    " CASE WHEN o_orderkey % 17 = 4 THEN 'task_mode' END], lambda x: x IS NOT NULL)) AS field FROM orders WHERE o_orderkey % 19 <> 5",
)
def v07_identity(spark, sf):
    """Values that differ, are missing on one side, or missing on both (no difference)."""
    base = keys(spark, sf)
    left = base.selectExpr("case_id", "'r1' AS run_id", "CASE WHEN k % 26 = 3 THEN NULL ELSE 's1' END AS dataset_name", "CASE WHEN k % 5 = 0 THEN NULL ELSE 'm1' END AS task_mode")
    right = base.filter("k % 19 <> 5").selectExpr(
        "case_id",
        "CASE WHEN k % 11 = 2 THEN NULL ELSE 'r1' END AS run_id",
        "CASE WHEN k % 13 = 3 THEN 's2' ELSE 's1' END AS dataset_name",
        "CASE WHEN k % 17 = 4 THEN 'm2' WHEN k % 5 = 0 THEN NULL ELSE 'm1' END AS task_mode",
    )
    return vd.identity_differences(left, right, ("run_id", "dataset_name", "task_mode"))


FINGERPRINT = (
    "SELECT count(*) AS n_rows, sha256(concat_ws(':', count(*)::VARCHAR, "
    + ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT), 0)::VARCHAR" for i in range(4))
    + ")) AS content_hash FROM (SELECT sha256(text) AS h FROM (%s))"
)


@register(
    "s08_artifact_id",
    FINGERPRINT % "SELECT concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag, l_partkey::VARCHAR) AS text FROM lineitem",
)
def s08(spark, sf):
    """Order-free content hash of the line items."""
    text = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return cal.fingerprint_of(dealt(read_table(spark, sf, "lineitem"), "l_orderkey").select(text.alias("text")))


@register(
    "v10_threshold_reuse",
    "SELECT o_orderkey AS thresholds_id, CASE o_orderkey % 7 WHEN 1 THEN 'missing_summary_provenance' WHEN 2 THEN 'different_summary_content'"
    " ELSE 'different_task_mode' END AS violation FROM orders WHERE o_orderkey % 7 IN (1, 2, 3)",
)
def v10(spark, sf):
    summary = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    own = cal.content_fingerprint(summary).first()["content_hash"]
    stored = keys(spark, sf).selectExpr(
        "k AS thresholds_id",
        f"CASE k % 7 WHEN 1 THEN NULL WHEN 2 THEN 'stale' ELSE '{own}' END AS summary_hash",
        "CASE k % 7 WHEN 3 THEN 'pancreas_only' ELSE 'pancreas_lesion' END AS task_mode",
    )
    return cal.reuse_violations(stored, summary, "pancreas_lesion")


@register(
    "v11_run_context",
    "SELECT 'run_1' AS run_id, 'orders' AS dataset_name, 'pancreas_only' AS task_mode, n_rows AS n_cases, content_hash AS case_list_hash,"
    " 'valid' AS validation_status FROM (" + FINGERPRINT % f"SELECT {CASE} AS text FROM orders" + ")",
)
def v11(spark, sf):
    return vd.run_context(keys(spark, sf), "run_1", "orders", "pancreas_only")


# -- sources ------------------------------------------------------------------------------------
@register(
    "s01_case_discovery",
    f"""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN {CASE} || '.v2' ELSE {CASE} END AS case_id FROM orders""",
)
def s01(spark, sf):
    paths = keys(spark, sf).selectExpr(
        "k",
        "concat('/data/images/', case_id, CASE k % 4 WHEN 0 THEN '_0000.nii.gz' WHEN 1 THEN '.nii.gz' WHEN 2 THEN '.mha'"
        " ELSE '.v2.mha' END) AS path",
    )
    return paths.select("k", rd.case_id_of(F.col("path")).alias("case_id"))


@register(
    "s02_metadata_scan",
    """SELECT 'P' || (c_custkey % 500) AS case_id, arg_max(c_mktsegment, c_custkey) AS manufacturer,
       arg_max(CASE WHEN c_acctbal > 0 THEN c_acctbal END, c_custkey) IS NOT NULL AS unused FROM customer WHERE c_custkey % 97 <> 5 GROUP BY 1""".replace(
        "arg_max(CASE WHEN c_acctbal > 0 THEN c_acctbal END, c_custkey) IS NOT NULL AS unused",
        "arg_max(c_nationkey, c_custkey) AS site_nationality",
    ),
)
def s02(spark, sf):
    raw = read_table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_custkey % 97 = 5 THEN '  ' ELSE concat(' P', CAST(c_custkey % 500 AS STRING), ' ') END AS id",
        "c_custkey AS line",
        "c_mktsegment AS manufacturer",
        "c_nationkey AS `site nationality`",
    )
    return rd.metadata_rows(raw, "id", "line")


CASE_SCHEMA = T.StructType([T.StructField("score", T.LongType()), T.StructField("status", T.StringType())])


@register("s03_case_map", f"SELECT {CASE} AS case_id, o_orderkey % 101 AS score, o_orderstatus AS status FROM orders")
def s03(spark, sf):
    """Cases written as JSON documents in the four shapes and read back."""
    orders = dealt(read_table(spark, sf, "orders").select(K, "o_orderstatus"))
    entry = F.expr(
        "map(concat('C', lpad(CAST(o_orderkey AS STRING), 8, '0')), struct(o_orderkey % 101 AS score, o_orderstatus AS status))"
    )
    docs = orders.select((F.col(K) % 4).alias("shape"), F.to_json(entry).alias("body"))
    texts = docs.selectExpr(
        "CASE shape WHEN 0 THEN body WHEN 1 THEN concat('{\"metadata\":{\"n\":1},\"cases\":', body, '}')"
        " WHEN 2 THEN concat('{\"metadata\":{\"n\":1},\"data\":', body, '}')"
        " ELSE concat('{\"metadata\":{\"n\":1},\"data\":{\"metadata\":{\"n\":1},\"cases\":', body, '}}') END AS text"
    )
    return rd.case_map(texts, CASE_SCHEMA).select("case_id", "case.score", "case.status")


@register("s04_record_collection", f"SELECT {CASE} AS case_id, o_orderstatus AS status FROM orders")
def s04(spark, sf):
    """Rows under alternative keys, as map or list, keyed by case_id or id."""
    orders = dealt(read_table(spark, sf, "orders").select(K, "o_orderstatus"))
    rows = orders.selectExpr("o_orderkey % 3 AS s", "concat('C', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS c", "o_orderstatus AS st")
    texts = rows.selectExpr(
        "CASE s WHEN 0 THEN concat('{\"cases\":{\"', c, '\":{\"status\":\"', st, '\"}}}')"
        " WHEN 1 THEN concat('{\"results\":[{\"case_id\":\"', c, '\",\"status\":\"', st, '\"}]}')"
        " ELSE concat('{\"results\":[{\"id\":\"', c, '\",\"status\":\"', st, '\"}]}') END AS text"
    )
    return rd.record_collection(texts, ("cases", "results"), T.StructType([T.StructField("status", T.StringType())]))


@register(
    "s05_csv_contract",
    """SELECT key, CASE WHEN key = '' THEN 'blank_key' ELSE 'duplicate_key' END AS violation, count(*) AS n FROM (
       SELECT CASE WHEN o_orderkey % 83 = 2 THEN '' WHEN o_orderkey % 79 = 3 THEN 'R' || (o_orderkey - 1) ELSE 'R' || o_orderkey END AS key FROM orders)
       GROUP BY key HAVING key = '' OR count(*) > 1""",
)
def s05(spark, sf):
    rows = keys(spark, sf).selectExpr(
        "CASE WHEN k % 83 = 2 THEN ' ' WHEN k % 79 = 3 THEN concat('R', CAST(k - 1 AS STRING)) ELSE concat('R', CAST(k AS STRING)) END AS review_id",
        "case_id",
    )
    return rd.csv_violations(rows, "review_id", ("review_id", "case_id"))


@register(
    "s06_confirmed_negatives",
    f"""SELECT {CASE} AS case_id, unnest(list_filter([CASE WHEN k % 35 = 0 THEN 'missing_field' END, CASE WHEN k % 42 = 0 THEN 'task_mismatch' END,
        CASE WHEN k % 49 = 0 THEN 'wrong_status' END, CASE WHEN k % 56 = 0 THEN 'unknown_case' END], lambda x: x IS NOT NULL)) AS violation
        FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 7 = 0""",
)
def s06(spark, sf):
    base = keys(spark, sf)
    records = base.filter("k % 7 = 0").selectExpr(
        "case_id",
        "CASE WHEN k % 42 = 0 THEN 'pancreas_only' ELSE 'pancreas_lesion' END AS task_mode",
        "CASE WHEN k % 49 = 0 THEN 'maybe' ELSE 'confirmed_absent' END AS lesion_status",
        "CASE WHEN k % 35 = 0 THEN '' ELSE 'dr' END AS confirmed_by",
        "'2024-01-01' AS confirmation_date",
        "'panel' AS confirmation_source",
        "'lesion' AS confirmation_scope",
    )
    return rd.confirmation_violations(records, base.filter("k % 56 <> 0").select("case_id"), "pancreas_lesion")


@register(
    "s07_resource_inventory",
    "SELECT 'doc_' || doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents",
)
def s07(spark, sf):
    """Size and hash of the documents as resources."""
    documents = read_table(spark, sf, "documents")
    return rd.hashed(documents.selectExpr("concat('doc_', CAST(doc_id AS STRING)) AS path", "encode(text, 'UTF-8') AS content"))


_RUNS = """runs AS (SELECT 'run_' || lpad((o_orderkey // 5)::VARCHAR, 8, '0') AS run_id, 'set_' || (o_orderkey // 5) % 7 AS dataset_name,
  CASE (o_orderkey // 5) % 3 WHEN 0 THEN 'pancreas_only' WHEN 1 THEN 'pancreas_lesion' ELSE 'pancreas_lesion_subregions' END AS task_mode,
  lpad(((o_orderkey // 5) * 7919 % 100003)::VARCHAR, 8, '0') AS created_at FROM orders)"""


def artifacts(spark, sf):
    rows = keys(spark, sf).selectExpr("k", "CAST(floor(k / 5e0) AS BIGINT) AS r")
    return rows.selectExpr(
        "concat('run_', lpad(CAST(r AS STRING), 8, '0')) AS run_id",
        "concat('set_', CAST(r % 7 AS STRING)) AS dataset_name",
        "CASE r % 3 WHEN 0 THEN 'pancreas_only' WHEN 1 THEN 'pancreas_lesion' ELSE 'pancreas_lesion_subregions' END AS task_mode",
        "lpad(CAST(r * 7919 % 100003 AS STRING), 8, '0') AS created_at",
        "concat('type_', CAST(k % 5 AS STRING)) AS artifact_type",
        "concat('/runs/', CAST(k AS STRING)) AS path",
        "sha2(CAST(k AS STRING), 256) AS sha256",
    )


@register(
    "s09_latest_runs",
    f"WITH {_RUNS} SELECT dataset_name, task_mode, arg_max(run_id, created_at || run_id) AS run_id FROM runs GROUP BY 1, 2",
)
def s09(spark, sf):
    return rd.latest_runs(artifacts(spark, sf))


@register(
    "s09_run_manifest",
    """SELECT run_id, CAST(sum(n) AS BIGINT) AS n_artifacts, string_agg(role || '=' || last || '=' || sha256(last[7:]), '|' ORDER BY role) AS artifacts
       FROM (SELECT 'run_' || lpad((k // 10)::VARCHAR, 8, '0') AS run_id, 'type_' || (k % 5) AS role, count(*) AS n, max('/runs/' || k) AS last
             FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1, 2) GROUP BY 1""",
)
def s09m(spark, sf):
    """Ten artifacts of five roles in a run."""
    rows = artifacts(spark, sf).withColumn("run_id", F.expr("concat('run_', lpad(CAST(CAST(substring(path, 7) AS BIGINT) div 10 AS STRING), 8, '0'))"))
    listed = "array_join(transform(artifacts, a -> concat(a.artifact_type, '=', a.path, '=', a.sha256)), '|') AS artifacts"
    return rd.run_manifest(rows).selectExpr("run_id", "n_artifacts", listed)


@register(
    "w05_duplicate_resolution",
    "SELECT l_orderkey AS case_key, arg_max(l_returnflag, (l_linenumber * 100000 + l_partkey) * 256 + ascii(l_returnflag)) AS later_wins,"
    " arg_min(l_returnflag, (l_linenumber * 100000 + l_partkey) * 256 + ascii(l_returnflag)) AS first_wins FROM lineitem GROUP BY 1",
)
def w05(spark, sf):
    from caseward.operators.align import first_by, latest_by

    rows = read_table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS case_key", "l_returnflag AS flag", "l_linenumber * 100000 + l_partkey AS pos"
    )
    later = latest_by(rows, ["case_key"], ["pos"]).selectExpr("case_key", "flag AS later_wins")
    first = first_by(rows, ["case_key"], ["pos"]).selectExpr("case_key", "flag AS first_wins")
    return later.join(first, "case_key")


