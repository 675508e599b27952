"""Voxel and geometry tables derived from the given line items and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseward.sources.derived import _project, read_table

CELL = {
    "c": "CAST(floor(l_suppkey / 5e0) AS BIGINT)",
    "x": "CAST(l_partkey % 12 AS INT)",
    "y": "CAST(CAST(floor(l_partkey / 12e0) AS BIGINT) % 12 AS INT)",
    "z": "CAST(l_linenumber - 1 AS INT)",
    "cents": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "organ": "CASE WHEN l_returnflag <> 'R' AND (CAST(floor(l_suppkey / 5e0) AS BIGINT) % 10 <> 3 OR l_quantity > 25)"
    " THEN 1 ELSE 0 END",
    "tumor": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 THEN 1 ELSE 0 END",
}
GROUPED = {
    "n": "count(*)",
    "total": "sum(cents)",
    "organ": "max(organ)",
    "lesion": "max(tumor)",
}
VOXEL = {
    "case_id": "concat('V', lpad(CAST(c AS STRING), 6, '0'))",
    "z": "z",
    "y": "y",
    "x": "x",
    "hu": "CAST(floor(total / (n * 40000e0)) - 50 + CASE WHEN lesion = 0 THEN 0 WHEN c % 3 = 1 THEN -120"
    " WHEN c % 3 = 2 THEN 120 ELSE 0 END AS INT)",
    "pancreas": "CASE WHEN organ = 1 AND c % 4 = 1 AND x = 0 THEN 2 ELSE organ END",
    "lesion": "CASE WHEN c % 6 = 4 THEN 0 ELSE lesion END",
    "head": "CASE WHEN organ = 1 AND (x < 4 OR (x = 4 AND c % 3 = 0)) THEN 1 ELSE 0 END",
    "body": "CASE WHEN organ = 1 AND x BETWEEN 4 AND 7 THEN 1 ELSE 0 END",
    "tail": "CASE WHEN x > 7 AND (organ = 1 OR c % 5 = 2) THEN 1 ELSE 0 END",
}
GEOMETRY = {
    "case_id": "concat('V', lpad(CAST(CAST(floor(s_suppkey / 5e0) AS BIGINT) AS STRING), 6, '0'))",
    "resource": "CASE s_suppkey % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'pancreas' WHEN 2 THEN 'lesion' WHEN 3 THEN 'head' ELSE 'body' END",
    "exists": "s_suppkey % 31 <> 7",
    "readable": "s_suppkey % 31 <> 7 AND s_suppkey % 37 <> 11",
    "nz": "CASE WHEN s_suppkey % 41 = 12 THEN 8 ELSE 7 END",
    "sp": "2e0 + CASE s_suppkey % 17 WHEN 3 THEN 0.001e0 WHEN 6 THEN 0.00008e0 ELSE 0e0 END",
    "ox": "-100e0 + CASE s_suppkey % 13 WHEN 2 THEN 0.05e0 WHEN 7 THEN 0.011e0 WHEN 8 THEN 0.009e0 ELSE 0e0 END",
    "skew": "CASE s_suppkey % 19 WHEN 1 THEN 0.01e0 WHEN 4 THEN 0.0004e0 ELSE 0e0 END",
}


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled cell."""
    cells = _project(read_table(spark, sf_dir, "lineitem"), CELL).groupBy("c", "z", "y", "x")
    grouped = cells.agg(*[F.expr(sql).alias(name) for name, sql in GROUPED.items()])
    return _project(grouped, VOXEL).filter("pancreas + lesion + head + body + tail > 0")


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case and resource."""
    flat = _project(read_table(spark, sf_dir, "supplier"), GEOMETRY)
    return flat.selectExpr(
        "case_id",
        "resource",
        "exists",
        "readable",
        "array(12, 12, nz) AS size_xyz",
        "array(0.8e0, 0.8e0, sp) AS spacing_xyz",
        "array(ox, -50e0, 20e0) AS origin_xyz",
        "array(1e0, skew, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 1e0) AS direction",
    )
