"""Embedding near-dedup against all pairs of a label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseward.llm import cells

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell int, vector string"


def brute(rows, threshold=0.93):
    good = []
    for i, (_, vector, label) in enumerate(rows):
        usable = label is not None and vector and None not in vector and np.isfinite(vector).all() and np.any(vector)
        good.append(np.array(vector, float) if usable else None)
    links = [[] for _ in rows]
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    links[i].append(j)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i] if group[i] == i else []
        while todo:
            for j in links[todo.pop()]:
                if group[j] > i:
                    group[j] = i
                    todo.append(j)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(known) if known else None
        out.append((vec, len(links[i]), least, vec == least))
    return sorted(map(repr, out))


def found(vectors, **options):
    return sorted(repr(tuple(r)) for r in cells.grouped(vectors, **options).collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    centres = rng.standard_normal((6, 8))
    for n in range(400):
        v = centres[n % 6] + rng.standard_normal(8) * rng.choice([0.1, 0.3, 1.0])
        rows.append((n + 1, [float(x) for x in v.astype(np.float32)], (0, 0, 0, 1, None)[n % 5]))
    rows += [rows[3], rows[3], (900, rows[3][1], 0), (901, rows[3][1], 1), (None, rows[3][1], rows[3][2]), (None, [1.0] * 8, 7)]
    rows += [(902, None, 0), (903, [], 0), (904, [0.0] * 8, 0), (905, [1.0, None] * 4, 0), (906, [float("nan")] * 8, 0), (907, [float("inf")] * 8, 0)]
    rows += [(908, [1e-30] * 8, 3), (909, [3e38] * 8, 3), (910, [1.0] * 3, 3), (911, [-0.0, 1.0], 3), (912, [0.0, 1.0], 3), (913, [-1.0] * 8, 3)]
    return rows, spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("options", [{}, {"cell": 20}, {"cell": 40, "piece": 7}, {"cell": 10, "max_cells": 4, "piece": 1000}])
def test_groups_equal_brute_force(vectors, options):
    rows, table = vectors
    assert found(table, **options) == brute(rows)


def test_whole_table_of_the_smallest_scale(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert found(table, cell=16) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_vectors_in_clusters_have_few_guests(spark):
    """With clusters the cells do the work: hardly a vector is sent to a second one."""
    rng = np.random.default_rng(2)
    centres = np.eye(32)[:16]
    rows = [(n, [float(x) for x in centres[n % 16] + rng.standard_normal(32) * 0.02], 0) for n in range(1600)]
    nodes = cells.keyed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    nodes = nodes.withColumns({"node": F.col("vec_id"), "size": F.lit(1).cast("long")})
    placed = cells.dealt(nodes, cell=50)
    assert placed.count() < 2.2 * 1600 and placed.select("cell").distinct().count() >= 12
