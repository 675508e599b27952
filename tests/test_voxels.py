"""Tiled components, holes and erosion against brute force on small volumes."""

import random

import pytest

from caseward.operators import components as cc
from caseward.operators import voxels as vx

STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def volume(seed, density):
    rng = random.Random(seed)
    return {(z, y, x) for z in range(7) for y in range(8) for x in range(9) if rng.random() < density}


def flood(cells):
    label = {}
    for start in sorted(cells):
        if start in label:
            continue
        stack = [start]
        label[start] = start
        while stack:
            z, y, x = stack.pop()
            for dz, dy, dx in STEPS:
                n = (z + dz, y + dy, x + dx)
                if n in cells and n not in label:
                    label[n] = start
                    stack.append(n)
    return label


def frame(spark, volumes):
    rows = [(name, *cell) for name, cells in volumes.items() for cell in cells]
    return spark.createDataFrame(rows, "case_id string, z int, y int, x int")


@pytest.mark.parametrize("tile", [2, 32])
def test_components_match_brute_force(spark, tile):
    volumes = {"a": volume(1, 0.35), "b": volume(2, 0.6)}
    got = cc.label_components(frame(spark, volumes), tile)
    numbers = {(r.case_id, r.root): r.lesion_id for r in cc.number_components(got).collect()}
    found = {(r.case_id, r.z, r.y, r.x): r.root for r in got.collect()}
    for name, cells in volumes.items():
        label = flood(cells)
        order = {root: i for i, root in enumerate(sorted(set(label.values())), 1)}
        for cell, (z, y, x) in label.items():
            root = found[(name, *cell)]
            assert root == (z << 40) + (y << 20) + x
            assert numbers[(name, root)] == order[(z, y, x)]


@pytest.mark.parametrize("tile", [3, 32])
def test_holes_match_brute_force(spark, tile):
    volumes = {"a": volume(3, 0.8), "b": volume(4, 0.9)}
    got = {tuple(r) for r in cc.enclosed_cells(frame(spark, volumes), tile).collect()}
    expected = set()
    for name, cells in volumes.items():
        grid = {(z, y, x) for z in range(-1, 8) for y in range(-1, 9) for x in range(-1, 10)} - cells
        label = flood(grid)
        expected |= {(name, *c) for c in grid if label[c] != label[(-1, -1, -1)]}
    assert got == expected and expected


def test_erosion_matches_brute_force(spark):
    cells = volume(5, 0.95)
    got = {tuple(r)[1:] for r in cc.erode(frame(spark, {"a": cells})).collect()}
    assert got == {c for c in cells if all(tuple(a + d for a, d in zip(c, s)) in cells for s in STEPS)}


def test_a_winding_tube_needs_few_rounds(spark, monkeypatch):
    """A tube through more than 200 tiles of side 2 is one component after ten rounds at most."""
    from caseward.operators import connected

    path = []
    for y in range(0, 40, 2):
        path += [(0, y, x) for x in (range(24) if y % 4 == 0 else range(23, -1, -1))]
        path.append((0, y + 1, 23 if y % 4 == 0 else 0))
    rounds = []

    class Counted(connected.Stored):
        def __init__(self, df, name):
            rounds.append(name)
            super().__init__(df, name)

    monkeypatch.setattr(connected, "Stored", Counted)
    got = cc.label_components(spark.createDataFrame([("t", *c) for c in path], "case_id string, z int, y int, x int"), 2)
    assert got.select("root").distinct().count() == 1 and got.count() == len(path)
    assert len(rounds) - 1 <= 10


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Jobs started in another folder ship the functions that their tasks run."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.append({root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from __spark_entry__ import queries
registered = queries()
for name in ("g08_connected_components", "g15_erosion", "g16_pancreas_hu"):
    registered[name](spark, "/root/testdata/sf0.001").count()
print("all done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in done.stdout, done.stderr[-2000:]


def test_components_of_random_masks_equal_flood_fill(spark):
    """Runs of many tiles and cases in one batch, tiles of several sizes."""
    import random

    rng = random.Random(8)
    masks = {f"c{n}": {(rng.randrange(9), rng.randrange(9), rng.randrange(9)) for _ in range(rng.choice([1, 60, 250]))} for n in range(12)}
    want = set()
    for case, cells in masks.items():
        left = set(cells)
        while left:
            todo, part = [left.pop()], []
            while todo:
                z, y, x = todo.pop()
                part.append((z, y, x))
                for near in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
                    if near in left:
                        left.remove(near)
                        todo.append(near)
            z, y, x = min(part)
            want |= {(case, *cell, (z << 20 | y) << 20 | x) for cell in part}
    table = spark.createDataFrame([(k, *c) for k, cells in masks.items() for c in cells], "case_id string, z int, y int, x int")
    for tile in (2, 4, 32):
        assert {tuple(r) for r in cc.label_components(table, tile).collect()} == want


def test_one_large_volume(spark):
    """A 512-cube case: a hollow box and a rod inside it, over thousands of tiles."""
    side = "explode(sequence(0, 511))"
    faces = spark.range(512).selectExpr("int(id) AS a").selectExpr("a", f"{side} AS b")
    walls = [faces.selectExpr(*[f"{v} AS {n}" for n, v in zip("zyx", order, strict=True)]) for k in (0, 511) for order in ((k, "a", "b"), ("a", k, "b"), ("a", "b", k))]
    box = walls[0]
    for wall in walls[1:]:
        box = box.unionByName(wall)
    rod = spark.range(10, 500).selectExpr("250 AS z", "int(id) AS y", "250 AS x")
    found = cc.label_components(box.unionByName(rod).distinct().selectExpr("'big' AS case_id", "z", "y", "x"))
    sizes = sorted(r["count"] for r in found.groupBy("root").count().collect())
    assert sizes == [490, 512**3 - 510**3]


def test_holes_leak_across_tiles(spark):
    """A tunnel through several tiles is a hole until its last cell gets a way out."""
    block = {(z, y, x) for z in range(3) for y in range(3) for x in range(15)}
    tunnel = {(1, 1, x) for x in range(1, 13)}
    volumes = {"closed": block - tunnel, "leak": block - tunnel - {(1, 0, 12)}}
    got = {tuple(r) for r in cc.enclosed_cells(frame(spark, volumes), 4).collect()}
    assert got == {("closed", *cell) for cell in tunnel}


def test_histogram_is_made_once(spark):
    cells = frame(spark, {"a": volume(5, 0.8)}).selectExpr("*", "z * 10 + x AS hu", "1 AS pancreas", "int(x = 4) AS lesion")
    plan = vx.hu_statistics(cells, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
