"""Measured cases, from voxels to decisions."""

import itertools

from caseward.config import Settings
from caseward.operators.assembly import assemble
from caseward.plans.run import run

VOXEL = "case_id string, z int, y int, x int, hu int, pancreas int, lesion int, head int, body int, tail int"
GEOMETRY = "case_id string, resource string, exists boolean, readable boolean, size_xyz array<int>, spacing_xyz array<double>, origin_xyz array<double>, direction array<double>"


def box(case, low, high, hu, masks):
    for z, y, x in itertools.product(*[range(a, b) for a, b in zip(low, high, strict=True)]):
        values = [masks(z, y, x).get(m, 0) for m in ("pancreas", "lesion", "head", "body", "tail")]
        yield (case, z, y, x, hu + (z + y + x) % 7, *values)


def tables(spark):
    def organ(z, y, x):
        part = "head" if x < 10 else "body" if x < 20 else "tail"
        return {"pancreas": 1, part: 1, "lesion": int((z, y, x) in lesion)}

    lesion = set(itertools.product(range(4, 8), range(4, 8), range(12, 16))) | {(2, 2, 2), (2, 2, 3)}
    cells = [*box("good", (1, 1, 1), (11, 11, 29), 40, organ), *box("stray", (1, 1, 1), (3, 3, 3), 40, lambda z, y, x: {"lesion": 1})]
    grid = ([40, 20, 20], [2.0, 2.0, 3.0], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])
    geometry = [(c, r, True, c != "unread", *grid) for c in ("good", "stray", "empty", "unread") for r in ("image", "pancreas", "lesion", "head", "body", "tail")]
    known = [("good", True), ("stray", True), ("empty", True), ("unread", False)]
    return spark.createDataFrame(known, "case_id string, image_readable boolean"), spark.createDataFrame(cells, VOXEL), spark.createDataFrame(geometry, GEOMETRY)


def test_blocks_of_measured_cases(spark):
    rows = {r["case_id"]: r.asDict(recursive=True) for r in assemble(*tables(spark), tile=4).collect()}
    assert set(rows) == {"good", "stray", "empty", "unread"}
    good = rows["good"]
    assert good["image"] == {"shape_zyx": [20, 20, 40], "spacing_xyz_mm": [2.0, 2.0, 3.0]}
    assert good["pancreas"]["volume_mm3"] == 2800 * 12.0 and good["pancreas"]["bounding_box_zyx"] == [[1, 1, 1], [10, 10, 28]]
    assert good["pancreas"]["region_consistency"]["relative_error_vs_pancreas"] == 0
    lesions = good["lesions"]["per_lesion"]
    assert [(x["lesion_id"], x["volume_mm3"], x["dominant_region"]) for x in lesions] == [(1, 24.0, "head"), (2, 768.0, "body")]
    assert good["lesions"]["n_lesions"] == 2 and good["lesions"]["total_volume_mm3"] == 792.0
    quality = good["quality_control"]
    assert quality["lesion_annotation_evidence"]["status"] == "lesion_present" and quality["total_overlap_rate_vs_lesion"] == 1.0
    assert good["hu_statistics"]["tumor_voxel_count"] == 66 and good["hu_statistics"]["hu_statistics_status"] == "full"
    assert rows["stray"]["quality_control"]["pancreas_mask_empty"] and rows["stray"]["quality_control"]["total_overlap_rate_vs_lesion"] == 0
    assert rows["empty"]["lesions"]["n_lesions"] == 0 and rows["empty"]["quality_control"]["lesion_annotation_evidence"]["status"] == "confirmed_absent"
    assert rows["unread"]["case_status"]["omit_from_training"] and not rows["empty"]["case_status"]["omit_from_training"]


def test_decisions_start_from_voxels(spark):
    cases = assemble(*tables(spark), tile=4)
    checks = cases.selectExpr("case_id", "'valid' AS status", "case_status.omit_from_training", "'i' AS image_path", "'s' AS segmentation_dir")
    rows = {r["case_id"]: r["final"] for r in run(cases, checks, Settings("pancreas_lesion")).select("case_id", "final").collect()}
    assert set(rows) == {"good", "stray", "empty", "unread"}
    assert rows["unread"]["final_decision"] == rows["stray"]["final_decision"] == "reject"
    assert rows["good"]["final_decision"] != "reject"


def test_cells_are_made_once(spark):
    known, voxels, geometry = tables(spark)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    assert len(assemble(known, voxels.mapInArrow(counted, VOXEL), geometry, 4).collect()) == 4
    assert made.value == voxels.count()
