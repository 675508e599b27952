"""File-based sources and sinks on temporary folders."""

import hashlib

import pytest

from caseward.operators.calibrate import content_fingerprint
from caseward.sources import readers as rd


def test_discovery_and_inventory(spark, tmp_path):
    (tmp_path / "A1_0000.nii.gz").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"y")
    rows = rd.discover(spark, str(tmp_path)).collect()
    assert [(r.case_id, r.size_bytes) for r in rows] == [("A1", 1)]
    hashes = {r.path.rsplit("/", 1)[1]: r.sha256 for r in rd.inventory(spark, str(tmp_path)).collect()}
    assert hashes["notes.txt"] == hashlib.sha256(b"y").hexdigest()


def test_csv_contract(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes(b"\xef\xbb\xbfreview_id,case_id\nR1,a\nR2,b\n")
    assert rd.read_csv(spark, str(good), "review_id", ("review_id", "case_id")).count() == 2
    bad = tmp_path / "bad.csv"
    bad.write_text("review_id,case_id\nR1,a\nR1,b\n")
    with pytest.raises(ValueError):
        rd.read_csv(spark, str(bad), "review_id", ("review_id",))
    with pytest.raises(ValueError):
        rd.read_csv(spark, str(good), "review_id", ("review_id", "score"))


def test_artifact_id_ignores_order_and_time(spark, tmp_path):
    data = spark.createDataFrame([("a", 1, "t1"), ("b", 2, "t2")], "case_id string, v int, created_at string")
    later = spark.createDataFrame([("b", 2, "t9"), ("a", 1, "t8")], "case_id string, v int, created_at string")
    ids = [
        rd.write_artifact(df, str(tmp_path / n), "t", "run", "set", "pancreas_only", n).first()["artifact_id"]
        for n, df in (("x", data), ("y", later))
    ]
    assert ids[0] == ids[1]
    assert content_fingerprint(data, ["v"]).first() == content_fingerprint(later, ["v"]).first()
    assert content_fingerprint(data, ["v"]).first() != content_fingerprint(data.limit(1), ["v"]).first()
