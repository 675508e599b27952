"""Review sampling: exactly 60, stratified, reproducible, no better case left out at any step."""

import hashlib
import re

import pytest

from caseward.operators import lookups as lk
from caseward.operators import review as rv
from caseward.sources.shared import stored

SCHEMA = "case_id string, action string, tokens array<string>, edge int, key string"


def pool_rows():
    actions = ["keep"] * 40 + ["warning"] * 30 + ["review"] * 50 + ["reject"] * 6 + ["insufficient_evidence"] * 9
    rows = []
    for i, action in enumerate(actions):
        tokens = sorted({f"domain:{i % 8}", f"target_presence:{i % 3}", f"policy:VP-{i % 5}"})
        cid = f"case{i:03d}"
        rows.append((cid, action, tokens, i * 7 % 11, hashlib.sha256(f"{rv.SEED}:{cid}".encode()).hexdigest()))
    return rows


def worth(row, covered):
    return (len(set(row[2]) - covered), row[3], [-ord(c) for c in row[4]])


def test_no_case_left_out_is_worth_more(spark):
    rows = {r[0]: r for r in pool_rows()}
    got = rv.select_cases(spark.createDataFrame(list(rows.values()), SCHEMA).repartition(5))
    assert got == rv.select_cases(spark.createDataFrame(list(rows.values()), SCHEMA))
    assert len({c for c, _ in got}) == 60
    stages = [s for _, s in got]
    assert [stages.count(f"quota:{a}") for a in ("keep", "warning", "review", "reject")] == [15, 15, 15, 6]
    everything = set()
    for stage in dict.fromkeys(stages):
        drawn = [c for c, s in got if s == stage]
        fill = stage == "diverse_edge_fill"
        covered = set(everything) if fill else set()
        before = {c for c, s in got if s != stage} if fill else set()
        for n, case in enumerate(drawn):
            open_ = [r for r in rows.values() if r[0] not in {*drawn[:n], *before} and (fill or r[1] == stage[6:])]
            assert max(worth(r, covered) for r in open_) == worth(rows[case], covered)
            covered |= set(rows[case][2])
        everything |= covered


def test_actions_without_a_quota_can_fill(spark):
    rows = [r if r[1] != "insufficient_evidence" else (r[0], "other", ["domain:new"], 99, r[4]) for r in pool_rows()]
    got = rv.select_cases(spark.createDataFrame(rows, SCHEMA))
    assert len({c for c, s in got if rows[int(c[4:])][1] == "other"}) == 9


def test_too_few_cases_fail(spark):
    with pytest.raises(ValueError):
        rv.select_cases(spark.createDataFrame(pool_rows()[:50], SCHEMA))


def test_import_checks_the_whole_package(spark):
    fields = "review_id string, case_id string, annotation_completeness string, expected_action string, reviewer_id string, confidence string, rationale string"
    ids = [f"c{n}" for n in range(60)]
    pid = rv.package_id(7, {"final": "f", "validation": "v", "deterministic": "d"}, ids)
    ref = "package_id string, review_id string, case_id string, selection_seed string, final_decisions_sha256 string, dataset_validation_sha256 string, deterministic_evidence_sha256 string"

    def review(rows):
        return spark.createDataFrame([(f"R{n:03d}", c, "Complete", "KEEP", "r", "0.5", "fine") for n, c in rows], fields)

    def reference(rows, package):
        return spark.createDataFrame([(package, f"R{n:03d}", c, "7", "f", "v", "d") for n, c in rows], ref)

    rows = list(enumerate(ids))
    assert {r["expected_action"] for r in rv.import_labels(review(rows), reference(rows, pid)).collect()} == {"keep"}
    for package, part in (("other", rows), (pid, rows[:59]), (pid, [*rows, (60, "c60")]), (pid, [*rows[:59], (59, "c0")]), (pid, [*rows[:59], (58, "c59")]), (pid, [*rows[:59], (59, " ")])):
        with pytest.raises(ValueError):
            rv.import_labels(review(part), reference(part, package)).collect()


def test_blinded_numbers_are_one_order(spark):
    cases = [f"c{n}" for n in range(1200)]
    rows = rv.review_ids(spark.createDataFrame([(c,) for c in cases], "case_id string"), 5).collect()
    want = sorted(cases, key=lambda c: hashlib.sha256(f"6:{c}".encode()).hexdigest())
    assert {r["case_id"]: r["review_id"] for r in rows} == {c: f"R{n:03d}" for n, c in enumerate(want, 1)}


def test_cases_stay_where_they_are(spark, monkeypatch):
    """The drawn rows go to the cases: a package and a lookup neither broadcast nor shuffle the cases."""
    present = "named_struct('annotation_presence', 'present', 'observed_presence', 'present', 'visible_target_annotation_status', 'complete')"
    aligned = stored(
        spark.range(200).selectExpr(
            "concat('c', id) AS case_id",
            "named_struct('final_decision', CASE id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'warning' WHEN 2 THEN 'review' ELSE 'reject' END,"
            " 'primary_domain', 'd', 'risk_level', 'low', 'policy_rules_triggered', array('P')) AS final",
            f"named_struct('target_presence', {present}, 'triage', named_struct('recommendation', 'keep', 'risk_level', 'low', 'score', 1D)) AS deterministic",
            "named_struct('image_path', concat('/i/', id), 'segmentation_dir', concat('/s/', id), 'status', 'valid', 'omit_from_training', false) AS validation",
        ),
        "cases",
    )
    plans = {}

    def kept(df, name="table"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(rv, "stored", kept)
    reviewer, system = rv.build_package(aligned, {"m": "m.nii.gz"}, {"run_id": "r"}, {"final": "f"})
    assert "BuildRight" in plans["picked"] and plans["picked"].count("Exchange") == 1
    ids = {r["case_id"]: r["review_id"] for r in reviewer.collect()}
    assert len(ids) == 60 and ids == {r["case_id"]: r["review_id"] for r in system.collect()}
    looked = lk.selection_lookup(aligned, system)
    assert looked._jdf.queryExecution().executedPlan().toString().count("BuildRight") >= 1
    rows = looked.collect()
    assert len(rows) == 200 and {r["case_id"] for r in rows if r["selected"]} == set(ids)


def test_import_counts_repeats_on_ids_alone(spark):
    """Review texts go to the grouping by review id and take no part in a join; repeats are told for every review id."""
    fields = "review_id string, case_id string, annotation_completeness string, expected_action string, reviewer_id string, confidence string, rationale string"
    cases = [("R1", "a"), ("R2", " a"), ("R3", None), ("R4", ""), ("R5", "e"), ("R5", "f")]
    reviews = spark.createDataFrame([(r, c, "complete", "keep", "r", "1", "fine") for r, c in cases], fields)
    reference = spark.createDataFrame([("R1", "a"), ("R2", "e"), ("R5", "e")], "review_id string, case_id string")
    found = rv.import_violations(reviews, reference)

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    joins = [n for n in nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert len(joins) == 2 and not any(re.search(r"\breview#", n.output().toString()) for n in joins)
    by = {}
    for r in found.collect():
        by.setdefault(r["review_id"], set()).add(r["violation"])
    assert by == {
        "R1": {"duplicate_review_case"},
        "R2": {"duplicate_review_case", "duplicate_reference_case", "case_mismatch"},
        "R3": {"duplicate_review_case", "unexpected_review", "blank_case_id"},
        "R4": {"duplicate_review_case", "unexpected_review", "blank_case_id"},
        "R5": {"duplicate_review", "duplicate_reference_case", "case_mismatch"},
    }
