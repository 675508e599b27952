"""Decisions across task profiles, each from its own run, held against plain Python."""

from collections import Counter

from caseward.config import DOMAINS, TASK_NOTATION
from caseward.operators import analysis as an
from caseward.plans.profiles import profile_runs
from caseward.sources import derived_reports as dr
from caseward.sources.derived import case_summary
from caseward.sources.shared import stored

SF = "/root/testdata/sf0.001"


def abnormal(severity):
    return severity not in ("normal", "not_applicable")


def test_profiles_judge_by_their_own_rules(spark):
    cases = stored(case_summary(spark, SF), "cases")
    runs = stored(profile_runs(cases, dr.validation_rows(spark, SF)), "runs")
    rows = [r.asDict(recursive=True) for r in runs.collect()]
    by = {p: {r["case_id"]: r for r in rows if r["profile"] == p} for p in TASK_NOTATION.values()}
    assert len(rows) == 3 * len(by["tau_P"]) and all(len(x) == len(by["tau_P"]) for x in by.values())
    assert len(by["tau_P"]) >= cases.count()
    # What a task does not look at has no severity there, but has one where it counts.
    assert {r["severities"]["lesion_localization"] for r in by["tau_P"].values()} == {"not_applicable"}
    assert {r["severities"]["region_consistency"] for r in by["tau_L"].values()} == {"not_applicable"}
    assert len({r["severities"]["region_consistency"] for r in by["tau_S"].values()}) > 2

    wide = stored(an.side_by_side(runs), "wide")
    triples = [tuple(by[p][c] for p in an.PROFILES) for c in by["tau_P"]]
    stable = [t for t in triples if len({r["action"] for r in t}) == 1]
    changing = [t for t in triples if len({r["action"] for r in t}) > 1]
    got = an.stability(wide).first()
    assert (got["aligned"], got["stable"], got["changed"]) == (len(triples), len(stable), len(changing))

    moves, mechanisms = Counter(), Counter()
    for one in triples:
        side = dict(zip(an.PROFILES, one, strict=True))
        for p, q in an.PAIRS:
            a, b = side[p], side[q]
            moves[f"{p}_to_{q}", a["action"], b["action"]] += 1
            if a["action"] == b["action"]:
                continue
            found = [f"basis: {a['basis']} -> {b['basis']}"] if a["basis"] != b["basis"] else []
            if a["routed"] != b["routed"]:
                found.append("routing: entered review" if b["routed"] else "routing: left review")
            if a["hard_failure"] and not b["hard_failure"]:
                found.append("status: left hard failure")
            if a["primary_domain"] != b["primary_domain"]:
                found.append("primary_domain_changed")
            for d in DOMAINS:
                x, y = a["severities"][d], b["severities"][d]
                if y != "not_applicable" and x != y:
                    found.append(f"task-relevant domain: {d}" if x == "not_applicable" else f"changed shared domain: {d}")
            mechanisms.update((f"{p}_to_{q}", m) for m in found)
    assert {(r["pair"], r["source"], r["target"]): r["n"] for r in an.transition_matrix(wide).collect()} == moves
    assert {(r["pair"], r["mechanism"]): r["n"] for r in an.change_mechanisms(wide).collect()} == mechanisms
    kinds = {m.split(":")[0] for _, m in mechanisms}
    assert kinds == {"basis", "routing", "status", "primary_domain_changed", "task-relevant domain", "changed shared domain"}

    for r in an.domain_prevalence(wide).collect():
        count = lambda part: sum(any(abnormal(x["severities"][r["domain"]]) for x in t) for t in part)  # noqa: B023, E731
        assert (r["stable_n"], r["changing_n"]) == (count(stable), count(changing))
