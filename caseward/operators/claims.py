"""Conflict summaries, claim audit and forbidden-field audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import DOMAINS
from caseward.functions.sql import case, compact, lit, project

QC_FIELDS = ("availability", "reported_recommendation", "risk_level", "score", "primary_domain")
COMPARISON_FIELDS = ("availability", "changed", "recommendation_change", "risk_change", "score_delta")
SOURCES = {"deterministic": QC_FIELDS, "calibrated": QC_FIELDS, "comparison": COMPARISON_FIELDS}
CONFLICT_FIELDS = QC_FIELDS[1:]
# Key tokens and names explanatory records must not carry.
REASONING_TOKENS = ("decision", "route", "routing", "action")
CRITIQUE_TOKENS = ("decision", "route", "routing", "action", "block", "blocking")
FORBIDDEN_NAMES = ("final_decision", "route_to_review", "policy_action")


def snapshot_columns(source: str) -> dict[str, str]:
    """Evidence snapshot of an aligned artifact (R1); all but availability null when missing."""
    if source == "comparison":
        body = {
            "changed": "coalesce(comparison.changed, false)",
            "recommendation_change": "coalesce(comparison.recommendation_change, 'unknown')",
            "risk_change": "coalesce(comparison.risk_change, 'unknown')",
            "score_delta": "comparison.score_delta",
        }
    else:
        body = {
            "reported_recommendation": f"coalesce({source}.triage.recommendation, 'unknown')",
            "risk_level": f"coalesce({source}.triage.risk_level, 'unknown')",
            "score": f"CAST({source}.triage.score AS DOUBLE)",
            "primary_domain": f"{source}.primary_issue.domain",
        }
    there = f"{source} IS NOT NULL"
    return {
        "availability": f"CASE WHEN {there} THEN 'available' ELSE 'missing' END",
        **{k: f"CASE WHEN {there} THEN {v} END" for k, v in body.items()},
    }


def snapshots(aligned: DataFrame) -> DataFrame:
    """Snapshot structs of the three sources, one row per case."""
    struct = lambda cols: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in cols.items()) + ")"
    return project(aligned, {s: struct(snapshot_columns(s)) for s in SOURCES}, ["case_id"])


def abnormal_domains(source: str) -> str:
    """Sorted ``domain=severity`` texts of the abnormal domains."""
    items = [
        f"CASE WHEN {source}.qc_domains.{d}.severity NOT IN ('normal', 'not_applicable')"
        f" THEN concat('{d}=', {source}.qc_domains.{d}.severity) END"
        for d in sorted(DOMAINS)
    ]
    return compact(items)


def conflict_fields(left: str = "deterministic", right: str = "calibrated") -> str:
    """Fields two available snapshots state differently."""
    both = f"{left}.availability = 'available' AND {right}.availability = 'available'"
    return compact([f"CASE WHEN {both} AND NOT ({left}.{f} <=> {right}.{f}) THEN '{f}' END" for f in CONFLICT_FIELDS])


def conflict_summary(snaps: DataFrame, identity_issues: tuple[str, ...] = (), declared: str = "true") -> DataFrame:
    """Conflicts, uncertainty codes and status per case (R2); narrow."""
    df = project(snaps, {"conflicts": conflict_fields()})
    codes = [f"CASE WHEN {s}.availability = 'missing' THEN 'missing_{s}_case' END" for s in SOURCES]
    codes.append("CASE WHEN size(conflicts) > 0 THEN 'deterministic_calibrated_conflict' END")
    codes.append(
        "CASE WHEN comparison.availability = 'available' AND comparison.changed <> (size(conflicts) > 0)"
        " THEN 'comparison_alignment_inconsistency' END"
    )
    codes.append(f"CASE WHEN NOT ({declared}) THEN 'case_not_declared_in_context' END")
    codes += ["'artifact_identity_mismatch'" for _ in identity_issues]
    df = project(df, {"uncertainty": compact(codes)})
    status = case(
        [
            (
                "deterministic.availability = 'missing' AND calibrated.availability = 'missing'",
                "'insufficient_evidence'",
            ),
            ("size(uncertainty) > 0", "'partial'"),
        ],
        "'complete'",
    )
    return project(df, {"status": status})


def identity_issues(contexts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Identity mismatches of run inputs against their context (R3), sorted text per run.

    ``contexts``: (run_key, run_id, dataset_name, task_mode); ``inputs`` adds ``source``.
    """
    fields = ("run_id", "dataset_name", "task_mode")
    left = contexts.select("run_key", *[F.col(f).alias(f"c_{f}") for f in fields])
    items = [
        f"CASE WHEN c_{f} <> {f} THEN concat(source, '_{f}_mismatch:', {f}, '!=', c_{f}) END" for f in fields
    ]
    issues = inputs.join(left, "run_key").selectExpr("run_key", f"explode({compact(items)}) AS issue")
    # A run has a handful of inputs, so the list per run stays small.
    return issues.groupBy("run_key").agg(F.array_sort(F.collect_set("issue")).alias("issues"))


def claim_checks(claimed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Long table of claim checks: (case_id, claim, supported).

    Both sides carry the three snapshot structs.  A field is checked when either
    side has the source.
    """
    pairs = claimed.select("case_id", *[F.col(s).alias(f"c_{s}") for s in SOURCES]).join(
        evidence.select("case_id", *[F.col(s).alias(f"e_{s}") for s in SOURCES]), "case_id"
    )
    items = []
    for source, fields in SOURCES.items():
        known = f"(c_{source}.availability = 'available' OR e_{source}.availability = 'available')"
        for f in fields:
            test = "true" if f == "availability" else known
            items.append(
                f"CASE WHEN {test} THEN named_struct('claim', '{source}.{f}', 'supported',"
                f" c_{source}.{f} <=> e_{source}.{f}) END"
            )
    exploded = pairs.selectExpr("case_id", f"explode({compact(items)}) AS r")
    return exploded.select("case_id", "r.claim", "r.supported")


def claim_audit(reasoning: DataFrame, evidence: DataFrame, identity: tuple[str, ...] = ()) -> DataFrame:
    """Audit record per case.

    ``reasoning``: snapshot structs and ``conflicts``; ``evidence``: snapshot
    structs.  Claims are counted in the row itself, one join and no explode.
    """
    left = reasoning.select("case_id", F.struct(*SOURCES, "conflicts").alias("claim"))
    df = evidence.join(left, "case_id", "left")
    supported, checked = [], []
    for source, fields in SOURCES.items():
        known = f"({source}.availability = 'available' OR claim.{source}.availability = 'available')"
        for f in fields:
            test = "claim IS NOT NULL" if f == "availability" else f"claim IS NOT NULL AND {known}"
            checked.append(f"CAST({test} AS INT)")
            supported.append(f"CAST({test} AND (claim.{source}.{f} <=> {source}.{f}) AS INT)")
    df = project(
        df,
        {
            "n_supported": " + ".join(supported),
            "n_checked": " + ".join(checked),
            "omitted_conflicts": f"CASE WHEN claim IS NOT NULL THEN array_sort(array_except({conflict_fields()},"
            " claim.conflicts)) ELSE CAST(array() AS ARRAY<STRING>) END",
            "evidence_gaps": compact(
                [
                    "CASE WHEN claim IS NULL THEN 'missing_reasoning_case' END",
                    *[f"CASE WHEN {s}.availability = 'missing' THEN 'missing_{s}_evidence_case' END" for s in SOURCES],
                ]
            ),
        },
    )
    high = [
        "claim IS NULL",
        "n_supported < n_checked",
        "deterministic.availability = 'missing'",
        "calibrated.availability = 'missing'",
    ] + (["true"] if identity else [])
    severity = case(
        [
            (" OR ".join(high), "'high'"),
            ("size(omitted_conflicts) > 0 OR comparison.availability = 'missing'", "'medium'"),
        ],
        "'none'",
    )
    return project(
        df,
        {
            "n_supported": "n_supported",
            "n_unsupported": "n_checked - n_supported",
            "omitted_conflicts": "omitted_conflicts",
            "evidence_gaps": "evidence_gaps",
            "severity": severity,
            "status": "CASE WHEN claim IS NOT NULL AND size(evidence_gaps) = 0 THEN 'complete' ELSE 'audit_limited' END",
        },
        ["case_id"],
    )


def forbidden_keys(text: str, tokens: tuple[str, ...], names: tuple[str, ...] = ()) -> str:
    """Sorted forbidden keys in a JSON text at any depth.

    The text is read literal by literal: quotes open and close string literals only,
    so a literal before a colon is a key, and what looks like one inside a value is
    part of that value's literal.  Escapes in keys are decoded.
    """
    literal = r"""r'"(?:[^"\\]|\\.)*"\s*:?'"""
    named = f"filter(regexp_extract_all({text}, {literal}, 0), s -> endswith(s, ':'))"
    keys = f"transform({named}, s -> lower(from_json(concat('[', rtrim(':', s), ']'), 'array<string>')[0]))"
    exact = " OR ".join(f"k = {lit(n)}" for n in names) or "false"
    starts = "|".join(tokens)
    hit = f"k RLIKE '(^|_)({starts})' OR {exact}"
    return f"array_sort(array_distinct(filter({keys}, k -> {hit})))"
