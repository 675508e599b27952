"""Final decisions: rule composition and the ordered first-match policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import (
    ACTION_OF_RECOMMENDATION,
    ACTIONS,
    DOMAINS,
    ROUTING_POLICY_VERSION,
    VISIBLE_PANCREAS_POLICY,
    policy_domains,
)
from caseward.functions.sql import case, compact, has_field, lit, project, some
from caseward.operators.compare import disagrees
from caseward.operators.routing import deterministic_rules, missing_rules, review_rules, sorted_set, validation_rules

OPERATORS = ("equals", "not_equals", "in", "not_in", "exists", "truthy", "falsy")


def action_of(recommendation: str) -> str:
    """Canonical action of a recommendation; unknown text gives insufficient evidence."""
    steps = [(f"lower({recommendation}) = {lit(k)}", lit(v)) for k, v in ACTION_OF_RECOMMENDATION.items()]
    return case(steps, "'insufficient_evidence'")


def _common(names: list[str]) -> dict[str, str]:
    known = "validation" in names
    return {
        "deterministic_recommendation": "deterministic.triage.recommendation",
        "calibrated_recommendation": "calibrated.triage.recommendation",
        "dataset_validation_status": "validation.status" if known else "CAST(NULL AS STRING)",
        "dataset_validation_omit_from_training": "validation.omit_from_training" if known else "CAST(NULL AS BOOLEAN)",
        "risk_level": "coalesce(calibrated.triage.risk_level, deterministic.triage.risk_level)",
        "primary_domain": "coalesce(deterministic.primary_issue.domain, calibrated.primary_issue.domain)",
    }


def decide_composed(aligned: DataFrame, task_mode: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """Reject, insufficient evidence, review, else the mapped calibrated recommendation (P10)."""
    hard, soft = policy_domains(task_mode)
    names = aligned.columns
    hard_rules = deterministic_rules(aligned, hard)
    if "validation" in names:
        hard_rules = validation_rules() + hard_rules
    own = review_rules(aligned, soft, mapped=True)
    own.append(f"CASE WHEN {disagrees()} THEN 'deterministic_calibrated_disagreement' END")
    df = project(
        aligned,
        {
            "__hard": compact(hard_rules),
            "__missing": compact(missing_rules()),
            "__own": compact(own),
            "__failed": some(hard_rules),
            "__lacking": some(missing_rules()),
            "__objected": some(own),
            "__routed": "coalesce(routing.route_to_review, false)" if "routing" in names else "false",
            "__mapped": action_of("calibrated.triage.recommendation"),
        },
    )
    listed = "CAST(array() AS ARRAY<STRING>)"
    if "routing" in names:
        listed = case(
            [
                ("size(routing.policy_rules_triggered) > 0", "routing.policy_rules_triggered"),
                ("size(routing.route_reasons) > 0", "routing.route_reasons"),
            ],
            "array('review_routing')",
        )
    df = project(
        df,
        {
            "final_decision": case(
                [
                    ("__failed", "'reject'"),
                    ("__lacking", "'insufficient_evidence'"),
                    ("__routed OR __objected", "'review'"),
                ],
                "__mapped",
            )
        },
    )
    live = "NOT __failed AND NOT __lacking"
    none = "CAST(array() AS ARRAY<STRING>)"
    trail = "concat('calibrated_recommendation_mapped:', coalesce(calibrated.triage.recommendation, 'None'), '->', __mapped)"
    mapped = f"{live} AND NOT __routed AND NOT __objected"
    rules = (
        f"concat(__hard, CASE WHEN __failed THEN {none} ELSE __missing END,"
        f" CASE WHEN {live} AND __routed THEN {listed} ELSE {none} END,"
        f" CASE WHEN {live} THEN __own ELSE {none} END,"
        f" CASE WHEN {mapped} THEN array({trail}) ELSE {none} END,"
        f" CASE WHEN {mapped} AND __mapped = 'insufficient_evidence'"
        f" THEN array('insufficient_evidence:unrecognized_calibrated_recommendation') ELSE {none} END)"
    )
    basis = case(
        [
            ("__failed", "'deterministic_hard_failure'"),
            ("final_decision = 'insufficient_evidence'", "'insufficient_evidence'"),
            ("__routed OR __objected", "'review_routing'"),
        ],
        "'calibrated_qc'",
    )
    return project(
        df,
        {
            "decision_basis": basis,
            "hard_failure": "__failed",
            "requires_human_review": "final_decision = 'review'",
            **_common(names),
            "policy_version": lit(ROUTING_POLICY_VERSION),
            "policy_rules_triggered": sorted_set(rules),
        },
        ["case_id", "final_decision", *keep],
    )


def policy_context(aligned: DataFrame) -> DataFrame:
    """Inputs of the first-match policy as one nested column ``ctx``."""
    schema, names = aligned.schema, aligned.columns

    def opt(path: str, kind: str) -> str:
        return path if has_field(schema, path) else f"CAST(NULL AS {kind})"

    det, cal = "deterministic", "calibrated"
    geometry, fov = f"{det}.qc_domains.geometry_integrity.severity", f"{det}.qc_domains.fov_integrity.severity"
    complete, hard = f"{geometry} IS NOT NULL", f"coalesce({geometry} = 'critical', false)"
    valid = f"CASE WHEN {geometry} IS NOT NULL THEN {geometry} <> 'critical' END"
    seen = [
        f"{opt(f'{det}.measurements.{m}', 'STRING')} IS NOT NULL"
        for m in ("border_touching", "partial_visibility_likely", "anatomical_truncation_suspected")
    ]
    target = f"{det}.target_presence"
    mask = case(
        [
            (f"{target}.annotation_presence = 'present'", "true"),
            (f"{target}.annotation_presence = 'absent'", "false"),
        ],
        f"{det}.measurements.pancreas_present",
    )
    blocking = " OR ".join(
        [
            f"coalesce({det}.triage.recommendation = 'omit_from_training', false)",
            f"coalesce({opt(f'{det}.omit_from_training', 'BOOLEAN')}, false)",
            f"coalesce({opt(f'{det}.blocking_processing_error', 'BOOLEAN')}, false)",
            f"coalesce({opt(f'{det}.measurements.blocking_processing_error', 'BOOLEAN')}, false)",
        ]
    )
    stated = (
        f"coalesce({opt(f'{det}.image_readable', 'BOOLEAN')}, {opt(f'{det}.measurements.image_readable', 'BOOLEAN')})"
    )
    readable = f"coalesce({stated}, CASE WHEN {det} IS NOT NULL THEN NOT ({blocking}) END)"
    evidence = (
        f"coalesce({target}.expected_presence = 'required'"
        f" AND {target}.observed_presence IN ('present', 'partial', 'absent', 'uncertain')"
        f" AND {target}.visible_target_annotation_status IN ('complete', 'incomplete', 'uncertain'), false)"
    )

    def mild(source: str) -> str:
        low = " OR ".join(
            f"coalesce({source}.qc_domains.{d}.severity = 'low_warning'"
            f" AND coalesce({source}.qc_domains.{d}.enabled, true), false)"
            for d in DOMAINS
        )
        return f"({action_of(f'{source}.triage.recommendation')} = 'warning' OR {low})"

    def changed(flag: str, text: str) -> str:
        if "comparison" not in names:
            return "false"
        by_text = f"coalesce(comparison.{text}, 'unchanged') <> 'unchanged'"
        return f"coalesce({opt(f'comparison.{flag}', 'BOOLEAN')}, {by_text})"

    omitted = "coalesce(validation.omit_from_training, false)" if "validation" in names else "false"
    invalid = "coalesce(lower(trim(validation.status)) = 'invalid', false)" if "validation" in names else "false"
    routed = "coalesce(routing.route_to_review, false)" if "routing" in names else "false"
    df = project(aligned, {"__mask": mask, "__valid": valid})
    s = lambda **k: "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in k.items()) + ")"
    ctx = s(
        validation=s(omit_from_training=omitted, status_invalid=invalid),
        deterministic=s(
            present=f"{det} IS NOT NULL",
            blocking_processing_error=f"({blocking})",
            image_readable=readable,
            geometry=s(complete=complete, valid="__valid", hard_failure=hard),
            fov=s(complete=f"({fov} IS NOT NULL AND ({' OR '.join(seen)}))"),
            non_blocking_warning=mild(det),
            target=s(
                evidence_complete=evidence,
                expected_presence=f"{target}.expected_presence",
                observed_presence=f"{target}.observed_presence",
                visible_target_annotation_status=f"{target}.visible_target_annotation_status",
                mask_present="__mask",
                mask_empty="NOT __mask",
                mask_valid="coalesce(__mask, false) AND coalesce(__valid, false)",
            ),
        ),
        calibrated=s(present=f"{cal} IS NOT NULL", non_blocking_warning=mild(cal)),
        comparison=s(
            recommendation_changed=changed("recommendation_changed", "recommendation_change"),
            risk_level_changed=changed("risk_level_changed", "risk_change"),
        ),
        routing=s(route_to_review=routed),
    )
    return project(df, {"ctx": ctx}, names)


def check_policy(policy: dict) -> None:
    """Reject malformed policies before anything is planned."""
    ids = [rule[0] for rule in policy["rules"]]
    if policy.get("evaluation") != "first_match":
        raise ValueError("only first-match policies are supported")
    if not ids or len(set(ids)) != len(ids):
        raise ValueError("rules need unique ids")
    if policy.get("no_match_action") not in ACTIONS:
        raise ValueError("the action without a match is not a known one")
    if set(policy.get("hard_rules", ())) - set(ids):
        raise ValueError("hard rules name unknown rules")
    for rule_id, name, action, reason, condition in policy["rules"]:
        if not name.strip() or not reason.strip():
            raise ValueError(f"rule {rule_id} needs a name and a reason")
        if action not in ACTIONS:
            raise ValueError(f"rule {rule_id} has an unknown action: {action}")
        _check(condition, policy["roots"], rule_id)


def _check(condition: tuple, roots: tuple[str, ...], rule_id: str) -> None:
    if condition[0] in ("all", "any"):
        for child in condition[1]:
            _check(child, roots, rule_id)
    elif condition[0] == "not":
        _check(condition[1], roots, rule_id)
    else:
        path, operator = condition[0], condition[1]
        if path.split(".")[0] not in roots:
            raise ValueError(f"rule {rule_id} reads a forbidden input: {path}")
        if operator not in OPERATORS:
            raise ValueError(f"rule {rule_id} uses an unknown operator: {operator}")
        if operator in ("in", "not_in") and not isinstance(condition[2], (list, tuple)):
            raise ValueError(f"rule {rule_id} operator {operator} needs a list")


def condition_sql(df: DataFrame, condition: tuple, root: str = "ctx") -> str:
    """Boolean SQL of a policy condition; never null.

    A path the context lacks fails every operator but ``exists``; a present null
    compares by equality.
    """
    if condition[0] in ("all", "any"):
        parts = [condition_sql(df, child, root) for child in condition[1]]
        empty = "true" if condition[0] == "all" else "false"
        return "(" + (" AND " if condition[0] == "all" else " OR ").join(parts) + ")" if parts else empty
    if condition[0] == "not":
        return f"(NOT {condition_sql(df, condition[1], root)})"
    path, operator = f"{root}.{condition[0]}", condition[1]
    value = condition[2] if len(condition) > 2 else None
    known = has_field(df.schema, path)
    if operator == "exists":
        return "true" if known is bool(value) else "false"
    if not known:
        return "false"
    if operator == "equals":
        return f"({path} <=> {lit(value)})"
    if operator == "not_equals":
        return f"(NOT ({path} <=> {lit(value)}))"
    if operator in ("in", "not_in"):
        hit = "(" + (" OR ".join(f"({path} <=> {lit(v)})" for v in value) or "false") + ")"
        return hit if operator == "in" else f"(NOT {hit})"
    kind = df.select(path).schema[0].dataType.typeName()
    filled = {"boolean": f"coalesce({path}, false)", "string": f"coalesce({path} <> '', false)"}.get(
        kind, f"coalesce({path} <> 0, false)"
    )
    return filled if operator == "truthy" else f"(NOT {filled})"


def first_match_policy(contexts: DataFrame, policy: dict = VISIBLE_PANCREAS_POLICY) -> DataFrame:
    """Action, rule and reason of the first matching rule per row.

    Rules become one boolean column each and a single ``CASE`` picks the first.
    Rows that match nothing keep a null rule and the policy's fall-back action.
    """
    check_policy(policy)
    conditions = [(rule, condition_sql(contexts, rule[4])) for rule in policy["rules"]]
    position = case([(sql, i) for i, (_, sql) in enumerate(conditions)], "-1")
    df = project(contexts, {"__rule": position})
    pick = lambda index, other: case(
        [(f"__rule = {i}", lit(rule[index])) for i, (rule, _) in enumerate(conditions)], other
    )
    return project(
        df,
        {
            "action": pick(2, lit(policy["no_match_action"])),
            "rule_id": pick(0, "CAST(NULL AS STRING)"),
            "rule_name": pick(1, "CAST(NULL AS STRING)"),
            "rule_reason": pick(3, "CAST(NULL AS STRING)"),
        },
        contexts.columns,
    )


def decide_by_policy(
    aligned: DataFrame, policy: dict = VISIBLE_PANCREAS_POLICY, keep: Sequence[str] = ()
) -> DataFrame:
    """Decisions of the first-match policy, rows without a match included (rule null)."""
    matched = first_match_policy(policy_context(aligned), policy)
    hard = "coalesce(rule_id IN (" + ", ".join(lit(r) for r in policy["hard_rules"]) + "), false)"
    return project(
        matched,
        {
            "final_decision": "action",
            "decision_basis": case(
                [
                    (hard, "'deterministic_hard_failure'"),
                    ("action = 'insufficient_evidence'", "'insufficient_evidence'"),
                    ("action = 'review'", "'review_routing'"),
                ],
                "'calibrated_qc'",
            ),
            "hard_failure": hard,
            "requires_human_review": "action = 'review'",
            **_common(aligned.columns),
            "policy_id": lit(policy["id"]),
            "policy_version": lit(policy["version"]),
            "policy_rules_triggered": "array_compact(array(rule_id))",
            "matched_rule": "rule_id",
            "matched_rule_name": "rule_name",
            "matched_rule_reason": "rule_reason",
        },
        ["case_id", *keep],
    )


def decide(aligned: DataFrame, task_mode: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """Final decisions of a run: policy for the organ task, composition otherwise."""
    if task_mode == "pancreas_only":
        return decide_by_policy(aligned, keep=keep)
    return decide_composed(aligned, task_mode, keep)


def with_decision(aligned: DataFrame, task_mode: str | None) -> DataFrame:
    """Aligned rows plus their decision as a struct ``final``; narrow."""
    inputs = [c for c in aligned.columns if c != "case_id"]
    decided = decide(aligned, task_mode, inputs)
    own = [c for c in decided.columns if c != "case_id" and c not in inputs]
    return decided.select("case_id", *inputs, F.struct(*own).alias("final"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Cases per action and basis with review and hard-failure counts (A4)."""
    return decisions.groupBy("final_decision", "decision_basis").agg(
        F.count("*").alias("n"),
        F.count_if("requires_human_review").alias("n_review_required"),
        F.count_if("hard_failure").alias("n_hard_failures"),
    )


def rule_table(policy: dict, field: int) -> str:
    """SQL map from rule id to its name (1) or action (2)."""
    return "map(" + ", ".join(f"{lit(rule[0])}, {lit(rule[field])}" for rule in policy["rules"]) + ")"


def decision_violations(stored: DataFrame, recomputed: DataFrame, policy: dict = VISIBLE_PANCREAS_POLICY) -> DataFrame:
    """(case_id, violation) of stored decisions (V9).

    ``stored``: case_id, final_decision, matched_rule, rule_name; ``recomputed``:
    case_id, final_decision, matched_rule, decided again from the run's inputs.  Both
    are grouped by case once; stored rows are held against the policy as well.
    """
    side = lambda df, name, *more: df.select(
        "case_id", F.struct("final_decision", "matched_rule", *more).alias(name)
    )
    both = side(stored, "old", "rule_name").unionByName(side(recomputed, "new"), allowMissingColumns=True)
    both = both.groupBy("case_id").agg(F.count("old").alias("n"), F.max("old").alias("old"), F.max("new").alias("new"))
    names, actions = rule_table(policy, 1), rule_table(policy, 2)
    known = f"map_contains_key({names}, old.matched_rule)"
    rules = {
        "missing_decision": "n = 0",
        "unexpected_decision": "new IS NULL",
        "duplicate_decision": "n > 1",
        "changed_action": "n > 0 AND new IS NOT NULL AND NOT (old.final_decision <=> new.final_decision)",
        "changed_rule": "n > 0 AND new IS NOT NULL AND NOT (old.matched_rule <=> new.matched_rule)",
        "unknown_rule": f"n > 0 AND NOT coalesce({known}, false)",
        "wrong_rule_name": f"{known} AND NOT (old.rule_name <=> {names}[old.matched_rule])",
        "wrong_rule_action": f"{known} AND NOT (old.final_decision <=> {actions}[old.matched_rule])",
    }
    codes = compact([f"CASE WHEN {cond} THEN '{code}' END" for code, cond in rules.items()])
    return both.selectExpr("case_id", f"explode({codes}) AS violation")


def unmatched(decisions: DataFrame) -> DataFrame:
    """Cases no policy rule matched; a complete policy leaves none."""
    return decisions.filter(F.col("matched_rule").isNull()).select("case_id")
