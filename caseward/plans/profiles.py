"""Runs of several task profiles over the same cases, for the analysis of decisions across profiles.

Every profile sees its own view of a case, is calibrated on it, judges it under
manual and calibrated thresholds, routes and decides by its own policy.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame

from caseward.config import DOMAINS, TASK_NOTATION, Settings
from caseward.operators.decisions import decide
from caseward.plans.run import routed


def _outcome(cases: DataFrame, validation: DataFrame, settings: Settings) -> DataFrame:
    """The decision of every case under one profile; what the analysis reads is picked before the decision rules."""
    severities = ", ".join(f"'{d}', coalesce(deterministic.qc_domains.{d}.severity, 'not_applicable')" for d in DOMAINS)
    picked = routed(cases, validation, settings, whole=False).selectExpr(
        "*", "routing.route_to_review AS routed", f"named_struct({severities}) AS severities"
    )
    return decide(picked, settings.task_mode, ["routed", "severities"]).selectExpr(
        "case_id",
        f"'{TASK_NOTATION[settings.task_mode]}' AS profile",
        "final_decision AS action",
        "decision_basis AS basis",
        "hard_failure",
        "primary_domain",
        "routed",
        "severities",
    )


def profile_runs(cases: DataFrame, validation: DataFrame, settings: Mapping[str, Settings] | None = None) -> DataFrame:
    """One row per case and task profile, the input of ``analysis.side_by_side``.

    ``settings`` maps task modes to their manual thresholds; all modes with the
    built-in ones where it is missing.  ``cases`` is read once for calibration and
    once for judging by each profile: give a stored table.  A case with a validation
    row alone has no domain that applies.
    """
    settings = settings or {mode: Settings(mode) for mode in TASK_NOTATION}
    parts = [_outcome(cases, validation, s) for s in settings.values()]
    return reduce(DataFrame.unionByName, parts)
