"""A whole run over a case table: assessment, calibration, comparison, routing, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.config import Settings
from caseward.operators.calibrate import calibrate
from caseward.operators.compare import comparison_columns
from caseward.operators.decisions import with_decision
from caseward.operators.report import for_decision, report_pair, struct_of
from caseward.operators.routing import with_routing
from caseward.operators.task import restrict_to_task


def routed(cases: DataFrame, validation: DataFrame, settings: Settings, whole: bool = True) -> DataFrame:
    """One row per case: deterministic, calibrated, validation, comparison, routing.

    Both threshold variants come from the same row, so the only shuffle is the
    join with the validation rows.  Nothing is stored in between: Spark computes and
    shuffles the report fields that the decision rules and the caller read.  Unless
    ``whole``, the reports keep the fields of the decision rules alone.
    """
    view = restrict_to_task(cases, settings.task_mode)
    reports = report_pair(view, settings, calibrate(view, settings))
    if not whole:
        reports = reports.selectExpr("case_id", *[f"{for_decision(c)} AS {c}" for c in ("deterministic", "calibrated")])
    rows = validation.select("case_id", F.struct(*[c for c in validation.columns if c != "case_id"]).alias("validation"))
    aligned = reports.join(rows, "case_id", "full_outer")
    compared = aligned.selectExpr("*", f"{struct_of(comparison_columns())} AS comparison")
    return with_routing(compared, settings.task_mode)


def run(cases: DataFrame, validation: DataFrame, settings: Settings) -> DataFrame:
    """One row per case: deterministic, calibrated, comparison, validation, routing, final."""
    return with_decision(routed(cases, validation, settings), settings.task_mode)
