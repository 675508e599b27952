"""Cases that no policy rule matches: planned in bounded size, and none lost."""

from __spark_entry__ import queries
from caseward.config import VISIBLE_PANCREAS_POLICY
from caseward.functions.sql import rows_where


def test_unmatched_cases_need_no_larger_plan_than_the_decisions(spark, tmp_path, monkeypatch):
    """A filter moved through the rules made a plan that no small driver holds."""
    spark.range(0, 300).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    run = queries()
    decided = run["p12_first_match_policy"](spark, str(tmp_path))
    size = len(decided._jdf.queryExecution().optimizedPlan().toString())
    rules = {r["case_id"]: r["matched_rule"] for r in decided.collect()}
    assert None not in rules.values()
    left = run["p12_unmatched_cases"](spark, str(tmp_path))
    assert len(left._jdf.queryExecution().optimizedPlan().toString()) < 2 * size
    assert left.count() == 0
    monkeypatch.setitem(VISIBLE_PANCREAS_POLICY, "rules", VISIBLE_PANCREAS_POLICY["rules"][:-1])
    got = sorted(r["case_id"] for r in run["p12_unmatched_cases"](spark, str(tmp_path)).collect())
    last = sorted(c for c, rule in rules.items() if rule == "VP-014")
    assert got == last and 0 < len(got) < len(rules)


def test_rows_where_keeps_what_a_filter_keeps(spark):
    rows = [("a", 1), ("a", 1), (None, 2), ("b", None), ("c", -1), (None, None)]
    df = spark.createDataFrame(rows, "name string, n int").selectExpr("name", "n", "struct(n * 2 AS twice) AS s")
    found = rows_where(df, "n > 0", {"who": "name", "twice": "s.twice"})
    assert found.columns == ["who", "twice"]
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 2), ("a", 2), (None, 4)]
