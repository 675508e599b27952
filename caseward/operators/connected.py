"""Connected components of an edge list in logarithmically many rounds.

Rounds alternate two steps on the edges alone: every node hangs its larger
neighbours on its smallest one (large star), then its smaller neighbours and
itself (small star).  Each step is one grouping with map-side combine for the
minimum and one join that adaptive execution may split, so a hub is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.sources.shared import Stored


def _hang(arcs: DataFrame, keys: list[str], above: bool) -> DataFrame:
    """arcs (keys, u, v): link each v to the least node around u, itself included."""
    least = arcs.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    least = least.select(*keys, "u", F.least("u", "m").alias("m"))
    if above:
        arcs = arcs.filter("v > u")
    linked = arcs.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))
    if not above:
        linked = linked.unionByName(least.select(*keys, F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def _stars(edges: DataFrame, keys: list[str]) -> bool:
    """Whether every larger end has one smaller end, which is nobody's larger end: then it is the least of its component."""
    ends = edges.selectExpr(*keys, "a AS node", "1 AS larger", "0 AS smaller").unionByName(
        edges.selectExpr(*keys, "b AS node", "0 AS larger", "1 AS smaller")
    )
    nodes = ends.groupBy(*keys, "node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    return nodes.filter("larger + smaller > 1 AND larger > 0").isEmpty()


def connected_components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, root) for every node of an edge list (keys, a, b).

    ``root`` is the least node of the component.  Loops and repeated edges do no
    harm; nodes without an edge to another node do not appear.  Keys, if any,
    separate graphs that share node ids.
    """
    keys = list(keys)
    now = Stored(edges.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        e = now.read()
        if _stars(e, keys):
            return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _hang(both, keys, above=True)
        small = _hang(large.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), keys, above=False)
        after = Stored(small, "edges")
        now.drop()
        now = after
