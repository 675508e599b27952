"""Operator 6: mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in equal blocks.  All blocks of the mix go to sources by highest
quotients of their targets; a source's blocks go to its shards in the same way
by their sizes.  Inside a shard, documents lie one after the other in a seeded
order; whole passes are taken as often as the quota holds them, and the rest is a
run of blocks from a seeded start, round the end.  So a document is taken whole
or not at all in a pass, but for two at the run's ends.

Scale: sizes are counted once; sources (their number is bounded) are weighed on
the driver, shards per source in Spark, documents by a running sum in shards of
bounded size, so a source with a third of all documents is many tasks.

Defined results: a null text has size 0, and documents of size 0 are never taken;
null is a source of its own, last in order; repeated rows are separate documents;
order and starts depend on ids, texts and the seed only; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseward.sources.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 32
SHARD_WORDS = 1 << 20
SEED = 7
#: Sources are weighed on the driver; more than this are refused.
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source: shares by weight; what exceeds ``most`` times a size is shared anew."""
    size = np.array(sizes, float)
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * size.sum()
    while free.any():
        part = left * weight / weight[free].sum()
        over = free & (part > most * size)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        free &= ~over
    return out.tolist()


def apportion(votes: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 * seats so far + 1), at most ``limits`` each.

    Seats that no divisor of this size would deny are given at once; the rest, at
    most one for each party, one by one.  Ties go to the earlier party.
    """
    votes, limits = np.asarray(votes, float), np.asarray(limits, np.int64)
    seats = min(int(seats), int(limits.sum()))
    got = np.zeros(len(votes), np.int64)
    sure = seats - len(votes) / 2
    if sure > 0 and votes.sum() > 0:
        got = np.minimum(np.floor(votes * (sure / votes.sum()) + 0.5).astype(np.int64), limits)
    queue = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes.tolist(), got.tolist(), limits.tolist(), strict=True)) if g < m]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Two lanes: equal order keys of different documents are out of reach.
    return documents.select("*", size.alias("_size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"), F.xxhash64(F.lit(~seed), "text", "doc_id").alias("_g"))


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, ranges of each row, then the columns named in ``keep``.

    ``passes`` counts whole copies; ``ranges`` are the two word ranges (from, to)
    taken besides, empty ones included.
    """
    given = documents.select("doc_id", "text", "source", *[F.col(c).alias(f"_in_{c}") for c in keep])
    narrow = stored(_sized(documents.select("doc_id", "text", "source"), seed).select("source", "_size", "_h"), "sizes")
    sums = narrow.groupBy("source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in sums]
    goal = targets(sizes, weights, share, most)
    blocks = apportion(np.array(goal), round(sum(goal) / block), np.array([most * -(-n // block) for n in sizes], np.int64))
    plan = [
        (i, r["source"], n, t, int(b), max(1, -(-n // shard_words)))
        for i, (r, n, t, b) in enumerate(zip(sums, sizes, goal, blocks, strict=True))
    ]
    spark = documents.sparkSession
    sources = spark.createDataFrame(plan, "place long, _source string, source_size long, target double, blocks long, shards long")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.expr("pmod(_h, shards)"))

    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard", ignore_index=True)
        n_blocks = -(-shards["n"] // block)
        quota = apportion(shards["n"].to_numpy(), int(shards["blocks"].iloc[0]), (most * n_blocks).to_numpy())
        return pd.DataFrame({"place": shards["place"], "shard": shards["shard"], "n": shards["n"], "n_blocks": n_blocks, "quota": quota, "_to": shards["_source"]})

    counted = placed(narrow.filter("_size > 0")).groupBy("place", "_source", "shard", "blocks").agg(F.sum("_size").alias("n"))
    shards = counted.groupBy("place").applyInPandas(quotas, "place long, shard long, n long, n_blocks long, quota long, _to string")
    start = F.pmod(F.xxhash64(F.lit(seed), "_to", "shard"), "n_blocks")
    shards = shards.select("place", "shard", F.expr("quota div n_blocks").alias("passes"), (start * block).alias("at"), F.least(F.col("n"), (start + F.expr("quota % n_blocks")) * block).alias("to"), F.greatest(F.lit(0), (start + F.expr("quota % n_blocks") - F.col("n_blocks")) * block).alias("over"))

    # The window and the join have the same keys, none of them null: one shuffle of the texts serves both.
    rows = placed(_sized(given, seed)).drop("text", "source", "_source", "blocks", "shards")
    before = Window.partitionBy("place", "shard").orderBy("_h", "_g").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("a", F.coalesce(F.sum("_size").over(before), F.lit(0))).join(shards, ["place", "shard"], "left")
    # A shard without a word has no quota, and documents without one lie between others with an empty span.
    cut = lambda x: F.coalesce(F.least(F.greatest(x - F.col("a"), F.lit(0)), F.col("_size")), F.lit(0).cast("long"))
    ends = [F.when(F.col("passes").isNull(), 0).otherwise(cut(F.col(c))).cast("long") for c in ("at", "to", "over")]
    spans = F.array(F.struct(ends[0].alias("from"), ends[1].alias("to")), F.struct(F.lit(0).cast("long").alias("from"), ends[2].alias("to")))
    extra = F.expr("ranges[0].to - ranges[0].from + ranges[1].to - ranges[1].from")
    passes = F.when(F.col("_size") > 0, F.coalesce("passes", F.lit(0))).otherwise(0).cast("long")
    rows = rows.withColumn("ranges", spans).withColumn("passes", passes)
    wanted = ["doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("passes") * F.col("_size") + extra).alias("taken")]
    return rows.select(*wanted, "passes", "ranges", *[F.col(f"_in_{c}").alias(f"_{c}") for c in keep])


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy of a document, or of its words where it is cut.

    A cut text has one blank between its words; ``n_chars`` follows the text.
    """
    columns = documents.columns
    rows = mix(documents, keep=tuple(columns))
    words = F.regexp_extract_all("_text", F.lit(WORD), 0)
    some = "concat(slice(w, CAST(ranges[0].from AS INT) + 1, CAST(ranges[0].to - ranges[0].from AS INT)), slice(w, 1, CAST(ranges[1].to AS INT)))"
    extra = F.expr("taken - passes * size")
    part = F.when(extra == F.col("size"), F.col("_text")).when(extra > 0, F.concat_ws(" ", F.expr(some)))
    rows = rows.filter("taken > 0").withColumn("w", F.when((extra > 0) & (extra < F.col("size")), words))
    copies = F.expr("filter(concat(array_repeat(_text, CAST(passes AS INT)), array(part)), x -> x IS NOT NULL)")
    rows = rows.withColumn("part", part).withColumn("copy", F.explode(copies))
    changed = {"text": F.col("copy"), "n_chars": F.length("copy").cast(dict(documents.dtypes).get("n_chars", "long"))}
    return rows.select(*[changed.get(c, F.col(f"_{c}")).alias(c) for c in columns])
