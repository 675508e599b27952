"""Operator 5: SimHash near-duplicates found with BK-trees.

A fingerprint has 64 bits, one bit set where more than half of the shingle hashes
set it.  Equal fingerprints are one node.  Two nodes are linked when at most
``RADIUS`` bits differ; components come from a star-contraction on Spark.

Search: fingerprints are cut into five blocks of bits.  When three bits differ at
most, two blocks at least are equal, so every pair of blocks makes a table whose
shards (equal block values) hold all links.  Each shard is a BK-tree: a child
hangs under its parent by their Hamming distance, and a query follows only edges
within the radius of its own distance to the parent.

Scale: one shuffle of (block pair, fingerprint), no text.  The shard trees are
not sent to every task, since they grow with the corpus; a task builds those of
its shards.  Trees have at most ``PIECE`` nodes: a larger shard is cut into
pieces, and every two pieces meet in a task of their own.  A task sends a
spanning forest of what it linked, never all pairs.

Defined results: a null text, or one without words, has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle; texts are
used whole; rows with equal doc_id keep a row each; a component's id is its
smallest doc_id that is not null (null if there is none); an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseward.llm.slabs import joined, slabs
from caseward.operators.connected import connected_components
from caseward.sources.shared import stored

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Bits of each block: with radius 3, two of five are equal.
BLOCKS = (13, 13, 13, 13, 12)
#: Nodes of a tree.
PIECE = 8192
#: (query, node) steps followed at once.
_FRONTIER = 1 << 21
_SLAB = 4 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text (UTF-8)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = len(words) - shingle + 1
    ends = (starts[shingle : shingle + n] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, t, fp) of each row: a hash of the text, and the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", _SLAB):
            texts = slab.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": slab.column("doc_id"), "t": slab.column("t"), "fp": pa.array(fp)})

    given = documents.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return given.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, t long, fp long")


class Forest:
    """BK-trees of several cells, built and searched together."""

    def __init__(self, values: np.ndarray, cells: np.ndarray):
        self.values = values
        none = np.zeros(0, np.int64)
        self.root_cells, self.root_nodes = none, none
        keys, children = [none], [none]
        rest = np.arange(len(values))
        # A tree's root hangs under its cell, written as a negative number.
        parent, edge = -1 - cells.astype(np.int64), np.zeros(len(values), np.int64)
        level = 0
        while len(rest):
            key = parent * 65 + edge
            order = np.argsort(key, kind="stable")
            rest, parent, edge, key = rest[order], parent[order], edge[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            node = rest[first][np.cumsum(first) - 1]
            if level:
                keys.append(key[first])
                children.append(rest[first])
            else:
                by_cell = np.argsort(-parent[first])
                self.root_cells, self.root_nodes = (-1 - parent[first])[by_cell], rest[first][by_cell]
            level += 1
            rest, parent = rest[~first], node[~first]
            edge = np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
        self.keys, self.children = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def within(self, queries: np.ndarray, cells: np.ndarray, radius: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) pairs at most ``radius`` bits apart (one, or one for each query), step by step."""
        reach = np.broadcast_to(np.asarray(radius, np.int64), len(queries))
        at = np.searchsorted(self.root_cells, cells)
        at = np.minimum(at, max(len(self.root_cells) - 1, 0))
        q = np.flatnonzero(self.root_cells[at] == cells) if len(self.root_cells) else np.zeros(0, np.int64)
        node = self.root_nodes[at[q]] if len(q) else q
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= reach[q]
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - reach[q], 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + reach[q], 64), side="right")
            n = high - low
            begin = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            q, node = np.repeat(q, n), self.children[begin + np.arange(n.sum())]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give joined elements the least label among them."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def link(cells: np.ndarray, values: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels: elements of a cell that are linked share one."""
    label = np.arange(len(values))
    nodes, asked = np.flatnonzero(tree), np.flatnonzero(query)
    forest = Forest(values[nodes], cells[nodes])
    size = np.bincount(cells[nodes], minlength=int(cells.max()) + 1 if len(cells) else 1)[cells[asked]]
    total = np.cumsum(size)
    start = 0
    while start < len(asked):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + _FRONTIER, side="right")))
        part = asked[start:stop]
        for q, node in forest.within(values[part], cells[part], radius):
            merge(label, part[q], nodes[node])
        start = stop
    return label


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by cell; cells that are whole are searched together."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        shard, low, high, piece, fp = (c.to_numpy() for c in rows.columns)
        new = (shard[1:] != shard[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        cells = np.concatenate([[0], np.cumsum(new)])
        many = np.bincount(cells)[cells] > 1
        cells, low, high, piece, fp = (x[many] for x in (cells, low, high, piece, fp))
        label = link(cells, fp.view(np.uint64), piece == low, piece == high, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_pydict({"a": pa.array(fp[linked]), "b": pa.array(fp[label[linked]])})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = joined(held)
        names = [rows.column(i).to_numpy() for i in range(3)]
        same = np.ones(rows.num_rows, bool)
        for x in names:
            same &= x == x[-1]
        whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if whole:
            yield found(rows.slice(0, whole))
        held = [rows.slice(whole)]
    if held:
        yield found(joined(held))


def _shards() -> str:
    """SQL of the shard keys of column fp: every pair of blocks, with its number."""
    low = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    block = [f"(shiftrightunsigned(fp, {s}) & {(1 << w) - 1})" for s, w in zip(low, BLOCKS, strict=True)]
    keys = [f"(shiftleft({n}L, 32) | shiftleft({block[i]}, 13) | {block[j]})" for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return f"array({', '.join(keys)})"


def links(nodes: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (fp)."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("the radius is too large for the blocks")
    rows = nodes.select("fp", F.explode(F.expr(_shards())).alias("shard"))
    large = rows.groupBy("shard").count().filter(F.col("count") > piece)
    large = large.select("shard", F.ceil(F.col("count") / piece).alias("n"))
    rows = rows.join(large, "shard", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("fp"), "n")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    cells = rows.select("shard", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "fp")
    cells = cells.repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high")
    return cells.mapInArrow(lambda b: _search(b, radius), "a long, b long")


def grouped(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, fp) of each row, and (fp, root, least) of each fingerprint: its component and its smallest doc_id."""
    marked = stored(fingerprints(documents, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes, radius)).withColumnRenamed("node", "fp")
    return marked, nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row."""
    marked, placed = grouped(documents, shingle, radius)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", digits, "component_id")


def near_key() -> Column:
    """Order in which rows of a component stay: the smallest doc_id, null last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each component stays, with all columns: the smallest doc_id, null last, then the smallest text hash."""
    marked, placed = grouped(documents.select("doc_id", "text"))
    key = near_key()
    best = marked.groupBy("fp").agg(F.min(F.struct(key.alias("_near_k"), F.col("t").alias("_near_t"))).alias("row"))
    best = best.join(placed, "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.*").distinct()
    rows = documents.withColumns({"_near_k": key, "_near_t": F.xxhash64("text")})
    kept = rows.join(best, ["_near_k", "_near_t"]).dropDuplicates(["_near_k", "_near_t"])
    return kept.select(*documents.columns)
