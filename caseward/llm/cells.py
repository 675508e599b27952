"""Operator 13: embedding near-dedup in the cells of a spherical k-means.

Vectors are compared only with those of their label.  Different vectors of a label
are its nodes (equal ones are one node that counts as many).  Centroids of every
large label are fitted on a bounded sample by spherical k-means; each node is an
owner in the cell of its nearest centroid.  It is a guest in every other cell that
may own a vector within the threshold: x lies nearest to c, so x(c - b) >= 0 for
the node's own centroid b, and x is at most an angle a away; this needs
y(b - c) <= sin(a) |b - c|.  The bound is exact, so no link is lost, whatever the
centroids.  In a cell every owner is compared with all members by blocked matrix
products in single precision; what comes near the threshold is decided by the
cosine in double precision.

A group is what links connect; the row with the smallest id of each group is kept.

Scale: owners of a cell beyond ``PIECE`` are cut into pieces; the members of the
cell are streamed past each piece, so a task holds one piece and one batch.  A task
sends a number for each owner and a spanning forest, never all pairs.  Centroids
are at most ``MAX_CELLS`` (a documented bound: they and their sample are the only
data sent to every task); larger cells are pieces.  Vectors that lie in clusters
have few guests; vectors without any structure are guests nearly everywhere, which
is then the comparison of a label with itself.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do rows without a label; vectors of different
lengths do not link; equal rows are rows of their own and link with each other; the
id of a group is its smallest vec_id that is not null (null if there is none); a
null vec_id is kept only in such a group; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.operators.connected import connected_components
from caseward.sources.shared import Stored, stored

THRESHOLD = 0.93
#: Vectors for which a label gets one centroid, centroids in all, sample of a centroid, rounds of fitting.
CELL, MAX_CELLS, PER_CELL, ROUNDS = 2048, 1024, 32, 8
#: Owners compared in one task, and members of a block.
PIECE, BLOCK = 4096, 512
SEED = 42
#: Cosines in single precision are this near to the exact ones.
_SLACK = 1e-4
_KEY = ["label", "length", "k1", "k2"]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    rows = scaled(vectors)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def unpacked(column: pa.Array) -> np.ndarray:
    """A matrix of packed vectors of one length."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b, in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, length, vector (packed doubles; null where it takes no part) and its 128-bit name k1, k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0  # no negative zeros
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
            blobs = []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                row = flat[a:b]
                blobs.append(row.tobytes() if np.isfinite(row).all() and row.any() else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "vector": pa.array(blobs, pa.binary())})

    # A null component is written as NaN: such a vector takes no part.
    doubles = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))))
    kinds = dict(vectors.dtypes)
    rows = vectors.select("vec_id", "label", doubles.alias("embedding")).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector binary")
    names = {"length": F.length("vector"), "k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(SEED), "vector")}
    return rows.withColumns(names)


def spherical_means(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Up to ``count`` unit centroids of unit vectors."""
    start = np.random.default_rng(seed).permutation(len(sample))[:count]
    centroids = np.unique(sample[np.sort(start)], axis=0)
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        lengths = np.sqrt((sums * sums).sum(axis=1))
        full = lengths > 1e-9
        centroids[full] = sums[full] / lengths[full][:, None]
    return centroids


def centroids_of(nodes: DataFrame, cell: int = CELL, max_cells: int = MAX_CELLS) -> dict[tuple, np.ndarray]:
    """Centroids of every (label, length) with more than ``cell`` nodes, fitted on at most PER_CELL vectors for each of ``max_cells`` centroids.

    The sample is drawn by the names of the vectors, so reruns agree.  Labels beyond
    the bound have one cell each, which is compared in pieces.
    """
    sizes = nodes.groupBy("label", "length").count().filter(F.col("count") > cell)
    wanted, left = {}, max_cells
    for r in sizes.orderBy(F.desc("count"), "label", "length").limit(max_cells // 2).collect():
        count = min(math.ceil(r["count"] / cell), left)
        if count > 1:
            wanted[r["label"], r["length"]] = (count, min(1.0, 2 * PER_CELL * count / r["count"]))
            left -= count
    if not wanted:
        return {}
    spark = nodes.sparkSession
    rates = spark.createDataFrame([(*key, rate) for key, (_, rate) in wanted.items()], f"label {dict(nodes.dtypes)['label']}, length int, rate double")
    drawn = nodes.join(F.broadcast(rates), ["label", "length"]).filter(F.pmod("k2", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    vectors: dict[tuple, list[bytes]] = {key: [] for key in wanted}
    for r in drawn.select("label", "length", "vector").orderBy("k1", "k2").limit(2 * PER_CELL * max_cells).collect():
        vectors[r["label"], r["length"]].append(bytes(r["vector"]))
    out = {}
    for key, blobs in vectors.items():
        if blobs:
            out[key] = spherical_means(unit(np.array([np.frombuffer(b, np.float64) for b in blobs])), wanted[key][0])
    return out


def dealt(nodes: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, max_cells: int = MAX_CELLS) -> DataFrame:
    """(label, length, cell, owner, node, size, vector): each node in its cell, and as a guest in every cell within reach."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids_of(nodes, cell, max_cells))
    sine = math.sqrt(1 - threshold * threshold) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("length").to_pylist(), strict=True))
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            group = np.array([number[k] for k in keys], np.int64)
            rows, cells, owns = [], [], []
            for key, i in number.items():
                at = np.flatnonzero(group == i)
                if key not in known:
                    found, where = np.arange(len(at)), np.zeros(len(at), np.int64)
                    own = np.ones(len(at), bool)
                else:
                    centroids = known[key]
                    near = unit(unpacked(batch.column("vector").take(pa.array(at)))) @ centroids.T
                    best = near.argmax(axis=1)
                    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
                    reach = near[np.arange(len(at)), best][:, None] - near <= sine * apart[best] + 1e-9
                    reach[np.arange(len(at)), best] = True
                    found, where = np.nonzero(reach)
                    own = where == best[found]
                rows.append(at[found])
                cells.append(where)
                owns.append(own)
            if rows:
                out = batch.take(pa.array(np.concatenate(rows)))
                more = {"cell": pa.array(np.concatenate(cells), pa.int32()), "owner": pa.array(np.concatenate(owns))}
                yield pa.RecordBatch.from_pydict({c: out.column(c) for c in ("label", "length", "node", "size", "vector")} | more)

    kind = dict(nodes.dtypes)["label"]
    given = nodes.select("label", "length", "node", "size", "vector")
    return given.mapInArrow(run, f"label {kind}, length int, node long, size long, vector binary, cell int, owner boolean")


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


class Owners:
    """The owners of a piece: numbers of links, and which are connected."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.node = rows.column("node").to_numpy()
        self.size = rows.column("size").to_numpy()
        self.raw = unpacked(rows.column("vector"))
        self.units = unit(self.raw).astype(np.float32)
        self.links = self.size - 1
        self.label = np.arange(len(self.node))
        self.by_node = np.argsort(self.node)

    def meet(self, batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Compare with members; yields an edge (member, owner) for each linked member that is not an owner here."""
        node, size, raw = batch.column("node").to_numpy(), batch.column("size").to_numpy(), unpacked(batch.column("vector"))
        units = unit(raw).astype(np.float32)
        for start in range(0, len(node), BLOCK):
            part = slice(start, start + BLOCK)
            member, owner = np.nonzero(units[part] @ self.units.T >= threshold - _SLACK)
            member += start
            other = node[member] != self.node[owner]
            member, owner = member[other], owner[other]
            ok = np.concatenate([cosines(raw[member[i : i + 65536]], self.raw[owner[i : i + 65536]]) >= threshold for i in range(0, len(member), 65536)] or [np.zeros(0, bool)])
            member, owner = member[ok], owner[ok]
            if not len(member):
                continue
            np.add.at(self.links, owner, size[member])
            new = np.ones(len(member), bool)
            new[1:] = member[1:] != member[:-1]
            first = owner[new]
            merge(self.label, owner, np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(member)))))
            linked = node[member[new]]
            at = self.by_node[np.minimum(np.searchsorted(self.node, linked, sorter=self.by_node), len(self.node) - 1)]
            here = self.node[at] == linked
            merge(self.label, at[here], first[here])
            yield linked[~here], self.node[first[~here]]


def compared(placed: DataFrame, threshold: float = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """(node, links, a, b): the number of links of each owner, or an edge of a forest between nodes."""
    key = ["label", "length", "cell"]
    counts = placed.filter("owner").groupBy(*key).count().select(*key, F.ceil(F.col("count") / piece).cast("int").alias("pieces"))
    rows = placed.join(counts, key)
    # An owner stands in its piece (first), and every member is streamed past each piece.
    own = F.array(F.struct(F.pmod(F.xxhash64("node"), "pieces").cast("int").alias("piece"), F.lit(0).alias("kind")))
    every = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.struct(i.alias("piece"), F.lit(1).alias("kind")))
    rows = rows.select(*key, "node", "size", "vector", F.inline(F.when(F.col("owner"), F.concat(own, every)).otherwise(every)))
    rows = rows.repartition(*key, "piece").sortWithinPartitions(*key, "piece", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

        def sent(node, links, a, b) -> pa.RecordBatch:
            n, m = len(node), len(a)
            columns = [np.append(node, np.zeros(m, np.int64)), np.append(links, np.zeros(m, np.int64)), np.append(np.zeros(n, np.int64), a), np.append(np.zeros(n, np.int64), b)]
            masks = [np.arange(n + m) >= n] * 2 + [np.arange(n + m) < n] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=x) for c, x in zip(columns, masks, strict=True)], schema=shape)

        def ended(owners: Owners) -> pa.RecordBatch:
            tied = np.flatnonzero(owners.label != np.arange(len(owners.label)))
            return sent(owners.node, owners.links, owners.node[tied], owners.node[owners.label[tied]])

        now, held, owners = None, [], None
        none = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = zip(*(batch.column(c).to_pylist() for c in (*key, "piece", "kind")), strict=True)
            kinds = list(parts)
            cuts = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]), len(kinds)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part, (*where, kind) = batch.slice(start, stop - start), kinds[start]
                if where != now:
                    if owners is not None:
                        yield ended(owners)
                    now, held, owners = where, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if owners is None and held:
                    owners, held = Owners(held), []
                if owners is not None:
                    for a, b in owners.meet(part, threshold):
                        yield sent(none, none, a, b)
        if owners is not None:
            yield ended(owners)

    return rows.mapInArrow(run, "node long, links long, a long, b long")


def grouped(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, piece: int = PIECE, max_cells: int = MAX_CELLS) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id, kept of each row."""
    rows = keyed(vectors.select("vec_id", "label", "embedding"))
    valid = rows.filter("vector IS NOT NULL AND label IS NOT NULL")
    nodes = valid.groupBy(*_KEY).agg(F.min("vector").alias("vector"), F.count("*").alias("size"), F.min("vec_id").alias("least"))
    # Written before it is read again: the numbers of nodes stay.
    nodes = Stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = stored(compared(dealt(nodes.read(), threshold, cell, max_cells), threshold, piece), "links")
    roots = connected_components(found.filter("a IS NOT NULL").select("a", "b"))
    counts = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("n_links"))
    placed = nodes.read().drop("vector").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select(*_KEY, "n_links", "component_id", F.lit(True).alias("known"))
    joined = rows.select("vec_id", *_KEY).join(named, _KEY, "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = f"""
WITH RECURSIVE good AS (
    SELECT vec_id, label, e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), least AS (
    SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.x LEFT JOIN (SELECT x, count(*) AS n_links FROM link GROUP BY x) n ON e.vec_id = n.x
"""
