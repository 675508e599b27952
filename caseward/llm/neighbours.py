"""Operator 4: approximate nearest neighbours on stable projections.

Unit vectors are projected on a few Gaussian directions: the squared projected
distance of two points, over their squared distance, follows a chi-square law.
Projections are indexed by a kd-tree: its upper splits, fitted on a bounded
sample, are the cells in which Spark deals the vectors; below, a task builds the
rest of the tree for its cell.  A query walks through leaves in ascending
projected distance and verifies their points by the true cosine, in double
precision.  It stops when the chi-square test says that a better point at this
projected distance has a probability below ``1 - confidence``.

A first bound for each query comes from the sample, so cells beyond it are never
asked.  Every row is indexed; the sample only places the splits and the bounds.

Scale: one shuffle of the vectors, one of the queries (a copy for each cell within
its bound).  A cell with more than ``piece`` vectors is cut into pieces by hash,
each a tree of its own; queries stream past a tree, so memory holds one piece and
one batch.  Tasks return their best ``k`` for each query.

Defined results: vectors that are null, zero, hold null or non-finite components
or have another length than most take no part, nor do rows without an id; the
different vectors of one id are a candidate each, and a query by that id takes the
best cosine of its vectors (its own id is no candidate); equal cosines are ordered
by id; equal vectors are verified together, so that ties are exact; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseward.llm.slabs import joined

#: Directions of the projection (an even number).
DIRECTIONS = 8
CONFIDENCE = 0.98
#: Rows that place the splits and first bounds; they are sent to every task.
SAMPLE = 4096
PIECE = 8192
LEAF = 32
#: Leaves verified between two stopping tests.
_STEP = 8
SEED = 11


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(degrees // 2))


def quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def directions(length: int, count: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, count))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def cosines(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Cosine of each row with the query; a row's value does not depend on the others."""
    return (rows * query).sum(axis=1) / (lengths * length)


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


class Splits:
    """The upper part of the kd-tree: 2**depth cells with their boxes."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, n = depth, points.shape[1] if len(points) else DIRECTIONS
        self.axis = np.zeros((1 << depth) - 1, np.int64)
        self.at = np.zeros((1 << depth) - 1)
        parts, boxes = [points], [np.array([[-np.inf] * n, [np.inf] * n])]
        for node in range((1 << depth) - 1):
            part, box = parts[node], boxes[node]
            axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            self.axis[node], self.at[node] = axis, at
            left = part[:, axis] < at
            for side, bound in ((left, 1), (~left, 0)):
                inner = box.copy()
                inner[bound, axis] = at
                parts.append(part[side])
                boxes.append(inner)
        self.boxes = np.array(boxes[(1 << depth) - 1 :])

    @classmethod
    def of(cls, state: dict) -> Splits:
        """The splits with these attributes: they travel to the tasks, the class does not."""
        splits = cls.__new__(cls)
        splits.__dict__.update(state)
        return splits

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - ((1 << self.depth) - 1)

    def near(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose box is nearer than the squared distance ``reach``."""
        return np.flatnonzero(_outside(self.boxes, point) < reach)


def _outside(boxes: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box (low, high)."""
    gap = np.maximum(np.maximum(boxes[:, 0] - point, point - boxes[:, 1]), 0)
    return (gap * gap).sum(axis=1)


class Tree:
    """Lower part of the kd-tree: different vectors of a piece in leaves with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, base: np.ndarray, most: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, number = np.unique(raw, return_index=True, return_inverse=True)
        # Of equal vectors the ``most`` smallest ids can be asked for.
        by_vector = np.argsort(number, kind="stable")
        begin = np.searchsorted(number[by_vector], np.arange(len(first)))
        place = np.arange(len(ids)) - begin[number[by_vector]]
        few = by_vector[place < most]
        self.ids, self.owner = ids[few], number[few]
        self.vectors = vectors[first]
        self.rows = scaled(self.vectors)
        self.lengths = _norms(self.rows)
        self.points = (self.rows / self.lengths[:, None]) @ base
        leaves = [np.arange(len(first))]
        while max(map(len, leaves)) > LEAF:
            cut = []
            for leaf in leaves:
                if len(leaf) <= LEAF:
                    cut.append(leaf)
                    continue
                axis = np.ptp(self.points[leaf], axis=0).argmax()
                half = np.argpartition(self.points[leaf, axis], len(leaf) // 2)
                cut += [leaf[half[: len(leaf) // 2]], leaf[half[len(leaf) // 2 :]]]
            leaves = cut
        self.leaves = leaves
        self.boxes = np.array([[self.points[x].min(axis=0), self.points[x].max(axis=0)] for x in leaves])
        self.starts = np.searchsorted(self.owner, np.arange(len(first) + 1))

    def search(self, query_id: int, vector: np.ndarray, base: np.ndarray, bound: float, k: int, factor: float) -> list[tuple[float, int, int]]:
        """Up to k (-cosine, id, number of the vector), the best first; ``bound`` is a squared distance within which k others lie."""
        row = scaled(vector[None])
        length = _norms(row)[0]
        point = (row[0] / length) @ base
        gaps = _outside(self.boxes, point)
        best: list[tuple[float, int, int]] = []
        reach = bound
        order = np.argsort(gaps, kind="stable")
        for at in range(0, len(order), _STEP):
            step = order[at : at + _STEP]
            # The test: unseen points lie at this projected distance or beyond.
            if gaps[step[0]] >= factor * reach:
                break
            some = np.concatenate([self.leaves[x] for x in step])
            away = self.points[some] - point
            some = some[(away * away).sum(axis=1) < factor * reach]
            if not len(some):
                continue
            score = cosines(self.rows[some], self.lengths[some], row[0], length)
            for x in np.argsort(-score, kind="stable").tolist():
                if len(best) >= k and -score[x] > best[k - 1][0]:
                    break
                ids = self.ids[self.starts[some[x]] : self.starts[some[x] + 1]].tolist()
                best = sorted(best + [(-float(score[x]), i, int(some[x])) for i in ids if i != query_id])[:k]
            if len(best) >= k:
                # A little room: a point as far as the k-th may have a smaller id.
                reach = min(reach, max(2 + 2 * best[k - 1][0], 0.0) + 1e-9)
        return best


def _packed(vectors: DataFrame, length: int) -> DataFrame:
    """(vec_id, vector) with the components as bytes; what takes no part is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length) + 0.0  # no negative zeros
            good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            blobs = [r.tobytes() for r in rows[good]]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").filter(pa.array(good)), "vector": pa.array(blobs, pa.binary())})

    whole = (F.size("embedding") == length) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("vec_id").isNotNull()
    given = vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return given.mapInArrow(run, "vec_id long, vector binary").distinct()


def search(vectors: DataFrame, asked: str, k: int = 5, confidence: float = CONFIDENCE, piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of every row for which ``asked`` (SQL on vec_id) holds."""
    spark = vectors.sparkSession
    sizes = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count()
    usual = sizes.orderBy(F.desc("count"), "n").first()
    length = usual["n"] if usual else 1
    rows = _packed(vectors, length)
    base = directions(length)
    factor = quantile(confidence, DIRECTIONS)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    total = usual["count"] if usual else 0
    ids = np.array([r["vec_id"] for r in chosen], np.int64)
    known = np.array([np.frombuffer(r["vector"], np.float64) for r in chosen]).reshape(-1, length)
    known = scaled(known) if len(known) else known
    known = known / _norms(known)[:, None]
    depth = max(0, min(math.ceil(math.log2(max(1, total / piece))), int(math.log2(max(1, len(known) / 16)))))
    splits = Splits(known @ base, depth)
    shared = spark.sparkContext.broadcast((ids, known, base, vars(splits)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector in its cell, and for each query in every cell within its bound."""
        ids, known, base, state = shared.value
        splits = Splits.of(state)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(-1, length)
            unit = scaled(raw)
            unit = unit / _norms(unit)[:, None]
            points = unit @ base
            number = batch.column("vec_id").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {"cell": pa.array(splits.cells(points), pa.int32()), "kind": pa.array(np.zeros(len(raw)), pa.int32()), "vec_id": batch.column("vec_id"), "vector": batch.column("vector"), "bound": pa.array(np.full(len(raw), np.inf))}
            )
            cells, who, bounds = [], [], []
            for q in np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False)):
                near = known @ unit[q]
                near[ids == number[q]] = -np.inf
                bound = np.inf if len(near) <= k else max(2 - 2 * float(np.partition(near, -k)[-k]), 0.0) + 1e-9
                found = splits.near(points[q], factor * bound)
                cells.append(found)
                who.append(np.full(len(found), q))
                bounds.append(np.full(len(found), bound))
            if who:
                who = np.concatenate(who)
                yield pa.RecordBatch.from_pydict(
                    {"cell": pa.array(np.concatenate(cells), pa.int32()), "kind": pa.array(np.ones(len(who)), pa.int32()), "vec_id": batch.column("vec_id").take(pa.array(who)), "vector": batch.column("vector").take(pa.array(who)), "bound": pa.array(np.concatenate(bounds))}
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by cell, piece and kind: the vectors of a tree, then its queries."""
        from xxhash import xxh64_intdigest

        _, _, base, _ = shared.value
        held: list[pa.RecordBatch] = []
        tree, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "piece", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, (cell, number, kind) = batch.slice(a, b - a), key[a].tolist()
                if (cell, number) != now:
                    now, held, tree = (cell, number), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if tree is None:
                    all_rows = joined(held)
                    raw = np.frombuffer(b"".join(all_rows.column("vector").to_pylist()), np.float64).reshape(-1, length)
                    tree = Tree(all_rows.column("vec_id").to_numpy(), raw, base, k + 1)
                out = []
                for q, blob, bound in zip(*(part.column(c).to_pylist() for c in ("vec_id", "vector", "bound")), strict=True):
                    found = tree.search(q, np.frombuffer(blob, np.float64), base, bound, k, factor)
                    out += [(q, i, -s, xxh64_intdigest(tree.vectors[x].tobytes()) - (1 << 63)) for s, i, x in found]
                if out:
                    columns = zip(*out, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score", "name"])

    marked = rows.withColumn("asked", F.coalesce(F.expr(asked), F.lit(False)))
    placed = marked.mapInArrow(place, "cell int, kind int, vec_id long, vector binary, bound double")
    # A large cell is cut into pieces; each of its queries goes to all of them.
    counts = placed.filter("kind = 0").groupBy("cell").count()
    pieces = counts.select("cell", F.ceil(F.col("count") / piece).cast("int").alias("n"))
    placed = placed.join(pieces, "cell")
    own = F.array(F.expr("CAST(pmod(xxhash64(vec_id), n) AS INT)"))
    to = F.when(F.col("kind") == 0, own).otherwise(F.expr("sequence(0, n - 1)"))
    dealt = placed.withColumn("piece", F.explode(to)).select("cell", "piece", "kind", "vec_id", "vector", "bound")
    dealt = dealt.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "kind")
    found = dealt.mapInArrow(answer, "query_id long, vec_id long, score double, name long")
    found = found.groupBy("query_id", "vec_id", "name").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "name")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
