"""Connected components and enclosed holes of sparse voxel masks.

Volumes are never gathered per case: a case may hold any share of all voxels.
Masks are cut into cubic tiles.  A task takes many whole tiles at once (an Arrow
batch, ordered by tile): cells of a line are runs along x, runs of neighbouring
lines touch where their intervals overlap, and the runs are labelled together.
Components that touch across tile faces are then merged by star contraction of the
tile-level components, in logarithmically many rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseward.functions.batches import changes, whole_groups
from caseward.operators.connected import connected_components
from caseward.sources.shared import stored

TILE = 32
AXES = ("z", "y", "x")
TILES = ["case_id", "tz", "ty", "tx"]
# Cell keys keep raster order: 20 bits per axis.
_BITS = 20


def cell_key(z: str = "z", y: str = "y", x: str = "x") -> str:
    shift = 1 << _BITS
    return f"((CAST({z} AS BIGINT) * {shift} + {y}) * {shift} + {x})"


def runs_of(cells: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of cells along x begin, and the run of each cell; cells (z, y, x) come in raster order within their tiles."""
    new = np.ones(len(cells), bool)
    new[1:] = (tile[1:] != tile[:-1]) | (cells[1:, :2] != cells[:-1, :2]).any(axis=1) | (cells[1:, 2] != cells[:-1, 2] + 1)
    return np.flatnonzero(new), np.cumsum(new) - 1


def touching_runs(cells: np.ndarray, tile: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of one tile that touch across a y- or z-face: neighbouring lines whose x-intervals overlap."""
    first, last = cells[starts], cells[np.append(starts[1:], len(cells)) - 1]
    low = cells.min(axis=0) - 1
    span = cells.max(axis=0) - low + 2
    line = (tile[starts] * span[0] + first[:, 0] - low[0]) * span[1] + first[:, 1] - low[1]
    begin, end = (line * span[2] + x[:, 2] - low[2] for x in (first, last))
    pairs = []
    for step in (1, span[1]):
        # Runs are ordered by line and x, so those that overlap with a shifted run stand side by side.
        lo = np.searchsorted(end, begin + step * span[2])
        hi = np.searchsorted(begin, end + step * span[2], side="right")
        count = np.maximum(hi - lo, 0)
        done = np.cumsum(count)
        pairs.append((np.repeat(np.arange(len(starts)), count), np.repeat(lo - (done - count), count) + np.arange(count.sum())))
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def least_labels(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least element that each of ``size`` elements is connected to."""
    label = np.arange(size)
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _positions(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack([rows.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64)


def first_cells(rows: pa.RecordBatch) -> np.ndarray:
    """Row of the first cell of each cell's 6-connected component inside its tile, for whole tiles in raster order."""
    tile = np.cumsum(changes(rows, TILES)) - 1
    cells = _positions(rows)
    starts, run = runs_of(cells, tile)
    return starts[least_labels(len(starts), *touching_runs(cells, tile, starts))][run]


def label_tiles(rows: pa.RecordBatch, first: np.ndarray) -> pa.Array:
    """Key of the first cell of each cell's component inside its tile, the smallest one."""
    at = _positions(rows)[first]
    return pa.array(((at[:, 0] << _BITS) + at[:, 1] << _BITS) + at[:, 2])


def in_tiles(cells: DataFrame) -> DataFrame:
    """Rows with their tile (tz, ty, tx), each tile in one task and in raster order."""
    return cells.repartition(*TILES).sortWithinPartitions(*TILES, *AXES)


def label_components(cells: DataFrame, tile: int = TILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """6-connected components of distinct cells (case_id, z, y, x).

    Adds ``root``: the key of the component's first cell in raster order.  Columns
    named in ``carry`` stay with their cells.
    """
    local = _tile_components(cells, tile, carry)
    merged = connected_components(_faces(local, tile), ("case_id",))
    return _merged(local, merged).select("case_id", *AXES, *carry, "root")


def _tile_components(cells: DataFrame, tile: int, carry: tuple[str, ...] = (), spread: tuple[str, ...] = ()) -> DataFrame:
    """Cells with the ``root`` of their component inside their tile; a ``spread`` flag holds for a whole component if for one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, TILES):
            first = first_cells(rows)
            out = {c: rows.column(c) for c in ("case_id", *AXES, *carry)} | {"root": label_tiles(rows, first)}
            for c in spread:
                flag = np.zeros(rows.num_rows, bool)
                flag[first[rows.column(c).to_numpy(zero_copy_only=False)]] = True
                out[c] = pa.array(flag[first])
            yield pa.RecordBatch.from_pydict(out)

    cells = cells.selectExpr("case_id", *[f"CAST({a} AS INT) AS {a}" for a in AXES], *carry, *spread)
    tiled = cells.select("*", *[F.floor(F.col(a) / tile).cast("int").alias(f"t{a}") for a in AXES])
    types = dict(cells.dtypes)
    schema = ", ".join(["case_id string, z int, y int, x int", *[f"{c} {types[c]}" for c in carry], "root bigint", *[f"{c} boolean" for c in spread]])
    return stored(in_tiles(tiled).mapInArrow(run, schema), "tiles")


def _merged(local: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of tile components with the ``root`` of the whole component in place of the tile's."""
    joined = local.join(merged.withColumnsRenamed({"root": "label", "node": "root"}), ["case_id", "root"], "left")
    return joined.withColumn("root", F.coalesce("label", "root")).drop("label")


def _faces(local: DataFrame, tile: int, end: str = "root") -> DataFrame:
    """Edges (case_id, a, b) of local components that meet across a tile face; ``end`` says what stands for a component.

    A cell at a face and the cell behind it share one key (the axis and the upper
    cell), so all three axes are one grouping; a key holds two cells at most.
    """
    ends = []
    for axis in AXES:
        for low in (1, 0):
            upper = [f"{a} + {low}" if a == axis else a for a in AXES]
            at = f"pmod({axis}, {tile}) = {tile - 1 if low else 0}"
            ends.append(f"CASE WHEN {at} THEN named_struct('axis', '{axis}', 'z', {upper[0]}, 'y', {upper[1]}, 'x', {upper[2]}, 'low', {low}) END")
    sides = local.selectExpr("case_id", f"{end} AS end", f"explode(filter(array({', '.join(ends)}), e -> e IS NOT NULL)) AS e").select("case_id", "end", "e.*")
    pairs = sides.groupBy("case_id", "axis", *AXES).agg(
        F.max(F.when(F.col("low") == 1, F.col("end"))).alias("a"), F.max(F.when(F.col("low") == 0, F.col("end"))).alias("b")
    )
    return pairs.filter("a IS NOT NULL AND b IS NOT NULL").select("case_id", "a", "b").distinct()


def number_components(labelled: DataFrame) -> DataFrame:
    """Raster-order component numbers per case, from 1.

    Numbers come from two bounded windows: components are counted per slice, the
    slice offsets are summed per case (one row per slice), and the components of
    a slice are numbered within it.  No window holds all components of a case.
    """
    roots = labelled.select("case_id", "root").distinct()
    line = F.expr(f"shiftright(root, {_BITS})")
    roots = roots.withColumn("line", line)
    counts = roots.groupBy("case_id", "line").agg(F.count("*").alias("n"))
    before = Window.partitionBy("case_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("case_id", "line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("case_id", "line").orderBy("root")
    numbered = roots.select("case_id", "line", "root", F.row_number().over(inner).alias("pos"))
    return numbered.join(offsets, ["case_id", "line"]).select(
        "case_id", "root", (F.col("offset") + F.col("pos")).cast("int").alias("lesion_id")
    )


def with_halo(cells: DataFrame, halo: str = "true", tile: int = TILE) -> DataFrame:
    """Cells with their tile (tz, ty, tx) and ``own``.

    A cell on a tile's face for which ``halo`` (SQL) holds comes a second time, not
    ``own``, with the tile behind that face: a tile then knows all neighbours of its
    cells, and one shuffle is enough.
    """
    here = {f"t{a}": f"CAST(floor({a} / {tile}) AS INT)" for a in AXES}
    places = [_place(here, True)]
    for axis in AXES:
        for edge, step in ((0, -1), (tile - 1, 1)):
            there = here | {f"t{axis}": f"{here[f't{axis}']} + {step}"}
            places.append(f"CASE WHEN pmod({axis}, {tile}) = {edge} AND ({halo}) THEN {_place(there, False)} END")
    return cells.selectExpr("*", f"inline(filter(array({', '.join(places)}), p -> p IS NOT NULL))")


def _place(tiles: dict[str, str], own: bool) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in tiles.items()) + f", 'own', {str(own).lower()})"


def surrounded(cells: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Which of the cells (z, y, x), in raster order within their tiles, have all six neighbours in their tile's cells."""
    if not len(cells):
        return np.zeros(0, bool)
    at = cells - (cells.min(axis=0) - 1)
    span = at.max(axis=0) + 2
    key = ((tile * span[0] + at[:, 0]) * span[1] + at[:, 1]) * span[2] + at[:, 2]
    out = np.ones(len(key), bool)
    for step in (1, span[2], span[1] * span[2]):
        for near in (key - step, key + step):
            out &= key[np.minimum(np.searchsorted(key, near), len(key) - 1)] == near
    return out


def erode(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells whose six neighbours are all in the mask; outside counts as background."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, TILES):
            inner = surrounded(_positions(rows), np.cumsum(changes(rows, TILES)) - 1)
            own = rows.column("own").to_numpy(zero_copy_only=False)
            yield rows.select(["case_id", *AXES]).filter(pa.array(inner & own))

    rows = with_halo(cells.selectExpr("case_id", *[f"CAST({a} AS INT) AS {a}" for a in AXES]), tile=tile)
    return in_tiles(rows).mapInArrow(run, "case_id string, z int, y int, x int")


def _covered(mask: DataFrame) -> DataFrame:
    """Lines (case_id, z, y) along x with the stretch of x on which all four neighbouring lines are mask or gap.

    Between its first and last mask cell a line is mask or gap throughout, so the
    neighbours' ends are enough: one row per line.  Null where a neighbour has no cell.
    """
    lines = mask.groupBy("case_id", "z", "y").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    for axis, other in (("y", "z"), ("z", "y")):
        w = Window.partitionBy("case_id", other).orderBy(axis)
        between = (F.lag(axis).over(w) == F.col(axis) - 1) & (F.lead(axis).over(w) == F.col(axis) + 1)
        lines = lines.withColumn(f"from_{axis}", F.when(between, F.greatest(F.lag("first").over(w), F.lead("first").over(w))))
        lines = lines.withColumn(f"to_{axis}", F.when(between, F.least(F.lag("last").over(w), F.lead("last").over(w))))
    return lines.drop("first", "last")


def enclosed_cells(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Background cells not 6-connected to the outside of the mask.

    Candidates are the gaps between two mask cells of one x-line.  A candidate is
    open when a y- or z-neighbour is neither mask nor candidate; components of
    candidates without an open cell are holes.  Tile components with an open cell
    are open themselves, so only the others are merged: a component of them leaks
    when it meets an open one across a tile face.
    """
    cells = mask.select("case_id", *AXES).filter("case_id IS NOT NULL")
    nxt = F.lead("x").over(Window.partitionBy("case_id", "z", "y").orderBy("x"))
    # A left join: gaps of lines without a place (null z or y) are not lost here but refused by the labelling.
    gaps = cells.withColumn("nxt", nxt).filter("nxt > x + 1").join(_covered(cells.na.drop()), ["case_id", "z", "y"], "left")
    gaps = gaps.withColumn("x", F.explode(F.expr("sequence(x + 1, nxt - 1)")))
    within = " AND ".join(f"x BETWEEN from_{a} AND to_{a}" for a in ("y", "z"))
    candidates = gaps.selectExpr("case_id", *AXES, f"NOT coalesce({within}, false) AS open")
    local = _tile_components(candidates, tile, spread=("open",))
    edges = stored(_faces(local, tile, "struct(root, open)").filter("NOT (a.open AND b.open)"), "faces")
    merged = connected_components(edges.filter("NOT (a.open OR b.open)").selectExpr("case_id", "a.root AS a", "b.root AS b"), ("case_id",))
    leaks = edges.filter("a.open OR b.open").selectExpr("case_id", "if(a.open, b.root, a.root) AS root")
    leaks = _merged(leaks.distinct(), merged).distinct()
    return _merged(local.filter("NOT open"), merged).join(leaks, ["case_id", "root"], "left_anti").select("case_id", *AXES)
