"""Operator 11: conversation structure repair by a grammar-compressed dynamic programme.

Rows of a conversation, in order of turn (nulls first), then role, then text, have
one fault at most: ``blank`` (no character but white space), ``duplicate`` (its role
and text stand in an earlier row), ``truncated`` (its last character that is no
white space is none of ``.!?``).  Edits keep a row (0), give it the role user or
assistant (3), delete it (4; blank and duplicate rows must be deleted), or insert an
empty row of user or assistant (3); a truncated row that is not deleted adds 3.  The
cheapest edits whose role initials read ``(s?(ua)+)?`` are found; of several the one
whose initials (K, R, D, I) come first in ASCII.

Search: a row is one of nine symbols (role initial and fault).  Re-Pair replaces the
most frequent pairs of neighbouring symbols by new ones until no pair occurs twice;
all different sequences of a slab share the rules.  Every symbol has one 4 x 4
matrix over the states (nothing yet, after s, after u, after a): the least cost from
state to state, the rank of its audit among those of the matrix, and a rope - which
middle state joins the ropes of the two halves.  A rule's matrix is the min-plus
product of the two below it, rule by rule upwards.  Inserts stand before their row,
so that no audit of a symbol is the beginning of another one, and ranks compare
audits without writing them; only the audits chosen are written.

Scale: one shuffle by ranges of (conversation, turn, role, text), sorted; a task
repairs the conversations that lie wholly inside it.  Those at a task's edges, and
longer than ``LONG_BYTES``, go on in pieces of bounded size: duplicates by a
grouping, a matrix for each piece, a walk over the matrices of a conversation (a few
hundred bytes for a piece), then the texts of the pieces.  A conversation with a
third of all rows is so spread over many tasks.  Only the hash of its text, which
has to be taken in order, is a stream through one task.

Defined results: null roles and texts are one space; a role whose initial is none of
s, u, a cannot be kept; rows equal in everything are repeats; a conversation without
rows (``gone`` is true for all) has zeros, an empty audit and text; a null conv_id is
a conversation; texts are used whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.slabs import joined, ragged
from caseward.sources.shared import stored

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Rows and bytes of text of a piece; a conversation beyond LONG_BYTES goes on in pieces; bytes handled at once.
PIECE_ROWS, PIECE_BYTES, LONG_BYTES, _SLAB = 4096, 1 << 20, 4 << 20, 4 << 20
#: Symbols: 2 * role (s, u, a, other) + truncated, and rows that must go.
GONE, SYMBOLS = 8, 9
STATES = 4
#: What the states need to end well: inserts of user and assistant.
_LEFT = (0, 2, 1, 0)
_FAR = 1 << 40
_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def base_audits() -> list[list[list[tuple[int, str]]]]:
    """[symbol][state before][state after]: cost and audit; inserts stand before the row's letter."""
    before = {(p, p): 0 for p in range(STATES)} | {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}
    opens, out = (0, 1, 3), []
    for symbol in range(SYMBOLS):
        role, extra = divmod(symbol, 2)
        steps = [(q, q, DELETE, "D") for q in range(STATES)]
        if symbol != GONE:
            keeps = {0: [(0, 1)], 1: [(q, 2) for q in opens], 2: [(2, 3)], 3: []}[role]
            steps += [(q, r, TRUNCATED * extra, "K") for q, r in keeps]
            steps += [(q, r, REROLE + TRUNCATED * extra, "R") for q, r in [(2, 3), *((q, 2) for q in opens)]]
        table = [[(_FAR, "~")] * STATES for _ in range(STATES)]
        for (p, q), n in before.items():
            for a, r, cost, letter in steps:
                if a == q:
                    table[p][r] = min(table[p][r], (cost + n * INSERT, "I" * n + letter))
        out.append(table)
    return out


class Grammar:
    """Re-Pair rules over sequences of symbols, with a matrix and a rope for each."""

    def __init__(self, sequences: list[np.ndarray]):
        self.base = base_audits()
        cost = np.array([[[e[0] for e in row] for row in table] for table in self.base], np.int64)
        rank = np.empty_like(cost)
        for k, table in enumerate(self.base):
            texts = [e[1] for row in table for e in row]
            rank[k] = np.reshape([sum(t < s for t in texts) for s in texts], (STATES, STATES))
        self.cost, self.rank = cost, rank
        self.rope = np.zeros_like(cost)
        self.halves = np.zeros((SYMBOLS, 2), np.int64)
        self.known: dict[tuple[int, int, int], str] = {}
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.symbols = np.concatenate([np.zeros(0, np.int64), *sequences]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sequences)), lengths)
        while self._round():
            pass
        self.starts = np.searchsorted(self.owner, np.arange(len(sequences) + 1))

    def _round(self) -> bool:
        """Replace the most frequent pairs that share no symbol."""
        base, symbols = len(self.cost), self.symbols
        pair = symbols[:-1] * base + symbols[1:]
        pair[self.owner[1:] != self.owner[:-1]] = -1
        keys, counts = np.unique(pair[pair >= 0], return_counts=True)
        keys, counts = keys[counts > 1], counts[counts > 1]
        if not len(keys):
            return False
        taken: set[int] = set()
        chosen = []
        for key in keys[np.lexsort((keys, -counts))].tolist():
            both = set(divmod(key, base))
            if not both & taken:
                taken |= both
                chosen.append(key)
        chosen = np.array(sorted(chosen), np.int64)
        left, right = chosen // base, chosen % base
        cost, rank, middle = product(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
        self.cost, self.rank, self.rope = np.concatenate([self.cost, cost]), np.concatenate([self.rank, rank]), np.concatenate([self.rope, middle])
        self.halves = np.concatenate([self.halves, np.stack([left, right], axis=1)])
        number = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
        at = np.flatnonzero(chosen[number] == pair)
        # In a run of one symbol every other pair is taken, from the left.
        lead = np.ones(len(at), bool)
        lead[1:] = (at[1:] != at[:-1] + 1) | (pair[at[1:]] != pair[at[:-1]])
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(lead, place, 0))) % 2 == 0]
        symbols[at] = base + number[at]
        rest = np.ones(len(symbols), bool)
        rest[at + 1] = False
        self.symbols, self.owner = symbols[rest], self.owner[rest]
        return True

    def matrices(self) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Cost and rank from state to state of each whole sequence, and the steps (sequences, middle states) to trace them."""
        n = len(self.starts) - 1
        cost = np.full((n, STATES, STATES), _FAR)
        cost[:, range(STATES), range(STATES)] = 0
        rank = np.zeros_like(cost)
        steps = []
        sizes = np.diff(self.starts)
        for t in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > t)
            symbol = self.symbols[self.starts[live] + t]
            cost[live], rank[live], middle = product(cost[live], rank[live], self.cost[symbol], self.rank[symbol])
            steps.append((live, middle))
        return cost, rank, steps

    def expanded(self, symbol: int, p: int, q: int) -> str:
        """The audit of a symbol from state to state."""
        if symbol < SYMBOLS:
            return self.base[symbol][p][q][1]
        key = symbol, p, q
        if key not in self.known:
            left, right = self.halves[symbol].tolist()
            m = int(self.rope[key])
            self.known[key] = self.expanded(left, p, m) + self.expanded(right, m, q)
        return self.known[key]

    def audits(self, steps: list[tuple[np.ndarray, np.ndarray]], entry: np.ndarray, leave: np.ndarray) -> list[str]:
        """The audit of each sequence from its state of entry to the one it leaves in."""
        parts: list[list[str]] = [[] for _ in entry]
        now = leave.copy()
        for t in range(len(steps) - 1, -1, -1):
            live, middle = steps[t]
            m = middle[np.arange(len(live)), entry[live], now[live]]
            for s, symbol, p, q in zip(live.tolist(), self.symbols[self.starts[live] + t].tolist(), m.tolist(), now[live].tolist(), strict=True):
                parts[s].append(self.expanded(symbol, p, q))
            now[live] = m
        return ["".join(reversed(p)) for p in parts]


def product(cost_a: np.ndarray, rank_a: np.ndarray, cost_b: np.ndarray, rank_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus product of stacks of matrices, ties by the audits: cost, rank, middle state."""
    both = (cost_a[:, :, :, None] + cost_b[:, None, :, :]) << 8
    both |= (rank_a[:, :, :, None] << 4) | rank_b[:, None, :, :]
    middle = both.argmin(axis=2)
    least = np.take_along_axis(both, middle[:, :, None, :], 2)[:, :, 0, :]
    code = (least & 255).reshape(len(least), -1)
    rank = (code[:, None, :] < code[:, :, None]).sum(axis=2).reshape(least.shape)
    return np.minimum(least >> 8, _FAR), rank, middle


def best_end(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, whole cost) of the best way from the start; cost and rank are rows over the states reached."""
    key = ((cost + np.array(_LEFT) * INSERT) << 8) | rank
    state = key.argmin(axis=1)
    return state, key[np.arange(len(key)), state] >> 8


def _change(*columns: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before (nulls are equal); the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _classes(role: pa.Array) -> np.ndarray:
    found = pc.index_in(pc.utf8_slice_codeunits(role, 0, 1), pa.array(["s", "u", "a"]))
    return pc.fill_null(found, 3).to_numpy().astype(np.int64)


def _illegal(role: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each row and the one before it, of the same conversation, are none of su, ua, au."""
    out = np.zeros(len(role), bool)
    pair = 4 * role[:-1] + role[1:]
    out[1:] = ~start[1:] & ~np.isin(pair, (1, 6, 9))
    return out


def repaired_text(audit: str, state: int, roles: list[str], texts: list[str]) -> str | None:
    """``role:text`` lines after the edits; None without a line.  ``state`` is the one before the first row."""
    lines, row = [], 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        due, after = ("assistant", 3) if state == 2 else ("user", 2)
        if letter == "I":
            lines.append(due + ":")
        elif letter == "R":
            lines.append(due + ":" + texts[row])
        else:
            lines.append(roles[row] + ":" + texts[row])
            after = 1 if roles[row][:1] == "s" else after
        row += letter != "I"
        state = after
    return "\n".join(lines) if lines else None


_ROW = "turn long, role string, text string, gone boolean"


def _ordered(conversations: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in conversations.columns else F.lit(False)
    texts = [F.when(~F.col("_g"), F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", gone.alias("_g"))
    rows = rows.select("conv_id", "turn", *texts, F.col("_g").alias("gone"))
    # The beginnings of texts are in the order of the texts: a turn with many rows is split as well.
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text")


def _marks(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are blank, and which are cut off."""
    blank = ~pc.fill_null(pc.match_substring_regex(text, _BLANK), False).to_numpy(zero_copy_only=False)
    ended = pc.fill_null(pc.match_substring_regex(text, _ENDED), False).to_numpy(zero_copy_only=False)
    return blank, ~blank & ~ended


def closed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The repair of whole conversations, one after the other in the rows."""
    conv = rows.column("conv_id")
    new = _change(conv)
    begin = np.flatnonzero(new)
    here = ~rows.column("gone").to_numpy(zero_copy_only=False)
    group = (np.cumsum(new) - 1)[here]
    n = len(begin)
    rows = rows.filter(pa.array(here))
    role, text, turn = rows.column("role"), rows.column("text"), rows.column("turn")
    start = np.ones(len(group), bool)
    start[1:] = group[1:] != group[:-1]
    blank, cut = _marks(text)
    who, what = (c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (role, text))
    name = (group * (int(who.max(initial=0)) + 1) + who) * (int(what.max(initial=0)) + 1) + what
    again = np.ones(len(group), bool)
    again[np.unique(name, return_index=True)[1]] = False
    again &= ~blank
    cut &= ~again
    kind = _classes(role)
    symbol = np.where(blank | again, GONE, 2 * kind + cut).astype(np.uint8)
    stated = turn.is_valid().to_numpy(zero_copy_only=False)
    number = pc.fill_null(turn, 0).to_numpy()
    fresh = stated & (start | np.append(True, (number[1:] != number[:-1]) | ~stated[:-1]))
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group[stated], number[stated])
    np.maximum.at(high, group[stated], number[stated])
    distinct = np.bincount(group[fresh], minlength=n)
    some = distinct > 0
    gaps = np.zeros(n, np.int64)
    gaps[some] = high[some] - low[some] + 1 - distinct[some]
    bounds = np.searchsorted(group, np.arange(n + 1)).tolist()
    data = symbol.tobytes()
    sequence = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    different = {s: i for i, s in enumerate(dict.fromkeys(sequence))}
    grammar = Grammar([np.frombuffer(s, np.uint8) for s in different])
    cost, rank, steps = grammar.matrices()
    state, total = best_end(cost[:, 0], rank[:, 0])
    audits = [a + "I" * _LEFT[q] for a, q in zip(grammar.audits(steps, np.zeros(len(state), np.int64), state), state.tolist(), strict=True)]
    which = [different[s] for s in sequence]
    roles, texts = role.to_pylist(), text.to_pylist()
    lines = [repaired_text(audits[w], 0, roles[a:b], texts[a:b]) for w, a, b in zip(which, bounds[:-1], bounds[1:], strict=True)]
    count = [np.bincount(group[x], minlength=n) for x in (blank, again, cut, _illegal(kind, start))]
    figures = dict(zip(_FIGURES, [gaps, *count, total[which]], strict=True))
    return pa.RecordBatch.from_pydict(
        {"conv_id": conv.take(pa.array(begin))}
        | {k: pa.array(v.astype(np.int64)) for k, v in figures.items()}
        | {"audit": pa.array([audits[w] for w in which], pa.string()), "repaired": pa.array([x or "" for x in lines], pa.string())}
    )


def _first_pass(rows: DataFrame, long_bytes: int, piece_rows: int) -> DataFrame:
    """Repairs of the conversations inside a task; the rows of the others, numbered by task, piece and place."""
    kind = dict(rows.dtypes)["conv_id"]
    result = f"conv_id {kind}, " + ", ".join(f"{f} long" for f in _FIGURES) + ", audit string, repaired string"
    open_row = f"part int, piece int, place int, {_ROW}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["conv_id", *_FIGURES, "audit", "repaired", "part", "piece", "place", "turn", "role", "text", "gone"]
        shape = {"audit": pa.string(), "repaired": pa.string(), "role": pa.string(), "text": pa.string(), "gone": pa.bool_()} | {c: pa.int32() for c in ("part", "piece", "place")}

        def sent(columns: dict) -> pa.RecordBatch:
            size = len(columns["conv_id"])
            return pa.RecordBatch.from_pydict({c: columns[c] if c in columns else pa.nulls(size, shape.get(c, pa.int64())) for c in names})

        piece = place = held_bytes = 0
        filled = 0

        def opened(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal piece, place, filled
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            pieces, places = [], []
            for new, size in zip(_change(batch.column("conv_id")).tolist(), sizes, strict=True):
                if place and (new and not pieces or place >= piece_rows or filled + size > PIECE_BYTES):
                    piece, place, filled = piece + 1, 0, 0
                pieces.append(piece)
                places.append(place)
                place, filled = place + 1, filled + size
            columns = {c: batch.column(c) for c in ("conv_id", "turn", "role", "text", "gone")}
            yield sent(columns | {"part": pa.array([part] * len(pieces), pa.int32()), "piece": pa.array(pieces, pa.int32()), "place": pa.array(places, pa.int32())})

        held: list[pa.RecordBatch] = []
        first = True  # the conversation at hand began in a task before, perhaps, or has become too long
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            held_bytes += sum(pc.sum(pc.binary_length(batch.column(c))).as_py() or 0 for c in ("role", "text")) + 64 * batch.num_rows
            if held_bytes < min(_SLAB, long_bytes):
                continue
            rows = joined(held)
            cuts = np.flatnonzero(_change(rows.column("conv_id"))).tolist()
            if first:
                # It ends where the next one begins.
                stop = cuts[1] if len(cuts) > 1 else rows.num_rows
                yield from opened(rows.slice(0, stop))
                rows, first = rows.slice(stop), len(cuts) == 1
                cuts = [c - stop for c in cuts[1:]]
            if len(cuts) > 1:
                yield sent({c: x for c, x in zip(names, closed(rows.slice(0, cuts[-1])).columns, strict=False)})
                rows = rows.slice(cuts[-1])
            held_bytes = sum(pc.sum(pc.binary_length(rows.column(c))).as_py() or 0 for c in ("role", "text")) + 64 * rows.num_rows
            if held_bytes >= long_bytes:
                yield from opened(rows)
                rows, first, held_bytes = rows.slice(rows.num_rows), True, 0
            held = [rows] if rows.num_rows else []
        if held:
            rows = joined(held)
            cuts = np.flatnonzero(_change(rows.column("conv_id"))).tolist()
            # The first may have begun before, the last may go on.
            stop = (cuts[1] if len(cuts) > 1 else rows.num_rows) if first else 0
            last = cuts[-1] if cuts[-1] >= stop else rows.num_rows
            if stop:
                yield from opened(rows.slice(0, stop))
            if last > stop:
                yield sent({c: x for c, x in zip(names, closed(rows.slice(stop, last - stop)).columns, strict=False)})
            if last < rows.num_rows:
                yield from opened(rows.slice(last))

    return rows.mapInArrow(run, f"{result}, {open_row}")


_PIECE = ["conv_id", "part", "piece"]


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows in batches of whole groups; rows come ordered by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < limit:
            continue
        rows = joined(held)
        last = int(np.flatnonzero(_change(*(rows.column(k) for k in keys)))[-1])
        if last:
            yield rows.slice(0, last)
        held = [rows.slice(last)]
    if held:
        yield joined(held)


class Pieces:
    """Symbols and matrices of pieces, one after the other in the rows."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows
        new = _change(*(rows.column(k) for k in _PIECE))
        self.begin = np.flatnonzero(new)
        self.bounds = np.append(self.begin, rows.num_rows)
        self.group = np.cumsum(new) - 1
        self.start = new
        self.kind = _classes(rows.column("role"))
        self.blank, self.again, self.cut = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("is_blank", "is_again", "is_cut"))
        symbol = np.where(self.blank | self.again, GONE, 2 * self.kind + self.cut)
        self.grammar = Grammar([symbol[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)])
        self.cost, self.rank, self.steps = self.grammar.matrices()

    def keys(self) -> dict:
        return {k: self.rows.column(k).take(pa.array(self.begin)) for k in _PIECE}


def _same(a: str, b: str, keys: list[str]):
    """Equal keys, nulls included."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _in_pieces(rows: DataFrame) -> DataFrame:
    """The repair of conversations in pieces, a row for each piece; figures of a conversation stand in its first."""
    kind = dict(rows.dtypes)["conv_id"]
    present = rows.filter("NOT gone").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    earliest = present.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("part", "piece", "place")).alias("earliest"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(_ENDED)
    named = present.alias("x").join(earliest.alias("y"), _same("x", "y", ["conv_id", "role", "h1", "h2"]))
    again = F.struct("x.part", "x.piece", "x.place") > F.col("earliest")
    marked = named.select(*[f"x.{c}" for c in (*_PIECE, "place", "turn", "role", "text")], blank.alias("is_blank"), again.alias("is_again"), cut.alias("is_cut"))
    marked = marked.withColumn("is_again", ~F.col("is_blank") & F.col("is_again"))
    marked = marked.withColumn("is_cut", F.col("is_cut") & ~F.col("is_blank") & ~F.col("is_again"))
    marked = stored(marked, "dialogue-rows")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, _PIECE):
            p = Pieces(rows)
            n = len(p.begin)
            turn = rows.column("turn")
            stated = turn.is_valid().to_numpy(zero_copy_only=False)
            number = pc.fill_null(turn, 0).to_numpy()
            fresh = stated & (p.start | np.append(True, (number[1:] != number[:-1]) | ~stated[:-1]))
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(low, p.group[stated], number[stated])
            np.maximum.at(high, p.group[stated], number[stated])
            counts = [fresh, p.blank, p.again, p.cut, _illegal(p.kind, p.start)]
            figures = [np.bincount(p.group[c], minlength=n) for c in counts]
            named = dict(zip(("turns", "blank", "duplicate", "truncated", "illegal"), figures, strict=True))
            named |= {"low": low, "high": high, "head": p.kind[p.begin], "tail": p.kind[p.bounds[1:] - 1]}
            blobs = {"cost": [x.tobytes() for x in p.cost], "rank": [x.astype(np.uint8).tobytes() for x in p.rank]}
            yield pa.RecordBatch.from_pydict(p.keys() | {k: pa.array(v.astype(np.int64)) for k, v in named.items()} | {k: pa.array(v, pa.binary()) for k, v in blobs.items()})

    numbers = "turns long, blank long, duplicate long, truncated long, illegal long, low long, high long, head long, tail long"
    by_piece = marked.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "place")
    matrices = by_piece.mapInArrow(measured, f"conv_id {kind}, part int, piece int, {numbers}, cost binary, rank binary")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states between the pieces of each conversation, and its figures."""
        for rows in _whole(batches, ["conv_id"], 1 << 10):
            n = rows.num_rows
            new = _change(rows.column("conv_id"))
            bounds = np.append(np.flatnonzero(new), n).tolist()
            cost = np.frombuffer(b"".join(rows.column("cost").to_pylist()), np.int64).reshape(n, STATES, STATES)
            rank = np.frombuffer(b"".join(rows.column("rank").to_pylist()), np.uint8).astype(np.int64).reshape(n, STATES, STATES)
            c = {k: rows.column(k).to_numpy() for k in ("turns", "blank", "duplicate", "truncated", "illegal", "low", "high", "head", "tail")}
            entry, leave = np.zeros(n, np.int64), np.zeros(n, np.int64)
            out = {k: np.zeros(n, np.int64) for k in (*_FIGURES, "number", "pieces", "after")}
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                now = np.full((1, STATES, STATES), _FAR)
                now[0, range(STATES), range(STATES)] = 0
                order, back = np.zeros_like(now), []
                for k in range(a, b):
                    now, order, middle = product(now, order, cost[k : k + 1], rank[k : k + 1])
                    back.append(middle[0, 0])
                state, total = best_end(now[:, 0], order[:, 0])
                at = int(state[0])
                out["after"][b - 1] = _LEFT[at]
                for k in range(b - 1, a - 1, -1):
                    leave[k], entry[k] = at, back[k - a][at]
                    at = int(entry[k])
                part = slice(a, b)
                held = c["turns"][part] > 0
                # A turn that goes on in the next piece was counted twice.
                twice = (c["high"][a : b - 1] == c["low"][a + 1 : b]) & held[:-1] & held[1:]
                if held.any():
                    out["gaps"][a] = c["high"][part][held].max() - c["low"][part][held].min() + 1 - c["turns"][part].sum() + twice.sum()
                for k in ("blank", "duplicate", "truncated"):
                    out[k][a] = c[k][part].sum()
                meet = 4 * c["tail"][a : b - 1] + c["head"][a + 1 : b]
                out["illegal"][a] = c["illegal"][part].sum() + (~np.isin(meet, (1, 6, 9))).sum()
                out["cost"][a], out["number"][part], out["pieces"][part] = total[0], np.arange(b - a), b - a
            keys = {k: rows.column(k) for k in _PIECE}
            yield pa.RecordBatch.from_pydict(keys | {k: pa.array(v) for k, v in (out | {"entry": entry, "leave": leave}).items()})

    shape = f"conv_id {kind}, part int, piece int, " + ", ".join(f"{k} long" for k in (*_FIGURES, "number", "pieces", "after", "entry", "leave"))
    walk = matrices.repartition("conv_id").sortWithinPartitions(*_PIECE).mapInArrow(walked, shape)
    walk = stored(walk, "dialogue-walk")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, _PIECE):
            p = Pieces(rows)
            at = pa.array(p.begin)
            entry, leave, after = (rows.column(c).take(at).to_numpy() for c in ("entry", "leave", "after"))
            audits = [a + "I" * n for a, n in zip(p.grammar.audits(p.steps, entry, leave), after.tolist(), strict=True)]
            roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
            spans = zip(audits, entry.tolist(), p.bounds[:-1].tolist(), p.bounds[1:].tolist(), strict=True)
            lines = [repaired_text(s, q, roles[a:b], texts[a:b]) for s, q, a, b in spans]
            figures = {k: rows.column(k).take(at) for k in (*_FIGURES, "number", "pieces")}
            yield pa.RecordBatch.from_pydict({"conv_id": p.keys()["conv_id"]} | figures | {"audit": pa.array(audits, pa.string()), "repaired": pa.array(lines, pa.string())})

    placed = marked.alias("x").join(walk.alias("y"), _same("x", "y", _PIECE)).select("x.*", *[f"y.{k}" for k in (*_FIGURES, "number", "pieces", "after", "entry", "leave")])
    placed = placed.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "place")
    result = f"conv_id {kind}, " + ", ".join(f"{k} long" for k in (*_FIGURES, "number", "pieces")) + ", audit string, repaired string"
    return placed.mapInArrow(told, result)


def repair(conversations: DataFrame, long_bytes: int = LONG_BYTES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, the six figures, number and pieces, audit, repaired text: a row for each conversation, or for each piece of a long one.

    Figures of a conversation in pieces stand in its first piece (number 0, the others
    have zeros); its audit and text are those of the pieces, one after the other (a
    piece without a line left has a null text).  Rows with ``gone`` count only as
    evidence that their conversation exists.
    """
    first = stored(_first_pass(_ordered(conversations), long_bytes, piece_rows), "dialogues")
    done = first.filter("part IS NULL").selectExpr("conv_id", *_FIGURES, "0L AS number", "1L AS pieces", "audit", "repaired")
    rows = first.filter("part IS NOT NULL").select(*_PIECE, "place", "turn", "role", "text", "gone")
    without = rows.groupBy("conv_id").agg(F.bool_and("gone").alias("gone")).filter("gone")
    without = without.selectExpr("conv_id", *[f"0L AS {f}" for f in _FIGURES], "0L AS number", "1L AS pieces", "'' AS audit", "'' AS repaired")
    return done.unionByName(without).unionByName(_in_pieces(rows))


def hashed(repaired: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, figures, audit, repaired_sha256; the pieces of a long one are hashed as a stream."""
    kind = dict(repaired.dtypes)["conv_id"]
    repaired = stored(repaired, "repaired")
    one = repaired.filter("pieces = 1").select("conv_id", *_FIGURES, "audit", F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))
    many = repaired.filter("pieces > 1")
    parts = F.array_sort(F.collect_list(F.struct("number", "audit")))
    figures = many.groupBy("conv_id").agg(*[F.sum(f).alias(f) for f in _FIGURES], parts.alias("parts"))
    figures = figures.withColumn("audit", F.array_join("parts.audit", "")).drop("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, state, lines = None, None, False
        ids, digests = [], []
        for batch in batches:
            for conv, number, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "number", "repaired")), strict=True):
                if number == 0:
                    if state is not None:
                        ids.append(now)
                        digests.append(state.hexdigest())
                    now, state, lines = conv, hashlib.sha256(), False
                if text is not None:
                    state.update(b"\n" * lines + text.encode())
                    lines = True
        if state is not None:
            ids.append(now)
            digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("conv_id").type), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])

    stream = many.select("conv_id", "number", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "number")
    digest = stream.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
    both = figures.alias("x").join(digest.alias("y"), _same("x", "y", ["conv_id"])).select("x.*", "y.repaired_sha256")
    return one.unionByName(both)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that their conv_id and turn call for; dropped ones are ``gone``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("damage", F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20)
    damage = F.col("damage")
    text = F.when(damage == 1, F.lit("")).when(damage == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(damage == 4, F.lit("user")).otherwise(F.col("role"))
    repeats = F.explode(F.when(damage == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (damage == 0).alias("gone"), repeats.alias("repeat")).drop("repeat")


SQL = r"""
WITH bits AS (
    SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS c FROM range(256) r(n)
    )
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key
    FROM conversations
), judged AS (
    SELECT *, xor(4294967295, list_reduce(list_transform(key, lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, bits.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS damage
    FROM keyed, bits
), rows_after AS (
    SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
        CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE damage WHEN 0 THEN []::BIGINT[] WHEN 3 THEN [0, 1]::BIGINT[] ELSE [0]::BIGINT[] END) AS again
    FROM judged
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS k,
        rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS trimmed
    FROM rows_after
), faulty AS (
    SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
        WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prior
    FROM numbered
), conv AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        list(struct_pack(i := initial, f := fault) ORDER BY k) AS seq, list(role ORDER BY k) AS roles, list(text ORDER BY k) AS texts
    FROM faulty GROUP BY conv_id
), inserts(p, q, n) AS (
    VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)
), acts(q, r, letter, need) AS (
    VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
        (0, 2, 'R', ''), (1, 2, 'R', ''), (3, 2, 'R', ''), (2, 3, 'R', '')
), steps AS (
    SELECT list(struct_pack(p := p, r := r, letter := letter, need := need, s := repeat('I', n) || letter, c := 3 * n + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END)) AS moves
    FROM inserts JOIN acts USING (q)
), walked AS (
    SELECT conv.*, list_reduce(seq, lambda st, row: list_transform([0, 1, 2, 3], lambda r: list_min(list_transform(
            list_filter(moves, lambda m: m.r = r AND st[m.p + 1] IS NOT NULL AND (m.letter = 'D' OR row.f NOT IN ('blank', 'duplicate')) AND (m.need = '' OR m.need = row.i)),
            lambda m: lpad((left(st[m.p + 1], 9)::BIGINT + m.c + CASE WHEN m.letter <> 'D' AND row.f = 'truncated' THEN 3 ELSE 0 END)::VARCHAR, 9, '0') || substr(st[m.p + 1], 10) || m.s))),
        ['000000000', NULL, NULL, NULL]) AS ends
    FROM conv, steps
), best AS (
    SELECT *, list_min(list_transform([[1, 0], [2, 2], [3, 1], [4, 0]], lambda e: CASE WHEN ends[e[1]] IS NOT NULL THEN
        lpad((left(ends[e[1]], 9)::BIGINT + 3 * e[2])::VARCHAR, 9, '0') || substr(ends[e[1]], 10) || repeat('I', e[2]) END)) AS found
    FROM walked
), letters AS (
    SELECT conv_id, substr(found, 10) AS audit, roles, texts, unnest(range(1, length(found) - 8)) AS j FROM best
), placed AS (
    SELECT *, substr(audit, j, 1) AS letter, length(replace(left(audit, j), 'I', '')) AS k, length(replace(left(audit, j), 'D', '')) AS m FROM letters
), spoken AS (
    SELECT *, max(CASE WHEN letter = 'K' AND m = 1 AND left(roles[k], 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_s FROM placed WHERE letter <> 'D'
), told AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN roles[k] WHEN (m - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE texts[k] END, chr(10) ORDER BY j) AS repaired
    FROM spoken GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(found, 9)::BIGINT, 0) AS cost, coalesce(substr(found, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN told ON ids.conv_id IS NOT DISTINCT FROM told.conv_id
"""
