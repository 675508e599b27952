"""Operator 12: periodic runs of words found with an enhanced suffix array.

A run is a stretch of words whose smallest period q (words q apart are identical)
cannot be kept on either side.  It is reported when it has at least ``min_length``
words and ``min_copies`` periods; the operator drops every word that lies in some
run after that run's first q words.

Search: the suffixes of each text are ranked by prefix doubling, and the ranks of
every width are kept.  Longest common prefixes of neighbours in the suffix array
come from these ranks.  A boundary of depth d (a common prefix of d words) lies in
the interval between the next smaller prefixes on both sides; boundaries with one
interval cut it into children.  All suffixes of all children but the largest are
visited: suffix i starts or ends a square of period d when the rank of i + d or
i - d lies in the same interval, but in another child (a square that does not go on
to the right, a branching tandem).  Such a square is rotated to the left as far as
words match, by the stored ranks; that gives a maximal run, and of the runs with
one extent the smallest period counts.  No tree node is ever made: intervals are
ranges of the suffix array.

Scale: one pass over the text without a shuffle; a task handles slabs of a few MB,
all texts of a slab at once.  Work is n log n in the words of a text.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has no words,
no runs and an empty collapsed text; texts are used whole; repeated rows get equal
results; a null doc_id is returned as it is; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.slabs import Words, ragged, slabs

MIN_LENGTH = 6
MIN_COPIES = 4
_SLAB = 3 << 20


class Suffixes:
    """Suffix array of the texts of a slab (texts one after the other), with ranks of all widths."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n = len(codes)
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.first, self.end = starts[:-1][rows], starts[1:][rows]
        key = rows * (int(codes.max()) + 1 if n else 1) + codes
        self.order = np.argsort(key, kind="stable")
        slots, key = np.arange(n), key[self.order]
        rank = np.empty(n, np.int32)
        self.levels: list[np.ndarray] = []
        width = 0
        while True:
            # Suffixes of equal keys share the slot of the first of them as their rank.
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            lead = np.flatnonzero(new)
            rank[self.order[slots]] = np.repeat(slots[lead], np.diff(np.append(lead, len(slots))))
            alone = new & np.append(new[1:], True)
            slots = slots[~alone]
            if not len(slots):
                break
            self.levels.append(rank.copy())
            width = max(1, 2 * width)
            at = self.order[slots]
            beyond = at + width
            inside = beyond < self.end[at]
            then = np.where(inside, rank[np.minimum(beyond, n - 1)], -1).astype(np.int64)
            key = rank[at].astype(np.int64) * (n + 1) + then + 1
            by_key = np.argsort(key, kind="stable")
            self.order[slots], key = at[by_key], key[by_key]
        self.rank = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b share."""
        length = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a[live] + length[live], b[live] + length[live]
            ok = (x < self.end[a[live]]) & (y < self.end[b[live]])
            same = live[ok][self.levels[k][x[ok]] == self.levels[k][y[ok]]]
            length[same] += 1 << k
        return length

    def before(self, at: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words before ``at`` equal those ``shift`` further on."""
        back = np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x = at - back - (1 << k)
            ok = np.flatnonzero(x >= self.first[at])
            x = x[ok]
            back[ok[self.levels[k][x] == self.levels[k][x + shift[ok]]]] += 1 << k
        return back


def smaller_beside(depth: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each boundary the nearest one in direction ``step`` with a smaller depth; pointers jump over deeper stretches."""
    pointer = np.arange(len(depth)) + step
    live = at
    while len(live):
        live = live[depth[pointer[live]] >= depth[live]]
        pointer[live] = pointer[pointer[live]]
    return pointer[at]


def squares(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching square."""
    order, rank = suffixes.order, suffixes.rank
    n = len(order)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not suffixes.levels:
        return none
    depth = np.zeros(n + 1, np.int64)
    word = suffixes.levels[0][order]
    pairs = np.flatnonzero(word[1:] == word[:-1]) + 1
    depth[pairs] = suffixes.common(order[pairs - 1], order[pairs])
    low, high = smaller_beside(depth, pairs, -1), smaller_beside(depth, pairs, 1)
    # Boundaries of one interval, in order: they and its ends cut it into children.
    by = np.lexsort((pairs, high, low))
    cuts, low, high = pairs[by], low[by], high[by]
    new = np.ones(len(cuts), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    lead = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    children = len(cuts) + len(lead)
    begin, stop = np.empty(children, np.int64), np.empty(children, np.int64)
    place = np.arange(len(cuts)) + number
    begin[place + 1] = cuts
    begin[lead + np.arange(len(lead))] = low[lead]
    stop[place] = cuts
    last = np.append(lead[1:], len(cuts)) - 1
    stop[last + 1 + np.arange(len(lead))] = high[lead]
    of = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(cuts))) + 1)
    size = stop - begin
    largest = np.maximum.reduceat(size, lead + np.arange(len(lead)))
    _, first = np.unique(np.where(size == largest[of], of, -1), return_index=True)
    small = np.ones(children, bool)
    small[first[-len(lead) :]] = False
    small = np.flatnonzero(small)
    child = np.repeat(small, size[small])
    i = order[ragged(begin[small], size[small])].astype(np.int64)
    d = depth[cuts[lead]][of[child]]
    l, r = low[lead][of[child]], high[lead][of[child]]
    starts, periods = [], []
    for sign in (1, -1):
        j = i + sign * d
        ok = np.flatnonzero((j >= 0) & (j < n))
        met = rank[j[ok]]
        ok = ok[(met >= l[ok]) & (met < r[ok]) & ((met < begin[child[ok]]) | (met >= stop[child[ok]]))]
        starts.append(np.minimum(i[ok], j[ok]))
        periods.append(d[ok])
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], axis=1), axis=0)
    return found[:, 0], found[:, 1]


def periodic_runs(codes: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the runs of all texts, by start, then period; starts count words of the slab."""
    suffixes = Suffixes(codes, starts)
    at, period = squares(suffixes)
    end = at + 2 * period
    at = at - suffixes.before(at, period) if len(at) else at
    order = np.lexsort((period, end, at))
    at, end, period = at[order], end[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1])
    keep = new & (end - at >= np.maximum(min_length, min_copies * period))
    at, length, period = at[keep], (end - at)[keep], period[keep]
    order = np.lexsort((period, at))
    return at[order], length[order], period[order]


def _joined(terms: pa.Array, codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    words = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), terms.take(pa.array(codes)).cast(pa.large_string()))
    return pc.binary_join(words, pa.scalar(" ", pa.large_string()))


def find(documents: DataFrame, min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES, rearranged: Callable | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed (the words kept, joined by a blank).

    ``rearranged(doc_id, n)`` may give, for a text of n words, the number of the word
    that takes each place before the search (None: as they are).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text", _SLAB):
            words = Words(slab.column("text"))
            codes, starts = words.codes, words.starts
            if rearranged is not None:
                for row, (doc, n) in enumerate(zip(slab.column("doc_id").to_pylist(), words.counts.tolist(), strict=True)):
                    source = rearranged(doc, n)
                    if source is not None:
                        codes[starts[row] : starts[row + 1]] = codes[starts[row] + source]
            at, length, period = periodic_runs(codes, starts, min_length, min_copies)
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, at + period, 1)
            np.add.at(gone, at + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            before = np.concatenate([[0], np.cumsum(kept)])
            row = np.searchsorted(starts, at, side="right") - 1
            cuts = pa.array(np.searchsorted(row, np.arange(slab.num_rows + 1)), pa.int32())
            each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (at - starts[row], length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": slab.column("doc_id"),
                    "n_words": pa.array(words.counts),
                    "runs": pa.ListArray.from_arrays(cuts, each),
                    "collapsed": _joined(words.terms, codes[kept], before[starts]).cast(pa.string()),
                }
            )

    kind = dict(documents.dtypes)["doc_id"]
    shape = f"doc_id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(run, shape)


def collapsed(documents: DataFrame) -> DataFrame:
    """The documents with their columns and texts without the repeats of periodic runs; texts without a run stay as they are."""
    columns = documents.columns
    found = find(documents.select(F.struct(*columns).alias("doc_id"), "text"))
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc_id.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("doc_id")[c].alias(c) for c in columns])


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Order of words by which one text in ten gets a periodic tail; others, and null ids, stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digests(documents: DataFrame) -> DataFrame:
    """Runs of the documents with planted tails: count, longest run, and hashes of all runs and of the words kept."""
    found = find(documents, rearranged=planted)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
