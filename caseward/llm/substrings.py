"""Operator 10: substring dedup over words with difference-cover anchors.

A word goes when a window of ``window`` words around it also starts in a document
with a smaller doc_id.  The cover is a set of residues modulo ``period`` such that
for any two offsets some shift below ``period`` brings both to residues of the
cover.  Hashing windows of ``window - period + 1`` words at cover positions only
is therefore enough: two equal long windows share an aligned anchor.  Around
anchors found in two documents the long windows are hashed in full (128 bits),
and all but those of the smallest doc_id are cut.

Scale: tasks settle what they can among their own documents and send the rest
packed, one entry per hash and task at most when it is common, so a passage in a
third of all documents is not a hot key.  Packed entries go to hash buckets whose
number follows the size of the text; buckets answer with positions.  The text is
shuffled once by doc_id and read from there twice.

Defined results: a null or empty text has no words and an empty kept text; a null
doc_id counts as smaller than any other; rows with equal doc_id are one document
as to where windows start, so they do not cut each other, but each text of a doc_id
has cuts of its own; texts are used whole;
an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.slabs import Words, mixed, slabs, term_hashes, window_hashes
from caseward.sources.shared import stored

WINDOW = 50
PERIOD = 31
#: A perfect difference set: every residue modulo 31 is a difference of two of these; fixed values.
COVER = (1, 5, 11, 24, 25, 27)
#: Bytes of text for each hash bucket.
BUCKET_BYTES = 8 << 20
_SLAB = 3 << 20
_NULL_ID = -(1 << 63)
#: ``texts`` tells texts of one doc_id apart; it is zero, which packs to nothing, where an id has one text.
_ENTRY = "bucket int, settled boolean, docs binary, texts binary, pos binary, h1 binary, h2 binary"
_TYPES = (np.int64, np.int64, np.int32, np.uint64, np.uint64)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _packed(bucket: np.ndarray, settled: bool, *columns: np.ndarray | None) -> list[tuple]:
    """One row for each bucket: the columns docs, texts, pos, h1, h2 of its entries as bytes."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    typed = [None if c is None else c.astype(t)[order] for c, t in zip(columns, _TYPES, strict=False)]
    typed += [None] * (len(_TYPES) - len(typed))
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        if b > a:
            out.append((int(bucket[order[a]]), settled, *(None if c is None else c[a:b].tobytes() for c in typed)))
    return out


def _answers(docs: np.ndarray, texts: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple]:
    """Positions of documents, packed by a bucket of the document."""
    place = mixed(docs.astype(np.int64).view(np.uint64), np.zeros(1, np.uint64)) >> np.uint64(33)
    return _packed(place.astype(np.int64) % buckets, True, docs, texts, pos)


def _entries(h1: np.ndarray, h2: np.ndarray | None, docs: np.ndarray, texts: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple]:
    """Unsettled entries, packed by a bucket of the hash."""
    return _packed((h1 >> np.uint64(33)).astype(np.int64) % buckets, False, docs, texts, pos, h1, h2)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    names = ["bucket", "settled", "docs", "texts", "pos", "h1", "h2"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """(settled, [docs, texts, pos, h1, h2]) of each bucket; rows come ordered by bucket and settled."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for bucket, settled, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, settled) != now:
                if held:
                    yield now[1], _whole(held)
                held, now = [], (bucket, settled)
            held.append(blobs)
    if held:
        yield now[1], _whole(held)


def _whole(parts: list) -> list:
    return [None if parts[0][i] is None else np.frombuffer(b"".join(p[i] for p in parts), t) for i, t in enumerate(_TYPES)]


def _groups(h1: np.ndarray, h2: np.ndarray | None, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash and document, the group number of each ordered entry, and where groups begin."""
    order = np.lexsort((docs, h1) if h2 is None else (docs, h2, h1))
    new = h1[order][1:] != h1[order][:-1]
    if h2 is not None:
        new |= h2[order][1:] != h2[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], new])) if len(order) else np.zeros(0, np.int64)
    return order, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order)))), first


def _hashed(slab: pa.RecordBatch, text: str) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the two hash lanes of each word."""
    words = Words(slab.column(text))
    one, two = (term_hashes(words.terms, seed)[words.codes] if len(words.codes) else np.zeros(0, np.uint64) for seed in (1, 2))
    return words, one, two


def _anchors(batches: Iterator[pa.RecordBatch], window: int, period: int, cover: tuple[int, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors found in two documents of the task are answered; the others are sent to their bucket."""
    width = window - period + 1
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True
    for slab in slabs(batches, "text", _SLAB):
        words = Words(slab.column("text"))
        if not len(words.codes):
            continue
        ids, marks = slab.column("k").to_numpy(), slab.column("t").to_numpy()
        rows = words.rows
        place = np.arange(len(rows)) - words.starts[rows]
        hashes = window_hashes(term_hashes(words.terms, 1)[words.codes], width)
        n = len(hashes)
        # Texts shorter than a window hold none.
        at = np.flatnonzero(chosen[place[:n] % period] & (place[:n] + width <= words.counts[rows[:n]]) & (words.counts[rows[:n]] >= window))
        h, docs, texts, pos = hashes[at], ids[rows[at]], marks[rows[at]], place[at]
        order, group, first = _groups(h, None, docs)
        if not len(order):
            continue
        last = np.append(first[1:], len(order)) - 1
        common = docs[order[first]] != docs[order[last]]
        out = _answers(docs[order][common[group]], texts[order][common[group]], pos[order][common[group]], buckets)
        lone = order[~common[group]]
        # A common hash goes out once, without a position: it needs no answer.
        told = order[first[common]]
        out += _entries(np.append(h[lone], h[told]), None, np.append(docs[lone], docs[told]), np.append(texts[lone], texts[told]), np.append(pos[lone], np.full(len(told), -1)), buckets)
        yield _batch(out)


def _windows(batches: Iterator[pa.RecordBatch], window: int, period: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Hash the long windows around shared anchors; the smallest document of the task stays unsettled."""
    for slab in slabs(batches, "text", _SLAB):
        words, one, two = _hashed(slab, "text")
        ids, marks = slab.column("k").to_numpy(), slab.column("t").to_numpy()
        ends = words.counts - window + 1  # windows of each row
        delta = np.zeros(len(words.codes) + 1, np.int64)
        for row, blob in enumerate(slab.column("found").to_pylist()):
            if ends[row] <= 0:
                continue
            p = np.frombuffer(blob, np.int32).astype(np.int64)
            np.add.at(delta, words.starts[row] + np.maximum(p - period + 1, 0), 1)
            np.add.at(delta, words.starts[row] + np.minimum(p + 1, ends[row]), -1)
        at = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
        if not len(at):
            continue
        h1, h2 = window_hashes(one, window, 1)[at], window_hashes(two, window, 2)[at]
        rows = words.rows[at]
        docs, texts, pos = ids[rows], marks[rows], at - words.starts[rows]
        order, group, first = _groups(h1, h2, docs)
        least = docs[order] == docs[order[first]][group]
        later, open_ = order[~least], order[least]
        yield _batch(_answers(docs[later], texts[later], pos[later], buckets) + _entries(h1[open_], h2[open_], docs[open_], texts[open_], pos[open_], buckets))


def _settle(batches: Iterator[pa.RecordBatch], windows: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """Answer the entries of each hash bucket; what is settled passes through."""
    for settled, (docs, texts, pos, h1, h2) in _by_bucket(batches):
        if not settled:
            order, group, first = _groups(h1, h2, docs)
            docs, texts, pos = docs[order], texts[order], pos[order]
            if windows:
                hit = docs != docs[first][group]
            else:
                last = np.append(first[1:], len(order)) - 1
                common = (docs[first] != docs[last]) | (np.minimum.reduceat(pos, first) < 0)
                hit = common[group] & (pos >= 0)
            docs, texts, pos = docs[hit], texts[hit], pos[hit]
        yield _batch(_answers(docs, texts, pos, buckets))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a document with its positions in ascending order."""
    for _, (docs, texts, pos, *_) in _by_bucket(batches):
        order = np.lexsort((pos, texts, docs))
        docs, texts, pos = docs[order], texts[order], pos[order]
        cuts = np.append(np.flatnonzero((docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1])) + 1, len(docs)).tolist()
        found = [pos[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        yield pa.RecordBatch.from_pydict({"k": pa.array(docs[[c - 1 for c in cuts]]), "t": pa.array(texts[[c - 1 for c in cuts]]), "found": pa.array(found, pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch], window: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for slab in slabs(batches, "text", _SLAB):
        n_words, removed, kept = [], [], []
        for text, blob in zip(slab.column("text").cast(pa.binary()).to_pylist(), slab.column("found").to_pylist(), strict=True):
            words = (text or b"").split()
            gone = 0
            if blob:
                delta = np.zeros(len(words) + 1, np.int64)
                p = np.unique(np.frombuffer(blob, np.int32))
                delta[p] += 1
                delta[p + window] -= 1
                stay = np.cumsum(delta[:-1]) == 0
                gone = int(len(stay) - stay.sum())
                n_words.append(len(words))
                words = list(compress(words, stay.tolist()))
            else:
                n_words.append(len(words))
            removed.append(gone)
            kept.append(b" ".join(words))
        named = {"doc_id": slab.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        named["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(named | {f"_{c}": slab.column(f"_in_{c}") for c in columns})


def dedupe(
    documents: DataFrame,
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
    buckets: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each row, then the columns named in ``keep``."""
    if not is_cover(cover, period) or period > window:
        raise ValueError("no difference cover, or the period is longer than the window")
    if buckets is None:
        buckets = 1 + (documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    kinds = dict(documents.dtypes)
    # The key has no null, so both joins below read one and the same exchange.
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("k")
    own = documents.select(key, F.xxhash64("text").alias("t")).groupBy("k").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    several = stored(own.filter("least <> most").select("k", F.lit(True).alias("several")), "several")
    base = documents.select(key, "doc_id", "text", *[F.col(c).alias(f"_in_{c}") for c in keep])
    base = base.join(several, "k", "left").withColumn("t", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("several")

    def settled(rows: DataFrame, windows: bool) -> DataFrame:
        def dealt(x: DataFrame) -> DataFrame:
            return x.repartition(buckets, "bucket").sortWithinPartitions("bucket", "settled")

        answers = dealt(rows).mapInArrow(lambda b: _settle(b, windows, buckets), _ENTRY)
        return dealt(answers).mapInArrow(_gather, "k long, t long, found binary")

    anchors = base.select("k", "t", "text").mapInArrow(lambda b: _anchors(b, window, period, cover, buckets), _ENTRY)
    near = base.join(settled(anchors, False), ["k", "t"])
    cuts = settled(near.mapInArrow(lambda b: _windows(b, window, period, buckets), _ENTRY), True)
    schema = f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept_text string" + "".join(f", `_{c}` {kinds[c]}" for c in keep)
    return base.join(cuts, ["k", "t"], "left").drop("k", "t").mapInArrow(lambda b: _cut(b, window, list(keep)), schema)


SQL = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT doc_id, s, array_to_string(w[s : s + {WINDOW - 1}], ' ') AS run
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM doc WHERE len(w) >= {WINDOW})
), later AS (
    SELECT doc_id, s FROM win WHERE true QUALIFY min(doc_id) OVER (PARTITION BY run) < doc_id
), gone AS (
    SELECT DISTINCT doc_id, s + o AS i FROM later, (SELECT unnest(range({WINDOW})) AS o)
), cut AS (
    SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), kept AS (
    SELECT doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
        array_to_string(list_filter(w, lambda x, i : NOT coalesce(list_contains(g, i), false)), ' ') AS t
    FROM doc LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""
