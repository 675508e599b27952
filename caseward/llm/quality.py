"""Operator 8: quality rules and a calibrated n-gram classifier.

Base rules are exact counts on the whole text.  What passes them is judged by a
logistic regression on hashed word and character n-grams, trained on labelled
rows and calibrated by Platt's method on labelled rows it has not seen; the
probability is held against a fixed threshold.

Scale: one pass over the text without a shuffle.  The model is two weight vectors
of fixed length.  Training reads at most ``max_labelled`` labelled rows (those
with the smallest hash of their id, so reruns agree).

Defined results: a null or empty text has no word and fails the base rules; very
long texts are cut at no length; repeated rows get equal results; an empty table
gives an empty result; other columns of the input are ignored, whatever their
names.  Without labelled rows of both classes the classifier keeps every
document that passes the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.slabs import Words, joined, mixed, slabs, term_hashes

#: Hash space of each of the two feature blocks.
BITS = 15
#: Character n-gram lengths and word n-gram lengths.
CHAR_NGRAMS, WORD_NGRAMS = (1, 3), (1, 2)
#: Labelled rows that training may use.
MAX_LABELLED = 3000
#: Documents with a lower calibrated probability of good quality go.
THRESHOLD = 0.8
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Bytes of text scored at once.
_SLAB = 4 << 20

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Model:
    weights: np.ndarray  # characters first, then words
    bias: float
    slope: float  # of the calibration
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -500, 500)))


def _per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def repeated_words(words: Words) -> np.ndarray:
    """Words of each row in 3-word windows that occur twice or more in the row."""
    codes, rows = words.codes, words.rows
    covered = np.zeros(len(codes) + 2, bool)
    n = len(codes) - 2
    if n > 0:
        inside = rows[:n] == rows[2:]
        at = np.flatnonzero(inside)
        # Exact names of windows: a pair is named, then the pair with its third word, then with its row.
        pairs = pd.factorize(codes[at] * len(words.terms) + codes[at + 1])[0]
        threes = pd.factorize(pairs.astype(np.int64) * len(words.terms) + codes[at + 2])[0]
        name = pd.factorize(threes.astype(np.int64) * len(words.counts) + rows[at])[0]
        twice = at[np.bincount(name, minlength=1)[name] > 1]
        for k in range(3):
            covered[twice + k] = True
    return _per_row(covered[: len(codes)].astype(np.int64), words.starts)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.encode().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column without nulls, and where each row begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    words = Words(column)
    filled = column.fill_null("") if column.null_count else column
    data, starts = _bytes_of(filled)
    kind = np.zeros(256, np.uint8)
    kind[0x80:0xC0] = 2  # later bytes of a code point
    kind[[0x20, *range(0x09, 0x0E)]] = 2
    chars = _per_row(kind[data] == 0, starts)
    kind = np.zeros(256, bool)
    kind[list(SYMBOLS)] = True
    return {
        "n_words": words.counts,
        "word_chars": chars,
        "n_symbols": _per_row(kind[data], starts),
        "n_dup_lines": np.array([duplicate_lines(t) for t in filled.to_pylist()], np.int64),
        "n_repeat_words": repeated_words(words),
    }


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, weight, row starts) of the hashed n-grams; each block's weights add up to 1 in a row.

    Character n-grams run over UTF-8 bytes, so that no text needs decoding.
    """
    filled = column.fill_null("") if column.null_count else column
    data, starts = _bytes_of(filled)
    words = Words(filled)
    parts = []
    low = data.astype(np.uint64)
    for n in CHAR_NGRAMS:
        gram = np.zeros(len(low), np.uint64)
        m = len(low) - n + 1
        if m > 0:
            code = np.zeros(m, np.uint64)
            for k in range(n):
                code = code << np.uint64(8) | low[k : m + k]
            gram[:m] = mixed(code, np.full(1, n, np.uint64)) >> np.uint64(64 - BITS)
        parts.append((gram, np.maximum(starts[1:] - n + 1, starts[:-1]), starts))
    hashed = term_hashes(words.terms, 8)[words.codes] if len(words.terms) else np.zeros(0, np.uint64)
    one = (hashed >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)
    parts.append((one, words.starts[1:], words.starts))
    two = np.zeros(len(hashed), np.uint64)
    if len(hashed) > 1:
        two[:-1] = (mixed(hashed[:-1], hashed[1:]) >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)
    parts.append((two, np.maximum(words.starts[1:] - 1, words.starts[:-1]), words.starts))
    return parts


def margins(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The classifier's linear score of each text."""
    out = np.zeros(len(column))
    for slots, ends, starts in features(column):
        total = np.concatenate([[0.0], np.cumsum(weights[slots.astype(np.int64)], dtype=np.float64)])
        out += (total[ends] - total[starts[:-1]]) / np.maximum(ends - starts[:-1], 1)
    return out


def _rows_for_training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed features of labelled documents: slots and weights as packed arrays."""
    for slab in slabs(batches, "text", _SLAB):
        parts = features(slab.column("text"))
        slots, values = [], []
        for row in range(slab.num_rows):
            s, v = [], []
            for gram, ends, starts in parts:
                n = max(int(ends[row] - starts[row]), 1)
                found, count = np.unique(gram[starts[row] : ends[row]], return_counts=True)
                s.append(found.astype(np.int32))
                v.append((count / n).astype(np.float32))
            slots.append(np.concatenate(s).tobytes())
            values.append(np.concatenate(v).tobytes())
        yield pa.RecordBatch.from_arrays(
            [slab.column("quality"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["quality", "slots", "vals"]
        )


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit on at most ``max_labelled`` labelled documents; every fourth of them only calibrates.

    Half of the bound goes to each class, so that a rare class is seen.
    """
    named = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = None
    for kind in (0, 1):
        some = named.filter(F.col("quality") == kind).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id")
        some = some.limit(max_labelled // 2).select("doc_id", "quality")
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = documents.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    # One text for each id, so that repeated rows do not widen the sample.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    packed = rows.select("quality", "text").mapInArrow(_rows_for_training, "quality int, slots binary, vals binary").toArrow()
    if not packed.num_rows:
        return None
    order = np.array(sorted(range(packed.num_rows), key=lambda i: packed["slots"][i].as_py()))
    y = packed["quality"].to_numpy()[order].astype(np.float64)
    if len(set(y)) < 2:
        return None
    slots = [np.frombuffer(packed["slots"][int(i)].as_py(), np.int32) for i in order]
    vals = [np.frombuffer(packed["vals"][int(i)].as_py(), np.float32) for i in order]
    found = {r["quality"]: r["count"] for r in named.groupBy("quality").count().collect()}
    return fit(y, slots, vals, np.log(found[1] / found[0]))


def _product(weights: np.ndarray, slots: list, vals: list) -> np.ndarray:
    return np.array([float(weights[s] @ v) for s, v in zip(slots, vals, strict=True)])


def fit(y: np.ndarray, slots: list, vals: list, log_odds: float, rounds: int = 200, decay: float = 1e-6) -> Model:
    """Class-balanced logistic regression by accelerated gradient steps, then Platt's calibration.

    ``log_odds`` are those of good quality among all labelled rows; the calibrated
    probability is for such rows, however many of each class were sampled.
    """
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    use = np.flatnonzero(~held)
    row = np.repeat(np.arange(len(use)), [len(slots[i]) for i in use])
    slot = np.concatenate([slots[i] for i in use])
    val = np.concatenate([vals[i] for i in use]).astype(np.float64)
    t = y[use]
    share = np.where(t == 1, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1))
    size = 2 << BITS
    # Slots that most documents fill tell little: they are scaled down by their document frequency.
    scale = np.log((1 + len(use)) / (1 + np.bincount(slot, minlength=size)))
    val *= scale[slot]
    w, b, wv, bv = np.zeros(size), 0.0, np.zeros(size), 0.0
    norm = np.bincount(row, val * val, len(use)).max() + 1
    step = 4 / norm
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, wv[slot] * val, len(use)) + bv, -500, 500)))
        g = (p - t) * share
        w2 = wv - step * (np.bincount(slot, g[row] * val, size) + decay * wv)
        b2 = bv - step * g.sum()
        speed = k / (k + 3)
        wv, bv, w, b = w2 + speed * (w2 - w), b2 + speed * (b2 - b), w2, b2
    w *= scale
    test = np.flatnonzero(held) if held.any() else use
    margin = _product(w, [slots[i] for i in test], [vals[i] for i in test]) + b
    spread = margin.std() or 1.0
    # Platt: targets are drawn in by one count for each class; classes weigh alike.
    up, down = max(y[test].sum(), 1), max((1 - y[test]).sum(), 1)
    goal = np.where(y[test] == 1, (up + 1) / (up + 2), 1 / (down + 2))
    share = np.where(y[test] == 1, 0.5 / up, 0.5 / down)
    a, c = 1.0, 0.0
    x = margin / spread
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -500, 500)))
        r, h = (p - goal) * share, p * (1 - p) * share + 1e-9
        grad = np.array([(r * x).sum() + 1e-4 * a, r.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum()]])
        a, c = np.array([a, c]) - np.linalg.solve(hess, grad)
    return Model(w.astype(np.float32), float(b), float(a / spread), float(c + log_odds))


def judge(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, probability, kept; then the columns named in ``keep``."""
    weights = None if model is None else model.weights
    # A text that is kept goes to the workers once.
    read = "_in_text" if "text" in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, read, _SLAB):
            text = slab.column(read)
            stats = statistics(text)
            n, repeated = stats["n_words"], stats["n_repeat_words"]
            failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
            p = np.ones(slab.num_rows)
            if model is not None:
                todo = np.flatnonzero(~failed)
                p = np.zeros(slab.num_rows)
                if len(todo):
                    p[todo] = model.probability(margins(text.take(pa.array(todo)), weights))
            else:
                p[failed] = 0
            kept = ~failed & (p >= threshold)
            named = {"doc_id": slab.column("_doc_id")} | {k: pa.array(v, pa.int64()) for k, v in stats.items()}
            named |= {"base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(kept)}
            yield pa.RecordBatch.from_pydict(named | {f"_{c}": slab.column(f"_in_{c}") for c in keep})

    kinds = dict(documents.dtypes)
    schema = f"doc_id {kinds['doc_id']}, {STATS}, base_failed boolean, probability double, kept boolean"
    schema += "".join(f", `_{c}` {kinds[c]}" for c in keep)
    texts = [] if "text" in keep else [F.col("text").alias("_text")]
    given = documents.select(F.col("doc_id").alias("_doc_id"), *texts, *[F.col(c).alias(f"_in_{c}") for c in keep])
    return given.mapInArrow(run, schema)


def filtered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    columns = documents.columns
    judged = judge(documents, train(documents, labels), keep=tuple(columns)).filter("kept")
    return judged.select(*[F.col(f"_{c}").alias(c) for c in columns])
