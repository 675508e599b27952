"""Operator 1: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point; a permutation (a cyclic shift) marks its place, binding (the product) makes
an n-gram vector, and bundling (the sum) makes a text vector.  A language's
prototype bundles all its training texts.  A text gets the language with the
largest cosine between the two vectors.

N-grams run over lower-cased letters; each run of other characters, and the ends
of the text, count as one boundary symbol.

Scale: two passes over the text, no shuffle of it.  Tasks send one vector per
language and task; the model is one vector per language.  Text vectors come from
n-gram counts and a product of matrices, slab by slab.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
and so is every text when nothing could be learned; of equal cosines the smaller
language name by code point wins; texts are used whole; repeated rows get equal
results; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.slabs import mixed, slabs

DIMS = 1024
NGRAM = 3
#: More languages than this are refused: the model is sent to every task.
MAX_LANGUAGES = 10_000
UNKNOWN = "und"
_SLAB = 1 << 20


def letter_vectors(points: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0 is the boundary symbol."""
    words = mixed(points.astype(np.uint64)[:, None], np.arange(dims // 64, dtype=np.uint64)[None, :], 1)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


class Profiler:
    """N-gram counts and vectors of texts."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.is_letter = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the n-gram) of every n-gram, and the vectors of the numbers."""
        texts = ["\n" + t.lower() for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        letter = self.is_letter[points]
        before = np.concatenate([[False], letter[:-1]])
        first = np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)]
        keep = letter | before | first
        points, rows = np.where(letter, points, 0)[keep], rows[keep]
        # The text's end is a boundary too: a last symbol after all texts, and each text's first one.
        points, rows = np.append(points, 0), np.append(rows, len(texts))
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        alphabet = np.flatnonzero(seen)
        dense = np.zeros(0x110000, np.int64)
        dense[alphabet] = np.arange(len(alphabet))
        symbols = dense[points]
        n = max(len(symbols) - NGRAM + 1, 0)
        code = np.zeros(n, np.int64)
        for k in range(NGRAM):
            code = code * len(alphabet) + symbols[k : n + k]
        last = NGRAM - 1
        ends = (rows[last - 1 : n + last - 1] == rows[:n]) & (points[last : n + last] == 0) & (rows[last : n + last] == rows[:n] + 1)
        whole = (rows[last : n + last] == rows[:n]) | ends
        number, codes = pd.factorize(code[whole])
        letters = letter_vectors(alphabet, self.dims)
        vectors = np.ones((len(codes), self.dims), np.int8)
        for k in range(NGRAM):
            at = codes // len(alphabet) ** (NGRAM - 1 - k) % len(alphabet)
            vectors *= np.roll(letters, NGRAM - 1 - k, axis=1)[at]
        return rows[:n][whole], number, vectors

    def bundles(self, texts: list[str], groups: np.ndarray, n_groups: int) -> np.ndarray:
        """The sum of the n-gram vectors of the texts of each group."""
        rows, number, vectors = self.grams(texts)
        counts = np.bincount(groups[rows] * len(vectors) + number, minlength=n_groups * len(vectors))
        return counts.reshape(n_groups, len(vectors)).astype(np.float32) @ vectors.astype(np.float32)

    def has_letter(self, texts: list[str]) -> np.ndarray:
        return np.array([any(map(str.isalpha, t)) for t in texts], bool)


def learn(documents: DataFrame, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their prototypes, from columns text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dims), {}
        for slab in slabs(batches, "text", _SLAB):
            names = slab.column("lang").to_pylist()
            known = sorted(set(names))
            groups = np.array([known.index(x) for x in names])
            for name, vector in zip(known, profiler.bundles(slab.column("text").to_pylist(), groups, len(known)), strict=True):
                sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    given = documents.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    parts = given.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    cells = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).limit(MAX_LANGUAGES + 1)
    found = sorted(whole.select("lang", "v.x").collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = [(name, np.array(v)) for name, v in found if np.any(v)]
    return [name for name, _ in found], np.array([v for _, v in found]).reshape(len(found), dims)


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of each row, then the columns named in ``keep``."""
    names, prototypes = model
    dims = prototypes.shape[1]
    unit = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True) if names else prototypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dims)
        for slab in slabs(batches, "_text", _SLAB):
            texts = slab.column("_text").fill_null("").to_pylist()
            score, best = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            real = profiler.has_letter(texts) if names else np.zeros(len(texts), bool)
            if real.any():
                vectors = profiler.bundles(texts, np.arange(len(texts)), len(texts)).astype(np.float64)
                length = np.linalg.norm(vectors, axis=1)
                cosine = (vectors @ unit.T) / np.maximum(length, 1e-300)[:, None]
                best = cosine.argmax(axis=1)
                score = np.where(real, np.clip(cosine.max(axis=1), 0, 1), 0)
            told = [names[b] if r else UNKNOWN for b, r in zip(best, real, strict=True)]
            named = {"doc_id": slab.column("_doc_id"), "lang_pred": pa.array(told, pa.string()), "score": pa.array(score)}
            yield pa.RecordBatch.from_pydict(named | {f"_{c}": slab.column(f"_in_{c}") for c in keep})

    kinds = dict(documents.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang_pred string, score double" + "".join(f", `_{c}` {kinds[c]}" for c in keep)
    given = documents.select(
        F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"), *[F.col(c).alias(f"_in_{c}") for c in keep]
    )
    return given.mapInArrow(run, schema)
