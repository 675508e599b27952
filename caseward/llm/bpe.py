"""Operator 7: BPE encoding with a pair occurrence index, and decoding.

The words of a slab of documents are told apart once; each different word is
normalised, cut into pieces and written as symbols of one long array with links
to the left and right neighbour.  An index maps the rank of each mergeable pair to
all its positions.  Active ranks are taken in ascending order: the positions of
a rank are merged together, and the pairs that arise at their neighbours are
added to the lists of their ranks.  Positions whose pair has changed meanwhile are
found when their list is read.

It reads tokenizer files of this kind: BPE with an end-of-word suffix over
byte-level symbols, NFC and lower case, white space dropped, special tokens taken
from the raw text.

Scale: one pass over the text without a shuffle; the vocabulary (fixed size) goes
to every task.

Defined results: a null text is encoded as the empty one and gives no ids; texts
are used whole; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseward.llm.slabs import Words, ragged, slabs

_SLAB = 3 << 19


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]) or len(self.special) > 2:
            raise ValueError("special tokens of this kind are not supported")
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.final = np.array([ids[s + suffix] for s in symbols], np.int64)
        self.size = max([*ids.values(), *self.special.values()]) + 1
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = self.left * self.size + self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        steps = data["pre_tokenizer"]["pretokenizers"]
        self.pattern = steps[0]["pattern"]["Regex"]
        self.tokens = [""] * self.size
        for token, number in chain(ids.items(), self.special.items()):
            self.tokens[number] = token

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """The vocabulary with these attributes: they travel to the tasks, the class does not."""
        vocabulary = cls.__new__(cls)
        vocabulary.__dict__.update(state)
        return vocabulary

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)


class PairIndex:
    """Symbols of many words, and for each rank the positions of its pair."""

    def __init__(self, vocabulary: Vocabulary, symbols: np.ndarray, words: np.ndarray):
        self.vocabulary = vocabulary
        # A guard at both ends: a symbol that no pair has.
        n = len(symbols)
        self.symbol = np.concatenate([[-1], symbols, [-1]])
        word = np.concatenate([[-1], words, [-2]])
        self.next = np.arange(1, n + 3)
        self.before = np.arange(-1, n + 1)
        # Words are kept apart: links across their borders lead to the guard.
        border = np.flatnonzero(word[1:] != word[:-1])
        self.next[border] = n + 1
        self.before[border + 1] = 0
        self.alive = np.ones(n + 2, bool)
        self.alive[[0, -1]] = False
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.arange(1, n + 1))

    def add(self, positions: np.ndarray) -> None:
        """Enter the pairs that begin at the positions."""
        rank = self.vocabulary.ranks(self.symbol[positions], self.symbol[self.next[positions]])
        known = rank >= 0
        if not known.any():
            return
        positions, rank = positions[known], rank[known]
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
            if r in self.lists:
                self.lists[r].append(part)
            else:
                self.lists[r] = [part]
                heapq.heappush(self.active, r)

    def merge(self) -> np.ndarray:
        """Apply all ranks; returns which symbols are left."""
        v = self.vocabulary
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.lists.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = v.left[rank], v.right[rank]
            right = self.next[at]
            now = self.alive[at] & (self.symbol[at] == a) & (self.symbol[right] == b)
            at, right = at[now], right[now]
            if a == b and len(at) > 1:
                # In a run of equal symbols every other pair is taken, from the left.
                starts = np.concatenate([[True], right[:-1] != at[1:]])
                number = np.arange(len(at))
                first = np.maximum.accumulate(np.where(starts, number, 0))
                odd = (number - first) % 2 == 1
                at, right = at[~odd], right[~odd]
            if not len(at):
                continue
            self.symbol[at] = v.made[rank]
            self.alive[right] = False
            after = self.next[right]
            self.next[at] = after
            inside = after < len(self.next) - 1
            self.before[after[inside]] = at[inside]
            left = self.before[at]
            self.add(np.concatenate([left[left > 0], at]))
        return self.alive[1:-1]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        # Marks inside the joined words; words themselves hold no such white space.
        self.marks = dict(zip(vocabulary.special, "\t\r", strict=False))
        self.pattern = regex.compile(vocabulary.pattern + r"|[\n\t\r]")

    def words(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and the number of ids of each word."""
        import unicodedata

        v = self.vocabulary
        line = "\n".join(terms)
        for content, mark in self.marks.items():
            line = line.replace(content, mark)
        # Lower case by single characters: only the sigma depends on what follows it.
        line = unicodedata.normalize("NFC", line).replace("Σ", "σ").lower()
        pieces = self.pattern.findall(line)
        known: dict[str, int] = {}
        number = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
        texts = [p.encode() for p in known]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        symbols = v.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = v.final[data[last]]
        owner = np.repeat(np.arange(len(texts)), lengths)
        special = {mark: v.special[content] for content, mark in self.marks.items()}
        for mark, n in special.items():
            if mark in known:
                symbols[last[known[mark]]] = n
        index = PairIndex(v, symbols, owner)
        left = index.merge()
        if "\n" in known:
            left[last[known["\n"]]] = False
        ids = index.symbol[1:-1][left]
        count = np.bincount(owner[left], minlength=len(texts))
        start = np.cumsum(count) - count
        out = ids[ragged(start[number], count[number])]
        word = np.cumsum(number == known.get("\n", -1))
        return out, np.bincount(word, weights=count[number], minlength=len(terms)).astype(np.int64)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each text begin."""
        words = Words(column)
        if not len(words.codes):
            return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
        ids, count = self.words(words.terms.to_pylist())
        start = np.cumsum(count) - count
        lengths = count[words.codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids[ragged(start[words.codes], lengths)], ends[words.starts]


def decoded(ids: bytes, tokens: np.ndarray) -> str:
    """The tokens of little-endian 32-bit ids, a blank between two."""
    return " ".join(tokens[np.frombuffer(ids, "<u4")].tolist())


def encode(documents: DataFrame, path: str, keep: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) of each row, then the columns named in ``keep``.

    With ``decode`` a column decoded follows ids: the text that these ids stand for.
    It is made in the same task, so that a task needs one worker only.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = Encoder(Vocabulary.of(shared.value)), np.array(shared.value["tokens"], object)
        for slab in slabs(batches, "_text", _SLAB):
            ids, starts = encoder.texts(slab.column("_text"))
            data = ids.astype("<u4").tobytes()
            blobs = [data[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            named = {"doc_id": slab.column("_doc_id"), "n_tokens": pa.array(np.diff(starts)), "ids": pa.array(blobs, pa.binary())}
            if decode:
                named["decoded"] = pa.array([decoded(b, tokens) for b in blobs], pa.string())
            yield pa.RecordBatch.from_pydict(named | {f"_{c}": slab.column(f"_in_{c}") for c in keep})

    kinds = dict(documents.dtypes)
    schema = f"doc_id {kinds['doc_id']}, n_tokens long, ids binary{', decoded string' * decode}" + "".join(f", `_{c}` {kinds[c]}" for c in keep)
    given = documents.select(
        F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"), *[F.col(c).alias(f"_in_{c}") for c in keep]
    )
    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Stored encoded rows with a column decoded."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array(shared.value, object)
        for slab in slabs(batches, "ids", _SLAB):
            yield slab.append_column("decoded", pa.array([decoded(b, tokens) for b in slab.column("ids").to_pylist()], pa.string()))

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string"
    return encoded.mapInArrow(run, schema)
