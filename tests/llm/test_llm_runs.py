"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from caseward.llm import runs
from caseward.llm.slabs import Words


def brute(words, min_length=6, min_copies=4):
    found = {}
    for q in range(1, len(words) // min_copies + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_copies * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc, words):
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(doc, text):
    words = planted(doc, (text or "").encode().split())
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    most = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    hashes = ["".join(f"{s},{n},{q}\n" for s, n, q in found).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone)]
    return (doc, len(found), *most, *(hashlib.sha256(h).hexdigest() for h in hashes))


def test_runs_of_random_words():
    rng = random.Random(1)
    texts = [None, "", " ", "a " * 500, "a b " * 300 + "c", "x " * 5, "x " * 6]
    for _ in range(2000):
        n, letters, p = rng.choice([1, 5, 10, 30, 60]), rng.choice([1, 2, 3, 5]), rng.randint(1, 8)
        w = [rng.choice("abcdefg"[:letters]) for _ in range(n)]
        a = rng.randrange(n)
        texts.append(" ".join(w if rng.random() < 0.5 else w[:a] + [w[a + i % min(p, n - a)] for i in range(n - a)]))
    for limits in ((6, 4), (2, 2), (9, 3)):
        words = Words(pa.array(texts, pa.string()))
        at, length, period = runs.periodic_runs(words.codes, words.starts, *limits)
        row = np.searchsorted(words.starts, at, side="right") - 1
        found = [[] for _ in texts]
        for r, s, n, q in zip(row, at - words.starts[row], length, period, strict=True):
            found[r].append((s, n, q))
        assert found == [brute((t or "").split(), *limits) for t in texts]


def test_query_equals_brute_force(small, odd, empty):
    for documents in (small, odd):
        rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
        assert sorted(map(repr, (tuple(r) for r in runs.digests(documents).collect()))) == sorted(repr(digest(*r)) for r in rows)
    assert runs.digests(empty).count() == 0


def test_collapsed_keeps_columns_and_clean_texts(odd, empty):
    out = runs.collapsed(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    before = sorted(r["text"] for r in odd.filter("text RLIKE 'start'").collect())
    assert before == sorted(r["text"] for r in out.filter("text RLIKE 'start'").collect())
    assert out.filter("text = 'a'").count() == odd.filter("text = 'a a a a a a'").count() == 1
    assert runs.collapsed(empty).count() == 0
