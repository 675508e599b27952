import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from caseward.llm import similar
from caseward.sources.shared import stored


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """Component number of each text: pairs with |x & y| / |x | y| >= 0.8 (or both without words) are linked."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def found_groups(docs, **options):
    marked, placed = similar.grouped(docs.select("doc_id", "text"), **options)
    groups = {}
    for r in marked.join(placed, "fp").collect():
        groups.setdefault(r["root"], []).append(str(r["doc_id"]))
    return sorted(sorted(g) for g in groups.values())


def wanted_groups(rows):
    groups = {}
    for (d, _), g in zip(rows, brute_groups([t for _, t in rows]), strict=True):
        groups.setdefault(g, []).append(str(d))
    return sorted(sorted(g) for g in groups.values())


def planted(seed=3):
    """Groups of texts with a few words replaced, around the similarity of 0.8, and a passage that many hold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [f"p{n}" for n in range(12)]
    texts = []
    for size in (1, 3, 4, 5, 8, 9, 14, 24, 60, 200, 400):
        for _ in range(3):
            first = [word() for _ in range(size)] + (passage if rng.random() < 0.7 else [])
            texts.append(" ".join(first))
            for _ in range(6):
                other = list(first)
                for _ in range(rng.randint(1, max(1, len(first) // 35))):
                    at = rng.randrange(len(other))
                    other[at : at + 1] = rng.choice(([], [word()], [other[at], word()]))
                texts.append(" ".join(other))
    return list(enumerate(texts))


def test_groups_equal_brute_force_jaccard(spark, odd, small, empty):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = wanted_groups(rows)
    assert 1 < sum(len(g) > 1 for g in want) and any(len(g) == 1 for g in want)
    assert found_groups(docs) == want
    # The order and the pieces change nothing.
    assert found_groups(docs, sample=5, piece=3) == want
    for docs in (odd, small):
        assert found_groups(docs) == wanted_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert similar.deduplicated(empty).collect() == []


def test_stage_links_at_similarity_080(spark):
    rows = planted(4)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    groups = brute_groups([t for _, t in rows])
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g: d for (d, _), g in reversed(list(zip(rows, groups, strict=True)))}.values())


def components(nodes, pairs):
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_pairs_need_no_stars(spark):
    """The search by prefixes alone finds what the stars leave, and every similar pair if they leave all."""
    rows = planted(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = stored(similar.prefixes(docs))
    nothing = spark.createDataFrame([], "fp long, root long")
    fp = {r["doc_id"]: r["fp"] for r in marked.collect()}
    sets = {fp[d]: shingles(t) for d, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    for piece in (8192, 3):
        found = stored(similar.pairs(marked, nothing, piece))
        room = {(r["a"], r["b"]) for r in similar.possible(found, marked).collect()}
        assert want <= room < {(r["a"], r["b"]) for r in found.collect()}
        # Buckets of a cluster change nothing; the links are a forest of the similar pairs.
        for cell_bytes in (similar.CELL_BYTES, 2000):
            got = {(r["a"], r["b"]) for r in similar.verified(docs, marked, found, cell_bytes).collect()}
            assert got <= want and components(sets, got) == components(sets, want)


def test_bitmap_has_the_bits_of_its_keys(spark):
    keys = spark.range(500).selectExpr("id AS _near_k", "id * 7 AS _near_t")
    bits = similar.bitmap(keys)
    at = {r[0] for r in keys.selectExpr(f"pmod(xxhash64(_near_k, _near_t), {8 * len(bits)})").collect()}
    assert {int(8 * i + j) for i in bits.nonzero()[0] for j in range(8) if bits[i] >> j & 1} == at
    assert not similar.bitmap(keys.limit(0)).any()


def test_trees_of_fingerprints_find_the_candidates(spark):
    """A fingerprint is the majority of the shingles' bits; a pair beyond its radius is no candidate, and no similar pair is."""
    rows = planted(6)
    marked = {r["doc_id"]: r for r in similar.prefixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows[::9]:
        _, value = similar.shingle_sets(pa.array([text]))
        bits = [sum(int(v) >> k & 1 for v in value) for k in range(64)]
        assert marked[d]["simhash"] % (1 << 64) == sum(1 << k for k in range(64) if 2 * bits[k] > len(value))

    def cell(prints, n):
        size = len(prints)
        columns = {"token": [7] * size, "low": [0] * size, "high": [0] * size, "piece": [0] * size, "fp": list(range(size)), "root": list(range(size))}
        columns |= {"simhash": np.array(prints, np.uint64).view(np.int64), "n": [n] * size, "pos": [0] * size}
        return {p for a, b in similar.candidates(pa.RecordBatch.from_pydict(columns)) for p in zip(a.tolist(), b.tolist(), strict=True)}

    prints = [0, (1 << 10) - 1, (1 << 32) - 1, (1 << 64) - 1]
    assert cell(prints, 100) == {(0, 1), (0, 2), (1, 2), (2, 3)}
    assert len(cell(prints, similar.SMALL)) == 6
    sets = {d: shingles(t) for d, t in rows}
    beyond = [
        (d, e)
        for d in sets
        for e in sets
        if d < e and len(sets[d]) > similar.SMALL and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])
        and ((marked[d]["simhash"] ^ marked[e]["simhash"]) % (1 << 64)).bit_count() > similar.RADIUS
    ]
    assert beyond == []
