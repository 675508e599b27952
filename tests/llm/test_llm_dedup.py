import random

import numpy as np
import xxhash

from caseward.llm import lines, simhash, substrings



def key(d):
    return (d is not None, d or 0)


def brute_substrings(rows, window):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            first[run] = min(first.get(run, (True, 1 << 62)), key(d))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((str(d), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def found_substrings(docs, **options):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedupe(docs, **options).collect())


def test_substrings_equal_brute_force(odd, small, empty):
    for docs in (odd, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert found_substrings(docs) == brute_substrings(rows, 50)
        assert found_substrings(docs, buckets=5) == brute_substrings(rows, 50)
    assert found_substrings(empty) == []


def test_substrings_at_every_alignment(spark):
    rng = random.Random(2)
    other = lambda n: [f"u{rng.random()}" for _ in range(n)]
    run = [f"r{n}" for n in range(50)]
    rows = [(0, " ".join(other(7) + run + other(3)))]
    rows += [(1 + n, " ".join(other(n) + run + other(5))) for n in range(40)]
    rows += [(99, " ".join(other(4) + run[:49] + other(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found_substrings(docs)
    assert got == brute_substrings(rows, 50) and sum(g[2] for g in got) == 40 * 50


def test_cover():
    assert substrings.is_cover(substrings.COVER, substrings.PERIOD)
    assert not substrings.is_cover((0, 1, 2), 31)


def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_equals_brute_force(odd, small, empty):
    for docs in (odd, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        values = [brute_fingerprint(t) for _, t in rows]
        groups = brute_components(values)
        least = {g: min((d for (d, _), x in zip(rows, groups, strict=True) if x == g and d is not None), default=None) for g in set(groups)}
        want = sorted((str(d), f"{v:016x}", str(least[g])) for (d, _), v, g in zip(rows, values, groups, strict=True))
        got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.components(docs).collect())
        assert got == want
        kept = simhash.deduplicated(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(groups))
    assert simhash.components(empty).collect() == [] and simhash.deduplicated(empty).collect() == []


def test_trees_find_all_links_and_pieces_lose_none(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in rng.integers(0, 5, 400)]
    values = np.unique(seeds[rng.integers(0, 40, 400)] ^ np.array(flips, np.uint64))
    want = brute_components([int(v) for v in values])
    label = simhash.link(np.zeros(len(values), np.int64), values, np.ones(len(values), bool), np.ones(len(values), bool))
    assert label.tolist() == want
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for piece in (8192, 10):
        pairs = [(r["a"], r["b"]) for r in simhash.links(nodes, piece=piece).collect()]
        at = {int(v): n for n, v in enumerate(values.view(np.int64))}
        got = list(range(len(values)))
        for a, b in pairs:
            x, y = got[at[a]], got[at[b]]
            got = [min(x, y) if g in (x, y) else g for g in got]
        assert got == want




def test_lines_small_cases(spark, empty):
    rows = [(1, "long line with more than eight words in it\na\nb\nc"), (2, "x\nb\nc\n\ny\nb"), (3, "long line with more than eight words in it\nz"), (4, "b\n\nc\nq"), (5, None), (6, ""), (7, "d\nd\nd\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["kept_text"]) for r in lines.dedupe(docs).collect()}
    assert got[1] == (4, 0, rows[0][1])
    assert got[2] == (6, 2, "x\n\ny\nb")
    assert got[3] == (2, 1, "z")
    assert got[4] == (4, 2, "\nq")
    assert got[5] == (0, 0, None) and got[6] == (1, 0, "")
    assert got[7] == (4, 3, "d")
    three = {r["doc_id"]: r["kept_text"] for r in lines.dedupe(docs, min_lines=3, min_words=99).collect()}
    assert three[2] == rows[1][1] and three[7] == "d" and three[3] == rows[2][1]
    assert lines.dedupe(empty).collect() == []


def test_lines_equal_brute_force_for_all_widths(spark):
    rng = random.Random(8)
    rows = [(n, "\n".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for m in (1, 2, 3, 5):
        seen, want = set(), {}
        for d, t in rows:
            x, gone = t.split("\n"), set()
            for i in range(len(x) - m + 1):
                run = tuple(x[i : i + m])
                if run in seen:
                    gone.update(range(i, i + m))
                seen.add(run)
            want[d] = len(gone)
        assert {r["doc_id"]: r["n_deleted"] for r in lines.dedupe(docs, min_lines=m, min_words=99).collect()} == want


def test_lines_of_odd_rows(odd):
    rows = lines.dedupe(odd, keep=("source",)).collect()
    assert len(rows) == odd.count()
    # Equal rows are one document: they keep the same text.
    kept = {r["kept_text"] for r in rows if r["doc_id"] == 9}
    assert len(kept) == 1
    assert lines.deduplicated(odd).columns == odd.columns
