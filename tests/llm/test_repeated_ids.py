import random

from caseward.llm import substrings


def test_texts_of_one_id_have_cuts_of_their_own(spark):
    rng = random.Random(6)
    other = lambda n: [f"u{rng.random()}" for _ in range(n)]
    run = [f"r{n}" for n in range(60)]
    texts = [(1, other(9) + run), (2, other(120) + run + other(4)), (2, other(200)), (2, other(55)), (2, other(3)), (3, other(80)), (None, other(70))]
    rows = [(d, " ".join(t)) for d, t in texts]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedupe(docs).collect())
        want = [(str(d), len(t), 60 if n == 1 else 0, " ".join(t[:120] + t[180:] if n == 1 else t)) for n, (d, t) in enumerate(texts)]
        assert got == sorted(want)
