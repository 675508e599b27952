import random

import numpy as np

from caseward.llm import language, quality
from caseward.llm.slabs import Words, window_hashes


def brute_statistics(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, run in enumerate(threes):
        if threes.count(run) > 1:
            covered |= {i, i + 1, i + 2}
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_statistics_equal_brute_force(odd, spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab# é|") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string"))
    docs = docs.filter("length(text) < 20000 OR text IS NULL")
    rows = quality.judge(docs, None, keep=("text",)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute_statistics(r["_text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_classifier_learns_labelled_quality(spark, small, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = "doc_id % 3 = 0"
    model = quality.train(docs, labels.filter(f"NOT ({held})"))
    rows = quality.judge(docs, model).join(labels.filter(held), "doc_id").filter("NOT base_failed").collect()
    assert len(rows) > 50
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.97
    assert quality.train(docs, labels.filter("quality = 1")) is None
    assert quality.judge(empty, model).collect() == []
    assert quality.filtered(docs, labels).columns == docs.columns


def test_training_ignores_the_order_of_rows(small, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = quality.train(small.repartition(5), labels, max_labelled=100)
    b = quality.train(small.repartition(2), labels, max_labelled=100)
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


def test_languages(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs.filter("doc_id % 2 = 0"))
    assert model[0] == ["de", "en", "es", "fr"]
    rows = language.predict(docs.filter("doc_id % 2 = 1"), model, keep=("lang",)).collect()
    assert sum(r["lang_pred"] == r["_lang"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r for r in language.predict(odd.filter("doc_id < 3"), model).collect()}
    assert [(found[n]["lang_pred"], found[n]["score"]) for n in range(3)] == [("und", 0.0)] * 3
    assert language.predict(odd, model).count() == odd.count()
    nothing = language.learn(empty)
    assert nothing[0] == [] and {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


def test_profile_is_the_sum_of_bound_vectors():
    profiler = language.Profiler(128)
    got = profiler.bundles(["Ab 1c"], np.zeros(1, np.int64), 1)[0]
    points = np.array([0, 97, 98, 0, 99, 0])
    v = language.letter_vectors(points, 128).astype(int)
    want = sum(np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2] for i in range(4))
    assert (got == want).all()


def test_words_and_windows():
    import pyarrow as pa

    words = Words(pa.array([" a  b\x0bc ", None, "", "b"]))
    assert words.counts.tolist() == [3, 0, 0, 1] and words.terms.to_pylist() == ["a", "b", "c"]
    assert words.codes.tolist() == [0, 1, 2, 1] and words.starts.tolist() == [0, 3, 3, 3, 4]
    values = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    hashes = window_hashes(values, 3)
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 5
