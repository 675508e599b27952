from collections import Counter

import pyarrow as pa

import corpus_pipeline
from caseward.llm import lines, mixing, quality, simhash
from caseward.sources.shared import stored


def test_stages_and_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, docs, folder), name)
        assert after.count() > 0
        if n < 4:
            assert after.columns == columns
        if n == 0:
            judged = quality.judge(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
            assert Counter(r[0] for r in after.select("doc_id").collect()) == Counter(r[0] for r in judged.filter("kept").select("doc_id").collect())
        if n == 1:
            left = {r["doc_id"]: r["kept_text"] for r in lines.dedupe(docs).collect()}
            assert all(left[r["doc_id"]] == r["text"] for r in after.collect())
        if n == 2:
            groups = {r["component_id"] for r in simhash.components(docs).collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(groups)
        if n == 3:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
            words = Counter()
            for r in after.collect():
                words[r["doc_id"]] += len(r["text"].encode().split())
                assert r["n_chars"] == len(r["text"])
            assert words == taken
        docs = after
    end = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, end.collect())) == sorted(map(str, docs.collect()))


def test_texts_reach_workers_in_bounded_batches(spark):
    docs = stored(spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "concat(id, ' ', repeat('word ', 2000)) AS text"), "docs")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    corpus_pipeline.tokens(spark, docs, "")
    found = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 2000 * 10_000 and max(found) < 6 << 20
