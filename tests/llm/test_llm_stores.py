import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from caseward.llm import mixing, neighbours, warc
from caseward.sources.shared import new_path


def test_archives_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 70_000, "<p>a</p>", "x\r\n\r\ny", "<p>a</p>"]
    rows = [(n, f"http://h/{n} ü\n", h, n) for n, h in enumerate(html)]
    rows += [(None, None, "<p>a</p>", 0), (7, "http://again", "<p>a</p>", 1), (None, None, "lone", 0), (3, "http://other", "other", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, newest long").repartition(3)
    most = {}
    for i, _, h, _ in rows:
        most[h or ""] = max(most.get(h or "", (False, 0)), (i is not None, i or 0))
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        top = most[h or ""] == (i is not None, i or 0)
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top else "revisit", None if top else most[h or ""][1]))
    for size in (1, 1 << 30):
        archives = warc.write_archives(pages, new_path(spark, "warc"), archive_bytes=size)
        got = warc.read_archives(archives, payload=True).collect()
        assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
        for r in got:
            assert (r["payload"] is None) == (r["record_type"] == "revisit")
            assert r["payload"] is None or base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"]
    long = warc.read_archives(warc.write_archives(pages, new_path(spark, "warc"), least=9)).collect()
    assert sum(r["record_type"] == "revisit" for r in long) == 0
    none = warc.write_archives(pages.limit(0), new_path(spark, "warc"))
    assert none.count() == 0 and warc.read_archives(none).collect() == []


def test_damaged_archives_are_refused():
    def member(data):
        packer = zlib.compressobj(wbits=31)
        return packer.compress(data) + packer.flush()

    good = warc.record(1, "http://a", b"payload", None, False)
    assert len(list(warc.records(io.BytesIO(member(good) * 3)))) == 3
    for bad in (good.replace(b"payload", b"pay1oad"), good[:-4], good + b"x", good.replace(b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(member(good) + member(bad))))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(member(good)[:-12])))


def quotients(votes, seats, limits):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(limits))):
        free = [i for i in range(len(votes)) if got[i] < limits[i]]
        best = max(free, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_highest_quotients():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        votes = [rng.choice([0, 1, 5, 5, 100, 1000.5]) for _ in range(n)]
        limits = [rng.choice([0, 3, 1000]) for _ in range(n)]
        seats = rng.randint(0, 120)
        assert mixing.apportion(np.array(votes), seats, np.array(limits)).tolist() == quotients(votes, seats, limits)


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 450 * 2 / 8 + (450 * 5 / 8 - 200) * 2 / 3, 450 / 8 + (450 * 5 / 8 - 200) / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_mix(spark, odd, small, empty):
    for docs in (odd, small):
        rows = mixing.mix(docs, keep=("source", "text")).collect()
        again = mixing.mix(docs.repartition(7)).collect()
        assert sorted(str((r["doc_id"], r["size"], r["taken"])) for r in rows) == sorted(str((r["doc_id"], r["size"], r["taken"])) for r in again)
        assert len(rows) == docs.count()
        for r in rows:
            assert r["size"] == len((r["_text"] or "").encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
        names = sorted({r["_source"] for r in rows}, key=lambda x: (x is None, x or ""))
        sizes = [sum(r["size"] for r in rows if r["_source"] == s) for s in names]
        for s, n, goal in zip(names, sizes, mixing.targets(sizes), strict=True):
            mine = [r for r in rows if r["_source"] == s]
            assert {(r["source_size"], round(r["target"], 6)) for r in mine} == {(n, round(goal, 6))}
            assert abs(sum(r["taken"] for r in mine) - goal) <= 2 * mixing.BLOCK
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        assert sum(len(r["text"].encode().split()) for r in out.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_mix_in_many_shards(small):
    rows = mixing.mix(small, shard_words=500, keep=("source",)).collect()
    for s in {r["_source"] for r in rows}:
        mine = [r for r in rows if r["_source"] == s]
        shards = -(-mine[0]["source_size"] // 500)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= mixing.BLOCK * (shards + 1)


def brute_search(rows, asked, k):
    out = {}
    for q, v in rows:
        if asked(q):
            scored = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i) for i, w in rows if i != q]
            out[q] = sorted(scored)[:k]
    return out


def found(vectors, **options):
    out = {}
    for r in sorted(neighbours.search(vectors, "vec_id % 50 = 0", **options).collect()):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


def test_recall_in_cells_and_pieces(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect()]
    want = brute_search(rows, lambda q: q % 50 == 0, 5)
    for options in ({}, {"piece": 60, "sample": 200}):
        got = found(vectors, **options)
        assert got.keys() == want.keys()
        hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
        assert hits / (5 * len(want)) >= 0.9
        for q in got:
            assert got[q] == sorted(got[q]) and all(i != q for _, i in got[q])


def test_vectors_that_take_no_part_and_ties(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(n, one) for n in range(0, 300, 3)] + [(1, None), (2, [0.0] * 4), (4, [1.0, None, 1.0, 1.0]), (5, [float("nan"), 1.0, 1.0, 1.0]), (7, [1.0, 2.0]), (None, one), (8, [1e300, 2e300, 3e300, 4e300]), (10, [4.0, 3.0, 2.0, 1.0]), (10, [4.0, 3.0, 2.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    got = found(vectors, piece=20)
    assert got.keys() == {0, 150}
    assert [i for _, i in got[0]] == [3, 6, 8, 9, 12] or [i for _, i in got[0]] == [3, 6, 9, 12, 15]
    assert [i for _, i in got[150]][:2] == [0, 3]
    assert found(vectors.filter("vec_id IN (0, 10, 3)")) [0][1][1] == 10
    assert found(vectors.limit(0)) == {} and found(vectors.filter("vec_id = 2")) == {}


def test_chi_square():
    assert abs(neighbours.chi_square(neighbours.quantile(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(neighbours.quantile(0.95, 8) - 15.507) < 1e-3
