import numpy as np

from caseward.llm import neighbours


def test_every_valid_vector_of_an_id_is_a_candidate(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows += [(5, [0.0] * 8), (7, [-np.inf] + [1.0] * 7), (9, rng.standard_normal(8).tolist()), (9, rows[9][1]), (0, rng.standard_normal(8).tolist()), (11, (-np.array(rows[11][1])).tolist())]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0", k=65, confidence=1 - 1e-12).collect()
    valid = sorted({(i, tuple(v)) for i, v in rows if np.isfinite(v).all() and np.any(v)})
    for q in range(0, 60, 10):
        mine = [np.array(v) for i, v in valid if i == q]
        cos = lambda v: max(float(np.dot(m, v) / np.linalg.norm(m) / np.linalg.norm(v)) for m in mine)
        want = sorted(((-cos(np.array(v)), i) for i, v in valid if i != q))
        found = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [f[1] for f in found] == [i for _, i in want]
        assert np.allclose([f[2] for f in found], [-s for s, _ in want])
