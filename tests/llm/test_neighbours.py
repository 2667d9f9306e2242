import numpy as np
import pytest

from geopanel.llm import ann_blocks


def brute(rows, k, asked):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for i, v in sorted({i: v for i, v in ok if asked(i)}.items()):
        best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("sizes", [(8192, 2048), (37, 5)])
def test_exact_with_odd_vectors(spark, sizes):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(300 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(400, [0.0] * 6), (401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6), (405, [1e-3] * 6), (406, [1e6, 0.0, 0.0, 0.0, 0.0, -1e-6])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in ann_blocks.nearest(df, "id % 20 = 0", 7, candidate_rows=sizes[0], query_rows=sizes[1]).orderBy("query_id", "rank").collect()]
    want = brute(rows, 7, lambda i: i % 20 == 0)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_few_and_none(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ann_blocks.nearest(df([]), "id % 20 = 0", 5).collect() == []
    assert ann_blocks.nearest(df([(20, [1.0])]), "id % 20 = 0", 5).collect() == []
    assert [tuple(r)[:3] for r in ann_blocks.nearest(df([(20, [1.0]), (3, [2.0]), (4, [2.0])]), "id % 20 = 0", 5).orderBy("rank").collect()] == [(20, 1, 3), (20, 2, 4)]


def test_error_bound_holds():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(50, 16)) * rng.lognormal(size=(50, 1))
    q, step, error = ann_blocks.quantised(v)
    assert np.all(np.sqrt(((v - q * step[:, None]) ** 2).sum(axis=1)) <= error * (1 + 1e-12))
