import math
from collections import Counter

import pytest

from geopanel.llm import lm_score


def brute(texts, order, least):
    docs = [t.split() if t else [] for t in texts]
    n = Counter(tuple(d[i - k : i + 1]) for d in docs for i in range(len(d)) for k in range(min(i + 1, order)))
    total = sum(map(len, docs))

    def s(gram):
        if len(gram) == 1:
            return n[gram] / total
        return n[gram] / n[gram[:-1]] if n[gram] >= least else lm_score.BACKOFF * s(gram[1:])

    return [sum(round(math.log(s(tuple(d[max(0, i - order + 1) : i + 1]))) * 1e6) for i in range(len(d))) / 1e6 for d in docs]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, sf_dir, corpus, order):
    ids = sorted(corpus)
    rows = {r.doc_id: r for r in lm_score.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), order, 2, batch_bytes=60_000).collect()}
    want = dict(zip(ids, brute([corpus[i] for i in ids], order, 2)))
    for i in ids:
        assert abs(rows[i].score - want[i]) < 1e-5 * (1 + rows[i].n_words) and rows[i].n_words == len(corpus[i].split())


def test_odd_rows(documents, odd_rows):
    rows = lm_score.scored(documents(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert all((r.mean_score is None and r.score == 0) == (r.n_words == 0) for r in rows)
    assert lm_score.scored(documents([])).collect() == []
