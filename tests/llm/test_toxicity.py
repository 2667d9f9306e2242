import numpy as np
import pytest

from geopanel.llm import toxicity as t


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, t.train(docs, labels)


def test_held_out_labels(trained):
    docs, labels, model = trained
    rows = t.score(docs, model).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    caught = [r.predicted for r in rows if r.toxic]
    assert hit >= 0.93 * len(rows) and np.mean(caught) >= 0.7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_kernel_of_subsequences():
    s = t.Settings()
    marks = t.Landmarks(("idiot", "flower"), s)
    k = marks.kernel([" idiot", " idi-ot", " idxiot", " garden", " flower"])
    assert abs(k[0, 0] - 1) < 1e-5 and abs(k[4, 1] - 1) < 1e-5
    assert k[1, 0] > 0.5 and k[2, 0] > 0.5 > k[3, 0]


def test_by_definition():
    """Kernel values equal a sum over all subsequences, term by term."""
    s = t.Settings()

    def shape(w):
        out = {}
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + s.reach)):
                for j in range(i + 1, k):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0) + s.decay ** (k - i - 2)
        return out, sum(v * v for v in out.values()) ** 0.5

    for a, b in (("idiot", "iddiiot"), ("trash", "trashes"), ("abcab", "cabca")):
        (x, nx), (y, ny) = shape(" " + a), shape(" " + b)
        want = sum(v * y.get(k, 0) for k, v in x.items()) / (nx * ny)
        assert abs(t.Landmarks((a,), s).kernel([" " + b])[0, 0] - want) < 1e-5


def test_marks_and_spelling_do_not_hide_a_word(trained):
    model = trained[2]
    marks = t.Landmarks(model.words, model.settings)
    plain, *others = marks.describe(["you idiot", "you i.d.i.o.t", "you i d i o t", "you IDIOT!!"])
    at = model.words.index("idiot")
    assert all(o[at] > 0.99 * plain[at] for o in others)


def test_odd_rows(documents, odd_rows, trained, spark):
    rows = t.score(documents(odd_rows), trained[2]).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert t.score(documents([]), trained[2]).collect() == []
    none = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    assert t.train(documents(odd_rows), none) is None
    assert {r.score for r in t.score(documents(odd_rows), None).collect()} == {0.0}
    kept = t.score(documents(odd_rows), trained[2], keep=True)
    assert kept.columns == ["doc_id", "text", "fp", "length", "predicted"] and kept.count() == len(odd_rows)


def test_no_more_than_the_limit_of_words_is_known_and_values_stay_the_same():
    s = t.Settings()
    texts = [" ".join(f"w{i * k % 997}x{k}" for i in range(40 * k)) for k in range(1, 12)] + ["", "idiot id.i.ot"]
    free, narrow = t.Landmarks(("idiot", "fool", "plain"), s), t.Landmarks(("idiot", "fool", "plain"), s, limit=64)
    assert np.array_equal(free.describe(texts), narrow.describe(texts))
    assert len(narrow.known) <= 64 and len(narrow.values) <= 4096
