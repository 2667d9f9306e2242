import random
import re
from collections import Counter

from geopanel.llm import quality_ledger as q


def base(text):
    """The base measurements by their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_by_definition():
    random.seed(4)
    texts = ["", " ", "a", "a a a a a a", "x y\n\nx y\n \nx y", "é ü\x85b\u2003c # | <>", "a b c d e a b c d e", "A-B\x0bc\x0cd"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(1, 60))) for _ in range(200)]
    texts += ["\n".join(" ".join(random.choice("ab") for _ in range(3)) for _ in range(9)) for _ in range(20)]
    for t in texts:
        assert q.measure(t.encode())[:5] == base(t), t


def test_odd_rows(documents, odd_rows):
    rows = q.ledger(documents(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert Counter(r.n_words for r in rows)[0] == 4 and max(r.n_words for r in rows) == 30_000
    assert all(r.failures & 1 for r in rows if r.n_words < 10)
    assert q.ledger(documents([])).collect() == []


def test_policies_and_ablations(spark, sf_dir):
    rows = q.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    data = [(r.doc_id, r.failures) for r in rows.collect()]
    for policy, names in q.POLICIES.items():
        whole = q.mask(names)
        assert {r.doc_id for r in rows.where(q.passes(policy)).collect()} == {d for d, f in data if not f & whole}
        for r in q.ablations(rows, policy).collect():
            bit = q.mask((r.rule,))
            assert r.fails == sum(bool(f & bit) for _, f in data)
            assert r.fails_alone == sum(f & whole == bit for _, f in data)
            assert r.kept_without == sum(not f & (whole & ~bit) for _, f in data)


def test_verdicts_agree_with_quality_labels(spark, sf_dir):
    kept = {r.doc_id for r in q.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).where(q.passes("v2")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum((i in kept) == bool(v) for i, v in labels.items()) >= 0.9 * len(labels)
