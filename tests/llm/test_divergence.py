import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T

from geopanel.llm import divergence

SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "doc_id" else T.StringType()) for c in ("doc_id", "text", "lang", "source", "term", "value", "block")])


def brute_force(rows, least=10):
    """Straight from the definition, in Python's own whole numbers."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        sources = [s for g, s in groups if g == lang]
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (k + 2) // (sum(c.values()) + 2 * len(kept)) for t, k in c.items()}
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted(((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]))[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def answer(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i % 7 or None, t, la, s, "x", "y", "z") for i, (t, la, s) in enumerate(rows)], SCHEMA)


def test_against_the_definition_in_one_and_in_many_blocks(spark):
    random.seed(3)
    word = lambda: random.choice(["the", "The", "of", "ÄÖ", "äö", "x-y", "don't", "a1b", "漢字", "zz", *(f"w{chr(97 + i)}" for i in range(20))])
    rows = [(" ".join(word() for _ in range(random.randint(0, 30))), random.choice(["en", "de", None]), random.choice(["s0", "s0", "s0", "s1", "ß2", None])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "fr", "a"), ("rare", "fr", "b"), ("only", "xx", "one"), ("word " * 20_000, "en", "s1"), ("the of", None, "s1")] + [("same text again", "en", "s0")] * 12
    expected = brute_force(rows)
    assert {r[2] for r in expected} == {"pair", "term"} and {r[0] for r in expected} == {"", "de", "en", "fr"}
    assert answer(divergence.audited(frame(spark, rows))) == expected
    assert answer(divergence.audited(frame(spark, rows), block_rows=7)) == expected


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert answer(divergence.audited(docs, block_rows=500)) == brute_force([(r.text, r.lang, r.source) for r in docs.collect()])


def test_empty_table(spark):
    assert divergence.audited(frame(spark, [])).collect() == []


def test_equal_subtrees_are_one_node():
    group, term = np.repeat(np.arange(4), 8), np.tile(np.arange(8), 4)
    trees = divergence.Trees(group, term, np.tile([1, 2, 1, 2, 5, 5, 1, 2], 4), 4, 8)
    assert len(set(trees.root.tolist())) == 1 and trees.root[0] > 0
    assert [len(left) - 1 for left, _ in trees.children] == [2, 2, 1]  # (1, 2) and (5, 5); their two pairs; the root
    which, x, y, times = trees.compared(np.array([0, 0]), np.array([1, 2]), np.array([False, True]))
    assert set(zip(which.tolist(), x.tolist(), y.tolist(), times.tolist())) == {(0, 1, 1, 3), (0, 2, 2, 3), (0, 5, 5, 2)}


def test_shares_of_large_counts_are_exact():
    n, total, kept = 3_999_999_999_999_999, 8_000_000_000_000_000, 700_000_001
    assert divergence.share(np.array([n]), np.array([total]), kept)[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)
