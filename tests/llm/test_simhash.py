import re

import numpy as np
import xxhash

from geopanel.llm import simhash_gray as g


def fingerprint(text):
    """By the definition, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(prints):
    """Smallest identifier that each one reaches over links of three bits or fewer."""
    ids = sorted(prints)
    out = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            least = min(out[b] for b in ids if bin(prints[a] ^ prints[b]).count("1") <= 3)
            if least < out[a]:
                out[a], changed = least, True
    return out


def test_whole_table(spark, sf_dir, corpus):
    rows = g.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    prints = {i: fingerprint(t) for i, t in corpus.items()}
    assert {r.doc_id: r.fp % 2**64 for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == reached(prints)


def test_small_groups_are_dealt_again(documents):
    texts = [(i, f"alpha beta gamma delta epsilon zeta eta theta word{i % 7}") for i in range(60)]
    whole = {(r.doc_id, r.component_id) for r in g.near_duplicates(documents(texts)).collect()}
    assert whole == {(r.doc_id, r.component_id) for r in g.near_duplicates(documents(texts), limit=2).collect()}


def test_odd_rows(documents, odd_rows):
    rows = g.near_duplicates(documents(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    own = {(r.doc_id, r.component_id) for r in rows}
    assert {(1, 1), (None, 1), (2, 2), (3, 2), (4, 2), (None, 2)} <= own
    assert g.near_duplicates(documents([])).collect() == []


def test_search_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    ball = base[0] ^ (np.uint64(1) << rng.integers(0, 9, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(20, 40, 300).astype(np.uint64))
    code = np.unique(np.r_[base, near, ball])
    rows, first = g.search(np.zeros(code.size, int), code, 0, chunk=2_000)
    label = np.arange(code.size)
    label[rows] = first
    clusters = g.Clusters(code.size)
    for i in range(code.size):
        j = np.flatnonzero(np.bitwise_count(code ^ code[i]) <= 3)
        clusters.link(np.full(j.size, i), j)
    assert np.unique(np.stack([label, clusters.label]), axis=1).shape[1] == np.unique(label).size == np.unique(clusters.label).size
