import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from geopanel.llm import token_links
from test_pieces import odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_force(texts, kind="ends"):
    """Tokens of both libraries on whole texts, groups and links by byte offsets, counts over all texts."""
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    back = {c: bytes([b]) for b, c in enumerate(token_links.byte_symbols())}
    piece = lambda i: bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for text in texts:
        raw = (" " + text).encode() if text else b""
        ids_a, ids_b = (lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)) if text else ([], [])
        body_a, body_b = [b"".join(back[c] for c in lib_a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(body_a) != raw or b"".join(body_b) != raw:
            out.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in body_a]).tolist(), np.cumsum([len(x) for x in body_b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        cut_a, cut_b = [0, *(ends_a.index(e) + 1 for e in both)], [0, *(ends_b.index(e) + 1 for e in both)]
        groups = [(ids_a[i:k], ids_b[j:m]) for i, k, j, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        spans_a, spans_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))
        if kind == "ends":
            links = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in both]
        else:
            links = [(x, y) for x, (s, e) in zip(ids_a, spans_a) for y, (t, f) in zip(ids_b, spans_b) if s < f and t < e]
        out.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(p for r in out for p in r[3])
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    said = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for _, _, g, _ in out]
    return [(a, b, len(g), len(li), sum(count[p] == highest[p[1]] for p in li), sum(count[p] for p in li), hashlib.sha256(s.encode()).hexdigest() if s else "") for (a, b, g, li), s in zip(out, said)]


def answer(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_whole_table(spark, sf_dir, corpus):
    rows = sorted(token_links.aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), A, B, batch_links=20_000).collect(), key=lambda r: r.doc_id)
    assert answer(rows) == brute_force([corpus[r.doc_id] for r in rows])


def test_odd_rows(documents, odd_rows):
    odd = [t for t in odd_texts(150, 5) if len(t) < 3000] + ["<|endoftext|> a <s>", "x  y   z", "one\r\n\r\ntwo  three\t\n four's 'S", "don't", "a ▁ b", "éàü ß œuvre naïve", "漢字 かな  テスト"]
    rows = [*odd_rows[:6], *odd_rows[7:], *((100 + i, t) for i, t in enumerate(odd))]
    for kind in ("ends", "overlap"):
        got = token_links.aligned(documents(rows), A, B, kind=kind).collect()
        assert sorted(answer(got)) == sorted(brute_force([t or "" for _, t in rows], kind))
    assert token_links.aligned(documents([]), A, B).collect() == []


def test_groups_are_kept_on_demand(documents):
    r = token_links.aligned(documents([(1, "Reoush hewh")]), A, B, keep=True).first()
    assert r.groups.count("|") == r.n_groups == r.n_links


def test_gallop_is_a_lower_bound_within_each_unit():
    random.seed(4)
    other = np.sort(np.array(random.sample(range(10_000), 800)))
    start = np.array([random.randint(0, 700) for _ in range(3000)])
    stop = np.minimum(start + [random.randint(0, 300) for _ in range(3000)], 800)
    ends = np.array([random.randint(0, 10_100) for _ in range(3000)])
    got = token_links.gallop(ends, start, stop, other)
    assert got.tolist() == [int(a + np.searchsorted(other[a:b], e)) for e, a, b in zip(ends, start, stop)]
