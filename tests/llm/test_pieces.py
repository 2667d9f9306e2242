import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from geopanel.llm import piece_rounds

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return piece_rounds.Codec(f.read(), keep_chars=20_000)  # so few that known words are dropped again and again


def odd_texts(n, seed):
    random.seed(seed)
    kinds = [
        lambda: "".join(random.choice("ab ▁\n.") for _ in range(random.randint(1, 60))),
        lambda: "".join(chr(random.choice([random.randint(32, 126), random.randint(160, 600), random.randint(0x400, 0x4FF), 32, 32, 0x2581])) for _ in range(random.randint(1, 80))),
        lambda: "".join(random.choice(["the", "ing", "er", "ion", " ", "  ", "tion", "ed", "\n", "s", "re", "nt"]) for _ in range(random.randint(1, 40))),
        lambda: "".join(random.choice("=-/*#.;:\r\n\t(){} ") for _ in range(random.randint(1, 60))),
        lambda: "".join(random.choice("etaoinshr") for _ in range(random.randint(1, 60))),
    ]
    fixed = ["", " ", "  ", " \n", "\n", "a ", "</s> <s> <unk> <0x0A>", "▁", "▁▁ x▁y", " " * 5000 + "x", "a" * 9000, "ab" * 5000, "日本語 漢字かな" * 700,
             "😀👩‍👩‍👧 é \x00 \x85", "\r\r\r;\r\n\t\t x", "the  the   the    the     end", "x" + " " * 33, "0123 456", "ababab" * 30, "....!!!!----"]
    return fixed + [random.choice(kinds)() for _ in range(n)]


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_texts_of_all_kinds_as_the_library(library, codec):
    texts = odd_texts(4000, 1)
    for at in range(0, len(texts), 500):
        for text, (ids, decoded) in zip(texts[at : at + 500], codec.run(texts[at : at + 500])):
            own = library.encode(text, add_eos=True)
            assert ids == " ".join(map(str, own)) and decoded.decode() == library.decode(own), text[:80]


def test_rounds_and_heap_agree(codec):
    random.seed(2)
    words = ["".join(random.choice("etaoinsr" if i % 2 else "▁ab") for _ in range(random.randint(1, 40))) for i in range(500)]
    symbols, count = codec.by_rounds(codec._symbols(words), np.array([len(w) for w in words]))
    for word, found in zip(words, np.split(symbols, np.cumsum(count)[:-1])):
        assert found.tolist() == codec.by_heap(codec._symbols([word])).tolist()


def test_whole_table(spark, sf_dir, corpus, library):
    rows = piece_rounds.encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: expected(library, t) for i, t in corpus.items()}


def test_odd_rows(documents, odd_rows, library):
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(odd_texts(50, 3)))]
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_rounds.encode_decode(documents(rows), PATH).collect())
    assert got == sorted(expected(library, t) for _, t in rows)
    assert piece_rounds.encode_decode(documents([]), PATH).collect() == []


def test_ids_and_text_are_kept_on_demand(documents, library):
    r = piece_rounds.encode_decode(documents([(1, "Hello wide world")]), PATH, keep=True).first()
    assert r.ids == library.encode("Hello wide world", add_eos=True) and r.decoded == "Hello wide world"
