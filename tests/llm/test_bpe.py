import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from geopanel.llm import bpe_split

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_whole_table(spark, sf_dir, corpus):
    library = Tokenizer.from_file(PATH)
    rows = bpe_split.encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {i: expected(library, t) for i, t in corpus.items()}


def test_odd_texts(documents, odd_rows):
    library = Tokenizer.from_file(PATH)
    random.seed(1)
    odd = ["<|endoftext|>abc<|startoftext|> d", "ÀÉ ῼ ΑΣ Σ İstanbul é \x1c x\x85y", "aaaa" * 400, "日本語 𝔘𝔫 ½ ²", "don't I'LL 'S''s", "a\x00b", "😀👩‍👩‍👧 ok!!!", "ﬁ ǅ ẞ ß"]
    odd += ["".join(chr(random.choice([random.randint(32, 126), random.randint(160, 600), random.randint(0x300, 0x2FFF), 32])) for _ in range(200)) for _ in range(40)]
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(odd))]
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_split.encode_decode(documents(rows), PATH).collect())
    assert got == sorted(expected(library, t) for _, t in rows)
    assert bpe_split.encode_decode(documents([]), PATH).collect() == []


def test_round_trip_keeps_ids(documents):
    r = bpe_split.encode_decode(documents([(1, "Hello wide world")]), PATH, keep=True).first()
    library = Tokenizer.from_file(PATH)
    assert r.ids == library.encode("Hello wide world", add_special_tokens=False).ids and r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_cuts_fall_only_between_pairs_of_no_token():
    with open(PATH, encoding="utf-8") as f:
        c = bpe_split.codec(f.read())
    assert "".join(c.fragments_of("qzxvwkj")) == "qzxvwkj "
    assert len(c.fragments_of("qzxvwkj")) > 1 and c.fragments_of("the") == ["the "]
