import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geopanel.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", " ", "a", " a b", "a b ", "a\n\nb", "a \n b", "<|endoftext|>x<|endoftext|> y", "don't I'LL 'S''s", "日本 語 𝔘𝔫 ½", "a\x00b c\x85d \x1c e", "x " * 50])
def test_ids_are_the_library_s(library, text):
    with open(PATH, encoding="utf-8") as f:
        enc = packing.byte_encoder(f.read())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check(rows, texts, library, capacity, end):
    """Pieces rebuild every text, and sequences are gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        at, total = 0, total + len(ids)
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_whole_table(spark, sf_dir, corpus, library):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH, 1024, 2).collect()
    used, least = check(rows, corpus, library, 1024, 2)
    assert used <= least * 1.05 + 2


def test_odd_rows(documents, odd_rows, library):
    rows = packing.pack(documents(odd_rows), PATH, 64, 2).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == len(rows)
    assert packing.pack(documents([]), PATH, 64, 2).collect() == []


def test_two_pieces_replace_the_smallest():
    plan = packing.fillings({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ((6, 2, 2), 1)  # greedy takes 6 and 3; two 2s fill the gap of 4 better than 3 does


def test_plan_repeats_and_uses_everything():
    counts = {1024: 5, 700: 900, 324: 400, 200: 1000, 100: 3, 1: 7}
    plan = packing.fillings(counts, 1024)
    used = defaultdict(int)
    for fill, times in plan:
        assert sum(fill) <= 1024
        for n in fill:
            used[n] += times
    assert used == counts and len(plan) < 40
