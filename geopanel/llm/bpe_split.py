"""Byte-pair encoding with forced boundaries.

A merge only ever builds a token of the vocabulary, so two neighbouring symbols that stand together inside no token are never
merged: the text can be cut between them. Cutting at all such places leaves short fragments that are encoded on their own and
joined again. Fragments recur far more often than words, so each worker keeps the ids of those it has met.

Defined results: null text counts as empty and encodes to no ids; the special tokens' strings become their ids; rows with null
or repeated identifiers are encoded like any other, one result for each input row; an empty table gives an empty result. Texts
of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from geopanel.llm.common import Memo, once_per_worker, texts

#: Characters that the short way below splits as the library does; words with others ask the library's own steps.
_PLAIN = regex.compile("[!-~¡-ɏ]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder for a BPE file with word ends; ``source`` is the file's text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) for m in model["merges"]]
        self.inner, self.last = BPE(model["vocab"], merges), BPE(model["vocab"], merges, end_of_word_suffix=self.end)
        self.by_id = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id |= {i: t for t, i in self.special.items()}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_str(source)
        self.symbols = "".join(byte_symbols())
        #: Neighbouring byte symbols that stand together inside some token, the second one marked by a blank if it ends a word.
        self.inside = {pair for token in model["vocab"] for pair in self._pairs(token)}
        self.fragments, self.pieces, self.words = Memo(self._encode_fragment), Memo(self._encode_piece), Memo(self._encode_word, 500_000)

    def _pairs(self, token: str):
        closed = token.endswith(self.end) and token != self.end
        body = token[: -len(self.end)] if closed else token
        pairs = [body[i : i + 2] for i in range(len(body) - 1)]
        if closed and pairs:
            pairs[-1] += " "
        return pairs

    def fragments_of(self, piece: str) -> list[str]:
        """A piece (in byte symbols) cut wherever no token holds the neighbouring pair; the last fragment ends with a blank."""
        inside, n = self.inside, len(piece)
        cuts = [i + 1 for i in range(n - 2) if piece[i : i + 2] not in inside]
        if n > 1 and piece[n - 2 :] + " " not in inside:
            cuts.append(n - 1)
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, n])][:-1] + [piece[cuts[-1] if cuts else 0 :] + " "]

    def _encode_fragment(self, fragment: str) -> tuple[int, ...]:
        if fragment[-1] == " ":
            return tuple(t.id for t in self.last.tokenize(fragment[:-1]))
        return tuple(t.id for t in self.inner.tokenize(fragment))

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        found = [self.fragments[f] for f in self.fragments_of(piece)]
        return found[0] if len(found) == 1 else tuple(itertools.chain.from_iterable(found))

    def _pretokens(self, word: str) -> list[str]:
        """Normalised pieces of a stretch without white space, in byte symbols."""
        if word.isascii() and word.isprintable():
            return [word.lower()] if word.isalpha() else _SPLIT.findall(word.lower())
        if _PLAIN.fullmatch(word):
            plain = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
            return [p.encode().decode("latin-1").translate(self.symbols) for p in ([plain] if plain.isalpha() else _SPLIT.findall(plain))]
        normal = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _encode_word(self, word: str) -> tuple[bytes, str]:
        ids: list[int] = []
        for part in self.special_re.split(word) if any(x in word for x in self.special) else [word]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for p in self._pretokens(part):
                    ids += self.pieces[p]
        return array("I", ids).tobytes(), " ".join([self.by_id[i] for i in ids])

    def run(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text: the tokens' strings joined by spaces, as the file
        names no decoder. White space is dropped, so words between it are encoded on their own."""
        got = [self.words[w] for w in _WORDS(text)]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])


_WORDS = regex.compile(r"[^\x20\x09-\x0D]+").findall


def codec(source: str) -> Codec:
    return once_per_worker(Codec, source)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Ids and decoded text of every row: their digests, and with ``keep`` also themselves (``ids``, ``decoded``)."""
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        c = codec(source.value)
        for b in batches:
            got = [c.run(t) for t in b.column("text").to_pylist()]
            cols = [
                pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in got], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return texts(docs, id_col, text_col).mapInArrow(run, schema)
