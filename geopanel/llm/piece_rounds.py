"""SentencePiece (BPE with byte fallback) by rounds of merges over flat arrays.

No piece holds a blank after another character, nor a line break beside one, so a text falls into words that are encoded on their
own: blanks and what follows them up to the next blank or line break. Words recur, so each worker keeps what it met, and the
new words of many texts are encoded together. Their symbols lie in one flat array. A round takes each word's least pair rank
(a segmented minimum), merges all its pairs of that rank at once, leftmost first where two overlap, and drops the symbols
merged away; a word without a pair left leaves the arrays.

One merge after the other, the library would do the same unless a merge makes a pair of the same or a lesser rank before the
round's last merge in that word (runs of blanks do: their pieces share one score). Such words, and those of more than ``LONG``
symbols, for which rounds would be many, are finished by a heap, one merge at a time.

Defined results: null text counts as empty and encodes to the end id alone; strings like ``</s>`` inside a text are ordinary
text; rows with null or repeated identifiers are encoded like any other, one result for each input row; an empty table gives an
empty result; further columns, whatever their names, stay behind. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from geopanel.llm.common import once_per_worker, texts

BLANK = "▁"
#: Symbols of a word from which on it is merged by a heap, and symbols of new words that are merged together.
LONG, TOGETHER = 4_000, 2_000_000
#: No pair.
NONE = np.iinfo(np.int64).max
_WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n").findall


class Pieces:
    """Tables of a model file and the words met so far; ``source`` is the file's bytes."""

    def __init__(self, source: bytes, keep_chars: int = 8_000_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=source)
        if sp.normalize("ﬁ  X") != f"{BLANK}ﬁ{BLANK}{BLANK}X":
            raise ValueError("the model changes texts before it cuts them, or adds no blank")
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(map(sp.is_unused, plain)):
            raise ValueError("unused pieces are not supported")
        self.bytes_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_id) != 256:
            raise ValueError("the model has no byte fallback")
        self.n, self.end_id = n, sp.eos_id()
        by_name = {names[i]: i for i in plain}
        if any(BLANK in name.lstrip(BLANK) or ("\n" in name and len(name) > 1) for name in by_name):
            raise ValueError("a piece holds a blank after another character, or a line break beside one")
        self.char = np.full(0x110000, -1, np.int32)
        for name, i in by_name.items():
            if len(name) == 1:
                self.char[ord(name)] = i
        #: What each id stands for, in bytes; control ids stand for nothing.
        self.body = [b""] * n
        for name, i in by_name.items():
            self.body[i] = name.replace(BLANK, " ").encode()
        for b, i in self.bytes_id.items():
            self.body[i] = bytes([b])
        self.decimal = list(map(str, range(n)))
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = sorted({(by_name[a] * n + by_name[b], i) for name, i in by_name.items() for k in range(1, len(name)) if (a := name[:k]) in by_name and (b := name[k:]) in by_name})
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.rank = rank[self.merged].astype(np.int64)
        #: Words met lately and before, with what is remembered of them.
        self.known, self.older, self.chars, self.keep_chars = {}, {}, 0, keep_chars

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; rank ``NONE`` where no piece is made of the two."""
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), self.pair.size - 1)
        found = self.pair[at] == key
        return np.where(found, self.rank[at], NONE), self.merged[at]

    def by_heap(self, symbols: np.ndarray) -> np.ndarray:
        """One merge at a time: least rank first, then leftmost."""
        ids, n = symbols.tolist(), symbols.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.look_up(symbols[:-1], symbols[1:])
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(r, i, a, b, m) for i, (r, m, a, b) in enumerate(zip(rank.tolist(), merged.tolist(), ids, ids[1:])) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if i < 0 or j >= n:
                return
            key = ids[i], ids[j]
            if key not in seen:
                r, m = self.look_up(np.array(key[:1]), np.array(key[1:]))
                seen[key] = int(r[0]), int(m[0])
            if seen[key][0] != NONE:
                heapq.heappush(heap, (seen[key][0], i, *key, seen[key][1]))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = m, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x in ids if x is not None], np.int64)

    def by_rounds(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after all merges, and how many each has; ``size`` has each word's number of symbols, none of them 0."""
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.repeat(np.arange(size.size), size)
        rank, merged = self._pairs(symbols, word)
        while symbols.size:
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            count = np.diff(np.r_[start, symbols.size])
            if (done := least == NONE).any():
                rest = np.repeat(~done, count)
                ended.append((word[~rest], symbols[~rest]))
                symbols, word, rank, merged = symbols[rest], word[rest], rank[rest], merged[rest]
                least, count = least[~done], count[~done]
                if not symbols.size:
                    break
            here = np.repeat(least, count)
            place = np.flatnonzero(rank == here)
            run = np.flatnonzero(np.r_[True, place[1:] != place[:-1] + 1])  # of pairs that overlap every second one is merged
            nth = np.arange(place.size) - np.repeat(run, np.diff(np.r_[run, place.size]))
            place = place[nth % 2 == 0]
            gone = np.zeros(symbols.size, bool)
            gone[place + 1] = True
            next_symbols = symbols.copy()
            next_symbols[place] = merged[place]
            kept = np.flatnonzero(~gone)
            at = np.searchsorted(kept, place)
            new, new_word = next_symbols[kept], word[kept]
            new_rank, new_merged = rank[kept], merged[kept]
            touched = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            new_rank[touched], new_merged[touched] = self._pairs(new, new_word, touched)
            early = new_rank[touched] <= here[kept[touched]]
            suspects = new_word[touched[early]]
            beside = place[:-1][(place[1:] == place[:-1] + 2) & (word[place[1:]] == word[place[:-1]])]
            if beside.size:  # what the library sees between two merges that touch
                between, _ = self.look_up(merged[beside], symbols[beside + 2])
                suspects = np.r_[suspects, word[beside[between <= here[beside]]]]
            if suspects.size:
                several = np.unique(word[place], return_counts=True)
                suspects = np.intersect1d(suspects, several[0][several[1] > 1])
                for w in suspects:
                    a, b = np.searchsorted(word, [w, w + 1])
                    found = self.by_heap(symbols[a:b])
                    ended.append((np.full(found.size, w), found))
                rest = ~np.isin(new_word, suspects)
                new, new_word, new_rank, new_merged = new[rest], new_word[rest], new_rank[rest], new_merged[rest]
            symbols, word, rank, merged = new, new_word, new_rank, new_merged
        word, symbols = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=size.size)

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of the pairs that begin at ``at`` (everywhere by default)."""
        at = np.arange(symbols.size) if at is None else at
        other = np.minimum(at + 1, symbols.size - 1)
        rank, merged = self.look_up(symbols[at], symbols[other])
        return np.where((other > at) & (word[at] == word[other]), rank, NONE), merged

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that are not known yet."""
        out: list[list[int]] = [[]] * len(words)
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        for i in long:
            symbols = self.by_heap(self._symbols([words[i]]))
            out[i] = self._spelled(symbols.tolist())
        for part in self._parts(words):
            several = [words[i] for i in part]
            symbols, count = self.by_rounds(self._symbols(several), np.array([len(w) for w in several], np.int64))
            bare, end = symbols.min() >= 0, np.cumsum(count)
            flat = symbols.tolist()
            for i, a, b in zip(part, (end - count).tolist(), end.tolist()):
                out[i] = flat[a:b] if bare else self._spelled(flat[a:b])
        return out

    def _symbols(self, words: list[str]) -> np.ndarray:
        """The id of each character; one without an id of its own is -1 less its code point, and part of no pair."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.char[code].astype(np.int64)
        return np.where(symbols < 0, -1 - code, symbols)

    @staticmethod
    def _parts(words: list[str]):
        """Places of the words that are merged in rounds, so many at a time."""
        part, size = [], 0
        for i, w in enumerate(words):
            if len(w) <= LONG:
                part.append(i)
                size += len(w)
            if size >= TOGETHER:
                yield part
                part, size = [], 0
        if part:
            yield part

    def _spelled(self, symbols: list[int]) -> list[int]:
        """Characters without an id in bytes."""
        if min(symbols) >= 0:
            return symbols
        return list(itertools.chain.from_iterable([(s,) if s >= 0 else [self.bytes_id[b] for b in chr(-1 - s).encode()] for s in symbols]))

    def words(self, text: str) -> list[str]:
        """The words of a text that is not empty, blanks written as the model writes them."""
        if text[0] == " " or "  " in text or BLANK in text:
            return _WORDS(BLANK + text.replace(" ", BLANK))
        return (BLANK + text.replace(" ", " " + BLANK).replace("\n", " \n")).split(" ")

    def learn(self, words: set[str]) -> None:
        """Have all ``words`` at hand. Of two shares the older is dropped when the newer is full, so that frequent words stay."""
        if self.chars > self.keep_chars:
            self.known, self.older, self.chars = {}, self.known, 0
        known, older, new = self.known, self.older, []
        for w in words.difference(known):
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
            self.chars += len(w) + 20
        for w, ids in zip(new, self.encode_words(new)):
            known[w] = self.entry(w, ids)

    def entry(self, word: str, ids: list[int]):
        """What is remembered of a word."""
        return ids


class Codec(Pieces):
    """Encodes and decodes texts; of a word its ids in decimals and what they decode to are remembered."""

    def entry(self, word, ids):
        return " ".join([self.decimal[i] for i in ids]), b"".join([self.body[i] for i in ids])

    def run(self, several: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids (the end id last) in decimals between blanks, and the text that they decode to."""
        out = []
        cut = [self.words(text) if text else [] for text in several]
        self.learn(set().union(*cut))
        for words in cut:
            got = [self.known[w] for w in words]
            ids = " ".join([g[0] for g in got])
            # The blank before the text goes.
            out.append((f"{ids} {self.end_id}" if ids else self.decimal[self.end_id], b"".join([g[1] for g in got])[1:]))
        return out


def codec(source: bytes) -> Codec:
    return once_per_worker(Codec, source)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Ids and decoded text of every row: their digests, and with ``keep`` also themselves (``ids``, ``decoded``)."""
    with open(path, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep]

    def run(batches):
        c = codec(source.value)
        for b in batches:
            rows = []
            for slice_ in range(0, b.num_rows, 256):
                for ids, text in c.run(b.column("text").slice(slice_, 256).to_pylist()):
                    row = ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()
                    rows.append((*row, list(map(int, ids.split())), text.decode()) if keep else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols = list(zip(*rows)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c_, k) for c_, k in zip(cols, kinds))], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return texts(docs, id_col, text_col).mapInArrow(run, schema)
