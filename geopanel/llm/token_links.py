"""Alignment of two tokenizers over the same bytes, and the links between their tokens.

Both tokenizers end a token before a blank or line break that follows another character, so a text is cut there into units.
Units recur: each worker keeps what it found for those it met, and the new units of many texts are aligned together. The
ends of the shorter list gallop into the longer one (steps that double, then halve, all ends in step), which gives each end its
rank there; equal ends cut the tokens into groups, and the ranks at a token's two ends say which tokens of the other side it overlaps.

A batch of texts names its links by places in its own list of distinct pairs. These lists, not the links, are exploded: pairs
are counted over all batches, compared with the highest count of their second id (one row for each id of a vocabulary),
joined back, and returned to their batch, which sums up its documents. A pair is sent once for each batch that holds it.

Defined results: null and empty texts, and those whose tokens do not spell the blank and the text, have no tokens and no links;
rows with null or repeated identifiers are aligned and counted like any other, one result for each input row; an empty table
gives an empty result; further columns, whatever their names, stay behind. Texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geopanel.llm.bpe_split import byte_symbols
from geopanel.llm.common import join_counted, once_per_worker, texts
from geopanel.llm.packing import _COMMON, SPLIT
from geopanel.llm.piece_rounds import BLANK, Pieces
from geopanel.session import materialised

#: Links that close a batch, and distinct pairs and characters of units that a worker keeps.
BATCH_LINKS, KEPT_PAIRS, KEPT_CHARS = 1_500_000, 1_500_000, 6_000_000
_RUN = re.compile(rf"\s[ \n]|{BLANK}")
_CUT = re.compile(rf"(?<=[^\s{BLANK}])(?=[ \n])")


class ByteTokens:
    """Ids of a byte-level BPE file, special tokens' strings being ordinary text; ``source`` is the file's text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        back = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {b"".join(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.body = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.body[i] = raw
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(source)
        self.library.encode_special_tokens = True
        self.short = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, several: list[str]) -> list[list[int]]:
        plain = [bool(_COMMON.fullmatch(t)) for t in several]
        rest = iter(self.library.encode_batch([t for t, p in zip(several, plain) if not p], add_special_tokens=False))
        return [self.short.encode_ordinary(t) if p else next(rest).ids for t, p in zip(several, plain)]


def gallop(ends: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of ``ends`` the first place in ``other`` (ascending from ``start`` to ``stop``) whose value is not less, ``stop`` if none."""
    low, step = start.copy(), np.ones(ends.size, np.int64)
    last = max(other.size - 1, 0)
    on = np.flatnonzero(low < stop)
    while on.size:  # every place before ``low`` has a lesser value
        probe = low[on] + step[on] - 1
        less = (probe < stop[on]) & (other[np.minimum(probe, last)] < ends[on])
        low[on[less]] += step[on[less]]
        step[on[less]] *= 2
        on = on[less]
    high = np.minimum(low + step - 1, stop)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = open_ & (other[np.minimum(middle, last)] < ends)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def ranks(ends_a: np.ndarray, count_a: np.ndarray, ends_b: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in A, places in B) of ends that both sides have, unit by unit; ``count`` has each unit's number of ends."""
    begin_a, begin_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    out = []
    for (ends, count, begin), (other, other_count, other_begin), swapped in (((ends_a, count_a, begin_a), (ends_b, count_b, begin_b), False), ((ends_b, count_b, begin_b), (ends_a, count_a, begin_a), True)):
        driving = count < other_count if swapped else count <= other_count
        unit = np.repeat(np.arange(count.size), count)
        at = np.flatnonzero(driving[unit])
        unit = unit[at]
        found = gallop(ends[at], other_begin[unit], other_begin[unit] + other_count[unit], other)
        both = (found < other_begin[unit] + other_count[unit]) & (other[np.minimum(found, max(other.size - 1, 0))] == ends[at])
        out.append((found[both], at[both]) if swapped else (at[both], found[both]))
    a, b = np.concatenate([out[0][0], out[1][0]]), np.concatenate([out[0][1], out[1][1]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def overlaps(ends_a: np.ndarray, count_a: np.ndarray, ends_b: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) place in B whose bytes each token of A shares, by the ranks of its two ends."""
    unit = np.repeat(np.arange(count_a.size), count_a)
    begin = (np.cumsum(count_b) - count_b)[unit]
    last = gallop(ends_a, begin, begin + count_b[unit], ends_b)
    first = np.r_[0, last[:-1] + (ends_b[last[:-1]] == ends_a[:-1])] if ends_a.size else last
    return np.where(np.r_[True, unit[1:] != unit[:-1]] if unit.size else unit, begin, first), last


class Aligner:
    """Units met so far and the pairs of ids in their links; ``source`` is (byte-level file's text, model file's bytes, kind of link)."""

    def __init__(self, source: tuple[str, bytes, str]):
        self.a, self.b, self.kind = ByteTokens(source[0]), Pieces(source[1]), source[2]
        self.size_a, self.size_b = (np.array([len(x) for x in t.body], np.int64) for t in (self.a, self.b))
        self.text_a, self.text_b = list(map(str, range(len(self.a.body)))), self.b.decimal
        self.n_b = self.b.n
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.chars = 0
        self.pair_at: dict[int, int] = {}

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a blank and a text. Where a unit is a blank and further characters, the blank may be written as ``BLANK``."""
        if _RUN.search(" " + text):
            return _CUT.split(" " + text)
        return (BLANK + text.replace(" ", " " + BLANK).replace("\n", " \n")).split(" ")

    def learn(self, units: set[str]) -> None:
        if self.chars > KEPT_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        new = []
        for u in units.difference(self.known):
            if u in self.older:
                self.known[u] = self.older[u]
            else:
                new.append(u)
            self.chars += len(u) + 20
        size, part = 0, []
        for u in new:
            part.append(u)
            size += len(u)
            if size > 1_000_000:
                self._align(part)
                size, part = 0, []
        if part:
            self._align(part)

    def _align(self, units: list[str]) -> None:
        raws = [" " + u[1:] if u[0] == BLANK else u for u in units]
        ids_a, ids_b = self.a.encode(raws), self.b.encode_words([r.replace(" ", BLANK) for r in raws])
        body_a, body_b = self.a.body, self.b.body
        good = []
        for u, raw, x, y in zip(units, map(str.encode, raws), ids_a, ids_b):
            if b"".join([body_a[i] for i in x]) == raw == b"".join([body_b[i] for i in y]):
                good.append((u, x, y))
            else:
                self.known[u] = None
        if not good:
            return
        count_a, count_b = np.array([len(x) for _, x, _ in good], np.int64), np.array([len(y) for _, _, y in good], np.int64)
        flat_a, flat_b = np.array([i for _, x, _ in good for i in x], np.int64), np.array([i for _, _, y in good for i in y], np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        at_a, at_b = ranks(ends_a, count_a, ends_b, count_b)
        first_group = np.searchsorted(at_a, np.cumsum(count_a) - count_a)
        groups = np.diff(np.r_[first_group, at_a.size])
        if self.kind == "ends":
            left, right, links = at_a, at_b, groups
        else:
            first, last = overlaps(ends_a, count_a, ends_b, count_b)
            each = last - first + 1
            left = np.repeat(np.arange(flat_a.size), each)
            right = np.repeat(first, each) + np.arange(left.size) - np.repeat(np.cumsum(each) - each, each)
            links = np.add.reduceat(each, np.cumsum(count_a) - count_a)
        pairs, inverse = np.unique(flat_a[left] * self.n_b + flat_b[right], return_inverse=True)
        place = np.array([self.pair_at.setdefault(p, len(self.pair_at)) for p in pairs.tolist()], np.int32)[inverse]
        link_end = np.cumsum(links)
        cut_a, cut_b = (at_a + 1).tolist(), (at_b + 1).tolist()
        text_a, text_b, base_a, base_b, g = self.text_a, self.text_b, 0, 0, 0
        for (u, x, y), n_groups, to, n in zip(good, groups.tolist(), link_end.tolist(), links.tolist()):
            parts, i, j = [], 0, 0
            for g in range(g, g + n_groups):
                k, m = cut_a[g] - base_a, cut_b[g] - base_b
                parts.append((text_a[x[i]] if k == i + 1 else ",".join([text_a[t] for t in x[i:k]])) + "|" + (text_b[y[j]] if m == j + 1 else ",".join([text_b[t] for t in y[j:m]])))
                i, j = k, m
            g += 1
            base_a, base_b = base_a + len(x), base_b + len(y)
            self.known[u] = len(x), len(y), n_groups, ";".join(parts), place[to - n : to].tobytes()

    def run(self, several: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, places of the pairs of its links as 32-bit integers) of each text."""
        cut = [self.units(t) if t else [] for t in several]
        self.learn(set().union(*cut))
        out = []
        for units in cut:
            found = [self.known[u] for u in units]
            if not found or None in found:
                out.append((0, 0, 0, "", b""))
            else:
                n_a, n_b, n_groups, groups, links = zip(*found)
                out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
        return out


def aligner(source: tuple[str, bytes, str]) -> Aligner:
    return once_per_worker(Aligner, source)


_ROW = "batch long, doc_id long, n_a long, n_b long, n_groups long, groups string, links binary, pairs array<long>, totals array<long>"


def batches(docs: DataFrame, path_a: str, path_b: str, kind: str, batch_links: int, keep: bool) -> DataFrame:
    """One row for each document, its links as places in its batch's pairs, and one row for each batch: its pairs and their counts."""
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        source = docs.sparkSession.sparkContext.broadcast((f.read(), g.read(), kind))
    schema = pa.schema([("batch", pa.int64()), *((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups")), ("groups", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])

    def run(stream):
        c, task, number = aligner(source.value), TaskContext.get().partitionId(), 0
        rows, n = [], 0

        def closed():
            flat = np.frombuffer(b"".join([r[5] for r in rows]), np.int32)
            total = np.bincount(flat, minlength=len(c.pair_at))
            used = np.flatnonzero(total)
            local = np.zeros(total.size, np.int32)
            local[used] = np.arange(used.size)
            pair = np.fromiter(c.pair_at, np.int64, len(c.pair_at))[used]
            batch, flat, at = (task << 32) + number, local[flat], 0
            for doc, n_a, n_b, n_groups, groups, links in rows:
                k = len(links) // 4
                yield batch, doc, n_a, n_b, n_groups, groups, flat[at : at + k].tobytes(), None, None
                at += k
            yield batch, None, None, None, None, None, None, pair, total[used]
            if len(c.pair_at) > KEPT_PAIRS:
                c.forget()

        def record():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*closed()), schema)], schema=schema)

        for b in stream:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                for doc, (n_a, n_b, n_groups, groups, links) in zip(part.column("doc_id").to_pylist(), c.run(part.column("text").to_pylist())):
                    said = groups if keep else hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    rows.append((doc, n_a, n_b, n_groups, said, links))
                    n += len(links) // 4 + 16
                if n >= batch_links:
                    yield record()
                    rows, n, number = [], 0, number + 1
        if rows:
            yield record()

    return docs.mapInArrow(run, _ROW)


def priced(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best, n) of every pair: its links, whether no other partner of its second id has more, and how many batches hold it."""
    held = rows.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "totals")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.totals").alias("total"))
    counts = materialised(held.groupBy("pair").agg(F.sum("total").alias("count"), F.count(F.lit(1)).alias("n")).withColumn("second", F.col("pair") % n_b))
    highest = counts.groupBy("second").agg(F.max("count").alias("highest"))  # one row for each id of the second vocabulary at most
    return counts.join(F.broadcast(highest), "second").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"), "n")


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "ends", keep: bool = False, batch_links: int = BATCH_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row (with ``keep`` the groups themselves, as ``groups``).
    ``kind`` of link: tokens that end together (``ends``), or that share a byte (``overlap``)."""
    if kind not in ("ends", "overlap"):
        raise ValueError(f"unknown kind of link: {kind}")
    with open(path_b, "rb") as f:
        n_b = Pieces(f.read()).n
    rows = materialised(batches(texts(docs, id_col, text_col), path_a, path_b, kind, batch_links, keep))
    prices = materialised(priced(rows, n_b))
    asked = rows.where("pairs IS NOT NULL").select("batch", F.posexplode("pairs").alias("at", "pair"))
    total = prices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answers = join_counted(asked, prices, "pair", total).select(F.col("batch").alias("of"), "at", "count", "best")
    named = "groups" if keep else "groups_sha256"
    counted = ["n_a", "n_b", "n_groups"]

    def run(left, right):
        at = right.column("at").to_numpy()
        count, best = np.zeros(at.size, np.int64), np.zeros(at.size, np.int64)
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        found = []
        for links in left.column("links").to_pylist():
            k = np.frombuffer(links, np.int32)
            found.append((k.size, int(best[k].sum()), int(count[k].sum())))
        cols = [pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * 3
        return pa.table({"doc_id": left.column("doc_id"), **{c: left.column(c) for c in counted}, **dict(zip(("n_links", "n_best", "count_sum"), cols)), named: left.column("groups")})

    own = rows.where("pairs IS NULL").select("batch", "doc_id", *counted, "groups", "links")
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {named} string"
    return own.groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
