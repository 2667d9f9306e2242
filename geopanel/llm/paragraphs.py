"""Repeated passages by MinHash banding of paragraphs.

Passages start anywhere in a text, so paragraphs are cut by content: a word begins one if the hash of it and its two
successors is the least within ``radius`` words on either side. A passage of fifty words or more therefore holds whole
paragraphs wherever it stands. Equal paragraphs are one node. The others collide in bands of MinHash values over five-word
shingles; with one row a band, the three
bands find a pair at similarity 0.8 with probability 1 - 0.2**3, over 0.99. Collisions
are verified by the exact Jaccard similarity of the shingle sets, and links are clustered by connected components. Each cluster keeps its first occurrence
(least document, then place); the others are removed where they form a run of at least ``run_words`` words.

A linked paragraph is also an anchor: its text and the one of its first occurrence are compared word by word on both sides,
over changed, missing and added words, and the longest stretch around it with a shingle similarity of 0.8 or more is a run
too. Of two passages of more than fifty words with that similarity, unchanged words stand together for 25 words or more, so a
passage with a changed word is taken whole although the paragraphs at the change and at its ends are not linked. Slices of
the texts are compared, not whole ones; a stretch that goes on beyond its slices has anchors of its own there.

A band's collisions are taken from one sorted stream. Within a band value the sets are compared through an index over
their rarest shingles, so a frequent shingle alone makes no pairs; pairs that already lie in one cluster are left out.

Defined results: null text counts as empty and has no paragraphs; rows with a null identifier take no part; rows with one
identifier count as one document, so repeated rows do not repeat each other; an empty table gives an empty result. Texts are
read whole.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.llm.common import SMALL, SPACE, fresh, join_counted, once_per_worker, texts
from geopanel.llm.components import components
from geopanel.session import let_go, materialised, scratch_path


@dataclasses.dataclass(frozen=True)
class Settings:
    radius: int = 5
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 3
    run_words: int = 20
    #: Words of a grid cell by which texts are sliced, words around it, and the longest change that a stretch goes over.
    cell: int = 256
    around: int = 128
    change: int = 4


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    out = np.zeros(max(0, h.size - width + 1), np.uint64)
    for k in range(width):
        out = out * _MIX + h[k : k + out.size]
    return _mixed(out)


_BLANK = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACE, np.uint8))
#: Masks of the first bytes of eight, and the longest word whose key is made of eight bytes at a time with those of all others.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_LONG = 64


def _slots(_):
    return np.zeros(2**20, np.uint64), np.zeros(2**20, np.uint64)


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, byte after it) of each word of several texts; bytes are counted from the text's beginning."""
    joined = b" ".join(raws) + b" " * 9
    data = np.frombuffer(joined, np.uint8)
    blank = _BLANK[data]
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(blank & ~np.r_[True, blank[:-1]])
    size = end - begin
    eight = np.ndarray((data.size - 7,), "<u8", joined, strides=(1,))
    key = _mixed(size.astype(np.uint64) + _MIX)
    at = np.flatnonzero(size <= _LONG)
    for k in range(0, _LONG, 8):
        at = at[size[at] > k]
        if not at.size:
            break
        key[at] = _mixed((key[at] ^ (eight[begin[at] + k] & _FIRST[np.minimum(size[at] - k, 8)])) * _MIX + np.uint64(k + 1))
    for i in np.flatnonzero(size > _LONG).tolist():
        key[i] = xxhash.xxh3_64_intdigest(joined[begin[i] : end[i]])
    # A worker keeps the hashes of words in a table of fixed size by their keys; a word that is not in its place is hashed anew.
    keys, values = once_per_worker(_slots, None)
    slot = key >> np.uint64(44)
    h, new = values[slot], np.flatnonzero(keys[slot] != key)
    if new.size:
        key, first, back = np.unique(key[new], return_index=True, return_inverse=True)
        at = new[first]
        made = np.array([xxhash.xxh3_64_intdigest(joined[i:j]) for i, j in zip(begin[at].tolist(), end[at].tolist())], np.uint64)
        h[new] = made[back]
        slot, first = np.unique(key >> np.uint64(44), return_index=True)
        keys[slot], values[slot] = key[first], made[first]
    lengths = np.array([len(r) + 1 for r in raws], np.int64)
    base = np.cumsum(lengths) - lengths
    doc = np.searchsorted(base, begin, "right") - 1
    return h, doc, begin - base[doc], end - base[doc]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return words_of([b" ".join(words)])[0]


def cuts(h: np.ndarray, doc: np.ndarray, radius: int) -> np.ndarray:
    """First words of the paragraphs of several texts: each text's first word, and all places whose three-word hash is the
    least around (the first of equal ones). ``doc`` numbers each word's text."""
    if h.size == 0:
        return np.zeros(0, np.int64)
    a = np.full(h.size, np.iinfo(np.uint64).max, np.uint64)
    a[: max(0, h.size - 2)] = _windows(h, 3)
    inside = np.zeros(h.size, bool)
    inside[: max(0, h.size - 2)] = doc[2:] == doc[:-2]
    a[~inside] = np.iinfo(np.uint64).max
    least = inside
    for k in range(1, min(radius, h.size - 1) + 1):
        other = doc[k:] != doc[:-k]
        least[k:] &= (a[k:] < a[:-k]) | other
        least[:-k] &= (a[:-k] <= a[k:]) | other
    least[np.r_[True, doc[1:] != doc[:-1]]] = True
    return np.flatnonzero(least)


def shingle_sets(h: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order of their paragraphs, where each paragraph's begin); a paragraph of fewer words is one shingle."""
    size = np.diff(np.r_[start, h.size])
    owner = np.repeat(np.arange(start.size), size)
    n = max(0, h.size - width + 1)
    inner = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n else np.zeros(0, np.int64)
    keys, owners = [_windows(h, width)[inner]], [owner[inner]]
    for m in range(1, width):
        short = np.flatnonzero(size == m)
        keys.append(_windows(h, m)[start[short]])
        owners.append(short)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order], np.searchsorted(owner[order], np.arange(start.size))


def paragraph_rows(raws: list[bytes], s: Settings, sets: bool = False, spans: bool = False, bands: bool = False) -> dict[str, np.ndarray]:
    """Paragraphs of several texts: text number, number there, words and content hash; byte spans, band values, or shingles
    (with where each paragraph's begin) where asked for."""
    h, doc, begin, end = words_of(raws)
    counts = np.bincount(doc, minlength=len(raws))
    start = cuts(h, doc, s.radius)
    size = np.diff(np.r_[start, h.size])
    at = doc[start]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if at.size else at
    place = np.arange(h.size) - np.repeat(start, size)
    out = {"at": at, "no": np.arange(at.size) - np.repeat(first, np.diff(np.r_[first, at.size])), "words": size}
    out["word"] = start - (np.cumsum(counts) - counts)[at]
    out["h"] = np.add.reduceat(_mixed(h + _mixed(place.astype(np.uint64) + _MIX)), start) if start.size else h
    if spans:
        out["begin"], out["end"] = begin[start], end[start + size - 1]
    if sets or bands:
        key, edge = shingle_sets(h, start, s.shingle)
        if sets:
            out["sets"], out["edges"] = key, np.r_[edge, key.size]
        if bands:
            out["bands"] = [np.minimum.reduceat(_mixed(key ^ _seed(b)), edge) if start.size else key for b in range(s.bands)]
    return out


def _seed(b: int) -> np.uint64:
    return _mixed(np.array([b + 1], np.uint64) * _MIX)[0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _arrow(docs: DataFrame, s: Settings, names: dict[str, str], **want) -> DataFrame:
    """One row for each paragraph with the named columns."""

    def run(batches):
        for b in batches:
            raws, ids = b.column("text").cast(pa.binary()).to_pylist(), b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo in range(0, len(raws), 500):
                got = paragraph_rows(raws[lo : lo + 500], s, **want)
                cols = {"doc_id": pa.array(ids[lo + got["at"]], pa.int64()), "h": _signed(got["h"])}
                cols |= {k: pa.array(got[k], pa.int32()) for k in ("no", "words", "word", "begin", "end") if k in got}
                cols |= {f"b{i}": _signed(v) for i, v in enumerate(got.get("bands", ()))}
                if want.get("sets"):
                    cols["sets"] = pa.ListArray.from_arrays(pa.array(got["edges"], pa.int32()), _signed(got["sets"]))
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], list(names))

    return docs.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in names.items()))


def _lists(x: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of lists as arrays, without a Python object for each number."""
    edge, flat = x.offsets.to_pylist(), x.values.to_numpy(zero_copy_only=False)
    return [flat[lo:hi] for lo, hi in zip(edge[:-1], edge[1:])]


def _mixed_groups(rows: DataFrame) -> DataFrame:
    """Rows of band values that several paragraphs share, and all rows of bands below zero, from a stream sorted by value alone: a single
    number is sorted without comparing rows. Where bands have a value in common, rows that are alone in theirs may stay."""
    def run(batches):
        held: list[pa.RecordBatch] = []

        def kept(table: pa.Table) -> pa.Table:
            band, value = table.column("band").to_numpy(), table.column("value").to_numpy()
            same = value[1:] == value[:-1]
            return table.filter(pa.array((band < 0) | np.r_[False, same] | np.r_[same, False]))

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 20_000:
                table = pa.Table.from_batches(held)
                value = table.column("value").to_numpy()
                other = np.flatnonzero(value != value[-1])
                cut = int(other[-1]) + 1 if other.size else 0
                if cut:  # the last value stays open
                    yield from kept(table.slice(0, cut)).to_batches()
                    held = table.slice(cut).to_batches()
                else:  # one very frequent value: two rows are enough to know that it is shared
                    yield from table.slice(2).to_batches()
                    held = table.slice(0, 2).to_batches()
        if held:
            yield from kept(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("value").sortWithinPartitions("value").mapInArrow(run, rows.schema)


def similar_pairs(sets: list[frozenset], similarity: float) -> list[tuple[int, int]]:
    """A tree of links over the pairs with at least this Jaccard similarity. Sets are compared only if they share one of
    their rarest shingles: of n shingles, the n - ceil(similarity * n) + 1 rarest cannot all be missing in a similar set."""
    if len(sets) == 2:  # as most band values have it
        x, y = sets
        both = len(x & y)
        return [(1, 0)] if both and both >= similarity * (len(x) + len(y) - both) else []
    count: dict[int, int] = {}
    for x in sets:
        for k in x:
            count[k] = count.get(k, 0) + 1
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index: dict[int, list[int]] = {}
    links = []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        x = sets[i]
        rare = sorted(x, key=lambda k: (count[k], k))[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]
        for j in {j for k in rare for j in index.get(k, ())}:
            y = sets[j]
            if len(y) >= similarity * len(x) and find(i) != find(j):
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both):
                    root[find(i)] = find(j)
                    links.append((i, j))
        for k in rare:
            index.setdefault(k, []).append(i)
    return links


def verified(rows: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links between the paragraphs of each band value whose sets are similar."""

    def run(batches):
        group, h, sets = None, [], []

        def links():
            got = similar_pairs(sets, s.similarity)
            return pa.RecordBatch.from_arrays([pa.array([h[i] for i, _ in got], pa.int64()), pa.array([h[j] for _, j in got], pa.int64())], ["a", "b"])

        for b in batches:
            for key, value, one, items in zip(b.column("band").to_pylist(), b.column("value").to_pylist(), b.column("h").to_pylist(), _lists(b.column("sets"))):
                if (key, value) != group:
                    if len(h) > 1:
                        yield links()
                    group, h, sets = (key, value), [], []
                h.append(one)
                sets.append(frozenset(items.tolist()))
        if len(h) > 1:
            yield links()

    return rows.select("band", "value", "h", "sets").repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(run, "a long, b long")


def _dealt_again(rows: DataFrame, s: Settings, most: int, depth: int = 3) -> DataFrame:
    """Band values with more than ``most`` paragraphs are dealt by further MinHash values of the sets, so that a shingle which
    very many paragraphs share does not bring them all into one task."""
    parts = []
    for d in range(depth):
        large = materialised(rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("band", "value"))
        if large.isEmpty():
            break
        parts.append(rows.join(large, ["band", "value"], "left_anti"))
        least = lambda seed: F.array_min(F.transform("sets", lambda x: F.xxhash64(x, F.lit(seed))))
        seeds = [least(1000 * (d + 1) + k) for k in range(s.bands + 1)]
        deal = F.array(*[F.struct(F.lit(k).alias("k"), m.alias("m")) for k, m in enumerate(seeds)])
        rows = rows.join(large, ["band", "value"], "left_semi").withColumn("deal", F.explode(deal))
        rows = rows.select("band", F.xxhash64("value", "deal.k", "deal.m").alias("value"), "h", "sets")
    for p in parts:
        rows = rows.unionAll(p)
    return rows


def _joined(left: DataFrame, right: DataFrame, on: str, how: str, rows: int) -> DataFrame:
    """Join that sends ``right`` to all tasks where its counted rows are few, and shuffles both sides otherwise."""
    return left.join(F.broadcast(right) if rows <= SMALL else right, on, how)


def slices(plain: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """doc_id, cell, w0 (first word), b0 (its byte), p0 (its paragraph), starts (first words of the later paragraphs, counted
    from w0) and raw of the wanted (doc_id, cell): two cells from the named one on and ``around`` words on both sides."""
    each = materialised(wanted.groupBy("doc_id").agg(F.collect_set("cell").alias("cells")))

    def run(batches):
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                raws = some.column("text").cast(pa.binary()).to_pylist()
                h, doc, begin, end = words_of(raws)
                starts = cuts(h, doc, s.radius)
                edge, first = (np.searchsorted(x, np.arange(len(raws) + 1)).tolist() for x in (doc, doc[starts]))
                for i, (doc_id, raw, cells) in enumerate(zip(some.column("doc_id").to_pylist(), raws, some.column("cells").to_pylist())):
                    base, size, start = edge[i], edge[i + 1] - edge[i], starts[first[i] : first[i + 1]] - edge[i]
                    for cell in cells:
                        lo, hi = max(0, cell * s.cell - s.around), min(size, (cell + 2) * s.cell + s.around)
                        if lo < hi:
                            p = int(np.searchsorted(start, lo, "right"))
                            later = start[p : int(np.searchsorted(start, hi))] - lo
                            rows.append((doc_id, cell, lo, int(begin[base + lo]), p - 1, later.tolist(), raw[begin[base + lo] : end[base + hi - 1]]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "cell", "w0", "b0", "p0", "starts", "raw"])

    wanted_ids = each.count()
    rows = _joined(plain, each, "doc_id", "inner", wanted_ids).select("doc_id", "text", "cells")
    cut = rows.mapInArrow(run, "doc_id long, cell long, w0 int, b0 int, p0 int, starts array<int>, raw binary")
    # Only rows that repeat give slices that repeat; where there are none, the slices need no shuffle.
    once = _joined(plain.select("doc_id"), each.select("doc_id"), "doc_id", "left_semi", wanted_ids).count() == wanted_ids
    path = scratch_path(plain.sparkSession, "slices")
    (cut if once else cut.distinct()).write.option("compression", "zstd").parquet(path)
    return plain.sparkSession.read.parquet(path)


@functools.lru_cache(maxsize=4)
def _steps(change: int) -> np.ndarray:
    """Rank of each change of x words against y, small ones first; no change at all comes last."""
    order = sorted(((x, y) for x in range(change + 1) for y in range(change + 1)), key=lambda t: (t == (0, 0), max(t), sum(t)))
    rank = np.zeros((change + 1, change + 1), np.int64)
    for k, step in enumerate(order):
        rank[step] = k
    return rank


def _onward(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, i: int, j: int, s: Settings) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the equal stretches from (i, j) on, changes of a few words between them. ``wa`` and
    ``wb`` are the hashes of their shingles."""
    rank = _steps(s.change)
    out = []
    while True:
        n = min(a.size - i, b.size - j)
        other = (a[i : i + n] != b[j : j + n]).argmax() if n else 0
        n = int(other) if n and a[i + other] != b[j + other] else n
        if n:
            out.append((i, j, n))
        i, j = i + n, j + n
        x, y = (wa[i : i + s.change + 1, None] == wb[None, j : j + s.change + 1]).nonzero()
        if not x.size:
            return out
        k = int(rank[x, y].argmin())
        if not x[k] and not y[k]:
            return out
        i, j = i + int(x[k]), j + int(y[k])


def stretch(a: np.ndarray, b: np.ndarray, i: int, j: int, size: int, s: Settings, wa: np.ndarray | None = None, wb: np.ndarray | None = None) -> tuple[int, int, int, int] | None:
    """(begin, end) in both texts of the longest stretch around an anchor of ``size`` words at (i, j) whose shingle similarity
    is high enough; None if the anchor's places have no shingle in common. ``wa`` and ``wb`` are the hashes of their shingles."""
    if a is b and i == j >= 0 and min(size, a.size - i) >= s.shingle:
        return 0, a.size, 0, a.size
    wa, wb = _windows(a, s.shingle) if wa is None else wa, _windows(b, s.shingle) if wb is None else wb
    for d in sorted(range(-s.shingle, s.shingle + 1), key=abs):
        x, y = max(i, d - j, 0), max(i, d - j, 0) - i + j + d
        if y < 0:
            x, y = x - y, 0
        n = min(size, a.size - x, b.size - y)
        if n < s.shingle:
            continue
        run = wa[x : x + n - s.shingle + 1] == wb[y : y + n - s.shingle + 1]
        k = int(run.argmax())
        if run[k]:
            x, y = x + k, y + k
            break
    else:
        return None
    after = _onward(a, b, wa, wb, x, y, s)
    back = lambda w, to: w[: max(0, to - s.shingle + 1)][::-1]
    before = [(x - p - n, y - q - n, n) for p, q, n in _onward(a[:x][::-1], b[:y][::-1], back(wa, x), back(wb, y), 0, 0, s)][::-1]
    if before and before[-1][0] + before[-1][2] == x and before[-1][1] + before[-1][2] == y:
        p, q, n = before.pop()
        after[0] = (p, q, n + after[0][2])
    p, q, n = (np.array(v, np.int64) for v in zip(*before, *after))
    kept = np.r_[0, np.cumsum(np.maximum(n - s.shingle + 1, 0))]
    both = kept[None, 1:] - kept[:-1, None]
    of_a = np.maximum((p + n)[None, :] - p[:, None] - s.shingle + 1, 0)
    of_b = np.maximum((q + n)[None, :] - q[:, None] - s.shingle + 1, 0)
    good = np.triu(both >= s.similarity * (of_a + of_b - both)) & (both > 0)
    if not good.any():
        return None
    u, v = np.unravel_index(int(np.argmax(np.where(good, of_b, -1))), good.shape)
    return int(p[u]), int(p[v] + n[v]), int(q[u]), int(q[v] + n[v])


def stretched(plain: DataFrame, marked: DataFrame, s: Settings) -> DataFrame:
    """Both places of each stretch around linked paragraphs: doc_id, removed, lo, hi (words), paragraph, last (paragraphs),
    begin, end (bytes) and first_id."""
    anchors = marked.where("removed").where(F.col("words") >= s.shingle).select("doc_id", F.col("first.doc_id").alias("src"), "word", "words", (F.col("word") - F.col("first.word")).alias("shift"))
    cell = lambda c: F.floor(c / s.cell)
    asked = anchors.groupBy("doc_id", "src", "shift", cell(F.col("word")).alias("cell")).agg(F.min("word").alias("lo"), F.max(F.col("word") + F.col("words")).alias("hi"))
    asked = asked.withColumn("src_cell", cell(F.col("lo") - F.col("shift"))).groupBy("doc_id", "src", "cell", "src_cell").agg(F.collect_list(F.struct("lo", "hi", "shift")).alias("asked"))
    asked = materialised(asked)
    counts = asked.groupBy("src", "src_cell").agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.select("doc_id", "cell").unionAll(asked.select("src", "src_cell")).distinct()
    cut = slices(plain, wanted, s)
    let_go(plain.sparkSession)
    part = lambda p: F.struct("w0", "b0", "p0", "starts", "raw").alias(p)
    first = cut.select(F.col("doc_id").alias("src"), F.col("cell").alias("src_cell"), part("a")).join(counts, ["src", "src_cell"])
    total = asked.count()
    rows = join_counted(asked, first, ["src", "src_cell"], total).join(cut.select("doc_id", "cell", part("b")), ["doc_id", "cell"])

    def place(x: dict, begin: np.ndarray, end: np.ndarray, lo: int, hi: int) -> tuple[int, ...]:
        no = lambda w: x["p0"] + int(np.searchsorted(x["starts"], w, "right"))
        return x["w0"] + lo, x["w0"] + hi, no(lo), no(hi - 1), x["b0"] + int(begin[lo]), x["b0"] + int(end[hi - 1])

    def read(raws: list[bytes]) -> list[tuple]:
        """Hashes, shingles, first bytes and ends of the words of each slice; equal slices are read once and give the same arrays."""
        place: dict[bytes, int] = {}
        for raw in raws:
            place.setdefault(raw, len(place))
        h, doc, begin, end = words_of(list(place))
        edge = np.searchsorted(doc, np.arange(len(place) + 1))
        w = _windows(h, s.shingle)  # those that cross into the next slice are left out below
        each = [(h[lo:hi], w[lo : max(lo, hi - s.shingle + 1)], begin[lo:hi], end[lo:hi]) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return [each[place[raw]] for raw in raws]

    def parts(x: pa.StructArray) -> list[dict]:
        plain = zip(*[x.field(c).to_pylist() for c in ("w0", "b0", "p0", "raw")], _lists(x.field("starts")))
        return [dict(zip(("w0", "b0", "p0", "raw", "starts"), values)) for values in plain]

    def run(batches):
        for batch in batches:
            out = set()
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                some = [dict(zip(("doc_id", "src", "asked", "a", "b"), row)) for row in zip(*[piece.column(c).to_pylist() for c in ("doc_id", "src", "asked")], parts(piece.column("a")), parts(piece.column("b")))]
                both = read([r[x]["raw"] for x in ("a", "b") for r in some])
                for r, (ha, wa, *at_a), (hb, wb, *at_b) in zip(some, both[: len(some)], both[len(some) :]):
                    a, b = r["a"], r["b"]
                    done: list[tuple[int, int, int]] = []
                    for x in sorted(r["asked"], key=lambda x: x["lo"]):
                        if any(d == x["shift"] and lo <= x["lo"] and x["hi"] <= hi for lo, hi, d in done):
                            continue
                        got = stretch(ha, hb, x["lo"] - x["shift"] - a["w0"], x["lo"] - b["w0"], x["hi"] - x["lo"], s, wa, wb)
                        if got is None or got[3] - got[2] < s.run_words:
                            continue
                        done.append((got[2] + b["w0"], got[3] + b["w0"], x["shift"]))
                        out.add((r["src"], False, *place(a, *at_a, *got[:2]), r["src"]))
                        out.add((r["doc_id"], True, *place(b, *at_b, *got[2:]), r["src"]))
            if out:
                kinds = [pa.int64(), pa.bool_(), *[pa.int32()] * 6, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "removed", "lo", "hi", "paragraph", "last", "begin", "end", "first_id"])

    found = rows.select("doc_id", "src", "asked", "a", "b").mapInArrow(run, "doc_id long, removed boolean, lo int, hi int, paragraph int, last int, begin int, end int, first_id long")
    return found.distinct()


def repeated(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> DataFrame:
    """Runs of repeated paragraphs: doc_id, paragraph (first one's number), begin, end (bytes), n_words, n_paragraphs,
    removed (false where the run is the first occurrence), first_ids (documents that hold the first occurrences)."""
    plain = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    b = [f"b{i}" for i in range(s.bands)]
    each = _arrow(plain, s, {"h": "long"} | dict.fromkeys(b, "long"), bands=True)
    nodes = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in b])
    count = F.least(F.col("n"), F.lit(2**30)).cast("int")  # bands below zero are counts of equal paragraphs
    again = F.when(F.col("n") > 1, F.array(F.struct((-count).alias("band"), F.col("h").alias("value")))).otherwise(F.array().cast("array<struct<band:int,value:bigint>>"))
    deal = F.concat(again, F.array(*[F.struct(F.lit(i).alias("band"), F.col(x).alias("value")) for i, x in enumerate(b)]))
    rows = materialised(_mixed_groups(nodes.select("h", F.explode(deal).alias("x")).select("x.band", "x.value", "h")))
    equal = rows.where("band < 0").select("h", (-F.col("band")).cast("long").alias("n"))
    close = rows.where("band >= 0")
    near = materialised(close.select("h").distinct())
    held = _arrow(plain, s, {"h": "long", "sets": "array<long>"}, sets=True)
    sets = materialised(_joined(held, near, "h", "left_semi", near.count()).groupBy("h").agg(F.first("sets").alias("sets")))
    let_go(docs.sparkSession)
    edges = verified(_dealt_again(close.join(sets, "h"), s, most), s)
    tied = components(edges).select(F.col("node").alias("h"), "root")
    keys = equal.unionAll(tied.select("h", F.lit(1).cast("long"))).groupBy("h").agg(F.max("n").alias("n"))
    keys = materialised(keys.join(tied, "h", "left").select("h", F.coalesce("root", "h").alias("root"), "n"))
    del each, nodes, rows, equal, close, near, held, sets, edges, tied  # the files of what is not read again go
    let_go(docs.sparkSession)
    size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = _arrow(plain, s, {"h": "long", "doc_id": "long", "no": "int", "words": "int", "word": "int", "begin": "int", "end": "int"}, spans=True)
    found = found.join(F.broadcast(keys), "h") if size[0] <= SMALL else join_counted(found, keys, "h", size[1])
    found = materialised(found.select("root", "doc_id", "no", "words", "word", "begin", "end").distinct())
    place = F.struct("doc_id", "no", "word")
    first = found.groupBy("root").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    first = first.where("first.doc_id <> last.doc_id OR first.no <> last.no").select("root", "first", "n")
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("no") != F.col("first.no"))
    marked = materialised(join_counted(found, materialised(first), "root", found.count()).withColumn("removed", other))
    del found, first, keys
    let_go(docs.sparkSession)
    run = F.col("no") - F.row_number().over(Window.partitionBy("doc_id", "removed").orderBy("no"))
    runs = marked.withColumn("run", run).groupBy("doc_id", "removed", "run").agg(
        F.min("word").alias("lo"), F.max(F.col("word") + F.col("words")).alias("hi"), F.min("no").alias("paragraph"), F.max("no").alias("last"),
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.collect_set("first.doc_id").alias("first_ids"),
    )
    spans = ["lo", "hi", "paragraph", "last", "begin", "end", "first_ids"]
    runs = runs.where(F.col("n_words") >= s.run_words).select("doc_id", "removed", *spans)
    more = stretched(plain, marked, s).groupBy("doc_id", "removed", "lo").agg(
        F.max("hi").alias("hi"), F.min("paragraph").alias("paragraph"), F.max("last").alias("last"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.collect_set("first_id").alias("first_ids")
    )
    return _united(runs.unionByName(more))


def _united(runs: DataFrame) -> DataFrame:
    """Runs that overlap or follow each other in a document as one."""
    so_far = Window.partitionBy("doc_id", "removed").orderBy("lo", "hi")
    new = F.coalesce(F.col("lo") > F.max("hi").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = runs.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("doc_id", "removed", "run").agg(
        F.min("paragraph").alias("paragraph"), F.min("begin").alias("begin"), F.max("end").alias("end"), (F.max("hi") - F.min("lo")).cast("long").alias("n_words"),
        (F.max("last") - F.min("paragraph") + 1).cast("long").alias("n_paragraphs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_ids")))).alias("first_ids"),
    )
    return joined.select("doc_id", "paragraph", "begin", "end", "n_words", "n_paragraphs", "removed", "first_ids")


def row_keys(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with a number ``key`` for each text under an identifier: the identifier where it has one text, otherwise a number
    below all identifiers made of both, so that an identifier's other texts are told apart (and come first, in the order of these numbers).
    Rows without an identifier have none."""
    ident = F.col(f"`{id_col}`").cast("long")
    print_ = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), ident)
    least, most, by = fresh(docs, "least", "most", "ident")
    shared = docs.where(ident.isNotNull()).groupBy(ident.alias(by)).agg(F.min(print_).alias(least), F.max(print_).alias(most))
    shared = materialised(shared.where(F.col(least) != F.col(most)).select(by))
    few = shared.count()
    rows = docs.join(F.broadcast(shared) if few <= SMALL else shared, ident == F.col(by), "left") if few else docs.withColumn(by, F.lit(None).cast("long"))
    own = F.lit(-(2**63)) + F.shiftrightunsigned(print_, 2)
    return rows.withColumn(key, F.when(F.col(by).isNull(), ident).otherwise(own)).drop(by)


def without_repeats(docs: DataFrame, runs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows with the removed runs cut out of their texts; a row of whose words nothing is left goes. ``id_col`` is the column
    that the runs were found by, one text for each of its values."""
    owner, spans_of = fresh(docs, "cut_id", "cut")
    spans = runs.where("removed").groupBy(F.col("doc_id").alias(owner)).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(spans_of))
    rows = docs.join(spans, F.col(f"`{id_col}`").cast("long") == F.col(owner), "left").drop(owner)
    fields = docs.schema.fields

    def run(batches):
        for b in batches:
            texts_, keep = [], []
            for text, cut in zip(b.column(text_col).to_pylist(), b.column(spans_of).to_pylist()):
                if cut:
                    raw, at, parts = text.encode(), 0, []
                    for c in cut:
                        parts.append(raw[at : c["begin"]])
                        at = c["end"]
                    raw = b"".join([*parts, raw[at:]]).strip()
                    text = raw.decode()
                    keep.append(bool(raw))
                else:
                    keep.append(True)
                texts_.append(text)
            cols = [pa.array(texts_, pa.string()) if f.name == text_col else b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields]).filter(pa.array(keep))

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
