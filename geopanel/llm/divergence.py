"""Divergence of sources by hash-consed segment trees over term ids.

Terms are counted within tasks before they are shuffled, once, by language and term. The terms that a language keeps are dealt to
blocks by a hash, so many that each block is work for one task. In a block, terms are numbered from frequent to rare, and each group's counts
are the leaves of a segment tree. Trees are built level by level: equal pairs of children are one node, so equal stretches of
counts (rare terms that most groups lack, above all) exist once, and a stretch without counts is node 0. Two groups
are compared by going down both trees at once: each distinct pair of nodes is opened once, with the number of places where it
occurs, and each distinct pair of counts at the leaves is priced once. Two empty nodes need not be opened, nor equal
ones of groups with equal totals. Blocks report a sum for each pair of groups, and the ten largest terms of each group.

All arithmetic is in whole numbers. Quotients are taken by long division in three digits of a thousand, which is exact while a
group has less than 9e15 occurrences.

Defined results: null text, language and source count as empty strings; rows with null or repeated identifiers count like any
other (identifiers are not read); a group without kept terms is compared like any other, with counts of 0; a language without kept
terms has value 0 for each pair; a language with one source has no pairs; an empty table gives an empty result; further columns,
whatever their names, stay behind. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopanel.llm.common import SMALL
from geopanel.session import materialised

#: Occurrences are scaled to parts of a billion; a term is kept from so many documents on; terms reported for a group.
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: Counts (of a term in a group) in a block, entries that a task counts before it hands them on, and pairs of nodes opened at once.
BLOCK_ROWS, HELD, OPENED = 200_000, 400_000, 2_000_000

#: ASCII characters other than letters separate terms; A-Z become a-z; all other bytes belong to terms.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row without a term for each
    group. Rows of a language's term lie together."""

    def run(batches):
        n, docs_, size = defaultdict(Counter), defaultdict(Counter), 0

        def counted():
            rows = [(*g, None, 0, 0) for g in n] + [(*g, t.decode(), k, docs_[g][t]) for g, c in n.items() for t, k in c.items()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, raw in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                terms = raw.translate(_TERMS).split()
                once, own = set(terms), n[lang, source]
                size -= len(own)
                own.update(terms)
                size += len(own)
                docs_[lang, source].update(once)
                if size > HELD:
                    yield counted()
                    n, docs_, size = defaultdict(Counter), defaultdict(Counter), 0
        yield counted()

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    rows = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), by long division."""
    rest, whole = count + 2, np.zeros(np.broadcast(count, total).shape, np.int64)
    size = total + 2 * kept
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Trees:
    """Segment trees of several groups over ``size`` terms; equal subtrees are one node, and node 0 is a subtree of zeros."""

    def __init__(self, group: np.ndarray, term: np.ndarray, count: np.ndarray, groups: int, size: int):
        leaf, node = np.unique(count, return_inverse=True)
        self.leaf = np.r_[0, leaf]  # the count of each leaf node
        node, at = node + 1, term
        self.height = max(0, int(size - 1).bit_length())
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # of the nodes of each level above the leaves
        for _ in range(self.height):
            parent, side = at // 2, at % 2
            place, where = np.unique(group * (1 << self.height) + parent, return_inverse=True)
            pair = np.zeros((place.size, 2), np.int64)
            pair[where, side] = node
            kinds, node = np.unique(pair[:, 0] * (node.max(initial=0) + 1) + pair[:, 1], return_index=True, return_inverse=True)[1:]
            self.children.append((np.r_[0, pair[kinds, 0]], np.r_[0, pair[kinds, 1]]))
            group, at, node = place >> self.height, place & ((1 << self.height) - 1), node + 1
        self.root = np.zeros(groups, np.int64)
        self.root[group] = node

    def compared(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the pair of groups, count in a, count in b, places) for each distinct pair of counts, two zeros excepted;
        equal nodes are left out for the pairs of groups marked in ``equal``."""
        which, x, y, times = np.arange(a.size), self.root[a], self.root[b], np.ones(a.size, np.int64)
        for level in range(self.height, -1, -1):
            open_ = ((x != 0) | (y != 0)) & ~((x == y) & equal[which])
            which, x, y, times = which[open_], x[open_], y[open_], times[open_]
            if level == 0:
                break
            left, right = self.children[level - 1]
            which, times = np.r_[which, which], np.r_[times, times]
            x, y = np.r_[left[x], right[x]], np.r_[left[y], right[y]]
            order = np.lexsort((y, x, which))
            which, x, y, times = which[order], x[order], y[order], times[order]
            first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if x.size else np.zeros(0, np.int64)
            which, x, y = which[first], x[first], y[first]
            times = np.add.reduceat(times, first) if first.size else times
        return which, self.leaf[x], self.leaf[y], times


def pair_values(trees: Trees, total: np.ndarray, kept: int, size: int):
    """Yields (groups a, groups b, value summed over the block's terms) for all pairs of groups a < b, some at a time."""
    zero = share(np.zeros_like(total), total, kept) if kept else total
    step = max(1, OPENED // max(1, 2 * size))
    a_all, first = np.arange(total.size - 1), 0
    while first < a_all.size:
        last = first + 1
        while last < a_all.size and (last - first + 1) * total.size <= step:
            last += 1
        own = a_all[first:last]
        a = np.repeat(own, total.size - 1 - own)
        b = np.concatenate([np.arange(i + 1, total.size) for i in own])
        for at in range(0, a.size, step):
            x, y = a[at : at + step], b[at : at + step]
            value = np.zeros(x.size, np.int64)
            if kept and size:
                which, n, m, times = trees.compared(x, y, total[x] == total[y])
                p, q = share(n, total[x[which]], kept), share(m, total[y[which]], kept)
                base = price(zero[x], zero[y])
                value = base * size  # as if all counts were zero; other places are put right
                np.add.at(value, which, (price(p, q) - base[which]) * times)
            yield x, y, value
        first = last


def audited(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank: how far each group (of a language and source) is from every
    other source of the language, and the terms by which it exceeds its language most."""
    counts = materialised(term_counts(docs, lang_col, source_col, text_col))
    by_term = Window.partitionBy("lang", "term")
    kept = counts.where("term IS NOT NULL").select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("docs"), F.sum("n").over(by_term).alias("all"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"))
    kept = materialised(kept.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").fillna(0, ["total", "rows", "firsts"])
    groups = materialised(groups)
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("kept"), F.greatest(F.lit(1), F.ceil(F.sum("rows") / block_rows)).cast("long").alias("blocks"))
    langs = materialised(langs)
    langs = F.broadcast(langs) if langs.count() <= SMALL else langs
    dealt = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "all")
    lists = groups.join(langs, "lang").select(F.col("lang").alias("of"), F.col("source").alias("name"), "total", "lang_total", "kept", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))

    def run(left, right):
        names = sorted(right.column("name").to_pylist(), key=str.encode)
        index = {s: i for i, s in enumerate(names)}
        total = np.zeros(len(names), np.int64)
        total[[index[s] for s in right.column("name").to_pylist()]] = right.column("total").to_numpy()
        lang, lang_total, n_kept = (right.column(c)[0].as_py() for c in ("of", "lang_total", "kept"))
        term = left.column("term").to_pylist()
        group = np.array([index[s] for s in left.column("source").to_pylist()], np.int64)
        n, all_ = left.column("n").to_numpy(), left.column("all").to_numpy()
        most = dict(zip(term, all_.tolist()))
        spelled = sorted(most, key=str.encode)
        rank = {t: i for i, t in enumerate(spelled)}
        number = {t: i for i, t in enumerate(sorted(spelled, key=lambda t: -most[t]))}
        trees = Trees(group, np.array([number[t] for t in term], np.int64), n, len(names), len(number))
        out = []
        name = np.array(names, object)
        for a, b, value in pair_values(trees, total, n_kept, len(number)):
            out.append(("pair", name[a], name[b], value))
        if term:
            p, q = share(n, total[group], n_kept), share(all_, np.array(lang_total), n_kept)
            value = price(p, q)
            over = np.flatnonzero(p > q)
            place = np.array([rank[t] for t in term], np.int64)[over]
            order = over[np.lexsort((place, -value[over], group[over]))]
            start = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if order.size else order
            nth = np.arange(order.size) - np.repeat(start, np.diff(np.r_[start, order.size]))
            order = order[nth < TOP]
            out.append(("term", name[group[order]], np.array(spelled, object)[np.array([rank[term[i]] for i in order], np.int64)] if order.size else name[:0], value[order]))
        size = [len(o[1]) for o in out]
        cat = lambda k, kind: pa.array(np.concatenate([o[k] for o in out]) if out else [], kind)
        return pa.table({"lang": pa.array([lang] * sum(size), pa.string()), "part": pa.array(np.repeat([o[0] for o in out], size).tolist(), pa.string()), "source": cat(1, pa.string()), "item": cat(2, pa.string()), "value": cat(3, pa.int64())})

    schema = "lang string, part string, source string, item string, value long"
    found = materialised(dealt.groupBy("lang", "block").cogroup(lists.groupBy("of", "at")).applyInArrow(run, schema))
    pairs = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", "part", F.explode(ways).alias("way"), "value").select("lang", "way.source", "part", "way.item", "value")
    ranked = pairs.unionByName(found.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
