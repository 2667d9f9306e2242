"""SimHash near-duplicates by a hierarchical index in Gray order.

Equal fingerprints are one node, whatever the number of their documents. Fingerprints within three bits agree in at least one
of four disjoint blocks, so each one is dealt to four groups by a block that it shares; a group that is too large for one task
is dealt again by the blocks of its other bits. Within a group, fingerprints are sorted by Gray rank, which keeps common
leading bits together: runs with the same leading bits are the nodes of a hierarchy, each level adding six bits of the mask.
Pairs of nodes go down the levels together with the differences gathered so far, and a pair beyond the limit ends with all
that lies under it. A group reports a tree of links for each of its clusters, never its pairs; node pairs that already lie
in one cluster are left out.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other; rows with a
null identifier take part, but never name a component; repeated rows share their component; an empty table gives an empty
result. Texts of any length are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import join_counted, texts
from geopanel.llm.components import components
from geopanel.session import materialised

BITS, NEAR, STEP = 64, 3, 6
#: Leading bits that a group shares after each dealing; four blocks of such a width fit into what is left before it.
WIDTHS = (16, 12, 9, 6)
#: Rows of a group that one task takes before the group is dealt again.
GROUP_ROWS = 50_000


def fingerprint(raw: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles, A-Z lower-cased, as a signed 64-bit integer."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(s), 42) for s in shingles], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(h, -(-h.size // 100_000)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """doc_id and fp of every row; with ``key`` also the SHA-256 of its text."""
    names = ["doc_id", "fp", *["key"] * key]

    def run(batches):
        for b in batches:
            fp = pa.array(map(fingerprint, b.column("text").cast(pa.binary()).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp, *([b.column("key")] if key else [])], names)

    rows = texts(docs, id_col, text_col)
    rows = rows.withColumn("key", F.sha2("text", 256)) if key else rows
    return rows.mapInArrow(run, "doc_id long, fp long" + ", key string" * key)


def _turned(code: Column, fixed: int, by: int) -> Column:
    """``code`` with the bits after the leading ``fixed`` ones turned left by ``by``."""
    n = BITS - fixed
    if not by:
        return code
    low = code if not fixed else code.bitwiseAND(F.lit((1 << n) - 1))
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, n - by))
    return turned if not fixed else code.bitwiseAND(F.lit(-(1 << n))).bitwiseOR(turned.bitwiseAND(F.lit((1 << n) - 1)))


def dealt(rows: DataFrame, depth: int) -> DataFrame:
    """Each row once for each of four blocks; ``path`` names the blocks chosen so far, ``code`` has them in front."""
    fixed, width = sum(WIDTHS[:depth]), WIDTHS[depth]
    ways = F.array(*[F.struct((F.col("path") * 4 + i).alias("path"), _turned(F.col("code"), fixed, i * width).alias("code")) for i in range(4)])
    return rows.withColumn("way", F.explode(ways)).select("way.path", "way.code", "fp")


def groups(nodes: DataFrame, limit: int = GROUP_ROWS) -> list[tuple[int, DataFrame]]:
    """(number of shared leading bits, rows) for each dealing, so that no group there exceeds ``limit``; only the last
    dealing can, where 43 shared bits leave at most 2**21 fingerprints."""
    out, rows = [], nodes.select(F.lit(0).alias("path"), F.col("fp").alias("code"), "fp")
    for depth in range(len(WIDTHS)):
        fixed = sum(WIDTHS[: depth + 1])
        rows = dealt(rows, depth).withColumn("key", F.shiftrightunsigned("code", BITS - fixed))
        if depth == len(WIDTHS) - 1:
            return [*out, (fixed, rows)]
        large = materialised(rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("path", "key"))
        if large.isEmpty():
            return [*out, (fixed, rows)]
        out.append((fixed, rows.join(large, ["path", "key"], "left_anti")))
        rows = rows.join(large, ["path", "key"], "left_semi").select("path", "code", "fp")
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class Clusters:
    """Smallest row number of each row's cluster, over arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            ra, rb = label[a], label[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def search(group: np.ndarray, code: np.ndarray, fixed: int, near: int = NEAR, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row of its cluster) for rows that are not the first, of fingerprints in equal groups within ``near`` bits.

    ``group`` numbers the groups; ``code`` has their shared leading bits, ``fixed`` of them, in front.
    """
    order = np.lexsort((gray_rank(code), group))
    group, code = group[order], code[order]
    n = code.size
    clusters = Clusters(n)
    beside = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(code[1:] ^ code[:-1]) <= near))
    clusters.link(beside, beside + 1)
    levels = []
    for shift in [*range(BITS - fixed, 0, -STEP), 0]:
        head = code >> np.uint64(shift) if shift < BITS else np.zeros(n, np.uint64)
        start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (head[1:] != head[:-1])]) if n else np.zeros(0, np.int64)
        levels.append((start, np.r_[start[1:], n], head[start] if n else head))
    children = [(np.searchsorted(low[0], up[0]), np.searchsorted(low[0], up[1])) for up, low in zip(levels, levels[1:])]
    roots = np.flatnonzero(levels[0][1] - levels[0][0] > 1)
    todo = [(0, roots, roots)]
    while todo:
        level, a, b = todo.pop()
        if level == len(children):
            clusters.link(levels[level][0][a], levels[level][0][b])
            continue
        first, last = children[level]
        na, nb = last[a] - first[a], last[b] - first[b]
        total = np.cumsum(na * nb)
        if total.size > 1 and total[-1] > chunk:
            cut = max(1, int(np.searchsorted(total, total[-1] // 2)))
            todo += [(level, a[cut:], b[cut:]), (level, a[:cut], b[:cut])]
            continue
        if not total.size:
            continue
        each = np.repeat(np.arange(a.size), na * nb)
        at = np.arange(total[-1]) - np.repeat(total - na * nb, na * nb)
        c, d = first[a[each]] + at // nb[each], first[b[each]] + at % nb[each]
        start, end, head = levels[level + 1]
        differing = np.bitwise_count(head[c] ^ head[d]).astype(np.int64)  # all bits down to this level: those gathered above and the new ones
        alive = (differing <= near) & ((c < d) | ((c == d) & (end[c] - start[c] > 1)))
        c, d = c[alive], d[alive]
        if c.size > 10_000:  # leave out what already lies in one cluster
            low, high = np.minimum.reduceat(clusters.label, start), np.maximum.reduceat(clusters.label, start)
            apart = ~((low[c] == high[c]) & (low[d] == high[d]) & (low[c] == low[d]))
            c, d = c[apart], d[apart]
        todo.append((level + 1, c, d))
    rows = np.flatnonzero(clusters.label != np.arange(n))
    return order[rows], order[clusters.label[rows]]


def links(rows: DataFrame, fixed: int, batch: int = 200_000) -> DataFrame:
    """(a, b): trees of links between fingerprints that share a group. A task reads its groups in order and searches many
    small ones at once."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def found(part):
            path, key, code, fp = part
            group = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
            a, b = search(group, code.view(np.uint64), fixed)
            return pa.RecordBatch.from_arrays([pa.array(fp[a], pa.int64()), pa.array(fp[b], pa.int64())], ["a", "b"])

        for b in batches:
            held.append(tuple(np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ("path", "key", "code", "fp")))
            if sum(h[0].size for h in held) >= batch:
                path, key, code, fp = (np.concatenate(c) for c in zip(*held))
                open_from = int(np.flatnonzero((path != path[-1]) | (key != key[-1]))[-1]) + 1 if ((path != path[-1]) | (key != key[-1])).any() else 0
                if open_from:
                    yield found((path[:open_from], key[:open_from], code[:open_from], fp[:open_from]))
                held = [(path[open_from:], key[open_from:], code[open_from:], fp[open_from:])]
        if held:
            whole = tuple(np.concatenate(c) for c in zip(*held))
            if whole[0].size:
                yield found(whole)

    return rows.select("path", "key", "code", "fp").repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = GROUP_ROWS, key: bool = False) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that can be reached) of every row; with ``key`` also
    tree (the least fingerprint of its component, which tells apart components with the same least doc_id) and the SHA-256 of its text."""
    prints = materialised(fingerprints(docs, id_col, text_col, key))
    nodes = materialised(prints.groupBy("fp").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("n")))
    edges = None
    for fixed, rows in groups(nodes, limit):
        part = links(rows, fixed)
        edges = part if edges is None else edges.unionAll(part)
    tied = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp")
    least = tied.groupBy("root").agg(F.min("own").alias("component"))
    named = nodes.join(tied.join(least, "root").select("fp", "root", "component"), "fp", "left")
    named = named.select("fp", F.coalesce("component", "own").alias("component_id"), F.coalesce("root", "fp").alias("tree"), "n")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_counted(prints, materialised(named), "fp", total).select("doc_id", "fp", "component_id", *["tree", "key"] * key)


def least_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and key of the first row of each component: its least doc_id, and the least key of the texts with it there."""
    rows = near_duplicates(docs, id_col, text_col, key=True).where("doc_id = component_id")
    # Two components may have the same least identifier; the tree that a fingerprint is in tells them apart.
    return rows.groupBy("doc_id", "tree").agg(F.min("key").alias("key")).select("doc_id", "key")
