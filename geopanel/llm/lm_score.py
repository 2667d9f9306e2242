"""Stupid-backoff scores joined from n-gram counts that are partitioned by hash.

Documents are put together in batches. A batch explodes its texts into n-grams (as 64-bit hashes), combines them, and sends
each hash range to the task that owns this part of the count table, with the batch's own counts. That task adds up the counts
of all batches and answers every batch with the totals, in the order asked. The batch joins the answers to its n-grams again
and sums the scores of each document. Every n-gram crosses the network once for each batch that holds it, never once for
each occurrence, so a frequent one weighs no more than a rare one; the parts of the table grow in number with the corpus.

The score of a word is the count of its n-gram over that of its context; an n-gram seen fewer than ``min_count`` times
backs off to one word less at the price of ``BACKOFF``; single words have their count over all words. Logarithms are summed
in millionths, so that a document's sum does not depend on the order of its words.

Defined results: words are stretches without white space; null text counts as empty; a document without words has score 0 and
no mean; rows with null or repeated identifiers are counted and scored like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.llm.common import Memo, once_per_worker, texts
from geopanel.session import materialised

BACKOFF, MILLION = 0.4, 1_000_000.0
#: Bytes of text that close a batch, and words for each part of the count table.
BATCH_BYTES, PART_WORDS = 5_000_000, 1_000_000


def batches(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, ids, sizes, body, n_words): texts end to end, packed."""

    def run(stream):
        task, number, ids, raws = TaskContext.get().partitionId(), 0, [], []

        def batch():
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(raws))
            cols = [[(task << 32) + number], [ids], [[len(r) for r in raws]], [body], [sum(len(r.split()) for r in raws)]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["batch", "ids", "sizes", "body", "n_words"])

        size = 0
        for b in stream:
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                ids.append(doc)
                raws.append(raw)
                size += len(raw) + 50
                if size >= batch_bytes:
                    yield batch()
                    number, size, ids, raws = number + 1, 0, [], []
        if ids:
            yield batch()

    return docs.mapInArrow(run, "batch long, ids array<long>, sizes array<int>, body binary, n_words long")


def _hashes(_):
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w), 200_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """The n-grams of a batch: for each order the hash at every word, and which words have that many before them."""

    def __init__(self, sizes: list[int], body: bytes, order: int):
        memo, raw, at = once_per_worker(_hashes, None), zstandard.ZstdDecompressor().decompress(body), 0
        words, counts = [], []
        for n in sizes:
            w = raw[at : at + n].split()
            words += w
            counts.append(len(w))
            at += n
        self.counts = np.array(counts, np.int64)
        word = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        del words, raw
        place = np.arange(word.size) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.at = [np.flatnonzero(place >= k) for k in range(order)]
        run, self.hash = word, []
        for k in range(order):
            if k:
                run = _mixed(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:])  # one word longer, ending at word k, k + 1, ...
            self.hash.append(_mixed(run[self.at[k] - k] + np.uint64(k + 1)))
        self.distinct, self.inverse, self.own = np.unique(np.concatenate(self.hash), return_inverse=True, return_counts=True)

    def split(self, parts: int) -> np.ndarray:
        """Where each part's range of hashes begins in ``distinct``."""
        edges = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
        return np.r_[np.searchsorted(self.distinct, edges), self.distinct.size]

    def scores(self, totals: np.ndarray, words: int, min_count: int) -> np.ndarray:
        """Millionths of the logarithm for each document."""
        by_order = np.split(totals[self.inverse], np.cumsum([h.size for h in self.hash])[:-1])
        n = int(self.counts.sum())
        count = [np.zeros(n, np.int64) for _ in by_order]
        for c, at, v in zip(count, self.at, by_order):
            c[at] = v
        value = count[0] / max(words, 1)
        for k in range(1, len(count)):
            at = self.at[k]
            seen = count[k][at] >= min_count
            value[at] = np.where(seen, count[k][at] / np.maximum(count[k - 1][at - 1], 1), BACKOFF * value[at])
        micro = np.rint(np.log(value) * MILLION).astype(np.int64) if n else np.zeros(0, np.int64)
        sums = np.r_[0, np.cumsum(micro)]
        end = np.cumsum(self.counts)
        return sums[end] - sums[end - self.counts]


def _packed(x: np.ndarray) -> bytes:
    """Equal bytes of all numbers side by side, so that leading zeros cost nothing once compressed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def asked(rows: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, batch, grams, own): the distinct n-grams of each batch in each part's range, and how often it holds them."""

    def run(stream):
        for b in stream:
            for batch, sizes, body in zip(*(b.column(c).to_pylist() for c in ("batch", "sizes", "body"))):
                g = Grams(sizes, body, order)
                edge = g.split(parts)
                full = [p for p in range(parts) if edge[p] < edge[p + 1]]
                cut = [slice(edge[p], edge[p + 1]) for p in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([batch] * len(full), pa.int64()),
                     pa.array([_packed(np.diff(g.distinct[c], prepend=np.uint64(0))) for c in cut], pa.binary()), pa.array([_packed(g.own[c]) for c in cut], pa.binary())],
                    ["part", "batch", "grams", "own"])

    return rows.select("batch", "sizes", "body").mapInArrow(run, "part int, batch long, grams binary, own binary")


def answered(requests: DataFrame) -> DataFrame:
    """(batch, part, totals): one part of the count table answers all batches."""

    def run(table):
        grams = [np.cumsum(_unpacked(x)) for x in table.column("grams").to_pylist()]
        own = np.concatenate([_unpacked(x) for x in table.column("own").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.zeros(distinct.size, np.uint64)
        np.add.at(total, inverse, own)
        found = np.split(total[inverse], np.cumsum([g.size for g in grams])[:-1])
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "totals": pa.array([_packed(x) for x in found], pa.binary())})

    return requests.groupBy("part").applyInArrow(run, "batch long, part int, totals binary")


def scored(docs: DataFrame, order: int = 2, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, score (sum of natural logarithms) and mean_score of every row, counts taken over all rows."""
    spark = docs.sparkSession
    rows = materialised(batches(texts(docs, id_col, text_col), batch_bytes))
    words = rows.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words * order // PART_WORDS))
    answers = answered(asked(rows, order, parts))

    def run(left, right):
        ids, sizes, body = (left.column(c).to_pylist()[0] for c in ("ids", "sizes", "body"))
        g = Grams(sizes, body, order)
        own = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist()))
        totals = np.concatenate([_unpacked(t) for _, t in own]).astype(np.int64) if own else np.zeros(0, np.int64)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(g.counts), "micro": pa.array(g.scores(totals, words, min_count))})

    found = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, "doc_id long, n_words long, micro long")
    score = F.col("micro") / F.lit(MILLION)
    return found.select("doc_id", "n_words", score.alias("score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_score"))
