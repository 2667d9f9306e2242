"""Best-two-fit packing of documents into sequences of a fixed length.

Documents become token ids and an end token; one longer than a sequence is cut into full pieces, the first of which may be
shorter. Which pieces share a sequence depends on their lengths alone, and there are only as many lengths as a sequence has
tokens. So the rule runs over the count of pieces of each length: it fills one sequence and repeats that filling as long as
its lengths last. Pieces are then numbered within their length, and a number decides the sequence and the place in it. The
count table (at most one row for each length) and the fillings are all that the driver sees, whatever the corpus.

The rule (best-two-fit): fill a sequence greedily, the longest piece that fits first; then replace its smallest piece by the
two unpacked pieces that together fill the widened gap best, if they fill it better than the piece did.

Defined results: null text counts as empty, and an empty document is its end token; rows with a null or repeated identifier
are packed like any other; repeated rows take places of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geopanel.llm.bpe_split import byte_symbols
from geopanel.llm.common import Memo, once_per_worker, texts
from geopanel.session import materialised

#: How GPT-2-like byte-level files split a text; the `tokenizers` library has it built in.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes all Unicode versions of the two libraries agree.
_COMMON = regex.compile("[\t\n\r -ɏ]*")
_RUN = regex.compile(r"\s\s")


class ByteEncoder:
    """Ids of a byte-level BPE file, as little-endian 32-bit integers; ``source`` is the file's text.

    A blank or line break between two other characters always ends a token, so the stretches between them are encoded on
    their own and remembered. Texts with runs of white space or with a special token go to the library whole.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        back = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {b"".join(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = special
        self.library = Tokenizer.from_str(source)
        self.short = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = Memo(self._stretch, 100_000), Memo(lambda w: self._stretch(" " + w), 500_000)
        self.line_break = self._stretch("\n")

    def _stretch(self, text: str) -> bytes:
        ids = self.short.encode_ordinary(text) if _COMMON.fullmatch(text) else self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text or text[0].isspace() or text[-1].isspace() or _RUN.search(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out += [self.later[w] for w in rest]
            out.append(self.line_break)
        return b"".join(out[:-1])


def byte_encoder(source: str) -> ByteEncoder:
    return once_per_worker(ByteEncoder, source)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    end = array("I", [end_id]).tobytes()

    def run(batches):
        enc = byte_encoder(source.value)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many sequences are filled so), by best-two-fit over the counts of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        used: dict[int, int] = {}
        free = lambda n: left[n] - used.get(n, 0)
        fill: list[int] = []
        gap = capacity
        while (i := bisect.bisect_right(sizes, gap) - 1) >= 0:
            while i >= 0 and free(sizes[i]) == 0:
                i -= 1
            if i < 0:
                break
            n = sizes[i]
            k = min(free(n), gap // n)
            fill += [n] * k
            used[n] = used.get(n, 0) + k
            gap -= k * n
        if gap and len(fill) > 1:
            small = fill[-1]
            pair = _best_pair(sizes, free, gap + small)
            if pair and sum(pair) > small:
                fill[-1:] = pair
                used[small] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
        used = {n: k for n, k in used.items() if k}
        times = min(left[n] // k for n, k in used.items())
        out.append((tuple(fill), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                sizes.remove(n)
    return out


def _best_pair(sizes: list[int], free, room: int) -> list[int] | None:
    """The two free lengths with the largest sum within ``room``: one pointer from each end."""
    open_sizes = [n for n in sizes[: bisect.bisect_right(sizes, room - 1)] if free(n)]
    a, b, best, found = 0, len(open_sizes) - 1, 0, None
    while a <= b:
        if a == b and free(open_sizes[a]) < 2:
            break
        total = open_sizes[a] + open_sizes[b]
        if total > room:
            b -= 1
            continue
        if total > best:
            best, found = total, [open_sizes[b], open_sizes[a]]
        if total == room:
            break
        a += 1
    return found


class Places:
    """Where the r-th piece of a length goes, as sorted arrays: runs of equal fillings, by (length, first number)."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = {}
        runs: list[tuple[int, int, int, int]] = []
        first = 0
        for fill, times in plan:
            offset = 0
            for n in fill:
                runs.append((n, taken.get(n, 0), first, offset))
                taken[n] = taken.get(n, 0) + times
                offset += n
            first += times
        runs.sort()
        self.length, self.number, self.sequence, self.offset = (np.array(c, np.int64) for c in (zip(*runs) if runs else [()] * 4))
        self.sequences = first

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((number, length))
        at = np.empty(len(length), np.int64)
        starts = np.searchsorted(self.length, np.unique(length))
        for n, lo in zip(np.unique(length), starts):
            hi = np.searchsorted(self.length, n, "right")
            mine = order[np.searchsorted(length[order], n) : np.searchsorted(length[order], n, "right")]
            at[mine] = lo + np.searchsorted(self.number[lo:hi], number[mine], "right") - 1
        return self.sequence[at] + number - self.number[at], self.offset[at]


def numbered(rows: DataFrame, spread: int = 256) -> DataFrame:
    """``number`` of each row among those of its length, from 0. Rows of a length are spread over buckets and numbered there;
    the buckets' own counts, few for each length, give where each begins. So one frequent length is no single task's work."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)).cast("int"))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = bucketed.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    return own.join(begins, ["length", "bucket"]).withColumn("number", F.col("begin") + F.col("own")).drop("begin", "own", "bucket")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece with its ``sequence_id`` and its ``offset`` there."""
    spark = docs.sparkSession
    rows = materialised(pieces(docs, path, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    places = spark.sparkContext.broadcast(Places(fillings(counts, capacity)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for b in batches:
            where = places.value.of(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(x, pa.int64()) for x in where)], [*names, "sequence_id", "offset"])

    return numbered(rows).select(*names, "number").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
