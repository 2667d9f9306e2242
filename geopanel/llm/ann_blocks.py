"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are cut into blocks by a hash of their identifier. Each tile is one block of queries times one block of candidates:
an int8 product gives every inner product up to an error that the quantisation steps bound, so only pairs whose upper
bound reaches the k-th best lower bound of their query survive. Survivors are computed again in double precision from the
original vectors; a query's best of each tile are merged by a top-k over all tiles. Nothing is lost: the result is exact.

Memory is bounded by two blocks; the number of tiles is that of query blocks times candidate blocks.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
no part; rows with a null identifier take no part; of rows with one identifier each takes part as a candidate, and a query is
never its own candidate under its identifier; repeated rows as queries are asked once; equal scores are ranked by the smaller
identifier; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopanel.session import materialised

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 8192, 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """One row for each block: ids and vectors as packed doubles."""

    def packed(key, batches):
        ids, vs = [], []
        for b in batches:
            ids.append(b.column("id").to_numpy(zero_copy_only=False))
            vs.append(b.column("v").values.to_numpy(zero_copy_only=False))
        return pa.table({name: [key[0].as_py()], "ids": [np.concatenate(ids).astype("<i8").tobytes()], "vs": [np.concatenate(vs).astype("<f8").tobytes()]},
                        schema=pa.schema([(name, pa.int32()), ("ids", pa.binary()), ("vs", pa.binary())]))

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(name), "id", "v")
    return dealt.groupBy(name).applyInArrow(lambda key, table: packed(key, table.combine_chunks().to_batches()), f"{name} int, ids binary, vs binary")


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, step of each row, bound on the length of each row's rounding error)."""
    step = np.abs(v).max(axis=1) / 127.0
    q = np.rint(v / step[:, None])
    error = np.sqrt(((v - q * step[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), step, error


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k nearest candidates of each query in one tile, a query itself left out."""
    qi, qs, qe = quantised(q)
    ci, cs, ce = quantised(c)
    qn, cn = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    out = []
    wide = ci.astype(np.float32).T  # products of int8 values are sums of integers that float32 holds exactly up to 1,040 components
    exact = wide.shape[0] * 127 * 127 < 2**24
    wide = wide if exact else wide.astype(np.float64)
    for at in range(0, len(qid), 128):
        part = slice(at, at + 128)
        near = (qi[part].astype(wide.dtype) @ wide).astype(np.float64) * qs[part, None] * cs
        # q.c - q'.c' = q.(c - c') + (q - q').c' and |c'| <= |c| + |c - c'|
        bound = (qn[part, None] * ce + qe[part, None] * (cn + ce)) * (1 + 1e-9) + 1e-12
        own = qid[part, None] == cid
        low = np.where(own, -np.inf, near - bound)
        m = min(k, low.shape[1])
        kth = np.partition(low, low.shape[1] - m, axis=1)[:, low.shape[1] - m]
        r, s = np.nonzero((near + bound >= kth[:, None]) & ~own)
        score = np.zeros(r.size)
        for d in range(q.shape[1]):  # one order of summation for every pair
            score += q[part][r, d] * c[s, d]
        order = np.lexsort((cid[s], -score, r))
        r, s, score = r[order], s[order], score[order]
        first = np.searchsorted(r, np.arange(r[-1] + 1 if r.size else 0))
        best = np.arange(r.size) - first[r] < k if r.size else np.zeros(0, bool)
        out.append((qid[part][r[best]], cid[s[best]], score[best]))
    return tuple(np.concatenate(x) if out else np.zeros(0) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", candidate_rows: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query row; ``queries`` is a condition on ``id``."""
    rows = materialised(usable(vectors, id_col, vector_col))
    asked = rows.where(queries).dropDuplicates(["id"])
    many, few = -(-max(1, rows.count()) // candidate_rows), -(-max(1, asked.count()) // query_rows)
    c, q = materialised(blocks(rows, many, "c")), materialised(blocks(asked, few, "q"))
    grid = q.select("q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).repartition(many * few, "q", "c")
    pairs = grid.join(q.withColumnsRenamed({"ids": "qids", "vs": "qvs"}), "q").join(c.withColumnsRenamed({"ids": "cids", "vs": "cvs"}), "c")

    def run(batches):
        for b in batches:
            for row in zip(*(b.column(n) for n in ("qids", "qvs", "cids", "cvs"))):
                qid, qv, cid, cv = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<i8", "<f8", "<i8", "<f8")))
                found = tile(qid, qv.reshape(len(qid), -1), cid, cv.reshape(len(cid), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = pairs.select("qids", "qvs", "cids", "cvs").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
