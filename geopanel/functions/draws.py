"""Reproducible random numbers: a draw depends only on its key, never on the partitioning.

``hash`` (default) derives uniforms from ``xxhash64`` of (seed, stream, id, rep). ``r2`` is a
low-discrepancy sequence any SQL engine can evaluate, used to compare results across engines.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 20260918
# Fixed values of the R2 sequence and the golden ratio step.
R2_A = 0.7548776662
R2_B = 0.5698402910
GOLDEN = 0.6180339887
STREAM_STEP = 1000003


def _hash_uniform(stream: int, ident: Column, rep: Column, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), F.lit(stream), ident, rep)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)


def _fraction(x: Column) -> Column:
    return x - F.floor(x)


def _r2_uniform(stream: int, ident: Column, rep: Column, first: float, second: float) -> Column:
    shifted = ident.cast("double") + float(STREAM_STEP * stream)
    return _fraction(F.lit(0.5) + shifted * first + rep.cast("double") * second)


def uniform(ident: Column, rep: Column, stream: int = 0, source: str = "hash", seed: int = SEED) -> Column:
    if source == "hash":
        return _hash_uniform(2 * stream, ident, rep, seed)
    return _r2_uniform(stream, ident, rep, R2_A, R2_B)


def normal(ident: Column, rep: Column, stream: int = 0, source: str = "hash", seed: int = SEED) -> Column:
    """Standard normal by Box-Muller on two keyed uniforms."""
    u1 = uniform(ident, rep, stream, source, seed)
    if source == "hash":
        u2 = _hash_uniform(2 * stream + 1, ident, rep, seed)
    else:
        u2 = _r2_uniform(stream, ident, rep, R2_B, R2_A)
    return F.sqrt(F.log(F.greatest(u1, F.lit(1e-12))) * -2.0) * F.cos(u2 * (2.0 * math.pi))


def persistence(rep: Column, source: str = "hash", seed: int = SEED, lo: float = 0.25, hi: float = 1.0) -> Column:
    """U(lo, hi), one value per replicate, shared by all units."""
    if source == "hash":
        u = _hash_uniform(90, F.lit(0), rep, seed)
    else:
        u = _fraction(F.lit(0.5) + rep.cast("double") * GOLDEN)
    return u * (hi - lo) + lo


# --- the same draws over arrays, inside tasks ----------------------------------------------------

_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(values, before) -> np.ndarray:
    """Spark's ``xxhash64`` of an int column after what gave ``before``, as unsigned integers."""
    with np.errstate(over="ignore"):
        word = np.asarray(values).astype(np.int32).view(np.uint32).astype(np.uint64)
        h = (np.asarray(before).astype(np.uint64) + _P5 + np.uint64(4)) ^ (word * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _unit_interval(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(2**53)


def seeds(ident: Column, stream: int, source: str = "hash", seed: int = SEED) -> tuple[Column, Column]:
    """What the two uniforms behind :func:`normal` share over all replicates of ``ident``."""
    if source == "hash":
        return tuple(F.xxhash64(F.lit(seed), F.lit(s), ident) for s in (2 * stream, 2 * stream + 1))
    shifted = ident.cast("double") + float(STREAM_STEP * stream)
    return F.lit(0.5) + shifted * R2_A, F.lit(0.5) + shifted * R2_B


def normals(first: np.ndarray, second: np.ndarray, n: int, source: str = "hash") -> np.ndarray:
    """:func:`normal` for every pair of ``seeds`` (rows) and replicate (columns)."""
    rep = np.arange(n)
    if source == "hash":
        u1, u2 = (_unit_interval(_hash_int(rep[None, :], h.view(np.uint64)[:, None])) for h in (first, second))
    else:
        u1, u2 = first[:, None] + (rep * R2_B)[None, :], second[:, None] + (rep * R2_A)[None, :]
        u1 -= np.floor(u1)
        u2 -= np.floor(u2)
    np.maximum(u1, 1e-12, out=u1)
    np.log(u1, out=u1)
    u1 *= -2.0
    np.sqrt(u1, out=u1)
    u2 *= 2.0 * math.pi
    np.cos(u2, out=u2)
    u1 *= u2
    return u1


def persistences(n: int, source: str = "hash", seed: int = SEED, lo: float = 0.25, hi: float = 1.0) -> np.ndarray:
    """:func:`persistence` of ``n`` replicates."""
    rep = np.arange(n)
    if source == "hash":
        before = np.uint64(42)
        for part in (seed, 90, 0):
            before = _hash_int(np.array([part]), before)
        u = _unit_interval(_hash_int(rep, before))
    else:
        u = 0.5 + rep * GOLDEN
        u -= np.floor(u)
    return u * (hi - lo) + lo
