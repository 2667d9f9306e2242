"""Exact ranks, quantiles and quantile classes over groups of any size.

A window over one whole group would run in a single task. Here equal values are counted first, the distinct values of a group
are split into ranges by bounds taken from a sketch of the same values, and only the totals of the ranges (``BUCKETS`` a group) are
accumulated. Ranges hold about equally many distinct values however narrow or wide the values lie.

Values that hold more than one in ``FREQUENT`` of all rows, ``FREQUENT`` of them at most, meet the rows where these are; the others are
joined by a shuffle, in which rows that have met theirs, and rows without a value, are spread evenly and match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geopanel.operators.meet import with_groups

BUCKETS = 256
FREQUENT = 1000
#: Places to which rows without a partner are spread.
SPREAD = 65_536


def bucketed(distinct: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``_bucket``: how many of its group's bounds lie below a value. Monotone in ``value`` within a group."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    number = F.col(value).cast("double")
    bounds = distinct.groupBy(*keys).agg(F.percentile_approx(number, shares, F.lit(20 * buckets)).alias("_bounds"))
    if keys:
        rows = with_groups(distinct, bounds, list(keys), width=buckets, salt=value)
    else:
        rows = distinct.select("*", bounds.scalar().alias("_bounds"))
    return rows.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < number))).drop("_bounds")


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-NULL value: ``keys, value, cnt, cum, n`` (cumulative and total counts)."""
    keys = list(keys)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    distinct = bucketed(distinct, keys, value)
    by_group = W.partitionBy(*keys)
    totals = (
        distinct.groupBy(*keys, "_bucket")
        .agg(F.sum("cnt").alias("_total"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(
                F.sum("_total").over(by_group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
            F.sum("_total").over(by_group).alias("n"),
        )
    )
    inside = F.sum("cnt").over(W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return (
        distinct.withColumn("_inside", inside)
        .join(totals, [*keys, "_bucket"])
        .select(*keys, value, "cnt", (F.col("_before") + F.col("_inside")).alias("cum"), "n")
    )


def join_by_value(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the column ``out`` of ``table`` (one row for each of ``keys`` and ``value``, ``cnt`` rows of ``df`` have it); NULL
    values get NULL."""
    on = [*keys, value]
    frequent = F.col("cnt") * FREQUENT > table.agg(F.coalesce(F.sum("cnt"), F.lit(0))).scalar()
    hot = F.broadcast(table.where(frequent).select(*on, F.col(out).alias("_hot"), F.lit(True).alias("_met")))
    cold = table.where(~frequent).select(*on, F.lit(-1).cast("bigint").alias("_place"), F.col(out).alias("_cold"))
    alone = F.col(value).isNull() | F.col("_met").isNotNull()
    rows = df.join(hot, on, "left").withColumn("_place", F.when(alone, F.monotonically_increasing_id() % SPREAD).otherwise(F.lit(-1).cast("bigint")))
    joined = rows.join(cold, [*on, "_place"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_hot", "_cold").alias(out))


def percentile_of(cnt: Column, cum: Column, n: Column) -> Column:
    """Average-tie fractional rank in [0, 1]; a lone value sits at 0.5."""
    mean_rank = cum - (cnt - 1) / 2.0
    return F.when(n == 1, F.lit(0.5)).otherwise(F.try_divide(mean_rank - 1.0, n - 1.0))


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the average-tie percentile rank of ``value`` within ``keys``; NULL stays NULL."""
    ranks = distribution(df, keys, value).select(
        *keys, value, "cnt", percentile_of(F.col("cnt"), F.col("cum"), F.col("n")).alias(out)
    )
    return join_by_value(df, ranks, keys, value, out)


def class_cuts(dist: DataFrame, keys: Sequence[str], value: str, n_classes: int, prefix: str = "cut") -> DataFrame:
    """Cut i = the value at 0-based position ``floor(i / n · len)`` of the sorted group."""
    cuts = [
        F.min(F.when(F.col("cum") > F.floor(F.lit(i / n_classes) * F.col("n")), F.col(value))).alias(f"{prefix}{i}")
        for i in range(1, n_classes)
    ]
    return dist.groupBy(*keys).agg(*cuts)


def class_of(value: Column, n_classes: int, prefix: str = "cut") -> Column:
    """First class whose cut is not below the value, so equal values share a class; NULL stays NULL."""
    expr = F.when(value.isNull(), None)
    for i in range(1, n_classes):
        expr = expr.when(value <= F.col(f"{prefix}{i}"), i)
    return expr.otherwise(n_classes)


def tercile_name(c: Column) -> Column:
    return F.when(c.isNull(), "sin_datos").when(c == 1, "baja").when(c == 2, "media").otherwise("alta")


def tercile_of_quintile(q: Column) -> Column:
    return F.when(q.isNull(), "sin_datos").when(q <= 2, "baja").when(q == 3, "media").otherwise("alta")


def classify(df: DataFrame, keys: Sequence[str], value: str, n_classes: int, out: str) -> DataFrame:
    keys = list(keys)
    cuts = class_cuts(distribution(df, keys, value), keys, value, n_classes)
    names = [f"cut{i}" for i in range(1, n_classes)]
    joined = (
        df.join(cuts, keys, "left")
        if keys
        else df.select("*", cuts.select(F.struct(*names)).scalar().alias("_cuts")).select("*", "_cuts.*").drop("_cuts")
    )
    return joined.withColumn(out, class_of(F.col(value), n_classes)).drop(*names)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group: ``keys`` plus one column per entry of ``probs``."""
    dist = distribution(df, keys, value)
    spots = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        spots.append(F.min(F.when(F.col("cum") > F.floor(at), F.col(value))).alias(f"_{name}_lo"))
        spots.append(F.min(F.when(F.col("cum") > F.least(F.floor(at) + 1, F.col("n") - 1), F.col(value))).alias(f"_{name}_hi"))
    table = dist.groupBy(*keys).agg(F.max("n").alias("_n"), *spots)
    out = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return table.select(*keys, *out)
