"""Profiles, drift between editions and churn of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.operators import rank

NULL_DRIFT = 2.0  # fixed value: percentage points


def column_profile(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``by, column, type, rows, nulls, blanks, distincts, min, max`` from one aggregate.

    Several exact distinct counts expand the scan; profile very wide tables in slices of ``columns``.
    """
    fields = [f for f in df.schema.fields if f.name not in by and (columns is None or f.name in columns)]
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        ordered = isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        aggs += [
            F.count(c).alias(f"_n{i}"),
            F.count_distinct(c).alias(f"_d{i}"),
            (F.lit(None).cast("bigint") if ordered else F.count_if(F.trim(c.cast("string")) == "")).alias(f"_e{i}"),
            (F.min(c).cast("string") if ordered else F.lit(None).cast("string")).alias(f"_lo{i}"),
            (F.max(c).cast("string") if ordered else F.lit(None).cast("string")).alias(f"_hi{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("_rows").alias("rows"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
                F.col(f"_e{i}").alias("blanks"),
                F.col(f"_d{i}").alias("distincts"),
                F.col(f"_lo{i}").alias("min"),
                F.col(f"_hi{i}").alias("max"),
            )
        )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def grouped_profile(profile: DataFrame, grouped: Sequence[str], label: str = "agrupadas") -> DataFrame:
    """Fold the listed columns of a profile into one line with the range of null rates."""
    name = F.when(F.col("column").isin(list(grouped)), label).otherwise(F.col("column"))
    pct = F.when(F.col("rows") > 0, F.col("nulls") * 100.0 / F.col("rows")).otherwise(0.0)
    return profile.groupBy(name.alias("line")).agg(
        F.count(F.lit(1)).alias("n_columns"), F.min(pct).alias("null_pct_min"), F.max(pct).alias("null_pct_max"),
        F.sum("distincts").alias("distincts"),
    )


def frequent_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 4, share: int = 1000) -> DataFrame:
    """``column, value, n, rank``: of every column the ``k`` most frequent values among those that more than one in ``share`` rows hold
    (ties by value), with exact counts. NULL does not count.

    A first scan keeps a bounded sketch of frequent items for each column, which misses none that so many rows hold; a second one counts
    its candidates exactly. Neither keeps all values of a column anywhere.
    """
    names = [c for c in df.columns if columns is None or c in columns]
    tracked = 1 << (8 * share - 1).bit_length()
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    sketch = text.agg(F.count(F.lit(1)).alias("rows"), *[F.expr(f"approx_top_k(c{i}, {2 * share}, {tracked})").alias(f"k{i}") for i in range(len(names))])
    found = F.array(*[F.struct(F.lit(i).alias("at"), F.transform(f"k{i}", lambda x: x["item"]).alias("items")) for i in range(len(names))])
    wanted = sketch.select("rows", F.inline(found)).select("rows", "at", F.explode("items").alias("value")).where("value IS NOT NULL")
    held = text.select(F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("at", "value"))
    # 2 * share candidates a column at most
    counts = held.join(F.broadcast(wanted), ["at", "value"]).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"), F.first("rows").alias("rows"))
    order = W.partitionBy("at").orderBy(F.col("n").desc(), "value")
    top = counts.where(F.col("n") * share > F.col("rows")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1)
    return top.select(name.alias("column"), "value", "n", "rank")


def top_values(df: DataFrame, column: str, k: int = 4) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k)


def samples(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First rows as maps of their non-empty fields."""
    first = df.orderBy(*order).limit(n)
    entries = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in df.columns])
    kept = F.filter(entries, lambda e: e["v"].isNotNull() & (e["v"] != ""))
    return first.select(*order, F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["k"], e["v"])), "; ").alias("sample"))


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def schema_difference(reference: DataFrame, other: DataFrame) -> DataFrame:
    """``column, change``: missing, added, or changed type. Inputs are ``column, type`` tables."""
    a = reference.select("column", F.col("type").alias("ref_type"))
    b = other.select("column", F.col("type").alias("new_type"))
    change = (
        F.when(F.col("new_type").isNull(), "faltan")
        .when(F.col("ref_type").isNull(), "añadidas")
        .when(F.col("ref_type") != F.col("new_type"), F.concat_ws("→", "ref_type", "new_type"))
    )
    return a.join(b, "column", "full").select("column", change.alias("change")).where(F.col("change").isNotNull())


def row_change(counts: DataFrame, edition: str = "edition", n: str = "n") -> DataFrame:
    """% change of row counts between consecutive editions; one row per edition, so one small window."""
    prev = F.lag(n).over(W.orderBy(edition))
    return counts.withColumn("change_pct", (F.col(n) - prev) * 100.0 / prev)


def family_profile(df: DataFrame, edition: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Per edition: rows, change against the previous one, key cardinality, and the columns whose
    null or blank rate drifts at least two points from the latest edition."""
    prof = column_profile(df.select(edition, key, *[c for c in columns if c != key]), [edition])
    rate = (F.col("nulls") + F.coalesce("blanks", F.lit(0))) * 100.0 / F.col("rows")
    p = prof.withColumn("rate", rate)
    latest = p.groupBy("column").agg(F.max_by("rate", edition).alias("ref_rate"))  # one row per column
    joined = p.join(latest, "column")
    drift = F.when(F.abs(F.col("rate") - F.col("ref_rate")) >= NULL_DRIFT, F.col("column"))
    per = joined.groupBy(edition).agg(
        F.max("rows").alias("n"),
        F.max(F.when(F.col("column") == key, F.col("distincts"))).alias("n_keys"),
        F.array_join(F.array_sort(F.collect_set(drift)), ",").alias("drifting"),  # at most the profiled columns
    )
    return row_change(per, edition)


def churn(entities: DataFrame, cuts: Sequence[int], cut: str = "cut", ident: str = "entity_id") -> DataFrame:
    """Per cut: entities that stayed from the previous cut, are new, are gone by the next one, or
    re-appear after an absence. Presence is a bitmap per entity, so there is no window and no self-join."""
    bit = F.lit(0)
    for i, c in enumerate(cuts):
        bit = F.when(F.col(cut) == c, 1 << i).otherwise(bit)
    seen = entities.where(F.col(cut).isin(list(cuts))).groupBy(ident).agg(F.bit_or(bit.cast("bigint")).alias("m"))
    has = lambda i: F.col("m").bitwiseAND(1 << i) != 0
    aggs = []
    for i in range(len(cuts)):
        before = F.col("m").bitwiseAND((1 << i) - 1) != 0
        was = has(i - 1) if i else F.lit(False)
        aggs += [
            F.count_if(has(i)).alias(f"n{i}"),
            F.count_if(has(i) & was).alias(f"stayed{i}"),
            F.count_if(has(i) & ~before).alias(f"new{i}"),
            F.count_if(was & ~has(i)).alias(f"gone{i}"),
            F.count_if(has(i) & ~was & before).alias(f"back{i}"),
        ]
    names = ("n", "stayed", "new", "gone", "back")
    rows = [F.struct(F.lit(c).alias("cut"), *[F.col(f"{x}{i}").alias(x) for x in names]) for i, c in enumerate(cuts)]
    return seen.agg(*aggs).select(F.inline(F.array(*rows)))


def concentration(entities: DataFrame, keys: Sequence[str], unit: str = "unit", small: int = 2) -> DataFrame:
    """Entities per occupied unit: units, quartile, median, p95, maximum, share with at most ``small``."""
    per = entities.groupBy(*keys, unit).agg(F.count(F.lit(1)).cast("double").alias("c"))
    q = rank.quantiles(per, keys, "c", {"q25": 0.25, "median": 0.5, "p95": 0.95})
    totals = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.max("c").alias("max"), F.avg((F.col("c") <= small).cast("double")).alias("share_small")
    )
    return totals.join(q, list(keys))


def drop_between(entities: DataFrame, by: str, cut: str, first: int, last: int) -> DataFrame:
    """Count at two cuts and the % change, per class."""
    at = lambda c: F.count_if(F.col(cut) == c)
    t = entities.where(F.col(cut).isin(first, last)).groupBy(by).agg(at(first).alias("n_first"), at(last).alias("n_last"))
    return t.withColumn("change_pct", F.try_divide((F.col("n_last") - F.col("n_first")) * 100.0, F.nullif(F.col("n_first"), F.lit(0))))


def listed_counts(df: DataFrame, column: str) -> DataFrame:
    """``a 10, b 7``: classes by descending count, then name."""
    counts = df.groupBy(F.col(column).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    packed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("c"))))  # one entry per class
    text = lambda x: F.concat_ws(" ", x["c"], (-x["k"]).cast("string"))
    return counts.agg(F.array_join(F.transform(packed, text), ", ").alias("listed"))


def anti_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def membership_rate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    keys = a.select(key).distinct()
    known = b.select(key).distinct().withColumn("_in", F.lit(1))
    return keys.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("n_keys"), F.avg(F.coalesce("_in", F.lit(0)).cast("double")).alias("rate")
    )


def contrast(a: DataFrame, b: DataFrame, key: str, value: str, tol: float = 0.01) -> DataFrame:
    """Largest relative difference of two sources' sums per key, in %, and keys at or above ``tol``."""
    left, right = a.groupBy(key).agg(F.sum(value).alias("x")), b.groupBy(key).agg(F.sum(value).alias("y"))
    rel = F.abs(F.try_divide(F.col("x"), F.nullif(F.col("y"), F.lit(0.0))) - 1.0)
    return left.join(right, key, "left").agg(
        (F.max(rel) * 100.0).alias("max_pct"), F.count_if(F.col("y").isNull() | (rel >= tol)).alias("n_off")
    )


def deviating(a: DataFrame, b: DataFrame, key: str, value: str, tol: float = 0.05) -> DataFrame:
    """Keys whose level deviates more than ``tol`` from the other source, with the deviation in %."""
    left, right = a.groupBy(key).agg(F.sum(value).alias("x")), b.groupBy(key).agg(F.sum(value).alias("y"))
    dev = F.try_divide(F.col("x"), F.nullif(F.col("y"), F.lit(0.0))) - 1.0
    return left.join(right, key).select(key, (dev * 100.0).alias("deviation_pct")).where(F.abs(F.col("deviation_pct")) > tol * 100.0)


def total_mismatches(parts: DataFrame, totals: DataFrame, keys: Sequence[str], part: str, total: str) -> DataFrame:
    sums = parts.groupBy(*keys).agg(F.sum(part).alias("_parts"))
    return totals.join(sums, list(keys)).agg(
        F.count(F.lit(1)).alias("n_compared"), F.count_if(F.col("_parts") != F.col(total)).alias("n_different")
    )


def names_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys carried under more than one name: group by key, never by name."""
    names = df.select(key, name).distinct().groupBy(key)
    return names.agg(F.count(F.lit(1)).alias("n_names"), F.min(name).alias("first_name")).where(F.col("n_names") > 1)
