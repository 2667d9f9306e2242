"""Distributed ranks, quantiles and classes against brute force."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from geopanel.operators import rank


def average_ranks(values):
    v = np.array(values, dtype=float)
    if len(v) == 1:
        return [0.5]
    return [((v < x).sum() + ((v == x).sum() - 1) / 2) / (len(v) - 1) for x in v]


def cut_class(values, n):
    s = sorted(values)
    cuts = [s[min(len(s) - 1, math.floor(i / n * len(s)))] for i in range(1, n)]
    return [next((i + 1 for i, c in enumerate(cuts) if x <= c), n) for x in values]


def run(spark, values):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, v double")


VALUES = st.lists(st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.0, 1.0000001, -3.5, 1e-300, -1e300, 7e5]), st.integers(-5, 5)), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES)
def test_rank_and_classes_match_brute_force(spark, values):
    got = rank.percentile_rank(run(spark, values), [], "v", "pr")
    got = rank.classify(got, [], "v", 3, "t")
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == len(values)
    real = [(i, float(v)) for i, v in enumerate(values) if v is not None]
    for (i, _), p, c in zip(real, average_ranks([v for _, v in real]) if real else [], cut_class([v for _, v in real], 3) if real else []):
        assert rows[i]["pr"] == pytest.approx(p, abs=1e-12)
        assert rows[i]["t"] == c
    for i, v in enumerate(values):
        if v is None:
            assert rows[i]["pr"] is None and rows[i]["t"] is None


def test_buckets_are_monotone_and_narrow_ranges_are_split(spark):
    wide = [-1e300, -2.0, -1.9999999, -1e-320, 0.0, 4.9e-324, 1e-12, 1.0, 1.0 + 2e-16, 2.0, 1e308]
    got = rank.bucketed(run(spark, wide), [], "v").orderBy("v").collect()
    assert [r["_bucket"] for r in got] == sorted(r["_bucket"] for r in got)
    narrow = spark.range(100_000).selectExpr("id % 3 AS k", "2020D + id / 100000D AS v")
    sizes = rank.bucketed(narrow, ["k"], "v").groupBy("k", "_bucket").count().collect()
    assert len({r["_bucket"] for r in sizes}) > 50 and max(r["count"] for r in sizes) < 100_000 / 3 / 50


def test_null_and_frequent_values_are_no_single_join_key(spark):
    from pyspark.sql import functions as F

    df = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 0D ELSE double(id) END AS v")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(held, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        table = df.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("cnt")).withColumn("x", F.col("v") + 1)
        out = rank.join_by_value(df, table, [], "v", "x")
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 30_000 and max(parts) < 1.2 * 30_000 / len(parts) and len(parts) == 4
        assert out.where("x IS NULL").count() == 10_000 and out.where("x = 1").count() == 10_000 and out.where("x = v + 1").count() == 20_000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_one_value_holding_a_third_of_all_rows(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(400), rng.gamma(2.0, 5.0, 800).round(2)])
    got = rank.percentile_rank(run(spark, values.tolist()), [], "v", "pr").collect()
    want = average_ranks(values)
    assert [r["pr"] for r in sorted(got, key=lambda r: r["id"])] == pytest.approx(want, abs=1e-12)


def test_quantiles_equal_numpy(spark):
    values = np.random.default_rng(5).normal(size=333).round(1)
    got = rank.quantiles(run(spark, values.tolist()), [], "v", {"a": 0.025, "b": 0.5, "c": 0.975, "d": 1.0}).first()
    assert [got[c] for c in "abcd"] == pytest.approx(np.quantile(values, [0.025, 0.5, 0.975, 1.0]).tolist())


def test_groups_do_not_mix(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    got = {(r["k"], r["v"]): r["pr"] for r in rank.percentile_rank(df, ["k"], "v", "pr").collect()}
    assert got == {("a", 1.0): 0.0, ("a", 3.0): 1.0, ("b", 2.0): 0.5}
