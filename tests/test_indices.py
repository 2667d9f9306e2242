"""Index algebra, rules and scenario thresholds."""

import pytest
from pyspark.sql import functions as F

from geopanel.functions import rules
from geopanel.operators import compose, rank
from geopanel.sources import catalog

# Golden vector of the opportunity index (K = 5).
COVERAGE = [0.0, 1000.0, 500.0, None, 250.0, 4000.0, 0.0]
RATE_D = [-3.0, -3.0, 2.0, -3.0, 0.0, -5.0, 1.0]
RATE_S = [-1.0, -1.0, 2.0, -1.0, 5.0, -6.0, -4.0]
EXPECTED = [0.75, 0.05, 0.4, None, 0.45, 0.15, 1.0]


def test_opportunity_golden_vector(spark):
    rows = [(i, *r) for i, r in enumerate(zip(COVERAGE, RATE_D, RATE_S))]
    df = spark.createDataFrame(rows, "id int, cov double, rd double, rs double")
    out = rank.percentile_rank(df, [], "cov", "pr").withColumn("o", compose.opportunity(F.col("pr"), F.col("rd"), F.col("rs"))).orderBy("id").collect()
    for row, want in zip(out, EXPECTED):
        assert row["o"] == (None if want is None else pytest.approx(want))


def test_branch_without_trend_is_not_adjusted(spark):
    df = spark.createDataFrame([(0.4, 50.0, None)], "pr double, rd double, rs double")
    o = df.select(compose.opportunity(F.col("pr"), F.col("rd"), F.col("rs"), F.lit(False)).alias("o")).first()["o"]
    assert o == pytest.approx(0.6)


def test_availability_rewards_only_confident_trends(spark):
    df = spark.createDataFrame([("alta",), ("media",), ("baja",)], "c string")
    got = [r[0] for r in df.select(compose.availability(F.lit(0.5), F.lit(10.0), F.col("c"))).collect()]
    assert got == pytest.approx([0.65, 0.575, 0.5])


def test_composite_skips_missing_branches(spark):
    df = spark.createDataFrame([("u", "educacion", 0.2), ("u", "salud", None), ("u", "comercio", 0.8), ("v", "salud", None)], "unit string, branch string, o double")
    w = {"educacion": 1.0, "salud": 5.0, "comercio": 3.0, "verde": 1.0}
    got = {r["unit"]: r["x"] for r in df.groupBy("unit").agg(compose.weighted_index("o", w).alias("x")).collect()}
    assert got["u"] == pytest.approx((0.2 + 2.4) / 4) and got["v"] is None


@pytest.mark.parametrize(
    "up,down,flat,want",
    [(0.80, 0.1, 0.1, "sube"), (0.79, 0.1, 0.11, "se_mantiene"), (0.1, 0.80, 0.1, "baja"), (0.1, 0.1, 0.8, "se_mantiene")],
)
def test_verdict_edges(spark, up, down, flat, want):
    row = spark.createDataFrame([(up, down, flat)], "u double, d double, f double").select(
        rules.verdict("u", "d").alias("v"), rules.decided_probability("u", "d", "f").alias("p")
    ).first()
    assert row["v"] == want and row["p"] == {"sube": up, "baja": down, "se_mantiene": flat}[want]


@pytest.mark.parametrize(
    "p,stable,n_obs,base,cap,want",
    [
        (0.95, True, 2, 100.0, None, "alta"), (0.9499, True, 2, 500.0, None, "media"), (0.95, False, 2, 500.0, None, "media"),
        (0.80, False, 2, 500.0, None, "baja"), (0.99, True, 1, 500.0, None, "baja"), (0.99, True, 2, 99.0, None, "baja"),
        (0.99, True, 3, None, "media", "media"), (0.5, True, 3, None, "media", "baja"),
    ],
)
def test_confidence_edges(spark, p, stable, n_obs, base, cap, want):
    df = spark.createDataFrame([(p, stable, n_obs, base, cap)], "p double, s boolean, n int, b double, c string")
    assert df.select(rules.confidence(*[F.col(x) for x in "psnbc"])).first()[0] == want


@pytest.mark.parametrize(
    "up,down,flat,want",
    [(3, 2, 2, "insuficiente"), (1, 6, 3, "baja"), (2, 6, 2, "mixto"), (6, 1, 3, "sube"), (3, 3, 4, "polarizado"), (1, 2, 5, "mantiene"), (2, 4, 3, "mixto")],
)
def test_scenarios(spark, up, down, flat, want):
    df = spark.createDataFrame([(up, down, flat)], "u int, d int, f int")
    assert df.select(rules.scenario(F.col("u"), F.col("d"), F.col("f"))).first()[0] == want


def test_weighted_mode_ties_and_zero_weights(spark):
    rows = [("z", 1, "b", 1.0), ("z", 2, "a", 1.0), ("y", 3, "a", 0.0), ("y", 4, "b", 0.0), ("y", 5, "b", -2.0), ("x", 6, "sin_datos", 9.0), ("x", 7, None, 9.0)]
    df = spark.createDataFrame(rows, "zone string, unit int, v string, w double")
    got = {r["zone"]: r["m"] for r in compose.weighted_mode(df, ["zone"], "v", "w", "m").collect()}
    assert got == {"z": "b", "y": "b", "x": "sin_datos"}


def test_cell_selection_algebra():
    assert catalog.selected_cells("educacion") == []
    assert catalog.selected_cells("salud", ("clinicas",), "publico") == ["clinicas__publico"]
    assert len(catalog.selected_cells("educacion", ("primaria", "secundaria"))) == 6
    assert catalog.selected_cells("comercio", tuple(catalog.COMMERCE_CELLS)) == []
    assert catalog.selected_cells("comercio", catalog.ESSENTIAL_GOODS) == list(catalog.ESSENTIAL_GOODS)
    assert [len(catalog.cell_names(b)) for b in catalog.BRANCHES] == [24, 12, 5, 3]


def test_names_sort_in_spanish(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["Zeta", "nube", "Álvaro", "Ñu", "Benito"])], "unit int, grp string").withColumn("value", F.lit(1.0))
    assert [r["grp"] for r in compose.ranking(df, "group", None).collect()] == ["Álvaro", "Benito", "nube", "Ñu", "Zeta"]
