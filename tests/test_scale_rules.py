"""Rules that must hold at any size: long series, dated folders, shared folders, group joins."""

import pytest
from pyspark.sql import functions as F

from geopanel import session
from geopanel.functions import scalars
from geopanel.operators import compose, meet, quality, trend
from geopanel.sources import readers


@pytest.mark.parametrize(("df", "want"), [(1, 12.706205), (30, 2.042272), (31, 2.039513), (60, 2.000298), (200, 1.971896)])
def test_t_quantile_at_any_length(spark, df, want):
    got = spark.range(1).select(trend.t_quantile(F.lit(df)).alias("t")).first()["t"]
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/data/2024_01/denue_2016_10.csv", "2016-10"), ("/data/2024_01/denue_2016_10/part-0.csv", "2016-10"), ("/data/2016_10/more/denue.csv", "denue"),
        ("denue_2019_04.csv", "2019-04"), ("/x/plain.csv", "plain"), ("/x/12016_103.csv", "12016_103"),
    ],
)
def test_edition_comes_from_the_file(spark, path, want):
    assert spark.range(1).select(scalars.edition_label(F.lit(path)).alias("e")).first()["e"] == want


def test_editions_are_worked_out_once_for_each_file(spark, tmp_path, monkeypatch):
    """Patterns over the whole path of every row took most of the time. Paths are listed as rows have them, odd characters too."""
    seen, paths = [], [str(tmp_path / "a b%20c,ñ" / f"denue_{year}_10") for year in (2016, 2019)]
    header = list(readers.EDUCATION_COLUMNS)
    for i, path in enumerate(paths):
        spark.createDataFrame([(str(k),) * len(header) for k in range(3)], [f"c{i}" for i in range(len(header))]).toDF(*header).write.option("header", True).csv(path)
    rows = readers.education_entities(spark, paths)
    assert sorted((r.edition, r.entity_id) for r in rows.collect()) == [(f"{y}-10", k) for y in (2016, 2019) for k in range(3)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "[^/]*$" not in plan
    monkeypatch.setattr(readers, "edition_label", lambda _: F.lit("of the file") if seen.append(1) or len(seen) == 1 else F.lit("of the row"))
    assert {r.edition for r in readers.education_entities(spark, paths, check=False).collect()} == {"of the file"}


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_group_join_gives_the_same_rows(spark, how):
    units = spark.range(500).selectExpr("id AS unit", "id % 7 AS grp")
    groups = spark.range(5).selectExpr("id AS grp", "id * 10 AS v")
    rows = lambda bound: sorted(tuple(r) for r in meet.with_groups(units, groups, ["grp"], how=how, bound=bound).select("unit", "grp", F.coalesce("v", F.lit(-1))).collect())
    assert rows(10**6) == rows(0)
    plan = meet.with_groups(units, groups, ["grp"], how=how, bound=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_repeated_ids_fail_by_default(spark, tmp_path):
    path = str(tmp_path / "denue_2016_10")
    header = list(readers.EDUCATION_COLUMNS)
    spark.createDataFrame([("1",) * len(header)] * 2, [f"c{i}" for i in range(len(header))]).toDF(*header).write.option("header", True).csv(path)
    with pytest.raises(quality.ContractError):
        readers.education_entities(spark, path)
    assert readers.education_entities(spark, path, check=False).count() == 2


def test_published_levels_only(spark):
    """A unit with a level but no change is not ranked; a branch without cells is zero supply."""
    cols = "branch string, cell string, unit long, grp long, horizon string, level_base double, delta_pct double, rate_pct double, confidence string, reason string"
    rows = [("demanda", "todas", u, 1, "h3", 100.0, None if u == 3 else 1.0 * u, 1.0, "alta", None) for u in range(1, 5)]
    rows += [("educacion", "x", u, 1, "h3", 5.0 * u, 0.0, 0.0, "alta", None) for u in (1, 2, 3)]
    out = {(r.branch, r.unit): r for r in compose.published_sensitivity(spark.createDataFrame(rows, cols)).collect()}
    assert out["educacion", 3].rank_lo is None and out["educacion", 1].rank_lo is not None
    assert out["educacion", 4].rank_lo is not None and out["salud", 1].rank_lo is not None
