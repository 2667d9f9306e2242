"""Levels add and rates do not: group and root records come from replicates, not from averages of published rates."""

import math

import pytest
from pyspark.sql import functions as F

from geopanel.operators import publish, quality, replicate
from geopanel.operators.calendar import Calendar

CAL = Calendar(t0=1995.5, t1=2000.5, t_base=2001.5, cuts=(1996.5, 1998.5, 2000.5), control_from=2000.5)
N = 70  # not a multiple of the chunk


@pytest.fixture(scope="module")
def sim(spark):
    """Two groups: a large unit that shrinks beside a small one that grows fast, and a group of one unit without a base."""
    rows = [("A", 1, "g", 1000.0, -0.02), ("A", 2, "g", 10.0, 0.30), ("A", 3, "h", 50.0, 0.05), ("A", 4, "z", 0.0, 0.01), ("B", 1, "g", 20.0, 0.10)]
    df = spark.createDataFrame(rows, "cell string, unit bigint, grp string, base double, mid double")
    r = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.col("mid") + (i - 35) / 10_000.0)
    return df.select("cell", "unit", "grp", F.lit(3).alias("n_obs"), "base", F.lit(None).cast("double").alias("conf_base"), F.lit("media").alias("cap"), r.alias("r"), F.array().cast("array<array<double>>").alias("r_fixed"))


def test_vector_sums_add_every_replicate_of_every_row(sim):
    sums = {(x.cell, x.grp): x for x in replicate.vector_sums(sim, ["cell", "grp"], {"a": F.col("r"), "b": F.transform("r", lambda v: -v)}, lambda v: F.col("base") * v, {"total": F.sum("base")}, ["base"]).collect()}
    rows = sim.collect()
    for (cell, grp), found in sums.items():
        own = [x for x in rows if (x.cell, x.grp) == (cell, grp)]
        assert found.total == sum(x.base for x in own) and len(found.a) == len(found.b) == N
        for k in range(N):
            want = sum(x.base * x.r[k] for x in own)
            assert math.isclose(found.a[k], want, abs_tol=1e-9) and math.isclose(found.b[k], -want, abs_tol=1e-9)
    assert len(sums) == 4


def test_sums_explode_chunks_not_replicates(sim):
    plan = replicate.roll_up(sim, ["cell"], 4.0, demand=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Generate explode") == 1


def test_root_from_groups_is_root_from_units(sim):
    groups = replicate.roll_up(sim, ["cell"], 4.0, demand=False)
    assert {x.grp for x in groups.collect()} == {"g", "h"}  # a group without a base has no rate
    direct, upper = ({x.cell: x for x in df.collect()} for df in (replicate.roll_up(sim, ["cell"], 4.0, False, root="root"), replicate.roll_up(groups, ["cell"], 4.0, False, root="root")))
    assert set(direct) == set(upper) == {"A", "B"}
    for cell in direct:
        assert direct[cell].base == upper[cell].base
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(direct[cell].r, upper[cell].r))


def test_levels_reconcile_and_averaged_rates_do_not(sim):
    units = publish.records(sim, "cell", CAL, ("h1", "h3"), CAL.cuts[-1])
    upper = publish.upper_levels(sim, "cell", CAL.supply_span, demand=False)
    groups = publish.records(upper["group"], "cell", CAL, ("h1", "h3"), CAL.cuts[-1])
    assert all(x.ok for x in quality.reconcile_levels(units, groups, keys=("cell", "horizon")).collect())
    averaged = units.groupBy("cell", "horizon", F.col("grp").alias("unit")).agg(F.sum("level_base").alias("level_base"), F.avg("delta_pct").alias("delta_pct"))
    assert not all(x.ok for x in quality.reconcile_levels(units, averaged, keys=("cell", "horizon")).collect())


def test_missing_members_are_records_without_data(spark, sim):
    found = publish.records(sim.where("unit = 1"), "cell", CAL, ("h1",), CAL.cuts[-1])
    frame = spark.createDataFrame([("A", 1, "g", None), ("A", 9, "g", "rural")], "cell string, unit bigint, grp string, reason string")
    rows = {x.unit: x for x in publish.with_missing(frame, found, ("h1",)).collect()}
    assert rows[9].verdict == "sin_datos" and rows[9].n_obs == 0 and rows[9].confidence == "baja" and rows[9].level_base is None
    assert rows[1].verdict != "sin_datos" and rows[1].ci_lo <= rows[1].delta_pct <= rows[1].ci_hi


def test_documents_are_equal_in_bytes_between_runs(spark, sim):
    layer = publish.with_missing(sim.select("cell", "unit", "grp", F.lit(None).cast("string").alias("reason")), publish.records(sim, "cell", CAL, ("h1", "h3"), CAL.cuts[-1]), ("h1", "h3"))
    made = lambda df: sorted((x.unit, x.doc) for x in quality.document_rows(quality.nested(df, "cell", "celdas"), "celdas").collect())
    assert made(layer) == made(layer.repartition(7, "horizon"))
