"""Simulations that are reduced inside their tasks give what written replicates give."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.functions import draws
from geopanel.operators import replicate, simulation
from geopanel.operators.calendar import Calendar
from geopanel.plans import load
from geopanel.plans.roles import Roles
from test_estimators import control, some_demand

CAL = Calendar()
QUERIES = load()[0]
N = 70  # not a multiple of the chunk


@pytest.mark.parametrize("source", ["hash", "r2"])
def test_draws_over_arrays_are_the_draws_of_columns(spark, source):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 7, -3, 2**40 + 5)], "unit bigint")
    reps = F.sequence(F.lit(0), F.lit(N - 1))
    a, b = draws.seeds(F.col("unit"), 3, source)
    share = F.transform(reps, lambda i: draws.persistence(i, source))
    rows = ids.select(a.alias("a"), b.alias("b"), F.transform(reps, lambda i: draws.normal(F.col("unit"), i, 3, source)).alias("z"), share.alias("p")).toPandas()
    np.testing.assert_allclose(draws.normals(rows.a.to_numpy(), rows.b.to_numpy(), N, source), np.vstack(rows.z), rtol=0, atol=1e-9)
    np.testing.assert_allclose(draws.persistences(N, source), rows.p[0], rtol=0, atol=1e-12)


def _close(got, want, key):
    got, want = ({tuple(r[k] for k in key): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        for c, v in row.items():
            assert got[k][c] == (pytest.approx(v, rel=1e-8, abs=1e-8) if isinstance(v, (float, list)) and "fixed" not in c else v) or "fixed" in c, (k, c)
            if "fixed" in c:
                np.testing.assert_allclose(np.array(got[k][c]), np.array(v), atol=1e-8)


def _both(spark, monkeypatch):
    monkeypatch.setattr(simulation, "SLICE", 7)  # groups of several slices
    monkeypatch.setattr(simulation, "BLOCK", 3)
    demand = some_demand(spark)
    demand = demand.unionByName(demand.withColumn("segment", F.lit("otra")).withColumn("d1", F.col("d1") * 2))
    inputs = replicate.demand_inputs(demand, control(spark), CAL, ["segment"])
    return replicate.demand_simulation(inputs, CAL, ["segment"], N), replicate.simulate_demand(inputs, CAL, ["segment"], N)


def test_reduced_demand_equals_written_demand(spark, monkeypatch):
    made, written = _both(spark, monkeypatch)
    summaries = (replicate.summarise(sim, ["segment"], CAL, ("h1", "h3", "h5")) for sim in (made, written))
    _close(*summaries, ["segment", "unit", "horizon"])
    rolled = (replicate.roll_up(sim, ["segment"], CAL.demand_span, demand=True) for sim in (made, written))
    _close(*rolled, ["segment", "grp"])


def test_reduced_supply_equals_written_supply(spark, monkeypatch):
    monkeypatch.setattr(simulation, "SLICE", 4)
    rows = [(c, u, f"g{u % 3}", [u % 4, 2, u], 0.01 * (u - 9), 0.0004 * (u % 5)) for c in "AB" for u in range(20)]
    posterior = spark.createDataFrame(rows, "cell string, unit bigint, grp string, s array<int>, b_tilde double, var_post double")
    made, written = replicate.supply_simulation(posterior, ["cell"], N), replicate.simulate_supply(posterior, ["cell"], N)
    _close(*(replicate.summarise(sim, ["cell"], CAL, ("h1", "h3")) for sim in (made, written)), ["cell", "unit", "horizon"])
    _close(*(replicate.roll_up(sim, ["cell"], 3.0, demand=False) for sim in (made, written)), ["cell", "grp"])
    assert replicate.roll_up(made, ["cell"], 3.0, demand=False, root="root").count() == 2


def test_the_run_moves_no_replicates_of_units(spark, sf_dir):
    r = Roles(spark, sf_dir)
    for sim in (r.demand_run, r.supply_run):
        assert not [f.name for f in sim.units.schema.fields if isinstance(f.dataType, T.ArrayType)]
        assert sim.made.n_sim == replicate.N_SIM


def test_quantiles_of_reduced_supply_equal_written_ones(spark):
    rows = [("A", u, f"g{u % 3}", [1, 2, u], 0.01 * (u - 9), 0.0004 * (u % 5)) for u in range(20)]
    posterior = spark.createDataFrame(rows, "cell string, unit bigint, grp string, s array<int>, b_tilde double, var_post double")
    made, written = replicate.supply_simulation(posterior, ["cell"], N), replicate.simulate_supply(posterior, ["cell"], N)
    q = lambda sim: [replicate.quantile(sim, p).alias(f"q{p}") for p in (0.025, 0.5, 0.975)]
    columns = ["cell", "unit", "p_up", "p_down", "p_flat"]
    _close(replicate.statistics(made).select(*columns, *q(made)), replicate.probabilities(written).select(*columns, *q(written)), ["cell", "unit"])


def test_median_coverage_without_replicates_equals_written_ones(spark, monkeypatch):
    """Units without supply, without a positive base, outside the universe, and with some or all supply missing."""
    made, written = _both(spark, monkeypatch)
    units = [r.unit for r in made.units.select("unit").distinct().orderBy("unit").collect()]
    kind = made.units.schema["unit"].dataType.simpleString()
    rows = [(c, u, "other", [1, 2, None if i % 5 == 1 or (i % 5 == 2 and c == "A") else i], 0.01 * i, 0.0004) for c in "AB" for i, u in enumerate(units) if i % 5]
    posterior = spark.createDataFrame(rows, f"cell string, unit {kind}, grp string, s array<int>, b_tilde double, var_post double")
    universe = spark.createDataFrame([(u,) for u in units[:-2]], f"unit {kind}")
    zero = F.when(F.col("unit") == F.lit(units[3]), 0.0).otherwise(F.col("base"))
    made, written = replace(made, units=made.units.withColumn("base", zero)), written.withColumn("base", zero)
    supply = lambda f: replicate.summed_levels(f(posterior, ["cell"], N), universe, [], 2020.0, 2024.0)
    got = replicate.median_coverage(supply(replicate.supply_simulation), replicate.replicate_levels(made.where("segment = 'otra'"), 2020.0, 2023.0))
    demand = replicate.replicate_levels(written.where("segment = 'otra'"), 2020.0, 2023.0).select("segment", "unit", F.col("levels").alias("demand"))
    both = demand.join(supply(replicate.simulate_supply).select("unit", F.col("levels").alias("supply")), "unit")
    want = both.select("segment", "unit", replicate.array_median(replicate.coverage_replicates("supply", "demand")).alias("coverage"))
    _close(got, want, ["segment", "unit"])
    found = {r.unit: r.coverage for r in got.collect()}
    assert found[units[0]] == 0.0 and found[units[1]] is None and found[units[2]] > 0 and found[units[3]] is None and len(found) == len(units) - 2


@pytest.mark.parametrize("name", ["a10_replicate_quantiles", "a11_threshold_probabilities", "m13_coverage_per_replicate"])
def test_summaries_of_replicates_write_none(spark, sf_dir, monkeypatch, name):
    def written(*_, **__):
        raise AssertionError("replicates of units are written")

    monkeypatch.setattr(replicate, "simulate_supply", written)
    monkeypatch.setattr(replicate, "simulate_demand", written)
    assert QUERIES[name](spark, sf_dir).count()
