"""Roll-ups and summaries of the supply simulation over its replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.operators import replicate
from geopanel.plans.projection import N_SIM, _supply_sim, supply_sql
from geopanel.plans.registry import query, r6
from geopanel.plans.roles import CAL, Roles

_SIM = "SELECT cell, unit, grp, s2, rep, r AS x FROM ssim"


@query(
    "a08_group_rollup_per_replicate",
    supply_sql(f"SELECT cell, grp, rep, {r6('ln(sum(s2 * exp(x * 4)) / sum(s2)) / 4')} AS r, CAST(sum(s2) AS DOUBLE) AS base FROM ({_SIM}) GROUP BY 1, 2, 3 HAVING sum(s2) > 0"),
)
def rollup(r: Roles):
    rolled = replicate.roll_up(_supply_sim(r), ["cell"], CAL.supply_span, demand=False)
    return rolled.select("cell", "grp", "base", F.posexplode("r").alias("rep", "r"))


@query(
    "a09_root_rollup_per_replicate",
    supply_sql(f"SELECT cell, rep, {r6('ln(sum(s2 * exp(x * 4)) / sum(s2)) / 4')} AS r, CAST(sum(s2) AS DOUBLE) AS base FROM ({_SIM}) GROUP BY 1, 2 HAVING sum(s2) > 0"),
)
def root(r: Roles):
    groups = replicate.roll_up(_supply_sim(r), ["cell"], CAL.supply_span, demand=False)
    rolled = replicate.roll_up(groups, ["cell"], CAL.supply_span, demand=False, root="root")
    return rolled.select("cell", "base", F.posexplode("r").alias("rep", "r"))


@query(
    "a10_replicate_quantiles",
    supply_sql(
        f"""SELECT cell, unit, {r6('quantile_cont(x, 0.025)')} AS q_lo, {r6('quantile_cont(x, 0.5)')} AS q_mid, {r6('quantile_cont(x, 0.975)')} AS q_hi
        FROM ({_SIM}) GROUP BY 1, 2""",
    ),
)
def replicate_quantiles(r: Roles):
    q = lambda p, name: replicate.quantile(r.supply_run, p).alias(name)
    return replicate.statistics(r.supply_run).select("cell", "unit", q(0.025, "q_lo"), q(0.5, "q_mid"), q(0.975, "q_hi"))


_SHARE = lambda cond: r6(f"avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END)")


@query(
    "a11_threshold_probabilities",
    supply_sql(
        f"SELECT cell, unit, {_SHARE('x > 0.01e0')} AS p_up, {_SHARE('x < -0.01e0')} AS p_down, {_SHARE('abs(x) <= 0.01e0')} AS p_flat FROM ({_SIM}) GROUP BY 1, 2",
    ),
)
def threshold(r: Roles):
    return replicate.statistics(r.supply_run).select("cell", "unit", "p_up", "p_down", "p_flat")


@query(
    "j13_sum_cells_over_universe",
    supply_sql(
        f"""SELECT u.unit, x.rep, {r6('coalesce(sum(w.s2 * exp(w.r * 4)), 0)')} AS level
        FROM supps u CROSS JOIN (SELECT unnest(range(0, {N_SIM})) AS rep) x LEFT JOIN ssim w ON w.unit = u.unit AND w.rep = x.rep GROUP BY 1, 2""",
    ),
)
def sum_cells(r: Roles):
    sim = _supply_sim(r)
    out = replicate.summed_levels(sim, r.suppliers.select("unit"), [], CAL.cuts[-1], CAL.cuts[-1] + 4.0)
    zeros = F.transform(F.sequence(F.lit(0), F.lit(N_SIM - 1)), lambda _: F.lit(0.0))
    return out.select("unit", F.posexplode(F.coalesce("levels", zeros)).alias("rep", "level"))
