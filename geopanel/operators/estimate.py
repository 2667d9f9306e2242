"""Rates, shrinkage, control series and Poisson trends as table-to-table plans.

``keys`` are the loop dimensions (segment, branch, cell, fraction …): one plan estimates them all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions.scalars import log_rate, log_rate_variance
from geopanel.operators.calendar import Calendar
from geopanel.operators.meet import with_groups
from geopanel.session import materialised, spread

RELIABLE_VARIANCE = 10.0  # fixed value: a slope variance at or above this is numerically separated
MIN_DISPERSION = 1.0  # fixed value
FIT_STEPS = 25  # fixed value


# --- demand ------------------------------------------------------------------------------------


def eligible(demand: DataFrame) -> DataFrame:
    return demand.where(F.col("reason").isNull())


def moments(r: Column, psi: Column, suffix: str = "") -> list[Column]:
    """Group sums from which the pooled variance follows: no second pass over the units is needed."""
    return [
        F.count(r).alias(f"n{suffix}"),
        F.sum(r).alias(f"r1{suffix}"),
        F.sum(r * r).alias(f"r2{suffix}"),
        F.sum(F.when(r.isNotNull(), psi)).alias(f"p{suffix}"),
    ]


def squared_gap(rho: str, suffix: str = "") -> str:
    """SQL text for Σ (r − ρ)² of a group."""
    return f"(r2{suffix} - 2 * {rho} * r1{suffix} + n{suffix} * {rho} * {rho})"


def pooled_variance(groups: DataFrame, keys: Sequence[str], rho: str = "rho", scale: str = "1D") -> DataFrame:
    """``tau2`` per key: max(0, mean((r − ρ)²) − mean(ψ)) over all units of all groups. When the groups
    carry ``_u`` moments (usable units only), those are used unless no unit is usable."""
    def moment(suffix: str) -> str:
        return f"try_divide(sum({squared_gap(rho, suffix)}) - sum({scale} * p{suffix}), nullif(sum(n{suffix}), 0))"

    expr = f"coalesce({moment('_u')}, {moment('')})" if "n_u" in groups.columns else moment("")
    return groups.groupBy(*keys).agg(F.expr(f"greatest(0D, {expr})").alias("tau2"))


def shrunk(r: str = "r_hat", psi: str = "psi", rho: str = "rho") -> dict[str, Column]:
    """``b, r_tilde, var_post`` from a unit's rate, its variance, its group's rate and ``tau2``.

    Without a rate of its own a unit gets ``r_tilde = ρ`` and ``var_post = τ²``.
    """
    b = f"coalesce(try_divide({psi}, {psi} + tau2), 1D)"
    return {
        "b": F.expr(f"if({r} IS NULL, NULL, {b})"),
        "r_tilde": F.expr(f"if({r} IS NULL, {rho}, {b} * {rho} + (1 - {b}) * {r})"),
        "var_post": F.expr(f"if({r} IS NULL, tau2, (1 - {b}) * {psi})"),
    }


def with_direct_rates(demand: DataFrame, dt: float, later: str = "d1", thin: float | Column = 1.0) -> DataFrame:
    return demand.withColumns({"r_hat": log_rate("d0", later, dt), "psi": log_rate_variance("d0", later, dt, thin)})


def group_rates(units: DataFrame, keys: Sequence[str], dt: float, later: str = "d1") -> DataFrame:
    """Rate of a group's summed counts over units observed twice, with the moments of its units' rates."""
    rated = units if "r_hat" in units.columns else with_direct_rates(units, dt, later)
    both = rated.where(F.col("d0").isNotNull() & F.col(later).isNotNull())
    sums = both.groupBy(*keys, "grp").agg(
        F.sum("d0").alias("sum_d0"), F.sum(later).alias("sum_d1"), *moments(F.col("r_hat"), F.col("psi"))
    )
    return sums.withColumn("rho", log_rate("sum_d0", "sum_d1", dt))


def shrink_to_groups(units: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join each unit to its group's rate and its key's pooled variance, and shrink."""
    keys = list(keys)
    tau = pooled_variance(groups, keys)
    out = with_groups(units, groups.select(*keys, "grp", "rho"), [*keys, "grp"], how="left")
    out = out.join(tau, keys, "left") if keys else out.select("*", tau.scalar().alias("tau2"))
    return out.withColumns(shrunk())


def demand_rates(demand: DataFrame, keys: Sequence[str], dt: float) -> DataFrame:
    """Eligible units with direct rate, group rate, shrunk rate and number of observations."""
    units = with_direct_rates(eligible(demand), dt)
    out = shrink_to_groups(units, group_rates(units, keys, dt), keys)
    return out.withColumn("n_obs", F.when(F.col("r_hat").isNotNull(), 2).otherwise(1))


# --- control series ----------------------------------------------------------------------------


def control_levels(control: DataFrame, times: dict[str, float]) -> DataFrame:
    """``grp`` plus one interpolated level per entry of ``times``.

    Values belong to mid-year; between two years the log is linear, outside the range the nearest
    year holds.
    """
    t = F.col("year") + F.lit(0.5)
    logged = control.select("grp", t.cast("double").alias("t"), F.log("population").alias("v"))
    aggs = []
    for name, at in times.items():
        below, above = F.col("t") <= float(at), F.col("t") >= float(at)
        aggs += [
            F.max(F.when(below, F.col("t"))).alias(f"_{name}_t0"),
            F.max_by(F.when(below, F.col("v")), F.when(below, F.col("t"))).alias(f"_{name}_v0"),
            F.min(F.when(above, F.col("t"))).alias(f"_{name}_t1"),
            F.min_by(F.when(above, F.col("v")), F.when(above, F.col("t"))).alias(f"_{name}_v1"),
        ]
    table = logged.groupBy("grp").agg(*aggs)
    out = []
    for name, at in times.items():
        t0, v0, t1, v1 = (F.col(f"_{name}_{c}") for c in ("t0", "v0", "t1", "v1"))
        share = F.coalesce(F.try_divide(F.lit(float(at)) - t0, t1 - t0), F.lit(0.0))
        out.append(F.exp(F.coalesce(v0 + share * (v1 - v0), v0, v1)).alias(name))
    return table.select("grp", *out)


def control_rate(control: DataFrame, t0: float, t1: float) -> DataFrame:
    levels = control_levels(control, {"c0": t0, "c1": t1})
    return levels.select("grp", (F.log(F.col("c1") / F.col("c0")) / (t1 - t0)).alias("control_rate"))


def control_summary(control: DataFrame, cal: Calendar) -> DataFrame:
    """Per group: past rate, future anchor rate and the level ratio the projection must reproduce."""
    c = control_levels(control, {"c_t0": cal.t0, "c_t1": cal.t1, "c_from": cal.control_from, "c_far": cal.t_far})
    return c.select(
        "grp",
        (F.log(F.col("c_t1") / F.col("c_t0")) / (cal.t1 - cal.t0)).alias("rho_past"),
        (F.log(F.col("c_far") / F.col("c_from")) / (cal.t_far - cal.control_from)).alias("rho_future"),
        (F.col("c_far") / F.col("c_t1")).alias("ratio"),
    )


def source_comparison(demand: DataFrame, control: DataFrame, cal: Calendar) -> DataFrame:
    """Census rate against control rate per group, in percentage points per year."""
    census = group_rates(eligible(demand), [], cal.dt)
    pct = lambda c: F.bround(c * 100.0, 2)
    return census.join(control_rate(control, cal.t0, cal.t1), "grp").select(
        "grp",
        pct(F.col("rho")).alias("census_pct"),
        pct(F.col("control_rate")).alias("control_pct"),
        pct(F.col("rho") - F.col("control_rate")).alias("gap_pp"),
    )


# --- supply ------------------------------------------------------------------------------------


#: exp and ln of the C library. numpy's own, used where the processor has wider registers, differ from them in the last bit,
#: which decides how a variance is rounded that ends in a 5 (counts 8, 0, 8 give 3 / 128).
_exp, _log = (np.frompyfunc(f, 1, 1) for f in (math.exp, math.log))


def _scoring_steps(y: np.ndarray, x: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fisher scoring of ``log E[y] = a + b·x`` for every row of ``y`` at once.

    Rows never influence each other, so a row's result does not depend on its batch. The linear
    predictor is held within ±30: separated counts end at a finite slope with a huge variance.
    """
    a, b = _log(np.maximum(y.mean(axis=1), 0.1)).astype(float), np.zeros(len(y))

    def weights(a, b):
        eta = np.clip(a[:, None] + b[:, None] * x, -30.0, 30.0)
        mu = _exp(eta).astype(float)
        w0, w1, w2 = mu.sum(axis=1), (mu * x).sum(axis=1), (mu * x * x).sum(axis=1)
        return eta, mu, w0, w1, w2, w0 * w2 - w1 * w1

    for _ in range(steps):
        eta, mu, w0, w1, w2, det = weights(a, b)
        z = mu * eta + y - mu
        u0, u1 = z.sum(axis=1), (z * x).sum(axis=1)
        a, b = (w2 * u0 - w1 * u1) / det, (w0 * u1 - w1 * u0) / det
    *_, w0, w1, w2, det = weights(a, b)
    return a, b, w0 / det


def poisson_fit(counts: str, xs: Sequence[float], steps: int = FIT_STEPS) -> Column:
    """struct(a, b, var_b) for an array of counts, NULL where all counts are 0.

    An iterative fit has no built-in expression, and written with higher-order functions it ran two
    orders of magnitude slower than this Arrow batch over plain double columns.
    """
    x = np.array(xs, dtype=float)

    @F.pandas_udf("a double, b double, var_b double")
    def fit(*columns: pd.Series) -> pd.DataFrame:
        y = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        out = np.full((len(y), 3), np.nan)
        live = y.sum(axis=1) > 0
        different, row = np.unique(y[live], axis=0, return_inverse=True)
        with np.errstate(all="ignore"):
            out[live] = np.column_stack(_scoring_steps(different, x, steps))[row.ravel()]
        return pd.DataFrame(out, columns=["a", "b", "var_b"])

    return fit(*[F.expr(f"double({counts}[{i}])") for i in range(len(xs))])


def fit_supply(wide: DataFrame, cal: Calendar) -> DataFrame:
    """Poisson trend per row of ``supply_wide``: ``a_hat, b_hat, var_b, no_data, reliable``."""
    xs = [c - cal.centre for c in cal.cuts]
    fit = F.col("_fit")
    return (
        wide.withColumn("_fit", poisson_fit("s", xs))
        .select(
            *wide.columns,
            fit["a"].alias("a_hat"),
            fit["b"].alias("b_hat"),
            fit["var_b"].alias("var_b"),
            fit["a"].isNull().alias("no_data"),
        )
        .withColumn("reliable", F.coalesce(F.col("var_b") < RELIABLE_VARIANCE, F.lit(False)))
    )


def pearson(cal: Calendar) -> Column:
    """Σ (y − μ)² / μ over the cuts, with μ floored at 1e-6."""
    mu = [f"greatest(exp(a_hat + b_hat * {cut - cal.centre!r}D), 1e-6D)" for cut in cal.cuts]
    return F.expr(" + ".join(f"pow(s[{i}] - {m}, 2) / {m}" for i, m in enumerate(mu)))


def group_trend(fit: DataFrame, keys: Sequence[str], cal: Calendar) -> DataFrame:
    """One pass per group of fitted units: the same trend on the group's totals (``b_grp, var_grp``),
    over-dispersion ``phi`` = max(1, Σ Pearson / units), and the moments of the unit slopes."""
    xs = [c - cal.centre for c in cal.cuts]
    totals = F.expr("array(" + ", ".join(f"sum(s[{i}])" for i in range(len(cal.cuts))) + ")")
    slope, var = F.col("b_hat"), F.col("var_b")
    usable = F.when(F.col("reliable"), slope)
    g = (
        fit.where(~F.col("no_data"))
        .groupBy(*keys, "grp")
        .agg(
            totals.alias("s"),
            F.greatest(F.lit(MIN_DISPERSION), F.avg(pearson(cal))).alias("phi"),
            *moments(slope, var),
            *moments(usable, var, "_u"),
        )
        .withColumn("_fit", poisson_fit("s", xs))
    )
    return g.select("*", F.col("_fit.b").alias("b_grp"), F.col("_fit.var_b").alias("var_grp")).drop("_fit", "s")


def supply_posterior(fit: DataFrame, keys: Sequence[str], cal: Calendar, sd_floor: float = 0.0) -> DataFrame:
    """Shrunk slope and its variance per unit: counts error inflated by φ, plus the group slope's own
    error. The fit feeds the group pass and the result, so it is materialised once."""
    keys = list(keys)
    live = materialised(spread(fit.where(~F.col("no_data")), "unit"))
    groups = group_trend(live, keys, cal)
    tau = pooled_variance(groups, keys, "b_grp", "phi")
    out = with_groups(live, groups.select(*keys, "grp", "b_grp", "var_grp", "phi"), [*keys, "grp"]).join(tau, keys)
    out = out.withColumn("psi", F.col("var_b") * F.col("phi")).withColumns(shrunk("b_hat", "psi", "b_grp"))
    var = F.expr(f"greatest(var_post + b * b * var_grp * phi, {float(sd_floor) ** 2}D)")
    return out.withColumn("var_post", var).withColumnRenamed("r_tilde", "b_tilde")


def attenuated_rate(wide: DataFrame, cal: Calendar) -> DataFrame:
    """Rate from the first two cuts only."""
    s = lambda i: F.get(F.col("s"), F.lit(i))
    return wide.withColumn("rate_b", log_rate(s(0), s(1), cal.cuts[1] - cal.cuts[0]))


def supply_scenarios(fit: DataFrame, cal: Calendar) -> DataFrame:
    """Full-fit against attenuated rate per unit, with their range, in %/year."""
    both = attenuated_rate(fit, cal).where(F.col("b_hat").isNotNull() & F.col("rate_b").isNotNull())
    keep = [c for c in ("unit", "cell", "grp", "b_hat", "reliable") if c in fit.columns]
    pct = lambda c: F.bround(c * 100.0, 2)
    return both.select(
        *keep,
        pct(F.col("b_hat")).alias("rate_a_pct"),
        pct(F.col("rate_b")).alias("rate_b_pct"),
        pct(F.abs(F.col("b_hat") - F.col("rate_b"))).alias("range_pp"),
    )
