"""Replicate-based projection.

A simulation is one row per unit holding its replicate rates as arrays of a fixed length
(``n_sim``), so summaries need no shuffle. Where units combine within a replicate (ratio control,
roll-ups, levels of several cells) arrays are added element by element: a row is dealt into
chunks of ``CHUNK`` replicates, each chunk is one row of sums, and these are combined map-side per
(group, chunk). A group of any size costs ``n_sim / CHUNK`` rows for each task that holds some of it.

Columns of a simulation: keys, ``unit, grp, n_obs, base, conf_base, cap``, ``r`` (array) and
``r_fixed`` (array of arrays, one per fixed persistence; empty for supply).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import draws, rules
from geopanel.operators import estimate
from geopanel.operators.calendar import Calendar
from geopanel.operators.meet import with_groups
from geopanel.operators.simulation import MAX_RATE, QUANTILES, Levels, Simulation, median_ratios, simulation
from geopanel.session import materialised, spread

N_SIM = 4000  # fixed value
FIXED_PERSISTENCE = (0.25, 0.60, 1.00)  # fixed values


#: Replicates that one row of partial sums holds.
CHUNK = 32


def replicates(df: DataFrame, n_sim: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_sim - 1))))


def vector_sums(df: DataFrame, keys: Sequence[str], vectors: dict[str, Column], shape: Callable[[Column], Column], totals: dict[str, Column], plain: Sequence[str] = ()) -> DataFrame:
    """Element-wise sums over the rows of each key: for each of ``vectors`` (arrays of one length) the sums of ``shape(element)`` as
    an array. ``totals`` are aggregates of the same rows; ``plain`` names the columns that ``shape`` and ``totals`` read besides."""
    keys, names = list(keys), list(vectors)
    # Columns of their own first: inside the chunks an expression would be evaluated for each of them.
    held = df.select(*keys, *plain, *[v.alias(f"_v{i}") for i, v in enumerate(vectors.values())])

    def chunks(i: int) -> Column:
        last = F.ceil(F.size(f"_v{i}") / CHUNK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(F.lit(i).alias("v"), c.alias("c"), F.slice(f"_v{i}", c * CHUNK + 1, CHUNK).alias("x")))

    rows = held.select(*keys, *plain, F.explode(F.flatten(F.array(*[chunks(i) for i in range(len(names))]))).alias("_chunk"))
    element = lambda i: shape(F.get(F.col("_chunk.x"), F.lit(i)))
    sums = rows.groupBy(*keys, F.col("_chunk.v").alias("_v"), F.col("_chunk.c").alias("_c")).agg(
        *[c.alias(n) for n, c in totals.items()], *[F.sum(element(i)).alias(f"_s{i}") for i in range(CHUNK)]
    )
    # One entry for each chunk: bounded by the number of replicates.
    part = F.struct("_v", "_c", F.array(*[f"_s{i}" for i in range(CHUNK)]).alias("s"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("_parts"), *[F.max(n).alias(n) for n in totals])  # totals are equal on every chunk
    whole = lambda i: F.filter(F.flatten(F.transform(F.filter("_parts", lambda p: p["_v"] == i), lambda p: p["s"])), lambda x: x.isNotNull())
    return packed.select(*keys, *totals, *[whole(i).alias(n) for i, n in enumerate(names)])


def _bounded(r: Column) -> Column:
    return F.least(F.greatest(r, F.lit(-MAX_RATE)), F.lit(MAX_RATE))


# --- demand ------------------------------------------------------------------------------------


def demand_inputs(demand: DataFrame, control: DataFrame, cal: Calendar, keys: Sequence[str], sd_floor: float = 0.0) -> DataFrame:
    """Posterior of every eligible unit next to its group's anchor, ratio and shock size.

    A group none of whose units was observed twice has no rate to shrink to: its units get no
    projection and are published as no-data.
    """
    rates = estimate.demand_rates(demand, keys, cal.dt).where("rho IS NOT NULL")
    joined = with_groups(rates, estimate.control_summary(control, cal), ["grp"])
    return joined.select(
        *keys,
        "unit",
        "grp",
        "n_obs",
        F.col("d1").alias("base"),
        F.col("d1").alias("conf_base"),
        rules.confidence_cap("relation").alias("cap"),
        "rho",
        "rho_future",
        "ratio",
        F.abs(F.col("rho") - F.col("rho_past")).alias("shock_sd"),
        "r_tilde",
        F.sqrt(F.greatest("var_post", F.lit(sd_floor * sd_floor))).alias("sd"),
    )


def _persistences(rep: Column, source: str, seed: int, fixed: Sequence[float], lam: float | None) -> list[Column]:
    main = draws.persistence(rep, source, seed) if lam is None else F.lit(float(lam))
    return [main, *[F.lit(float(x)) for x in fixed]]


def simulate_demand(
    inputs: DataFrame,
    cal: Calendar,
    keys: Sequence[str],
    n_sim: int = N_SIM,
    source: str = "hash",
    seed: int = draws.SEED,
    lam: float | None = None,
    fixed: Sequence[float] = FIXED_PERSISTENCE,
    unit_id: Column | None = None,
    group_id: Column | None = None,
) -> DataFrame:
    """Anchor + persistence × local deviation, tied to the control ratio per group and replicate,
    then shifted by one shared shock per (group, replicate). The inputs feed both passes, so they are
    materialised once."""
    keys = list(keys)
    inputs = materialised(inputs)
    span = cal.demand_span
    uid = unit_id if unit_id is not None else F.col("unit")
    gid = group_id if group_id is not None else F.xxhash64("grp")
    reps = F.sequence(F.lit(0), F.lit(n_sim - 1))
    # Draws multiply each row: partitions follow rows times replicates, not bytes.
    units = spread(inputs, "unit", weight=inputs.count() * n_sim).withColumn("_gid", gid)
    draw = lambda rep: F.col("r_tilde") + draws.normal(uid, rep, 1, source, seed) * F.col("sd") - F.col("rho")
    units = materialised(units.withColumn("_dev", F.transform(reps, draw)))

    def pull(i: int) -> Column:
        share = lambda rep: _persistences(rep, source, seed, fixed, lam)[i]
        return F.transform("_dev", lambda dev, rep: F.col("rho_future") + share(rep) * dev)

    pulls = {f"_p{i}": pull(i) for i in range(1 + len(fixed))}
    level = lambda x: F.col("base") * F.exp(x * span)
    first = {"_base": F.sum("base"), "_ratio": F.first("ratio"), "_shock": F.first("shock_sd")}
    sums = vector_sums(units, [*keys, "grp", "_gid"], pulls, level, first, ["base", "ratio", "shock_sd"])
    sums = sums.withColumn("_z", F.transform(reps, lambda rep: draws.normal(F.col("_gid"), rep, 2, source, seed) * F.col("_shock")))
    shifts = sums.select(*keys, "grp", *[_group_shift(f"_p{i}", span).alias(f"_k{i}") for i in range(len(pulls))])
    joined = with_groups(units, shifts, [*keys, "grp"], width=n_sim * len(pulls))

    lams = lambda rep: _persistences(rep, source, seed, fixed, lam)
    # One pass for each persistence.
    rates = lambda i: F.transform("_dev", lambda dev, rep: _bounded(F.col("rho_future") + lams(rep)[i] * dev + F.get(f"_k{i}", rep)))

    return joined.select(
        *keys, "unit", "grp", "n_obs", "base", "conf_base", "cap",
        rates(0).alias("r"),
        F.array(*[rates(i + 1) for i in range(len(fixed))]).alias("r_fixed"),
    )


def demand_simulation(
    inputs: DataFrame,
    cal: Calendar,
    keys: Sequence[str],
    n_sim: int = N_SIM,
    source: str = "hash",
    seed: int = draws.SEED,
    lam: float | None = None,
    fixed: Sequence[float] = FIXED_PERSISTENCE,
    unit_id: Column | None = None,
    group_id: Column | None = None,
) -> Simulation:
    """:func:`simulate_demand` without writing replicates of units: one pass adds up levels for the groups' shifts, and whatever
    reads the simulation makes its rates again."""
    keys = list(keys)
    inputs = materialised(inputs)
    gid = group_id if group_id is not None else F.xxhash64("grp")
    main = draws.persistences(n_sim, source, seed) if lam is None else float(lam)
    units = inputs.withColumnRenamed("r_tilde", "mid").drop("ratio", "shock_sd")
    sim = simulation(units, keys, n_sim, source, seed, unit_id if unit_id is not None else F.col("unit"), 1, [main, *map(float, fixed)])
    span, width = cal.demand_span, 1 + len(fixed)
    parts = sim.unshifted_sums(span)
    totals = vector_sums(parts, [*keys, "grp"], {f"_p{i}": F.col(f"_t{i}") for i in range(width)}, lambda x: x, {})
    groups = inputs.groupBy(*keys, "grp").agg(F.sum("base").alias("_base"), F.first("ratio").alias("_ratio"), F.first("shock_sd").alias("_shock"))
    reps = F.sequence(F.lit(0), F.lit(n_sim - 1))
    sums = totals.join(groups.withColumn("_gid", gid), [*keys, "grp"])
    sums = sums.withColumn("_z", F.transform(reps, lambda rep: draws.normal(F.col("_gid"), rep, 2, source, seed) * F.col("_shock")))
    return sim.shifted(sums.select(*keys, "grp", *[_group_shift(f"_p{i}", span).alias(f"_k{i}") for i in range(width)]))


def _group_shift(levels: str, span: float) -> Column:
    """What ties a group's summed levels to its control ratio, plus its shock."""
    return F.zip_with(levels, "_z", lambda total, z: F.log(F.col("_ratio") * F.col("_base") / total) / span + z)


# --- supply ------------------------------------------------------------------------------------


def supply_simulation(
    posterior: DataFrame,
    keys: Sequence[str],
    n_sim: int = N_SIM,
    source: str = "hash",
    seed: int = draws.SEED,
    unit_id: Column | None = None,
) -> Simulation:
    """:func:`simulate_supply` without writing replicates."""
    keys = list(keys)
    units = posterior.select(
        *keys, "unit", "grp", *_supply_columns(), F.col("b_tilde").alias("mid"), F.sqrt("var_post").alias("sd")
    )
    return simulation(units, keys, n_sim, source, seed, unit_id if unit_id is not None else F.col("unit"), 3)


def _supply_columns() -> list[Column]:
    return [
        F.lit(3).alias("n_obs"),
        F.element_at("s", -1).cast("double").alias("base"),
        F.lit(None).cast("double").alias("conf_base"),
        F.lit("media").alias("cap"),
    ]


def simulate_supply(
    posterior: DataFrame,
    keys: Sequence[str],
    n_sim: int = N_SIM,
    source: str = "hash",
    seed: int = draws.SEED,
    unit_id: Column | None = None,
) -> DataFrame:
    uid = unit_id if unit_id is not None else F.col("unit")
    sd = F.sqrt("var_post")
    stream = 3
    r = F.transform(
        F.sequence(F.lit(0), F.lit(n_sim - 1)),
        lambda rep: _bounded(F.col("b_tilde") + draws.normal(uid, rep, stream, source, seed) * sd),
    )
    return posterior.select(
        *keys, "unit", "grp",
        *_supply_columns(),
        r.alias("r"),
        F.array().cast("array<array<double>>").alias("r_fixed"),
    )


# --- roll-up -----------------------------------------------------------------------------------


def roll_up(sim: DataFrame | Simulation, keys: Sequence[str], span: float, demand: bool, root: str | None = None) -> DataFrame:
    """Add projected levels per replicate within each group; the group rate is their log ratio to the
    summed base. Groups with base 0 have no rate and drop out. ``root`` aggregates everything into one; it may be given the
    groups' own roll-up, whose levels add up to the same."""
    keys, n_fixed = list(keys), len(FIXED_PERSISTENCE) if demand else 0
    totals = {"total": F.sum("base"), "most_obs": F.max("n_obs"), "total_conf": F.sum("conf_base")}
    if isinstance(sim, Simulation):
        named = lambda df: df.withColumn("grp", F.lit(root)) if root else df
        vectors = {"m": F.col("_t0")} | {f"f{i}": F.col(f"_t{i + 1}") for i in range(n_fixed)}
        sums = vector_sums(named(sim.level_sums(float(span))), [*keys, "grp"], vectors, lambda x: x, {})
        sums = sums.join(named(sim.units).groupBy(*keys, "grp").agg(*[c.alias(n) for n, c in totals.items()]), [*keys, "grp"])
    else:
        src = sim.withColumn("grp", F.lit(root)) if root else sim
        vectors = {"m": F.col("r")} | {f"f{i}": F.get(F.col("r_fixed"), F.lit(i)) for i in range(n_fixed)}
        sums = vector_sums(src, [*keys, "grp"], vectors, lambda x: F.col("base") * F.exp(x * float(span)), totals, ["base", "n_obs", "conf_base"])
    rate = lambda c: F.transform(c, lambda level: F.log(level / F.col("total")) / float(span))
    fixed = F.array(*[rate(f"f{i}") for i in range(n_fixed)]) if n_fixed else F.array().cast("array<array<double>>")
    return sums.where("total > 0").select(
        *keys,
        F.col("grp").alias("unit"),
        "grp",
        F.col("most_obs").alias("n_obs"),
        F.col("total").alias("base"),
        F.col("total_conf").alias("conf_base"),
        F.lit(None if demand else "media").cast("string").alias("cap"),
        rate("m").alias("r"),
        fixed.alias("r_fixed"),
    )


# --- summaries ---------------------------------------------------------------------------------


def _share(r: Column, test) -> Column:
    return F.size(F.filter(r, test)) / F.size(r)


def _quantile(ordered: Column, p: float, shape=lambda x: x) -> Column:
    """Linear-interpolation quantile of ``shape(x)`` for a monotone ``shape`` on a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(p)
    lo = F.floor(at).cast("int")
    low = shape(F.get(ordered, lo))
    high = shape(F.get(ordered, F.least(lo + 1, F.size(ordered) - 1)))
    return low + (at - lo) * (high - low)


def probabilities(sim: DataFrame, delta: float = rules.DEAD_BAND) -> DataFrame:
    """``p_up, p_down, p_flat, stable`` and the sorted replicate array ``r``."""
    up = lambda a: _share(a, lambda x: x > delta)
    down = lambda a: _share(a, lambda x: x < -delta)
    verdicts = F.transform("r_fixed", lambda a: rules.verdict(up(a), down(a)))
    return (
        sim.withColumn("p_up", up(F.col("r")))
        .withColumn("p_down", down(F.col("r")))
        .withColumn("p_flat", _share(F.col("r"), lambda x: F.abs(x) <= delta))
        .withColumn("stable", F.size(F.array_distinct(verdicts)) <= 1)
        .withColumn("r", F.sort_array("r"))
        .drop("r_fixed")
    )


def statistics(sim: Simulation, delta: float = rules.DEAD_BAND) -> DataFrame:
    """:func:`probabilities` of a simulation that is not written out, with the replicates next to the quantiles instead of all."""
    stats = sim.statistics(delta)
    verdicts = F.zip_with("up", "down", lambda up, down: rules.verdict(up, down))
    return stats.withColumn("stable", F.size(F.array_distinct(verdicts)) <= 1).drop("up", "down")


def _quantile_between(n_sim: int, p: float, shape=lambda x: x) -> Column:
    """:func:`_quantile` from the replicates next to it."""
    at, i = (n_sim - 1) * p, QUANTILES.index(p)
    low, high = (shape(F.get(F.col(c), F.lit(i))) for c in ("low", "high"))
    return low + F.lit(at - int(at)) * (high - low)


def quantile(sim: DataFrame | Simulation, p: float) -> Column:
    """The ``p`` quantile of the replicates, over the rows of :func:`statistics` or, of a written simulation, :func:`probabilities`."""
    return _quantile_between(sim.made.n_sim, p) if isinstance(sim, Simulation) else _quantile(F.col("r"), p)


def summarise(
    sim: DataFrame | Simulation, keys: Sequence[str], cal: Calendar, horizons: Sequence[str], delta: float = rules.DEAD_BAND
) -> DataFrame:
    """One row per unit × horizon: median rate, change since the base date with its 95 % interval,
    probabilities, verdict and confidence. Verdict and confidence do not depend on the horizon."""
    years = dict(cal.horizons)
    if isinstance(sim, Simulation):
        p, quantile = statistics(sim, delta), lambda *a: _quantile_between(sim.made.n_sim, *a)
    else:
        p, quantile = probabilities(sim, delta), lambda *a: _quantile(F.col("r"), *a)
    p_dec = rules.decided_probability("p_up", "p_down", "p_flat")
    p = p.withColumn("p_dec", p_dec).withColumn("verdict", rules.verdict("p_up", "p_down"))
    p = p.withColumn(
        "confidence", rules.confidence(F.col("p_dec"), F.col("stable"), F.col("n_obs"), F.col("conf_base"), F.col("cap"))
    )
    dims = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(float(years[h])).alias("years")) for h in horizons])
    rows = p.select("*", F.inline(dims))
    change = lambda x: (F.exp(x * F.col("years")) - 1.0) * 100.0
    return rows.select(
        *keys, "unit", "grp", "horizon", "n_obs", "base",
        (quantile(0.5) * 100.0).alias("rate_pct"),
        quantile(0.5, change).alias("delta_pct"),
        quantile(0.025, change).alias("ci_lo"),
        quantile(0.975, change).alias("ci_hi"),
        "p_up", "p_down", "p_flat", "p_dec", "stable", "verdict", "confidence",
    )


def level_at(sim: DataFrame, keys: Sequence[str], t0: float, t: float) -> DataFrame:
    """Level at a date from the median rate, to one decimal."""
    median = _quantile(F.sort_array("r"), 0.5)
    return sim.select(*keys, "unit", "grp", F.bround(F.col("base") * F.exp(median * (t - t0)), 1).alias("level_base"))


def replicate_levels(sim: DataFrame | Simulation, t0: float, t: float) -> DataFrame | Levels:
    span = t - t0
    if isinstance(sim, Simulation):
        return Levels(sim, span)
    return sim.withColumn("levels", F.transform("r", lambda x: F.col("base") * F.exp(x * span)))


def summed_levels(sim: DataFrame | Simulation, universe: DataFrame, keys: Sequence[str], t0: float, t: float) -> DataFrame | Levels:
    """Add all cells' replicate levels per unit; units without any simulated cell get zeros.

    ``keys`` are kept (e.g. branch), of written simulations only; the universe is expected to carry them.
    """
    if isinstance(sim, Simulation):
        if keys:
            raise ValueError("sums of a simulation that is not written keep no keys")
        return Levels(sim, t - t0, universe)
    packed = vector_sums(sim, [*keys, "unit"], {"levels": F.col("r")}, lambda x: F.col("base") * F.exp(x * (t - t0)), {}, ["base"])
    return universe.join(packed, [*keys, "unit"], "left")


def group_levels(sim: DataFrame, keys: Sequence[str], t0: float, t: float) -> DataFrame:
    """Replicate levels added up within each group."""
    return vector_sums(sim, [*keys, "grp"], {"levels": F.col("r")}, lambda x: F.col("base") * F.exp(x * (t - t0)), {}, ["base"])


def coverage_replicates(supply: str, demand: str) -> Column:
    """Per replicate: supply / demand × 1000; NULL where demand is not positive, missing supply is 0."""
    s, d = F.col(supply), F.col(demand)
    filled = F.coalesce(s, F.transform(d, lambda _: F.lit(0.0)))
    return F.zip_with(filled, d, lambda a, b: F.when(b > 0, a / b * 1000.0))


def array_median(c: str | Column) -> Column:
    a = F.col(c) if isinstance(c, str) else c
    ordered = F.sort_array(F.filter(a, lambda x: x.isNotNull()))
    return F.when(F.size(ordered) > 0, _quantile(ordered, 0.5))


def median_coverage(supply: Levels, demand: Levels) -> DataFrame:
    """Keys, ``unit`` and ``coverage`` of every demand row whose unit the supply's universe holds: the :func:`array_median` of its
    :func:`coverage_replicates`, without writing any."""
    found = median_ratios(supply, demand, 1000.0).withColumnRenamed("median", "coverage")
    return found if supply.universe is None else found.join(supply.universe.select("unit"), "unit")
