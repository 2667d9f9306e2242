"""Back-tests and calibration as fold tables: the loops are columns of one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import draws, rules
from geopanel.functions.scalars import array_of, log_rate, log_rate_variance
from geopanel.operators import estimate
from geopanel.operators.calendar import Calendar
from geopanel.operators.trend import Z_975
from geopanel.operators.meet import with_groups
from geopanel.session import materialised, spread

# Fixed values of the validation.
FRACTIONS = (0.25, 0.5)
FLOOR_GRID = (0.000, 0.005, 0.010, 0.015, 0.020)
COVERAGE_BAND = (0.90, 0.97)
CLASSES = ("sube", "se_mantiene", "baja")
MODEL, CONSTANT = "modelo_poisson_2016_2019", "baseline_s_constante"
MU_FLOOR = 1e-6
CHUNK = 10_000  # people drawn per row


def twice_observed(demand: DataFrame) -> DataFrame:
    return demand.where(F.col("reason").isNull() & F.col("d0").isNotNull())


def thin_panel(demand: DataFrame, fractions: Sequence[float] = FRACTIONS, ident: Column | None = None, source: str = "hash") -> DataFrame:
    """Add ``frac`` and ``d1_thin`` = Binomial(d1, frac) / frac: one keyed uniform per counted person.

    A unit's people are drawn in chunks spread over all tasks, so a unit of any size is neither one
    array nor one task.
    """
    key = ident if ident is not None else F.col("unit")
    cols = demand.columns
    folds = demand.withColumn("frac", F.explode(array_of(list(fractions))))
    # Each fraction draws afresh: the fold is part of the key.
    per_fold = F.xxhash64(key, "frac") if source == "hash" else key.cast("double") + F.col("frac") * 4000.0
    chunks = folds.withColumns({"_key": per_fold, "_n": F.expr("greatest(bigint(round(d1)), 0L)")})
    chunks = chunks.withColumn("_chunk", F.expr(f"explode(sequence(0L, coalesce(greatest(_n - 1, 0L), 0L) div {CHUNK}))"))
    stream = 5
    people = F.expr(
        f"if(_n > 0, sequence(_chunk * {CHUNK} + 1, least(_n, (_chunk + 1) * {CHUNK})), cast(array() AS array<bigint>))"
    )
    kept = F.filter(people, lambda i: draws.uniform(F.col("_key"), i, stream, source) < F.col("frac"))
    drawn = spread(chunks, "unit", "frac", "_chunk").withColumn("_kept", F.size(kept))
    return drawn.groupBy(*cols, "frac").agg(F.expr("if(d1 IS NULL, NULL, sum(_kept) / frac)").alias("d1_thin"))


def thinning_folds(
    demand: DataFrame, cal: Calendar, fractions: Sequence[float] = FRACTIONS, ident: Column | None = None, source: str = "hash"
) -> DataFrame:
    """``frac, unit, grp, estimator, r_real, r_est, var_est`` for four estimators on thinned counts."""
    thin = thin_panel(twice_observed(demand), fractions, ident, source).withColumn("r_real", log_rate("d0", "d1", cal.dt))
    own = estimate.with_direct_rates(thin, cal.dt, "d1_thin", F.col("frac"))
    fitted = estimate.shrink_to_groups(own, estimate.group_rates(own, ["frac"], cal.dt, "d1_thin"), ["frac"])
    null = F.lit(None).cast("double")
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("estimator"), r.alias("r_est"), v.alias("var_est"))
            for name, r, v in (
                ("r_hat_directo", F.col("r_hat"), F.col("psi")),
                ("r_tilde_eb", F.col("r_tilde"), F.col("var_post")),
                ("rho_m", F.col("rho"), null),
                ("baseline_r0", F.lit(0.0), null),
            )
        ]
    )
    return fitted.select("frac", "unit", "grp", "r_real", F.inline(rows)).select(
        "frac", "unit", "grp", "estimator", "r_real", "r_est", "var_est"
    )


def leave_group_out(demand: DataFrame, cal: Calendar) -> DataFrame:
    """τ² of every group from all the other groups: totals minus the group's own sums."""
    units = twice_observed(demand)
    own = estimate.with_direct_rates(units, cal.dt)
    groups = estimate.group_rates(own, [], cal.dt).selectExpr("grp", "rho", f"{estimate.squared_gap('rho')} AS g2", "p", "n AS m")
    whole = groups.agg(F.expr("struct(sum(g2) AS g2, sum(p) AS p, sum(m) AS m)").alias("w")).scalar()
    outside = groups.select("*", whole.alias("w")).selectExpr(
        "grp", "rho", "w.m - m AS m_out", "try_divide(w.g2 - g2 - (w.p - p), w.m - m) AS moment"
    )
    tau = outside.where("m_out >= 2").selectExpr("grp", "rho", "greatest(0D, moment) AS tau2")
    return with_groups(own, tau, ["grp"]).withColumns(estimate.shrunk()).selectExpr(
        "unit", "grp", "r_hat AS r_real", "r_tilde AS r_est", "var_post AS var_est", "tau2 AS tau2_out"
    )


def supply_hold_out(wide: DataFrame, cal: Calendar) -> DataFrame:
    """Predict the last cut from the first two, by the saturated two-point model and by no change."""
    s = [F.get(F.col("s"), F.lit(i)).cast("double") for i in range(3)]
    near, far = cal.cuts[1] - cal.cuts[0], cal.cuts[2] - cal.cuts[0]
    slope = log_rate(s[0], s[1], near)
    model = F.greatest((s[0] + 0.5) * F.exp(slope * far) - 0.5, F.lit(0.0))
    null = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit(MODEL).alias("estimator"), model.alias("s_pred"), slope.alias("r_est"), log_rate_variance(s[0], s[1], near).alias("var_est")),
        F.struct(F.lit(CONSTANT).alias("estimator"), s[1].alias("s_pred"), null.alias("r_est"), null.alias("var_est")),
    )
    return wide.select(
        "unit", "grp", s[0].alias("s_first"), s[1].alias("s_mid"), s[2].alias("s_real"), log_rate(s[0], s[2], far).alias("r_real"), F.inline(rows)
    )


def deviance(y: Column, mu: Column) -> Column:
    """Poisson deviance term; y = 0 leaves 2 µ."""
    m = F.greatest(mu, F.lit(MU_FLOOR))
    return (F.when(y > 0, y * F.log(y / m)).otherwise(F.lit(0.0)) - (y - m)) * 2.0


def mean_deviance(folds: DataFrame, keys: Sequence[str] = ("estimator",)) -> DataFrame:
    return folds.groupBy(*keys).agg(F.avg(deviance(F.col("s_real"), F.col("s_pred"))).alias("deviance"))


def inside_interval(sd_floor: Column | float = 0.0) -> Column:
    floor2 = F.pow(sd_floor if isinstance(sd_floor, Column) else F.lit(float(sd_floor)), 2)
    half = F.sqrt(F.greatest(F.col("var_est"), floor2)) * Z_975
    hit = (F.col("r_real") >= F.col("r_est") - half) & (F.col("r_real") <= F.col("r_est") + half)
    return F.when(F.col("var_est").isNotNull(), hit.cast("double"))


def metrics(folds: DataFrame, keys: Sequence[str], rate: str = "r_est", delta: float = rules.DEAD_BAND) -> DataFrame:
    """Per key: MAE in pp/year, macro F1 over the three fixed classes, interval hit rate, n."""
    real, est = rules.dead_band_class("r_real", delta), rules.dead_band_class(F.coalesce(rate, F.lit(0.0)), delta)
    counts = []
    for c in CLASSES:
        counts += [
            F.count_if((real == c) & (est == c)).alias(f"tp_{c}"),
            (F.count_if(real == c) + F.count_if(est == c)).alias(f"marks_{c}"),
        ]
    err = F.abs(F.coalesce(rate, F.lit(0.0)) - F.col("r_real")) * 100.0
    agg = folds.groupBy(*keys).agg(
        F.avg(err).alias("mae_pp"),
        F.when(F.count("var_est") == F.count(F.lit(1)), F.avg(inside_interval())).alias("hit_rate"),
        F.count(F.lit(1)).alias("n"),
        *counts,
    )
    f1 = [F.coalesce(F.try_divide(F.col(f"tp_{c}") * 2.0, F.col(f"marks_{c}")), F.lit(0.0)) for c in CLASSES]
    return agg.select(*keys, "mae_pp", (sum(f1[1:], f1[0]) / 3.0).alias("f1_macro"), "hit_rate", "n")


def floor_grid(folds: DataFrame, keys: Sequence[str] = ("layer",), grid: Sequence[float] = FLOOR_GRID) -> DataFrame:
    """Interval hit rate under every candidate floor; one aggregate with a column per candidate."""
    hits = [F.avg(inside_interval(g)).alias(f"h{i}") for i, g in enumerate(grid)]
    wide = folds.groupBy(*keys).agg(*hits)
    rows = F.array(*[F.struct(F.lit(float(g)).alias("floor"), F.col(f"h{i}").alias("hit_rate")) for i, g in enumerate(grid)])
    return wide.select(*keys, F.inline(rows))


def choose_floor(grid: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Smallest floor inside the band; else 0 if it already over-covers, else the best hit rate."""
    lo, hi = COVERAGE_BAND
    ok = f"hit_rate BETWEEN {lo}D AND {hi}D"
    picks = grid.groupBy(*keys).agg(
        F.expr(f"min(floor) FILTER (WHERE {ok})").alias("in_floor"),
        F.expr(f"min_by(hit_rate, floor) FILTER (WHERE {ok})").alias("in_hit"),
        F.expr("min(struct(floor, hit_rate))").alias("first"),
        F.expr("min(struct(-hit_rate AS k, floor, hit_rate))").alias("best"),
    )
    chosen = lambda c, found: f"coalesce({found}, if(first.hit_rate > {hi}D, first.{c}, best.{c})) AS {c}"
    return picks.selectExpr(*keys, chosen("floor", "in_floor"), chosen("hit_rate", "in_hit"), "in_floor IS NULL AS grid_insufficient")


def calibration_folds(thin: DataFrame, logo: DataFrame, supply: DataFrame) -> DataFrame:
    cols = ["layer", "r_real", "r_est", "var_est"]
    tag = lambda df, layer: df.withColumn("layer", F.lit(layer)).select(*cols)
    return (
        tag(thin.where(F.col("estimator") == "r_tilde_eb"), "demanda")
        .unionByName(tag(logo, "demanda"))
        .unionByName(tag(supply.where(F.col("estimator") == MODEL), "oferta"))
    )


def supply_summary(folds: DataFrame) -> DataFrame:
    return metrics(folds, ["estimator"]).join(mean_deviance(folds), "estimator")


def adoption(thin_summary: DataFrame, logo_summary: DataFrame, supply: DataFrame) -> DataFrame:
    """One row: does the model beat its baselines everywhere, and if not, what failed."""
    def beats(df: DataFrame, keys: list[str], model: str, base: str) -> DataFrame:
        at = lambda c, e: F.max(F.when(F.col("estimator") == e, F.col(c)))
        wins = (at("mae_pp", model) <= at("mae_pp", base)) & (at("f1_macro", model) >= at("f1_macro", base))
        return df.groupBy(*keys).agg(wins.alias("wins"))

    # A fraction without both competitors is skipped; supply without both is a failure.
    demand_ok = beats(thin_summary, ["frac"], "r_tilde_eb", "baseline_r0").agg(F.coalesce(F.bool_and("wins"), F.lit(True)).alias("x"))
    logo_ok = logo_summary.agg(F.coalesce(F.bool_and(F.col("hit_rate").between(*COVERAGE_BAND)), F.lit(False)).alias("x"))
    supply_ok = beats(supply, [], MODEL, CONSTANT).select(F.coalesce("wins", F.lit(False)).alias("x"))
    row = demand_ok.select(
        F.col("x").alias("demand_ok"), logo_ok.scalar().alias("logo_ok"), supply_ok.scalar().alias("supply_ok")
    )
    adopted = F.col("demand_ok") & F.col("logo_ok") & F.col("supply_ok")
    failed = F.concat_ws(",", *[F.when(~F.col(f"{name}_ok"), name) for name in ("demand", "logo", "supply")])
    return row.withColumn("adopted", adopted).withColumn("failed_checks", failed)


def run(demand: DataFrame, wide: DataFrame, control: DataFrame, cal: Calendar, ident: Column | None = None, source: str = "hash") -> dict[str, DataFrame]:
    """The whole back-test as tables. Fold tables feed several summaries, so they are materialised once."""
    thin = materialised(thinning_folds(demand, cal, ident=ident, source=source))
    logo = materialised(leave_group_out(demand, cal))
    supply = materialised(supply_hold_out(wide, cal))
    thin_s, logo_s, supply_s = metrics(thin, ["frac", "estimator"]), metrics(logo, []), supply_summary(supply)
    grid = floor_grid(calibration_folds(thin, logo, supply))
    return {
        "thinning": thin_s,
        "leave_group_out": logo_s,
        "supply": supply_s,
        "sources": estimate.source_comparison(demand, control, cal),
        "floor_grid": grid,
        "floor": choose_floor(grid),
        "adoption": adoption(thin_s, logo_s, supply_s),
    }
