"""Linear trends per zone × category, their validation, and the dashboard's reports.

Points: ``zone, category, x`` (year), ``y`` (count): one row per year, so every zone × category
holds as many rows as there are years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.operators import rank

# Student t quantile 0.975 by degrees of freedom 1..30.
T_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
Z_975 = 1.959963984540054
_Z = {k: Z_975**k for k in (1, 3, 5, 7, 9)}
#: Coefficients of 1/df, 1/df^2, ... in the expansion of the t quantile around the normal one.
T_SERIES = (
    (_Z[3] + _Z[1]) / 4,
    (5 * _Z[5] + 16 * _Z[3] + 3 * _Z[1]) / 96,
    (3 * _Z[7] + 19 * _Z[5] + 17 * _Z[3] - 15 * _Z[1]) / 384,
    (79 * _Z[9] + 776 * _Z[7] + 1482 * _Z[5] - 1920 * _Z[3] - 945 * _Z[1]) / 92160,
)
AHEAD = (3, 5, 7)
FLAT_SLOPE = 1e-9  # rounding noise of a flat series must not decide its class


def t_quantile(df: Column) -> Column:
    """Tabled up to 30 degrees of freedom; beyond, four terms of the series (error below 1e-6)."""
    table = F.array(*[F.lit(t) for t in T_975])
    series = F.lit(Z_975)
    for i, c in enumerate(T_SERIES, 1):
        series = series + F.lit(c) / F.pow(df, F.lit(i))
    return F.when(df > len(T_975), series).when(df >= 1, F.get(table, (df - 1).cast("int")))


def _moments(keep: Column | None = None) -> list[Column]:
    pick = (lambda c: F.when(keep, F.col(c))) if keep is not None else F.col
    y, x = pick("y").cast("double"), pick("x").cast("double")
    return [
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.regr_sxx(y, x).alias("sxx"),
        F.greatest(F.lit(0.0), F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x))).alias("sse"),
        F.max(pick("x")).alias("x_last"),
    ]


def ols(points: DataFrame, keys: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Per key: ``n, slope, intercept, r2, x_mean, sxx, sse, x_last``; ``keep`` restricts the training rows."""
    return points.groupBy(*keys).agg(*_moments(keep))


def predicted(x: Column) -> Column:
    return F.col("intercept") + F.col("slope") * x


def band(x: Column) -> Column:
    """Half width of the 95 % prediction band at ``x``."""
    s = F.sqrt(F.try_divide(F.col("sse"), F.col("n") - 2))
    spread = F.lit(1.0) + F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.pow(x - F.col("x_mean"), 2), F.col("sxx"))
    return t_quantile(F.col("n") - 2) * s * F.sqrt(spread)


def projections(fit: DataFrame, keys: Sequence[str], ahead: Sequence[int] = AHEAD) -> DataFrame:
    rows = fit.select("*", F.explode(F.array(*[F.lit(a) for a in ahead])).alias("ahead"))
    x = F.col("x_last") + F.col("ahead")
    return rows.select(
        *keys, "ahead", "slope", "r2", predicted(x).alias("estimate"),
        (predicted(x) - band(x)).alias("lo"), (predicted(x) + band(x)).alias("hi"),
    )


def leave_one_out(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute % error of predicting each point from the others, without refitting:
    the left-out residual is the residual over one minus its leverage."""
    fit = ols(points, keys)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    leverage = F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.pow(x - F.col("x_mean"), 2), F.col("sxx"))
    left_out = F.try_divide(y - predicted(x), F.lit(1.0) - leverage)
    # Two remaining points are needed for a line.
    pct = F.when((y > 0) & (F.col("n") > 2), F.abs(left_out) / y * 100.0)
    return points.join(fit, list(keys)).groupBy(*keys).agg(F.avg(pct).alias("loo_mape"))


def hold_out(points: DataFrame, keys: Sequence[str], last_train: int) -> DataFrame:
    """Fit up to ``last_train``, predict every later point: error in % and whether it lies in the band."""
    fit = ols(points, keys, F.col("x") <= last_train)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    rows = points.where(F.col("x") > last_train).join(fit, list(keys))
    err = F.when(y > 0, F.abs(predicted(x) - y) / y * 100.0)
    return rows.select(
        *keys, "x", "y", predicted(x).alias("estimate"), err.alias("error_pct"), (F.abs(y - predicted(x)) <= band(x)).alias("inside")
    )


def validation_metrics(held: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return held.groupBy(*keys).agg(
        (F.avg(F.coalesce(F.col("inside"), F.lit(False)).cast("double")) * 100.0).alias("hit_rate_pct"), F.avg("error_pct").alias("mape"), F.count(F.lit(1)).alias("n")
    )


def per_capita(counts: DataFrame, population: DataFrame, scale: float = 100000.0) -> DataFrame:
    """``zone, category, y`` with ``zone, population`` -> supply per ``scale`` inhabitants."""
    return counts.join(population, "zone").withColumn(
        "per_capita", F.try_divide(F.col("y").cast("double"), F.nullif(F.col("population").cast("double"), F.lit(0.0))) * scale
    )


def traffic_light(zones: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Green: low relative supply and growing; red: high relative supply, or the middle class not
    growing; yellow: the rest. Relative supply is the tercile of ``per_capita`` within ``keys``."""
    t = rank.classify(zones, keys, "per_capita", 3, "_t")
    growing = F.col("slope") > FLAT_SLOPE
    light = (
        F.when((F.col("_t") == 1) & growing, "verde")
        .when((F.col("_t") == 3) | ((F.col("_t") == 2) & ~growing), "rojo")
        .otherwise("amarillo")
    )
    return t.withColumn("light", light).drop("_t")


def quadrants(zones: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Position against the median supply and zero growth."""
    medians = rank.quantiles(zones, keys, "per_capita", {"median_supply": 0.5})
    joined = (
        zones.join(medians, list(keys), "left")
        if keys
        else zones.select("*", medians.select("median_supply").scalar().alias("median_supply"))
    )
    low, grows = F.col("per_capita") <= F.col("median_supply"), F.col("slope") > FLAT_SLOPE
    return joined.withColumn(
        "quadrant",
        F.when(low & grows, "oportunidad_alta")
        .when(low, "deficit_critico")
        .when(~grows, "zona_saturada")
        .otherwise("alta_oferta_creciente"),
    )


def dashboard_filter(zones: DataFrame, category: str | None = None, lights: Sequence[str] = ()) -> DataFrame:
    out = zones if category in (None, "Todas") else zones.where(F.col("category") == category)
    return out.where(F.col("light").isin(list(lights))) if lights else out


def kpis(zones: DataFrame) -> DataFrame:
    green = F.col("light") == "verde"
    key = F.when(green, F.struct("per_capita", "zone", "category"))
    return zones.agg(
        F.count(F.lit(1)).alias("n_zones"),
        F.count_if(green).alias("n_green"),
        F.count_if(F.col("light") == "rojo").alias("n_red"),
        F.min(key)["zone"].alias("most_urgent"),
    )


def priorities(zones: DataFrame, n: int = 4) -> DataFrame:
    return zones.where(F.col("light") == "verde").orderBy("per_capita", "zone", "category").limit(n)


def composition(entities: DataFrame, zone: str, part: str) -> DataFrame:
    """Count and share of each subcategory within its zone."""
    counts = entities.groupBy(zone, part).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(zone).agg(F.sum("n").alias("total"))
    return counts.join(totals, zone).select(zone, part, "n", (F.col("n") * 100.0 / F.col("total")).alias("share_pct"))
