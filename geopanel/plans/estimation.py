"""E: rates, shrinkage, control series, Poisson trends, and the zone trends of the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.functions.scalars import log_rate, log_rate_variance
from geopanel.operators import estimate, trend
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CAL, Roles

KEYS = ["segment"]

# --- demand ------------------------------------------------------------------------------------

RATES = """SELECT *, CASE WHEN d0 IS NOT NULL THEN ln((d1 + 0.5e0) / (d0 + 0.5e0)) / 5 END AS r_hat,
    CASE WHEN d0 IS NOT NULL THEN (1 / (d1 + 0.5e0) + 1 / (d0 + 0.5e0)) / 25 END AS psi FROM dem WHERE reason IS NULL"""
RHO = "SELECT segment, grp, ln((sum(d1) + 0.5e0) / (sum(d0) + 0.5e0)) / 5 AS rho FROM dem WHERE reason IS NULL AND d0 IS NOT NULL GROUP BY 1, 2"
SHRUNK = f"""SELECT *, CASE WHEN r_hat IS NULL THEN rho ELSE b * rho + (1 - b) * r_hat END AS r_tilde,
    CASE WHEN r_hat IS NULL THEN tau2 ELSE (1 - b) * psi END AS var_post FROM (
    SELECT r.*, g.rho, t.tau2, CASE WHEN r_hat IS NOT NULL THEN psi / (psi + tau2) END AS b FROM ({RATES}) r LEFT JOIN ({RHO}) g USING (segment, grp)
    LEFT JOIN (SELECT segment, greatest(0, avg((r_hat - rho) ** 2) - avg(psi)) AS tau2 FROM ({RATES}) x LEFT JOIN ({RHO}) y USING (segment, grp) WHERE r_hat IS NOT NULL GROUP BY 1) t USING (segment))"""


@query("e01_direct_rate", with_ctes("dem", body=f"SELECT segment, unit, {r6('r_hat')} AS r_hat, {r6('psi')} AS psi FROM ({RATES})"))
def direct(r: Roles):
    units = estimate.eligible(r.demand())
    return units.select("segment", "unit", log_rate("d0", "d1", CAL.dt).alias("r_hat"), log_rate_variance("d0", "d1", CAL.dt).alias("psi"))


@query("e02_group_rate", with_ctes("dem", body=f"SELECT segment, grp, {r6('rho')} AS rho FROM ({RHO})"))
def group_rate(r: Roles):
    return estimate.group_rates(estimate.eligible(r.demand()), KEYS, CAL.dt).select("segment", "grp", "rho")


@query("e03_shrinkage", with_ctes("dem", body=f"SELECT segment, unit, {r6('tau2')} AS tau2, {r6('b')} AS b, {r6('r_tilde')} AS r_tilde, {r6('var_post')} AS var_post FROM ({SHRUNK}) WHERE r_hat IS NOT NULL"))
def shrinkage(r: Roles):
    out = estimate.demand_rates(r.demand(), KEYS, CAL.dt).where("r_hat IS NOT NULL")
    return out.select("segment", "unit", "tau2", "b", "r_tilde", "var_post")


@query("e04_no_counterpart", with_ctes("dem", body=f"SELECT segment, unit, {r6('r_tilde')} AS r_tilde, {r6('var_post')} AS var_post, 1 AS n_obs FROM ({SHRUNK}) WHERE r_hat IS NULL"))
def no_counterpart(r: Roles):
    out = estimate.demand_rates(r.demand(), KEYS, CAL.dt).where("r_hat IS NULL")
    return out.select("segment", "unit", "r_tilde", "var_post", "n_obs")


def level_sql(at: float) -> str:
    """Control level per group at a time: log-linear between mid-years, constant outside."""
    t = f"{at}e0"
    return f"""SELECT grp, exp(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + ({t} - t0) / (t1 - t0) * (v1 - v0) END) AS v FROM (
        SELECT grp, max(yr + 0.5e0) FILTER (WHERE yr + 0.5e0 <= {t}) AS t0, max_by(ln(population), yr) FILTER (WHERE yr + 0.5e0 <= {t}) AS v0,
            min(yr + 0.5e0) FILTER (WHERE yr + 0.5e0 >= {t}) AS t1, min_by(ln(population), yr) FILTER (WHERE yr + 0.5e0 >= {t}) AS v1 FROM ctl GROUP BY 1)"""


@query("e05_control_interpolation", with_ctes("ctl", body=f"SELECT a.grp, {r6('a.v')} AS inside, {r6('b.v')} AS before, {r6('c.v')} AS after FROM ({level_sql(1998.25)}) a JOIN ({level_sql(1990.0)}) b USING (grp) JOIN ({level_sql(2010.0)}) c USING (grp)"))
def interpolation(r: Roles):
    return estimate.control_levels(r.control, {"inside": 1998.25, "before": 1990.0, "after": 2010.0})


@query("e06_control_rate", with_ctes("ctl", body=f"SELECT a.grp, {r6('ln(b.v / a.v) / 5')} AS control_rate FROM ({level_sql(1995.5)}) a JOIN ({level_sql(2000.5)}) b USING (grp)"))
def control_rate(r: Roles):
    return estimate.control_rate(r.control, CAL.t0, CAL.t1)


# --- supply ------------------------------------------------------------------------------------


def fit_sql(src: str, steps: int = 25) -> str:
    """Fisher scoring as a recursion: ``rowid`` identifies a row of ``src`` (with s0, s1, s2)."""
    xs = (-2, 0, 2)
    eta = [f"greatest(-30, least(30, a + b * {x}))" for x in xs]
    m = ", ".join(f"exp({e}) AS m{i}, exp({e}) * {e} + s{i} - exp({e}) AS z{i}" for i, e in enumerate(eta))
    w0, w1, w2 = "(m0 + m1 + m2)", "(-2 * m0 + 2 * m2)", "(4 * m0 + 4 * m2)"
    u0, u1 = "(z0 + z1 + z2)", "(-2 * z0 + 2 * z2)"
    det = f"({w0} * {w2} - {w1} * {w1})"
    return f"""src AS (SELECT *, row_number() OVER () AS id FROM ({src}) WHERE s0 + s1 + s2 > 0),
    fit AS (SELECT id, s0, s1, s2, ln(greatest((s0 + s1 + s2) / 3e0, 0.1e0)) AS a, 0e0 AS b, 0 AS step FROM src
        UNION ALL SELECT id, s0, s1, s2, ({w2} * {u0} - {w1} * {u1}) / {det}, ({w0} * {u1} - {w1} * {u0}) / {det}, step + 1
        FROM (SELECT *, {m} FROM fit WHERE step < {steps})),
    fitted AS (SELECT src.*, a AS a_hat, b AS b_hat, {w0} / {det} AS var_b FROM (SELECT *, {m} FROM fit WHERE step = {steps}) f JOIN src USING (id))"""


def with_fit(*blocks: str, src: str, body: str) -> str:
    return with_ctes(*blocks, body="").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + fit_sql(src) + "\n" + body


_OK = "coalesce(f.var_b < 10, false)"
#: Digits where the fit is reliable; for all fits the slope's sign and whether it is steep.
_FIT_COLS = f"{_OK} AS reliable, " + ", ".join(f"CASE WHEN {_OK} THEN {r6('f.' + c)} END AS {c}" for c in ("a_hat", "b_hat", "var_b")) + ", CAST(sign(CASE WHEN abs(f.b_hat) > 1e-9 THEN f.b_hat ELSE 0 END) AS BIGINT) AS slope_sign, abs(f.b_hat) >= 1 AS steep"


def _fit_rows(fit, keys):
    digits = [F.when(F.col("reliable"), F.col(c)).alias(c) for c in ("a_hat", "b_hat", "var_b")]
    slope = F.when(F.abs("b_hat") > 1e-9, F.col("b_hat")).when(F.col("b_hat").isNotNull(), F.lit(0.0))
    return fit.select(*keys, F.coalesce("reliable", F.lit(False)).alias("reliable"), *digits, F.signum(slope).cast("bigint").alias("slope_sign"), (F.abs("b_hat") >= 1).alias("steep"))


@query("e08_poisson_fit", with_fit("swide", src="SELECT * FROM swide", body=f"SELECT w.cell, w.unit, {_FIT_COLS} FROM swide w LEFT JOIN fitted f ON f.cell = w.cell AND f.unit = w.unit"))
def poisson(r: Roles):
    """Separated counts end at a huge variance whose digits are not comparable: their slope's sign and size are."""
    return _fit_rows(estimate.fit_supply(r.supply_cells, CAL), ["cell", "unit"])


@query("e08b_poisson_fit_sparse", with_fit("pwide", src="SELECT * FROM pwide", body=f"SELECT w.unit, {_FIT_COLS} FROM pwide w LEFT JOIN fitted f ON f.unit = w.unit"))
def poisson_sparse(r: Roles):
    return _fit_rows(estimate.fit_supply(r.part_supply, CAL), ["unit"])


@query("e09_fit_reliability", with_fit("pwide", src="SELECT * FROM pwide", body="SELECT w.unit, f.unit IS NULL AS no_data, coalesce(f.var_b < 10, false) AS reliable FROM pwide w LEFT JOIN fitted f USING (unit)"))
def reliability(r: Roles):
    return estimate.fit_supply(r.part_supply, CAL).select("unit", "no_data", "reliable")


_GRP = "SELECT cell, grp, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2 FROM swide WHERE s0 + s1 + s2 > 0 GROUP BY 1, 2"


@query("e10_group_trend", with_fit("swide", src=_GRP, body=f"SELECT cell, grp, {r6('b_hat')} AS b_grp, {r6('var_b')} AS var_grp FROM fitted"))
def group_trend(r: Roles):
    return estimate.group_trend(estimate.fit_supply(r.supply_cells, CAL), ["cell"], CAL).select("cell", "grp", "b_grp", "var_grp")


_CHI = " + ".join(f"(s{i} - greatest(exp(a_hat + b_hat * {x}), 1e-6)) ** 2 / greatest(exp(a_hat + b_hat * {x}), 1e-6)" for i, x in enumerate((-2, 0, 2)))


@query("e11_dispersion", with_fit("swide", src="SELECT * FROM swide", body=f"SELECT cell, grp, {r6(f'greatest(1, avg({_CHI}))')} AS phi FROM fitted GROUP BY 1, 2"))
def dispersion(r: Roles):
    return estimate.group_trend(estimate.fit_supply(r.supply_cells, CAL), ["cell"], CAL).select("cell", "grp", "phi")


def posterior_sql(body: str) -> str:
    """``post``: shrunk slope and variance of every supplier × cell."""
    group = fit_sql(_GRP).replace("src", "gsrc").replace("fit ", "gfit ").replace("fitted", "gfitted")
    post = f"""post AS (SELECT *, b * b_grp + (1 - b) * b_hat AS b_tilde, (1 - b) * psi + b ** 2 * var_grp * phi AS var_post FROM (
        SELECT *, psi / (psi + tau2) AS b FROM (
            SELECT p.*, greatest(0, coalesce(avg((b_hat - b_grp) ** 2) FILTER (WHERE var_b < 10) OVER w - avg(psi) FILTER (WHERE var_b < 10) OVER w,
                avg((b_hat - b_grp) ** 2) OVER w - avg(psi) OVER w)) AS tau2 FROM (
                SELECT f.*, g.b_hat AS b_grp, g.var_b AS var_grp, d.phi, f.var_b * d.phi AS psi FROM fitted f
                JOIN gfitted g ON g.cell = f.cell AND g.grp = f.grp
                JOIN (SELECT cell, grp, greatest(1, avg({_CHI})) AS phi FROM fitted GROUP BY 1, 2) d ON d.cell = f.cell AND d.grp = f.grp) p
            WINDOW w AS (PARTITION BY cell))))"""
    return with_fit("swide", src="SELECT * FROM swide", body="").rstrip() + ",\n" + group + ",\n" + post + "\n" + body


@query("e12_supply_posterior", posterior_sql(f"SELECT cell, unit, {r6('b_tilde')} AS b_tilde, {r6('var_post')} AS var_post, {r6('tau2')} AS tau2 FROM post"))
def posterior(r: Roles):
    out = estimate.supply_posterior(estimate.fit_supply(r.supply_cells, CAL), ["cell"], CAL)
    return out.select("cell", "unit", "b_tilde", "var_post", "tau2")


@query("e13_supply_scenarios", with_fit("swide", src="SELECT * FROM swide", body=f"""SELECT cell, unit, var_b < 10 AS reliable, CAST(sign(CASE WHEN abs(b_hat) > 1e-9 THEN b_hat ELSE 0 END) AS BIGINT) AS slope_sign, CASE WHEN var_b < 10 THEN {r6('round_even(b_hat * 100, 2)')} END AS rate_a_pct,
    {r6('round_even(ln((s1 + 0.5e0) / (s0 + 0.5e0)) / 2 * 100, 2)')} AS rate_b_pct, CASE WHEN var_b < 10 THEN {r6('round_even(abs(b_hat - ln((s1 + 0.5e0) / (s0 + 0.5e0)) / 2) * 100, 2)')} END AS range_pp FROM fitted"""))
def scenarios(r: Roles):
    fit = estimate.fit_supply(r.supply_cells, CAL).where("NOT no_data")
    sure = lambda c: F.when(F.col("reliable"), F.col(c)).alias(c)
    sign = F.signum(F.when(F.abs("b_hat") > 1e-9, F.col("b_hat")).otherwise(F.lit(0.0))).cast("bigint").alias("slope_sign")
    return estimate.supply_scenarios(fit, CAL).select("cell", "unit", "reliable", sign, sure("rate_a_pct"), "rate_b_pct", sure("range_pp"))


# --- zone trends -------------------------------------------------------------------------------

ZK = ["zone", "category"]
OLS = """SELECT zone, category, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, avg(x) AS xm,
    regr_sxx(y, x) AS sxx, greatest(0, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) AS sse, max(x) AS xl FROM {src} GROUP BY 1, 2"""
TQ = "(CASE n - 2 WHEN 1 THEN 12.706205e0 WHEN 2 THEN 4.302653e0 WHEN 3 THEN 3.182446e0 WHEN 4 THEN 2.776445e0 END)"
BAND = TQ + " * sqrt(sse / (n - 2)) * sqrt(1 + 1e0 / n + ({x} - xm) ** 2 / sxx)"


@query("e14_ols_projection", with_ctes("zpts", body=f"""SELECT zone, category, ahead, {r6('slope')} AS slope, {r6('r2')} AS r2, {r6('intercept + slope * (xl + ahead)')} AS estimate,
    {r6('intercept + slope * (xl + ahead) - ' + BAND.format(x='(xl + ahead)'))} AS lo, {r6('intercept + slope * (xl + ahead) + ' + BAND.format(x='(xl + ahead)'))} AS hi
    FROM ({OLS.format(src='zpts')}) CROSS JOIN (VALUES (3), (5), (7)) a(ahead)"""))
def projection(r: Roles):
    return trend.projections(trend.ols(r.zone_points, ZK), ZK)


@query("e15_leave_one_out", with_ctes("zpts", body=f"""SELECT p.zone, p.category, {r6('avg(CASE WHEN p.y > 0 AND q.k > 1 THEN abs(p.y - (q.my + q.sl * (p.x - q.mx))) / p.y * 100 END)')} AS loo_mape FROM zpts p JOIN (
    SELECT a.zone, a.category, a.x AS skip, avg(b.y) AS my, avg(b.x) AS mx, count(*) AS k, regr_slope(b.y, b.x) AS sl FROM zpts a JOIN zpts b ON a.zone = b.zone AND a.category = b.category AND a.x <> b.x GROUP BY 1, 2, 3) q
    ON q.zone = p.zone AND q.category = p.category AND q.skip = p.x GROUP BY 1, 2"""))
def loo(r: Roles):
    """The oracle refits without each point; the plan uses leverages."""
    return trend.leave_one_out(r.zone_points, ZK)


_HELD = f"""SELECT p.zone, p.category, p.x, p.y, intercept + slope * p.x AS est, CASE WHEN p.y > 0 THEN abs(intercept + slope * p.x - p.y) / p.y * 100 END AS err,
    abs(p.y - (intercept + slope * p.x)) <= {BAND.format(x='p.x')} AS inside FROM (SELECT * FROM zpts WHERE x > 1998) p JOIN ({OLS.format(src='(SELECT * FROM zpts WHERE x <= 1998)')}) f USING (zone, category)"""


@query("e16_hold_out", with_ctes("zpts", body=f"SELECT zone, category, x, y, {r6('est')} AS estimate, {r6('err')} AS error_pct, inside FROM ({_HELD})"))
def held(r: Roles):
    return trend.hold_out(r.zone_points, ZK, 1998)


@query("a22_validation_metrics", with_ctes("zpts", body=f"SELECT {r6('avg(CASE WHEN inside THEN 1e0 ELSE 0e0 END) * 100')} AS hit_rate_pct, {r6('avg(err)')} AS mape, count(*) AS n FROM ({_HELD})"))
def metrics(r: Roles):
    return trend.validation_metrics(trend.hold_out(r.zone_points, ZK, 1998))


_CAP = "SELECT zone, category, y * 100000e0 / population AS per_capita, slope FROM (SELECT * FROM zpts WHERE x = 2000) p JOIN zpop USING (zone) JOIN (" + OLS.format(src="zpts") + ") USING (zone, category)"


def _zones(r: Roles):
    last = trend.per_capita(r.zone_points.where("x = 2000"), r.zone_population)
    return last.join(trend.ols(r.zone_points, ZK).select(*ZK, "slope"), ZK)


@query("e17_supply_per_capita", with_ctes("zpts", "zpop", body=f"SELECT zone, category, {r6('per_capita')} AS per_capita FROM ({_CAP})"))
def per_capita(r: Roles):
    return trend.per_capita(r.zone_points.where("x = 2000"), r.zone_population).select(*ZK, "per_capita")


def _light_sql() -> str:
    from geopanel.plans.registry import class_sql

    return f"SELECT *, CASE WHEN cls = 1 AND slope > 1e-9 THEN 'verde' WHEN cls = 3 OR (cls = 2 AND slope <= 1e-9) THEN 'rojo' ELSE 'amarillo' END AS light FROM ({class_sql('per_capita', 3, _CAP, 'category')})"


def _lit(r: Roles):
    return trend.traffic_light(_zones(r))


@query("e18_traffic_light", with_ctes("zpts", "zpop", body=f"SELECT zone, category, light FROM ({_light_sql()})"))
def light(r: Roles):
    return _lit(r).select(*ZK, "light")


@query("w11_quadrants", with_ctes("zpts", "zpop", body=f"""SELECT zone, category, {r6('med')} AS median_supply, CASE WHEN per_capita <= med AND slope > 1e-9 THEN 'oportunidad_alta' WHEN per_capita <= med THEN 'deficit_critico'
    WHEN slope <= 1e-9 THEN 'zona_saturada' ELSE 'alta_oferta_creciente' END AS quadrant FROM (SELECT *, median(per_capita) OVER () AS med FROM ({_CAP}))"""))
def quadrants(r: Roles):
    return trend.quadrants(_zones(r)).select(*ZK, "median_supply", "quadrant")


@query("a20_dashboard_kpis", with_ctes("zpts", "zpop", body=f"""SELECT count(*) AS n_zones, count(*) FILTER (WHERE light = 'verde') AS n_green, count(*) FILTER (WHERE light = 'rojo') AS n_red,
    (SELECT zone FROM ({_light_sql()}) WHERE light = 'verde' ORDER BY per_capita, zone, category LIMIT 1) AS most_urgent FROM ({_light_sql()})"""))
def kpis(r: Roles):
    return trend.kpis(_lit(r))


@query("t05_priority_zones", with_ctes("zpts", "zpop", body=f"SELECT zone, category, {r6('per_capita')} AS per_capita FROM ({_light_sql()}) l WHERE light = 'verde' ORDER BY l.per_capita, zone, category LIMIT 4"))
def priorities(r: Roles):
    return trend.priorities(_lit(r)).select(*ZK, "per_capita")

