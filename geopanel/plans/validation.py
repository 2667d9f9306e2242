"""B: back-tests and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.operators import backtest, estimate
from geopanel.plans.estimation import RATES, RHO, level_sql
from geopanel.plans.projection import A, B, frac
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CAL, Roles

Z = "1.959963984540054e0"

# --- oracle fold tables (segment 'todas') ------------------------------------------------------

_ELIG = "(SELECT * FROM dem WHERE segment = 'todas' AND reason IS NULL AND d0 IS NOT NULL)"
_U = frac(f"0.5e0 + (unit + frac * 4000e0 + 5000015e0) * {A} + i * {B}")
THIN = f"""thin0 AS (SELECT unit, grp, d0, d1, frac FROM {_ELIG} CROSS JOIN (VALUES (0.25e0), (0.5e0)) f(frac)),
    thinned AS (SELECT unit, grp, d0, d1, frac, count(*) FILTER (WHERE {_U} < frac) / frac AS dt FROM (SELECT *, unnest(range(1, CAST(d1 AS BIGINT) + 1)) AS i FROM thin0) GROUP BY unit, grp, d0, d1, frac),
    trate AS (SELECT *, ln((d1 + 0.5e0) / (d0 + 0.5e0)) / 5 AS r_real, ln((dt + 0.5e0) / (d0 + 0.5e0)) / 5 AS r_hat, (1 / ((dt + 0.5e0) * frac) + 1 / (d0 + 0.5e0)) / 25 AS psi FROM thinned),
    trho AS (SELECT frac, grp, ln((sum(dt) + 0.5e0) / (sum(d0) + 0.5e0)) / 5 AS rho FROM trate GROUP BY 1, 2),
    tjoin AS (SELECT t.*, rho FROM trate t JOIN trho USING (frac, grp)),
    tfit AS (SELECT j.*, psi / (psi + tau2) AS b FROM tjoin j JOIN (SELECT frac, greatest(0, avg((r_hat - rho) ** 2) - avg(psi)) AS tau2 FROM tjoin GROUP BY 1) USING (frac)),
    tfold AS MATERIALIZED (SELECT frac, unit, grp, 'r_hat_directo' AS estimator, r_real, r_hat AS r_est, psi AS var_est FROM tfit UNION ALL SELECT frac, unit, grp, 'r_tilde_eb', r_real, b * rho + (1 - b) * r_hat, (1 - b) * psi FROM tfit
        UNION ALL SELECT frac, unit, grp, 'rho_m', r_real, rho, NULL FROM tfit UNION ALL SELECT frac, unit, grp, 'baseline_r0', r_real, 0e0, NULL FROM tfit)"""
_LR = f"SELECT r.unit, r.grp, r_hat, psi, rho FROM ({RATES}) r JOIN ({RHO}) g USING (segment, grp) WHERE segment = 'todas' AND r_hat IS NOT NULL"
LOGO = f"""lrate AS ({_LR}), lout AS (SELECT g.grp, greatest(0, avg((r_hat - rho) ** 2) - avg(psi)) AS tau2 FROM (SELECT DISTINCT grp FROM lrate) g JOIN lrate o ON o.grp <> g.grp GROUP BY 1 HAVING count(*) >= 2),
    lfold AS MATERIALIZED (SELECT unit, grp, r_hat AS r_real, psi / (psi + tau2) * rho + (1 - psi / (psi + tau2)) * r_hat AS r_est, (1 - psi / (psi + tau2)) * psi AS var_est, tau2 AS tau2_out FROM lrate JOIN lout USING (grp))"""
SUPPLY = """sfold AS MATERIALIZED (SELECT unit, grp, 'modelo_poisson_2016_2019' AS estimator, s0, s1, s2, greatest(0, (s0 + 0.5e0) * exp(ln((s1 + 0.5e0) / (s0 + 0.5e0)) / 2 * 4) - 0.5e0) AS s_pred,
        ln((s1 + 0.5e0) / (s0 + 0.5e0)) / 2 AS r_est, (1 / (s1 + 0.5e0) + 1 / (s0 + 0.5e0)) / 4 AS var_est, ln((s2 + 0.5e0) / (s0 + 0.5e0)) / 4 AS r_real FROM pwide
    UNION ALL SELECT unit, grp, 'baseline_s_constante', s0, s1, s2, s1, NULL, NULL, ln((s2 + 0.5e0) / (s0 + 0.5e0)) / 4 FROM pwide)"""


def folds_sql(body: str) -> str:
    return with_ctes("dem", "ctl", "pwide", body="").rstrip() + ",\n" + ",\n".join([THIN, LOGO, SUPPLY]) + "\n" + body


_K = "CASE WHEN {r} > 0.01e0 THEN 'sube' WHEN {r} < -0.01e0 THEN 'baja' ELSE 'se_mantiene' END"


def metrics_sql(src: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    real, est = _K.format(r="r_real"), _K.format(r="coalesce(r_est, 0)")
    f1 = " + ".join(
        f"coalesce(2e0 * count(*) FILTER (WHERE k1 = '{c}' AND k2 = '{c}') / nullif(count(*) FILTER (WHERE k1 = '{c}') + count(*) FILTER (WHERE k2 = '{c}'), 0), 0)" for c in ("sube", "se_mantiene", "baja")
    )
    hit = f"avg(CASE WHEN r_real BETWEEN r_est - {Z} * sqrt(var_est) AND r_est + {Z} * sqrt(var_est) THEN 1e0 ELSE 0e0 END)"
    return f"""SELECT {k}avg(abs(coalesce(r_est, 0) - r_real) * 100) AS mae_pp, ({f1}) / 3 AS f1_macro, CASE WHEN count(var_est) = count(*) THEN {hit} END AS hit_rate, count(*) AS n
        FROM (SELECT *, {real} AS k1, {est} AS k2 FROM {src}) {group}"""


_M = f"{r6('mae_pp')} AS mae_pp, {r6('f1_macro')} AS f1_macro, {r6('hit_rate')} AS hit_rate, n"
_DEV = "avg(2 * (CASE WHEN s2 > 0 THEN s2 * ln(s2 / greatest(s_pred, 1e-6)) ELSE 0 END - (s2 - greatest(s_pred, 1e-6))))"


def _thin(r: Roles):
    return backtest.thinning_folds(r.demand_all, CAL, source="r2")


def _logo(r: Roles):
    return backtest.leave_group_out(r.demand_all, CAL)


def _supply(r: Roles):
    return backtest.supply_hold_out(r.part_supply, CAL)


@query("b01_binomial_thinning", folds_sql(f"SELECT unit, frac, {r6('d1')} AS d1, {r6('dt')} AS d1_thin FROM thinned"))
def thinning(r: Roles):
    out = backtest.thin_panel(backtest.twice_observed(r.demand_all), source="r2")
    return out.select("unit", "frac", "d1", "d1_thin")


@query("b01b_binomial_thinning_hash")
def thinning_hash(r: Roles):
    return backtest.thin_panel(backtest.twice_observed(r.demand_all)).select("unit", "frac", "d1", "d1_thin")


@query("b02_thinning_folds", folds_sql(f"SELECT frac, unit, grp, estimator, {r6('r_real')} AS r_real, {r6('r_est')} AS r_est, {r6('var_est')} AS var_est FROM tfold"))
def thin_folds(r: Roles):
    return _thin(r)


@query("b03_leave_group_out", folds_sql(f"SELECT unit, grp, {r6('r_real')} AS r_real, {r6('r_est')} AS r_est, {r6('var_est')} AS var_est, {r6('tau2_out')} AS tau2_out FROM lfold"))
def leave_out(r: Roles):
    return _logo(r)


@query("b04_temporal_hold_out", folds_sql(f"SELECT unit, estimator, {r6('s_pred')} AS s_pred, {r6('r_est')} AS r_est, {r6('var_est')} AS var_est, {r6('r_real')} AS r_real FROM sfold"))
def hold_out(r: Roles):
    return _supply(r).select("unit", "estimator", "s_pred", "r_est", "var_est", "r_real")


_SRC = f"""SELECT grp, rho, ln(b.v / a.v) / 5 AS c FROM ({RHO}) g JOIN ({level_sql(1995.5)}) a USING (grp) JOIN ({level_sql(2000.5)}) b USING (grp) WHERE segment = 'todas'"""


@query("b05_source_comparison", with_ctes("dem", "ctl", body=f"SELECT grp, {r6('round_even(rho * 100, 2)')} AS census_pct, {r6('round_even(c * 100, 2)')} AS control_pct, {r6('round_even((rho - c) * 100, 2)')} AS gap_pp FROM ({_SRC})"))
def sources(r: Roles):
    return estimate.source_comparison(r.demand_all, r.control, CAL)


@query("b07_metrics", folds_sql(f"SELECT {_M} FROM ({metrics_sql('lfold', '')})"))
def metrics(r: Roles):
    return backtest.metrics(_logo(r), [])


@query("b08_poisson_deviance", folds_sql(f"SELECT estimator, {r6(_DEV)} AS deviance FROM sfold GROUP BY 1"))
def deviance(r: Roles):
    return backtest.mean_deviance(_supply(r))


_CAL_FOLDS = "(SELECT 'demanda' AS layer, r_real, r_est, var_est FROM tfold WHERE estimator = 'r_tilde_eb' UNION ALL SELECT 'demanda', r_real, r_est, var_est FROM lfold UNION ALL SELECT 'oferta', r_real, r_est, var_est FROM sfold WHERE estimator LIKE 'modelo%')"
_GRID = f"SELECT layer, g AS floor, avg(CASE WHEN r_real BETWEEN r_est - {Z} * sqrt(greatest(var_est, g * g)) AND r_est + {Z} * sqrt(greatest(var_est, g * g)) THEN 1e0 ELSE 0e0 END) AS hit FROM {_CAL_FOLDS} CROSS JOIN (VALUES (0e0), (0.005e0), (0.01e0), (0.015e0), (0.02e0)) v(g) GROUP BY 1, 2"


def _grid(r: Roles):
    return backtest.floor_grid(backtest.calibration_folds(_thin(r), _logo(r), _supply(r)))


@query("b09_floor_grid", folds_sql(f"SELECT layer, {r6('floor')} AS floor, {r6('hit')} AS hit_rate FROM ({_GRID})"))
def floor_grid(r: Roles):
    return _grid(r)


@query("b09b_floor_choice", folds_sql(f"""SELECT layer, {r6('f')} AS floor, {r6('h')} AS hit_rate, ins AS grid_insufficient FROM (
    SELECT layer, g.floor AS f, hit AS h, c.ok IS NULL AS ins, row_number() OVER (PARTITION BY layer ORDER BY CASE WHEN g.floor = c.ok THEN 0 ELSE 1 END, CASE WHEN c.first > 0.97 AND g.floor = 0 THEN 0 ELSE 1 END, hit DESC, g.floor) AS k
    FROM ({_GRID}) g JOIN (SELECT layer, min(floor) FILTER (WHERE hit BETWEEN 0.90 AND 0.97) AS ok, min_by(hit, floor) AS first FROM ({_GRID}) GROUP BY 1) c USING (layer)) WHERE k = 1"""))
def floor_choice(r: Roles):
    return backtest.choose_floor(_grid(r))


@query("b10_fold_summaries", folds_sql(f"SELECT frac, estimator, {_M} FROM ({metrics_sql('tfold', 'frac, estimator')})"))
def summaries(r: Roles):
    return backtest.metrics(_thin(r), ["frac", "estimator"])


@query("b10b_supply_summary", folds_sql(f"SELECT estimator, {_M}, {r6('deviance')} AS deviance FROM ({metrics_sql('sfold', 'estimator')}) JOIN (SELECT estimator, {_DEV} AS deviance FROM sfold GROUP BY 1) USING (estimator)"))
def supply_summary(r: Roles):
    return backtest.supply_summary(_supply(r))


_T = metrics_sql("tfold", "frac, estimator")
_S = metrics_sql("sfold", "estimator")
ADOPT = f"""SELECT d AS demand_ok, l AS logo_ok, s AS supply_ok, d AND l AND s AS adopted, concat_ws(',', CASE WHEN NOT d THEN 'demand' END, CASE WHEN NOT l THEN 'logo' END, CASE WHEN NOT s THEN 'supply' END) AS failed_checks FROM (
    SELECT (SELECT bool_and(a.mae_pp <= b.mae_pp AND a.f1_macro >= b.f1_macro) FROM ({_T}) a JOIN ({_T}) b ON a.frac = b.frac AND a.estimator = 'r_tilde_eb' AND b.estimator = 'baseline_r0') AS d,
    (SELECT coalesce(hit_rate BETWEEN 0.90 AND 0.97, false) FROM ({metrics_sql('lfold', '')})) AS l,
    (SELECT bool_and(a.mae_pp <= b.mae_pp AND a.f1_macro >= b.f1_macro) FROM ({_S}) a JOIN ({_S}) b ON a.estimator LIKE 'modelo%' AND b.estimator LIKE 'baseline%') AS s)"""


@query("b11_adoption_decision", folds_sql(ADOPT))
def adoption(r: Roles):
    return backtest.adoption(backtest.metrics(_thin(r), ["frac", "estimator"]), backtest.metrics(_logo(r), []), backtest.supply_summary(_supply(r)))


@query("b12_backtest_run", folds_sql(f"""SELECT 'thinning' AS part, estimator || ' ' || frac AS item, {r6('mae_pp')} AS value FROM ({_T}) UNION ALL SELECT 'leave_group_out', '', {r6('mae_pp')} FROM ({metrics_sql('lfold', '')})
    UNION ALL SELECT 'supply', estimator, {r6('mae_pp')} FROM ({_S}) UNION ALL SELECT 'adoption', failed_checks, CASE WHEN adopted THEN 1e0 ELSE 0e0 END FROM ({ADOPT})"""))
def run(r: Roles):
    """Every table of the run folded into one list."""
    t = backtest.run(r.demand_all, r.part_supply, r.control, CAL, source="r2")
    row = lambda df, part, item, value: df.select(F.lit(part).alias("part"), item.alias("item"), value.cast("double").alias("value"))
    return (
        row(t["thinning"], "thinning", F.concat_ws(" ", "estimator", F.col("frac").cast("string")), F.col("mae_pp"))
        .union(row(t["leave_group_out"], "leave_group_out", F.lit(""), F.col("mae_pp")))
        .union(row(t["supply"], "supply", F.col("estimator"), F.col("mae_pp")))
        .union(row(t["adoption"], "adoption", F.col("failed_checks"), F.col("adopted").cast("int")))
    )


@query("u04_fold_union", folds_sql("SELECT layer, count(*) AS n FROM (SELECT 'demanda' AS layer FROM tfold WHERE estimator = 'r_tilde_eb' UNION ALL SELECT 'demanda' FROM lfold UNION ALL SELECT 'oferta' FROM sfold WHERE estimator LIKE 'modelo%') GROUP BY 1"))
def fold_union(r: Roles):
    folds = backtest.calibration_folds(_thin(r), _logo(r), _supply(r))
    return folds.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
