"""M: replicate-based projection. The oracle comparison uses the low-discrepancy draw source."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.functions import draws, rules
from geopanel.operators import estimate, quality, replicate
from geopanel.plans.estimation import RHO, SHRUNK, level_sql, posterior_sql
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CAL, Roles

N_SIM = replicate.N_SIM
KEYS = ["segment"]
A, B = "0.7548776662e0", "0.5698402910e0"


def frac(x: str) -> str:
    return f"(({x}) - floor({x}))"


def normal_sql(no: str, rep: str, stream: int) -> str:
    shifted = f"({no} + {1000003 * stream}e0)"
    u1, u2 = frac(f"0.5e0 + {shifted} * {A} + {rep} * {B}"), frac(f"0.5e0 + {shifted} * {B} + {rep} * {A}")
    return f"(sqrt(ln(greatest({u1}, 1e-12)) * -2) * cos({u2} * (2 * pi())))"


LAM = f"({frac('0.5e0 + rep * 0.6180339887e0')} * 0.75e0 + 0.25e0)"
REPS = f"(SELECT unnest(range(0, {N_SIM})) AS rep)"

SIMBASE = f"""post AS MATERIALIZED (SELECT s.segment, s.unit, s.grp, s.d1 AS base, CASE WHEN s.r_hat IS NULL THEN 1 ELSE 2 END AS n_obs,
        CASE WHEN relation IN ('division', 'fusion_o_expansion', 'cambio_limites') THEN 'media' END AS cap, s.rho, s.r_tilde, sqrt(s.var_post) AS sd,
        ln(far.v / t1.v) / 6 AS rho_future, far.v / t1.v AS ratio, abs(s.rho - ln(t1.v / t0.v) / 5) AS shock
        FROM ({SHRUNK}) s JOIN ({level_sql(1995.5)}) t0 ON t0.grp = s.grp JOIN ({level_sql(2000.5)}) t1 ON t1.grp = s.grp JOIN ({level_sql(2006.5)}) far ON far.grp = s.grp WHERE s.rho IS NOT NULL),
    dev AS MATERIALIZED (SELECT p.*, rep, r_tilde + {normal_sql('p.unit', 'rep', 1)} * sd - rho AS dev FROM post p CROSS JOIN {REPS} r),
    pre AS MATERIALIZED (SELECT d.*, lam, rho_future + CASE WHEN lam = 0 THEN {LAM} ELSE lam END * dev AS r_pre FROM dev d CROSS JOIN (VALUES (0e0), (0.25e0), (0.6e0), (1e0)) l(lam)),
    ctrl AS MATERIALIZED (SELECT segment, grp, rep, lam, ln(any_value(ratio) * sum(base) / sum(base * exp(r_pre * 6))) / 6 + {normal_sql('grp', 'rep', 2)} * any_value(shock) AS k FROM pre GROUP BY 1, 2, 3, 4),
    sim AS MATERIALIZED (SELECT p.segment, p.unit, p.grp, p.n_obs, p.base, p.cap, p.rep, p.lam, greatest(-20, least(20, r_pre + k)) AS r FROM pre p JOIN ctrl c USING (segment, grp, rep, lam))"""


def sim_sql(body: str) -> str:
    return with_ctes("dem", "ctl", body="").rstrip() + ",\n" + SIMBASE + "\n" + body


def _inputs(r: Roles):
    return replicate.demand_inputs(r.demand(), r.control, CAL, KEYS)


def _demand_sim(r: Roles, source: str = "r2", n_sim: int = N_SIM):
    if source == "r2" and n_sim == N_SIM:
        return r.demand_sim
    return replicate.simulate_demand(_inputs(r), CAL, KEYS, n_sim, source, group_id=F.col("grp") if source == "r2" else None)


def _supply_sim(r: Roles, source: str = "r2", n_sim: int = N_SIM):
    return r.supply_sim


@query("m01_keyed_draws_hash")
def draws_hash(r: Roles):
    """Moments of the hash draws over all suppliers × replicates (the other engine lacks the hash)."""
    long = replicate.replicates(r.suppliers, N_SIM)
    z = draws.normal(F.col("unit"), F.col("rep"), 1)
    return long.select("grp", z.alias("z")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.stddev("z").alias("sd"))


@query("m01b_keyed_draws_r2", with_ctes("supps", body=f"SELECT grp, count(*) AS n, {r6('avg(z)')} AS mean, {r6('stddev_samp(z)')} AS sd FROM (SELECT grp, {normal_sql('unit', 'rep', 1)} AS z FROM supps CROSS JOIN {REPS}) GROUP BY 1"))
def draws_r2(r: Roles):
    long = replicate.replicates(r.suppliers, N_SIM)
    z = draws.normal(F.col("unit"), F.col("rep"), 1, "r2")
    return long.select("grp", z.alias("z")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.stddev("z").alias("sd"))


@query("m02_demand_projection", sim_sql(f"SELECT segment, unit, n_obs, cap, {r6('avg(r)')} AS r_mean, {r6('min(r)')} AS r_min, {r6('max(r)')} AS r_max FROM sim WHERE lam = 0 GROUP BY 1, 2, 3, 4"))
def demand(r: Roles):
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    return _demand_sim(r).select("segment", "unit", "n_obs", "cap", (total / N_SIM).alias("r_mean"), F.array_min("r").alias("r_min"), F.array_max("r").alias("r_max"))


@query("m02b_demand_projection_hash")
def demand_hash(r: Roles):
    sim = _demand_sim(r, "hash")
    return sim.select("segment", "unit", F.array_min("r").alias("r_min"), F.array_max("r").alias("r_max"))


@query("m03_fixed_persistence", sim_sql(f"SELECT segment, unit, {r6('avg(r) FILTER (WHERE lam = 0.25)')} AS r_025, {r6('avg(r) FILTER (WHERE lam = 0.6)')} AS r_060, {r6('avg(r) FILTER (WHERE lam = 1)')} AS r_100 FROM sim GROUP BY 1, 2"))
def fixed(r: Roles):
    mean = lambda i: F.aggregate(F.col("r_fixed")[i], F.lit(0.0), lambda a, x: a + x) / N_SIM
    return _demand_sim(r).select("segment", "unit", mean(0).alias("r_025"), mean(1).alias("r_060"), mean(2).alias("r_100"))


SUPPLY_SIM = f"ssim AS MATERIALIZED (SELECT cell, unit, grp, s2, rep, greatest(-20, least(20, b_tilde + {normal_sql('p.unit', 'rep', 3)} * sqrt(var_post))) AS r FROM post p CROSS JOIN {REPS} x)"


def supply_sql(body: str) -> str:
    return posterior_sql("").rstrip() + ",\n" + SUPPLY_SIM + "\n" + body


@query("m04_supply_projection", supply_sql(f"SELECT cell, unit, {r6('avg(r)')} AS r_mean, {r6('min(r)')} AS r_min, {r6('max(r)')} AS r_max FROM ssim GROUP BY 1, 2"))
def supply(r: Roles):
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    return _supply_sim(r).select("cell", "unit", (total / N_SIM).alias("r_mean"), F.array_min("r").alias("r_min"), F.array_max("r").alias("r_max"))


@query("m05_shock_size", with_ctes("dem", "ctl", body=f"SELECT segment, grp, {r6('abs(rho - ln(b.v / a.v) / 5)')} AS shock_sd FROM ({RHO}) g JOIN ({level_sql(1995.5)}) a USING (grp) JOIN ({level_sql(2000.5)}) b USING (grp)"))
def shock(r: Roles):
    rho = estimate.group_rates(estimate.eligible(r.demand()), KEYS, CAL.dt)
    past = estimate.control_summary(r.control, CAL).select("grp", "rho_past")
    return rho.join(past, "grp").select("segment", "grp", F.abs(F.col("rho") - F.col("rho_past")).alias("shock_sd"))


def stats_sql(keys: str, src: str, n_obs: str, conf_base: str, cap: str) -> str:
    """Verdict and confidence of every unit from a long simulation with ``lam`` variants (0 = main)."""
    p = lambda c: f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"
    ver = "CASE WHEN up >= 0.8e0 THEN 'sube' WHEN dn >= 0.8e0 THEN 'baja' ELSE 'se_mantiene' END"
    return f"""SELECT *, ['baja', 'media', 'alta'][least(CASE WHEN n_obs = 1 OR coalesce({conf_base} < 100, false) THEN 0 ELSE greatest(0, CASE WHEN p_dec >= 0.95e0 THEN 2 WHEN p_dec >= 0.8e0 THEN 1 ELSE 0 END
            - CASE WHEN stable THEN 0 ELSE 1 END) END, CASE {cap} WHEN 'media' THEN 1 ELSE 2 END) + 1] AS confidence FROM (
        SELECT m.*, coalesce(s.nv, 1) <= 1 AS stable, CASE WHEN up >= 0.8e0 THEN up WHEN dn >= 0.8e0 THEN dn ELSE fl END AS p_dec, {ver} AS verdict FROM (
            SELECT {keys}, any_value({n_obs}) AS n_obs, any_value(base) AS base, any_value({cap}) AS cap, {p('r > 0.01e0')} AS up, {p('r < -0.01e0')} AS dn, {p('abs(r) <= 0.01e0')} AS fl,
                list_sort(list(r)) AS rs FROM {src} WHERE lam = 0 GROUP BY {keys}) m
        LEFT JOIN (SELECT {keys}, count(DISTINCT {ver}) AS nv FROM (SELECT {keys}, lam, {p('r > 0.01e0')} AS up, {p('r < -0.01e0')} AS dn FROM {src} WHERE lam > 0 GROUP BY {keys}, lam) GROUP BY {keys}) s USING ({keys}))"""


def _q(p: float, f: str = "{x}", n: int = N_SIM) -> str:
    lo = int((n - 1) * p)
    w = (n - 1) * p - lo
    a, b = f.format(x=f"rs[{lo + 1}]"), f.format(x=f"rs[{min(lo + 2, n)}]")
    return f"({a} + {w!r}e0 * ({b} - {a}))" if "e" not in repr(w) else f"({a} + {w:.18f} * ({b} - {a}))"


_CHANGE = "((exp({x} * yrs) - 1) * 100)"
_SUMMARY_COLS = ", ".join(
    [f"{r6(_q(0.5) + ' * 100')} AS rate_pct", f"{r6(_q(0.5, _CHANGE))} AS delta_pct", f"{r6(_q(0.025, _CHANGE))} AS ci_lo", f"{r6(_q(0.975, _CHANGE))} AS ci_hi"]
)
_STATS = stats_sql("segment, unit", "sim", "n_obs", "base", "cap")
_HZ = "(VALUES ('h1', 1e0), ('h3', 3e0), ('h5', 5e0)) h(horizon, yrs)"


@query("m06_replicate_summary", sim_sql(f"SELECT segment, unit, horizon, {_SUMMARY_COLS}, {r6('up')} AS p_up, {r6('dn')} AS p_down, {r6('fl')} AS p_flat, {r6('p_dec')} AS p_dec, verdict, confidence FROM ({_STATS}) CROSS JOIN {_HZ}"))
def summary(r: Roles):
    out = replicate.summarise(_demand_sim(r), KEYS, CAL, ("h1", "h3", "h5"))
    return out.select("segment", "unit", "horizon", "rate_pct", "delta_pct", "ci_lo", "ci_hi", "p_up", "p_down", "p_flat", "p_dec", "verdict", "confidence")


@query("m06b_dead_band_sensitivity", sim_sql("SELECT segment, delta, verdict, count(*) AS n FROM (SELECT segment, unit, delta, CASE WHEN avg(CASE WHEN r > delta THEN 1e0 ELSE 0e0 END) >= 0.8e0 THEN 'sube' WHEN avg(CASE WHEN r < -delta THEN 1e0 ELSE 0e0 END) >= 0.8e0 THEN 'baja' ELSE 'se_mantiene' END AS verdict FROM sim CROSS JOIN (VALUES (0.005e0), (0.01e0), (0.02e0)) d(delta) WHERE lam = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"))
def dead_bands(r: Roles):
    sim = _demand_sim(r)
    share = lambda test: F.size(F.filter("r", test)) / F.size("r")
    band = lambda d: F.struct(F.lit(d).alias("delta"), rules.verdict(share(lambda x: x > d), share(lambda x: x < -d)).alias("verdict"))
    rows = sim.select("segment", F.inline(F.array(*[band(d) for d in (0.005, 0.01, 0.02)])))
    return rows.groupBy("segment", "delta", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("m07_verdict_rule", sim_sql(f"SELECT segment, unit, verdict, {r6('p_dec')} AS p_dec FROM ({_STATS})"))
def verdict(r: Roles):
    p = replicate.probabilities(_demand_sim(r))
    return p.select("segment", "unit", rules.verdict("p_up", "p_down").alias("verdict"), rules.decided_probability("p_up", "p_down", "p_flat").alias("p_dec"))


@query("m08_confidence_rule", sim_sql(f"SELECT segment, unit, confidence FROM ({_STATS})"))
def confidence(r: Roles):
    return replicate.summarise(_demand_sim(r), KEYS, CAL, ("h3",)).select("segment", "unit", "confidence")


@query("m09_persistence_stability", sim_sql(f"SELECT segment, unit, stable FROM ({_STATS})"))
def stability(r: Roles):
    return replicate.probabilities(_demand_sim(r)).select("segment", "unit", "stable")


@query("m10_confidence_cap", with_ctes("dem", body="SELECT segment, unit, CASE WHEN relation IN ('division', 'fusion_o_expansion', 'cambio_limites') THEN 'media' END AS cap FROM dem WHERE reason IS NULL"))
def cap(r: Roles):
    return estimate.eligible(r.demand()).select("segment", "unit", rules.confidence_cap("relation").alias("cap"))


@query("m11_level_at_date", sim_sql(f"SELECT segment, unit, {r6(f'round_even(base * exp({_q(0.5)} * 1), 1)')} AS level_base FROM ({_STATS})"))
def level(r: Roles):
    return replicate.level_at(_demand_sim(r), KEYS, CAL.t1, CAL.t_base).select("segment", "unit", "level_base")


@query("m12_level_per_replicate", supply_sql(f"SELECT cell, grp, rep, {r6('sum(s2 * exp(r * 4))')} AS level FROM ssim GROUP BY 1, 2, 3"))
def levels(r: Roles):
    sums = replicate.group_levels(_supply_sim(r), ["cell"], CAL.cuts[-1], CAL.t_base + 3)
    return sums.select("cell", "grp", F.posexplode("levels").alias("rep", "level"))


def both_sims_sql(body: str) -> str:
    """``sim`` (demand) and ``ssim`` (supply) in one text."""
    supply = posterior_sql("").rstrip().replace("post AS (", "spost AS (") + ",\n" + SUPPLY_SIM.replace("FROM post p", "FROM spost p")
    demand = with_ctes("dem", "ctl", body="").rstrip().removeprefix("WITH ")
    known = {"supps", "ent", "cells", "swide"}
    blocks = [x for x in demand.split("),\n") if x.split(" AS (", 1)[0].strip() not in known]
    return supply + ",\n" + "),\n".join(blocks) + ",\n" + SIMBASE + "\n" + body


@query(
    "m13_coverage_per_replicate",
    both_sims_sql(f"""SELECT d.unit, {r6('median(coalesce(s.lev, 0) / d.lev * 1000)')} AS coverage FROM (SELECT unit, rep, base * exp(r * 4) AS lev FROM sim WHERE lam = 0 AND segment = 'todas') d
    LEFT JOIN (SELECT unit, rep, sum(s2 * exp(r * 4)) AS lev FROM ssim GROUP BY 1, 2) s USING (unit, rep) GROUP BY 1"""),
)
def coverage(r: Roles):
    """Median over replicates of supply per 1,000 demand."""
    d = replicate.replicate_levels(r.demand_run.where("segment = 'todas'"), CAL.t1, CAL.t_base + 3)
    s = replicate.summed_levels(r.supply_run, r.suppliers.select("unit"), [], CAL.cuts[-1], CAL.t_base + 3)
    return replicate.median_coverage(s, d).select("unit", "coverage")


@query("e07_ratio_control", sim_sql(f"SELECT segment, grp, rep, {r6('sum(base * exp((r - z) * 6)) / sum(base)')} AS ratio FROM (SELECT s.*, {normal_sql('grp', 'rep', 2)} * shock AS z FROM sim s JOIN (SELECT segment, unit, shock FROM post) USING (segment, unit)) WHERE lam = 0 GROUP BY 1, 2, 3"))
def ratio_control(r: Roles):
    """Before the shared shock, projected over base equals the control ratio in every replicate."""
    shocks = _inputs(r).groupBy("segment", "grp").agg(F.first("shock_sd").alias("shock_sd"))
    level = lambda x: F.col("base") * F.exp(x * CAL.demand_span)
    sums = replicate.vector_sums(_demand_sim(r), ["segment", "grp"], {"levels": F.col("r")}, level, {"total": F.sum("base")}, ["base"]).join(shocks, ["segment", "grp"])
    rows = sums.select("segment", "grp", "total", "shock_sd", F.posexplode("levels").alias("rep", "level"))
    # the shock is one for a group and replicate
    z = draws.normal(F.col("grp"), F.col("rep"), 2, "r2") * F.col("shock_sd")
    return rows.select("segment", "grp", "rep", (F.col("level") * F.exp(-z * CAL.demand_span) / F.col("total")).alias("ratio"))


@query("q09_replicate_additivity", sim_sql("SELECT segment, grp, true AS additive, count(DISTINCT rep) AS n_rep FROM sim WHERE lam = 0 GROUP BY 1, 2"))
def additivity(r: Roles):
    sim = _demand_sim(r)
    rolled = replicate.roll_up(sim, KEYS, CAL.demand_span, demand=True)
    return quality.replicate_additivity(sim, rolled, KEYS, CAL.demand_span)


_GSIM = f"""SELECT segment, grp AS unit, any_value(n) AS n_obs, any_value(b) AS base, NULL AS cap, rep, lam, ln(any_value(tot) / any_value(b)) / 6 AS r FROM (
    SELECT segment, grp, rep, lam, max(n_obs) AS n, sum(base) AS b, sum(base * exp(r * 6)) AS tot FROM sim GROUP BY 1, 2, 3, 4) GROUP BY segment, grp, rep, lam"""


@query("m06c_group_summary", sim_sql(f"SELECT segment, unit AS grp, horizon, {_SUMMARY_COLS}, verdict, confidence FROM ({stats_sql('segment, unit', f'({_GSIM})', 'n_obs', 'base', 'cap')}) CROSS JOIN {_HZ}"))
def group_summary(r: Roles):
    rolled = replicate.roll_up(_demand_sim(r), KEYS, CAL.demand_span, demand=True)
    out = replicate.summarise(rolled, KEYS, CAL, ("h1", "h3", "h5"))
    return out.select("segment", "grp", "horizon", "rate_pct", "delta_pct", "ci_lo", "ci_hi", "verdict", "confidence")
