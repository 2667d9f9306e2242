"""The published run as SQL blocks for the oracle engine: both simulations, their roll-ups, and the records of every level."""

from __future__ import annotations

from geopanel.plans.projection import _CHANGE, SIMBASE, SUPPLY_SIM, _q, posterior_sql, stats_sql
from geopanel.plans.registry import with_ctes

BRANCH = "CASE cell[1] WHEN 'A' THEN 'educacion' WHEN 'N' THEN 'salud' ELSE 'comercio' END"
_BASE = with_ctes("swide", body="").rstrip().removeprefix("WITH ")
_SUPPLY = posterior_sql("").rstrip().removeprefix("WITH RECURSIVE ").removeprefix(_BASE).lstrip(",\n").replace("post AS (", "spost AS (") + ",\n" + SUPPLY_SIM.replace("FROM post p", "FROM spost p")

#: Simulations of the upper levels, in the shape that ``stats_sql`` reads.
_UPPER = {
    "dgroup": """SELECT segment, grp AS unit, grp, rep, lam, max(n_obs) AS n_obs, sum(base) AS base, NULL AS cap, ln(sum(base * exp(r * 6)) / sum(base)) / 6 AS r FROM sim GROUP BY segment, grp, rep, lam""",
    "droot": """SELECT segment, 'root' AS unit, 'root' AS grp, rep, lam, max(n_obs) AS n_obs, sum(base) AS base, NULL AS cap, ln(sum(base * exp(r * 6)) / sum(base)) / 6 AS r FROM sim GROUP BY segment, rep, lam""",
    "sunit": "SELECT cell, unit, grp, 3 AS n_obs, CAST(s2 AS DOUBLE) AS base, 'media' AS cap, rep, 0e0 AS lam, r FROM ssim",
    "sgroup": """SELECT cell, grp AS unit, grp, 3 AS n_obs, CAST(sum(s2) AS DOUBLE) AS base, 'media' AS cap, rep, 0e0 AS lam, ln(sum(s2 * exp(r * 4)) / sum(s2)) / 4 AS r
        FROM ssim GROUP BY cell, grp, rep HAVING sum(s2) > 0""",
    "sroot": """SELECT cell, 'root' AS unit, 'root' AS grp, 3 AS n_obs, CAST(sum(s2) AS DOUBLE) AS base, 'media' AS cap, rep, 0e0 AS lam, ln(sum(s2 * exp(r * 4)) / sum(s2)) / 4 AS r
        FROM ssim GROUP BY cell, rep HAVING sum(s2) > 0""",
}


def _records(member: str, source: str, conf_base: str, horizons: str) -> str:
    """Published values of every simulated row of ``source``."""
    r1 = lambda x: f"CAST(round_even({x}, 1) AS DOUBLE)"
    stats = stats_sql(f"{member}, unit", source, "n_obs", conf_base, "cap")
    return f"""SELECT {member} AS cell, unit, horizon, n_obs, {r1(f'base * exp({_q(0.5)} * 1)')} AS level_base, {r1(_q(0.5, _CHANGE))} AS delta_pct, {r1(_q(0.5) + ' * 100')} AS rate_pct,
        {r1(_q(0.025, _CHANGE))} AS ci_lo, {r1(_q(0.975, _CHANGE))} AS ci_hi, verdict, confidence FROM ({stats}) CROSS JOIN (VALUES {horizons}) h(horizon, yrs)"""


_H5, _H3 = "('h1', 1e0), ('h3', 3e0), ('h5', 5e0)", "('h1', 1e0), ('h3', 3e0)"
_VALUES = "p.level_base, p.delta_pct, p.rate_pct, p.ci_lo, p.ci_hi, coalesce(p.verdict, 'sin_datos') AS verdict, coalesce(p.confidence, 'baja') AS confidence"

BLOCKS = {
    "sims": SIMBASE + ",\n" + _SUPPLY,
    **_UPPER,
    "pub": f"""SELECT 'demanda' AS branch, d.segment AS cell, d.unit, d.grp, h.horizon, coalesce(p.n_obs, 0) AS n_obs, d.reason, {_VALUES}
        FROM dem d CROSS JOIN (VALUES ('h1'), ('h3'), ('h5')) h(horizon) LEFT JOIN ({_records('segment', 'sim', 'base', _H5)}) p ON p.cell = d.segment AND p.unit = d.unit AND p.horizon = h.horizon
        UNION ALL
        SELECT {BRANCH.replace('cell', 'w.cell')}, w.cell, w.unit, w.grp, h.horizon, CASE WHEN s0 + s1 + s2 > 0 THEN coalesce(p.n_obs, 0) ELSE 0 END, CASE WHEN s0 + s1 + s2 = 0 THEN 'sin_establecimientos' END, {_VALUES}
        FROM swide w CROSS JOIN (VALUES ('h1'), ('h3')) h(horizon) LEFT JOIN ({_records('cell', 'sunit', 'NULL', _H3)}) p ON s0 + s1 + s2 > 0 AND p.cell = w.cell AND p.unit = w.unit AND p.horizon = h.horizon
        UNION ALL
        SELECT 'verde', cell, unit, grp, 'actual', 1, NULL, CAST(level_base AS DOUBLE), NULL, NULL, NULL, NULL, NULL, 'baja' FROM greencells WHERE ambit = 'urbano'""",
}
for _level in ("group", "root"):
    BLOCKS[f"pub_{_level}"] = f"""SELECT 'demanda' AS branch, * FROM ({_records('segment', f'd{_level}', 'base', _H5)})
        UNION ALL SELECT {BRANCH}, * FROM ({_records('cell', f's{_level}', 'NULL', _H3)})"""
NEEDS = {
    "sims": ("dem", "ctl", "swide"),
    **{name: ("sims",) for name in _UPPER},
    "pub": ("sims", "sunit", "greencells"),
    "pub_group": ("dgroup", "sgroup"),
    "pub_root": ("droot", "sroot"),
}
#: Blocks that are several named expressions already, and those that are computed once.
RAW, ONCE = {"sims"}, {*_UPPER, "pub", "pub_group", "pub_root"}
