"""C, W, T: index algebra, ranks, classes, rankings, and the zone aggregates of A built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.functions.scalars import implied_rate_pct, per_thousand
from geopanel.operators import compose, panel, rank
from geopanel.operators.compose import State
from geopanel.plans.aggregates import verdict_sql
from geopanel.plans.registry import class_sql, query, r6, with_ctes
from geopanel.plans.roles import CAL, Roles
from geopanel.sources.catalog import BRANCHES

WEIGHTS = {"educacion": 3.0, "salud": 2.0, "comercio": 1.0, "verde": 4.0}
STATE = State(weights=WEIGHTS)

# --- flagship ----------------------------------------------------------------------------------

_PR = "((rank() OVER ({p} ORDER BY {v}) + (count(*) OVER ({q}) - 1) / 2e0 - 1) / nullif(count({v}) OVER ({p}) - 1, 0))"


def pct_sql(value: str, part: str = "") -> str:
    """Average-tie percentile rank over non-NULL rows only."""
    p = f"PARTITION BY {part}" if part else ""
    q = f"PARTITION BY {part + ', ' if part else ''}{value}"
    return _PR.format(p=p, q=q, v=value)


_COV = "SELECT w.unit, w.grp, s0, s2, CASE WHEN d1 > 0 THEN s2 * 1000e0 / d1 END AS cov FROM pwide w LEFT JOIN pdem d USING (unit)"


def _part_coverage(r: Roles):
    s = r.part_supply.selectExpr("unit", "grp", "s[0] AS s0", "s[2] AS s2")
    return s.join(r.part_demand.select("unit", "d1"), "unit", "left").withColumn("cov", per_thousand("s2", "d1"))


@query(
    "c00_top_opportunities",
    with_ctes(
        "pwide", "pdem",
        body=f"""SELECT unit, grp, {r6('cov')} AS coverage, {r6('o')} AS opportunity FROM (
        SELECT *, greatest(0, least(1, 1 - {pct_sql('cov')} + greatest(-0.15e0, least(0.15e0, -rate / 5)))) AS o FROM (
            SELECT *, CASE WHEN s0 <= 0 THEN 0 WHEN s2 <= 0 THEN -100 ELSE 100 * ln(s2 / s0) / 4 END AS rate FROM ({_COV}) WHERE cov IS NOT NULL))
        ORDER BY o DESC, unit LIMIT 20""",
    ),
)
def flagship(r: Roles):
    """Supply panel -> coverage -> average-tie percentile -> opportunity -> top 20."""
    ranked = rank.percentile_rank(_part_coverage(r), [], "cov", "rank")
    rate = implied_rate_pct("s0", "s2", 4.0)
    out = ranked.withColumn("value", compose.opportunity(F.col("rank"), F.lit(0.0), rate))
    return compose.ranking(out, "value", 20).select("unit", "grp", F.col("cov").alias("coverage"), F.col("value").alias("opportunity"))


# --- W -----------------------------------------------------------------------------------------


@query("w01_pct_rank_avg", with_ctes("pwide", "pdem", body=f"SELECT unit, {r6(pct_sql('cov'))} AS pr FROM ({_COV}) WHERE cov IS NOT NULL UNION ALL SELECT unit, NULL FROM ({_COV}) WHERE cov IS NULL"))
def pct_rank(r: Roles):
    return rank.percentile_rank(_part_coverage(r), [], "cov", "pr").select("unit", "pr")


@query("w01b_pct_rank_by_group", with_ctes("pwide", "pdem", body=f"SELECT unit, {r6(f'CASE WHEN count(*) OVER (PARTITION BY grp) = 1 THEN 0.5e0 ELSE {pct_sql(chr(99) + chr(111) + chr(118), chr(103) + chr(114) + chr(112))} END')} AS pr FROM ({_COV}) WHERE cov IS NOT NULL"))
def pct_rank_group(r: Roles):
    return rank.percentile_rank(_part_coverage(r).where("cov IS NOT NULL"), ["grp"], "cov", "pr").select("unit", "pr")


@query("w02_quantile_classes", with_ctes("pwide", "pdem", body=f"SELECT unit, cls AS class FROM ({class_sql('cov', 7, _COV)})"))
def classes(r: Roles):
    return rank.classify(_part_coverage(r), [], "cov", 7, "class").select("unit", "class")


@query(
    "w03_terciles_quintiles",
    with_ctes(
        "pwide", "pdem",
        body=f"""SELECT a.unit, CASE a.cls WHEN 1 THEN 'baja' WHEN 2 THEN 'media' WHEN 3 THEN 'alta' ELSE 'sin_datos' END AS tercile, b.cls AS quintile,
        CASE WHEN b.cls <= 2 THEN 'baja' WHEN b.cls = 3 THEN 'media' WHEN b.cls > 3 THEN 'alta' ELSE 'sin_datos' END AS legend
        FROM ({class_sql('cov', 3, _COV)}) a JOIN ({class_sql('cov', 5, _COV)}) b USING (unit)""",
    ),
)
def terciles(r: Roles):
    rows = rank.classify(rank.classify(_part_coverage(r), [], "cov", 3, "t"), [], "cov", 5, "quintile")
    return rows.select("unit", rank.tercile_name(F.col("t")).alias("tercile"), "quintile", rank.tercile_of_quintile(F.col("quintile")).alias("legend"))


@query("w04_terciles_per_group", with_ctes("pwide", "pdem", body=f"SELECT unit, cls AS tercile FROM ({class_sql('cov', 3, _COV, 'grp')})"))
def terciles_group(r: Roles):
    return rank.classify(_part_coverage(r), ["grp"], "cov", 3, "tercile").select("unit", "tercile")


@query("w05_carry_last_observation", with_ctes("plong", body="SELECT grp, t, CAST(sum(s) AS BIGINT) AS s, CAST(sum(s_last) AS BIGINT) AS s_last FROM plong GROUP BY 1, 2"))
def carry(r: Roles):
    long = panel.supply_long(r.part_supply, CAL.cuts)
    return long.groupBy("grp", "t").agg(F.sum("s").alias("s"), F.sum("s_last").alias("s_last"))


@query(
    "w06_top_per_key",
    "SELECT l_suppkey AS unit, l_partkey AS best FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1",
)
def top_per_key(r: Roles):
    sums = r.table("lineitem").groupBy(F.col("l_suppkey").alias("unit"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return sums.groupBy("unit").agg(F.min_by("l_partkey", F.struct(-F.col("q"), "l_partkey")).alias("best"))


# --- levels and coverage -----------------------------------------------------------------------

_LD = "(SELECT unit, grp, CASE WHEN delta_pct IS NULL THEN level_base ELSE level_base * (1 + delta_pct / 100) END AS ld, coalesce(rate_pct, 0) AS rd, rate_pct AS rdraw, coalesce(confidence, 'baja') AS conf, reason FROM pub WHERE branch = 'demanda' AND cell = 'todas' AND horizon = 'h3')"
_LS = """(SELECT unit, branch, sum(coalesce(level_base, 0)) AS b0, sum(coalesce(level_base * (1 + coalesce(delta_pct, 0) / 100), 0)) AS ls FROM pub
    WHERE (branch IN ('educacion', 'salud', 'comercio') AND horizon = 'h3') OR branch = 'verde' GROUP BY 1, 2)"""
_RS = "CASE WHEN branch = 'verde' OR b0 IS NULL THEN NULL WHEN b0 <= 0 THEN 0 WHEN ls <= 0 THEN -100 ELSE 100 * ln(ls / b0) / 3 END"
_BR = "(VALUES ('educacion', 3e0, 1), ('salud', 2e0, 2), ('comercio', 1e0, 3), ('verde', 4e0, 4)) b(branch, w, ord)"
_CB = f"SELECT d.*, b.branch, b.w, b.ord, b0, ls, {_RS.replace('branch', 's.branch')} AS rs, CASE WHEN ld > 0 THEN ls / ld * 1000 END AS cov FROM {_LD} d CROSS JOIN {_BR} LEFT JOIN {_LS} s ON s.unit = d.unit AND s.branch = b.branch"
_ADJ_O = "CASE WHEN branch = 'verde' THEN 0 WHEN rs IS NULL THEN NULL ELSE greatest(-0.15e0, least(0.15e0, (rd - rs) / 5)) END"
_ADJ_F = "CASE WHEN branch = 'verde' THEN 0 WHEN rs IS NULL THEN NULL ELSE greatest(-0.15e0, least(0.15e0, rs / 5)) * CASE conf WHEN 'alta' THEN 1 WHEN 'media' THEN 0.5 ELSE 0 END END"
_CLIP = "CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0, least(1, {x})) END"
_IDX = f"""SELECT *, {_CLIP.format(x=f'(1 - pr + {_ADJ_O})')} AS o, {_CLIP.format(x=f'(pr + {_ADJ_F})')} AS f FROM (
    SELECT *, CASE WHEN cov IS NOT NULL THEN {pct_sql('cov', 'branch, (cov IS NULL)')} END AS pr FROM ({_CB}))"""


@query(
    "c01_level_at_horizon",
    with_ctes("pub", body=f"SELECT branch, cell, unit, horizon, {r6('coalesce(level_base * (1 + coalesce(delta_pct, 0) / 100), 0)')} AS level FROM pub"),
)
def level_at(r: Roles):
    from geopanel.functions.scalars import level_at_horizon

    return r.published.select("branch", "cell", "unit", "horizon", level_at_horizon("level_base", "delta_pct").alias("level"))


@query("c02_sum_selected_cells", with_ctes("pub", body=f"""SELECT unit, branch, {r6('sum(coalesce(level_base, 0))')} AS level_s0,
    {r6('sum(coalesce(level_base * (1 + coalesce(delta_pct, 0) / 100), 0))')} AS level_s FROM pub WHERE branch = 'educacion' AND horizon = 'h1' AND cell = 'A__F' GROUP BY 1, 2
    UNION ALL SELECT unit, branch, {r6('sum(coalesce(level_base, 0))')}, {r6('sum(coalesce(level_base * (1 + coalesce(delta_pct, 0) / 100), 0))')} FROM pub
    WHERE (branch IN ('salud', 'comercio') AND horizon = 'h1') OR branch = 'verde' GROUP BY 1, 2"""))
def sum_cells(r: Roles):
    state = State(horizon="h1", cells={"educacion": ("A__F",)})
    return compose.branch_levels(r.published, state).select("unit", "branch", "level_s0", "level_s")


@query("c03_implied_rate", with_ctes("pub", body=f"SELECT unit, branch, {r6(_RS)} AS rate_s FROM {_LS}"))
def implied(r: Roles):
    return compose.branch_levels(r.published, STATE).select("unit", "branch", "rate_s")


@query("c04_coverage", with_ctes("pub", body=f"SELECT unit, branch, {r6('cov')} AS coverage FROM ({_CB})"))
def coverage(r: Roles):
    return compose.coverage_by_branch(r.published, STATE).select("unit", "branch", "coverage")


@query("c05_opportunity_index", with_ctes("pub", body=f"SELECT unit, branch, {r6('o')} AS o FROM ({_IDX})"))
def opportunity(r: Roles):
    return compose.branch_indices(r.summary, STATE).select("unit", "branch", "o")


@query("c06_availability_index", with_ctes("pub", body=f"SELECT unit, branch, {r6('f')} AS f FROM ({_IDX})"))
def availability(r: Roles):
    return compose.branch_indices(r.summary, STATE).select("unit", "branch", "f")


_VAL = "sum(w * o) FILTER (WHERE o IS NOT NULL) / nullif(sum(w) FILTER (WHERE o IS NOT NULL), 0)"


@query("c07_composite_index", with_ctes("pub", body=f"SELECT unit, {r6(_VAL)} AS value FROM ({_IDX}) GROUP BY 1"))
def composite(r: Roles):
    return compose.branch_indices(r.summary, STATE).groupBy("unit").agg(compose.weighted_index("o", WEIGHTS).alias("value"))


_PICKS = ", ".join(f"max(CASE WHEN branch = '{b}' THEN {c} END) AS {n}_{b}" for n, c in (("o", "o"), ("coverage", "cov")) for b in BRANCHES)
_FIXED = {b: f"CASE WHEN o_{b} IS NULL THEN 0 ELSE {WEIGHTS[b]}e0 END" for b in BRANCHES}
_ROWVAL = f"({' + '.join(f'{_FIXED[b]} * coalesce(o_{b}, 0)' for b in BRANCHES)}) / nullif({' + '.join(_FIXED.values())}, 0)"
_WIDE = f"SELECT unit, grp, conf AS confidence, max(reason) AS reason, coalesce(max(ld), 0) AS weight, {_PICKS} FROM idx GROUP BY unit, grp, conf"
_WIDE = f"SELECT *, {_ROWVAL} AS value FROM ({_WIDE})"
_NAME = "CASE {c} WHEN 1 THEN 'baja' WHEN 2 THEN 'media' WHEN 3 THEN 'alta' ELSE 'sin_datos' END"


def composed_sql(body: str) -> str:
    """``comp``: the oracle's composition table."""
    parts = [f"idx AS MATERIALIZED ({_IDX})", f"wide AS MATERIALIZED ({_WIDE})"]
    joins, cols = [], []
    for c, n in [("value", 3), ("value", 5), *[(f"o_{b}", 3) for b in BRANCHES]]:
        name = f"k_{c}_{n}"
        parts.append(f"{name} AS (SELECT unit, cls FROM ({class_sql(c, n, 'SELECT * FROM wide')}))")
        joins.append(f"JOIN {name} USING (unit)")
        cols.append(f"{name}.cls AS {name}c")
    terciles = ", ".join(f"{_NAME.format(c=f'k_o_{b}_3c')} AS tercile_{b}" for b in BRANCHES)
    parts.append(
        f"""comp AS MATERIALIZED (SELECT *, {_NAME.format(c='k_value_3c')} AS tercile, k_value_5c AS quintile, confidence = 'baja' AS low_confidence, {terciles} FROM (
        SELECT wide.*, CASE WHEN value IS NOT NULL THEN {pct_sql('value', '(value IS NULL)')} END AS percentile, {', '.join(cols)} FROM wide {' '.join(joins)}))"""
    )
    base = with_ctes("pub", body="")
    return base.rstrip() + ",\n" + ",\n".join(parts) + "\n" + body


_COMP_COLS = ["unit", "grp", "value", "percentile", "quintile", "tercile", "confidence", "reason", "low_confidence", "weight"]
_COMP_COLS += [f"{p}_{b}" for p in ("o", "tercile", "coverage") for b in BRANCHES]


def _cols(names: list[str]) -> str:
    rounded = ("value", "percentile", "weight")
    return ", ".join(f"{r6(c)} AS {c}" if c in rounded or c.startswith(("o_", "coverage_")) else c for c in names)


@query("c08_full_composition", composed_sql(f"SELECT {_cols(_COMP_COLS)} FROM comp"))
def full(r: Roles):
    return compose.compose(r.summary, STATE)


#: Published levels only: a unit without a change is not ranked, a branch without cells is level zero.
_CBS = (
    _CB.replace("CASE WHEN delta_pct IS NULL THEN level_base ELSE level_base * (1 + delta_pct / 100) END AS ld", "level_base * (1 + delta_pct / 100) AS ld")
    .replace("rate_pct AS rdraw", "CASE WHEN delta_pct IS NOT NULL THEN rate_pct END AS rdraw")
    .replace("OR b0 IS NULL THEN NULL WHEN b0 <= 0", "THEN NULL WHEN b0 IS NULL OR b0 <= 0").replace("s.branch = 'verde'", "b.branch = 'verde'")
    .replace("THEN ls / ld * 1000 END", "THEN coalesce(ls, 0) / ld * 1000 END")
)
_SENS = f"""WITH_BASE SELECT {{cols}} FROM (
    SELECT branch, unit, max(CASE WHEN k = 3 THEN p END) AS lo, max(CASE WHEN k = 8 THEN p END) AS hi FROM (
        SELECT branch, unit, k, CASE WHEN o IS NOT NULL THEN {pct_sql('o', 'branch, k, (o IS NULL)')} END AS p FROM (
            SELECT branch, unit, k, {_CLIP.format(x='(1 - pr + greatest(-0.15e0, least(0.15e0, (rdraw - rs) / k)))')} AS o FROM (
                SELECT *, CASE WHEN cov IS NOT NULL THEN {pct_sql('cov', 'branch, (cov IS NULL)')} END AS pr FROM ({_CBS}) WHERE b.branch <> 'verde')
            CROSS JOIN (VALUES (3e0), (8e0)) k(k) )) GROUP BY 1, 2)"""
_SENS = _SENS.replace("WITH_BASE ", "").replace(" WHERE b.branch <> 'verde'", "").replace(f"({_CBS})", f"(SELECT * FROM ({_CBS}) WHERE branch <> 'verde')")
# A missing rate must not be swallowed by greatest/least.
_SENS = _SENS.replace("(1 - pr + greatest(-0.15e0, least(0.15e0, (rdraw - rs) / k)))", "(1 - pr + CASE WHEN rdraw - rs IS NOT NULL THEN greatest(-0.15e0, least(0.15e0, (rdraw - rs) / k)) END)")


@query("c09_sensitivity_to_k", with_ctes("pub", body=_SENS.format(cols=f"branch, unit, {r6('lo')} AS rank_lo, {r6('hi')} AS rank_hi, coalesce(abs(lo - hi) > 0.10e0, false) AS moves")))
def sensitivity(r: Roles):
    return compose.published_sensitivity(r.summary)


@query("c10_sensitivity_totals", with_ctes("pub", body=_SENS.format(cols="branch, count(*) FILTER (WHERE abs(lo - hi) > 0.10e0) AS n_moved, count(*) FILTER (WHERE lo IS NOT NULL AND hi IS NOT NULL) AS n_evaluated") + " GROUP BY 1"))
def sensitivity_totals(r: Roles):
    return compose.sensitivity_totals(compose.published_sensitivity(r.summary), ["branch"])


# --- zone summaries ----------------------------------------------------------------------------


def _mode_sql(label: str) -> str:
    return f"""SELECT z.grp, coalesce(m.v, 'sin_datos') AS v FROM (SELECT grp, sum(weight) AS tot FROM comp GROUP BY 1) z LEFT JOIN (
        SELECT p.grp, v, row_number() OVER (PARTITION BY p.grp ORDER BY CASE WHEN tot > 0 THEN w ELSE c END DESC, f) AS k
        FROM (SELECT grp, {label} AS v, sum(weight) AS w, count(*) AS c, min(unit) AS f FROM comp GROUP BY 1, 2) p
        JOIN (SELECT grp, sum(weight) AS tot FROM comp GROUP BY 1) t USING (grp) WHERE v <> 'sin_datos') m ON m.grp = z.grp AND k = 1"""


_LABELS = ["tercile", "confidence", *[f"tercile_{b}" for b in BRANCHES]]
_MEANS = ", ".join(f"sum(o_{b} * weight) FILTER (WHERE o_{b} IS NOT NULL) / nullif(sum(weight) FILTER (WHERE o_{b} IS NOT NULL), 0) AS o_{b}" for b in BRANCHES)


def _top_sql(src: str, key: str, n: int = 2) -> str:
    rows = " UNION ALL ".join(f"SELECT {key}, '{b}' AS branch, {i} AS ord, o_{b} * {WEIGHTS[b]}e0 AS sc FROM {src}" for i, b in enumerate(BRANCHES))
    return f"""SELECT {key}, string_agg(branch, ',' ORDER BY k) AS top_branches FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sc DESC, ord) AS k FROM ({rows}) WHERE sc IS NOT NULL) WHERE k <= {n} GROUP BY 1"""


_ZONE = (
    f"SELECT m.grp, {', '.join(f'{c}m.v AS {c}' for c in _LABELS)}, {', '.join(f'm.o_{b}' for b in BRANCHES)}, coalesce(t.top_branches, '') AS top_branches "
    f"FROM (SELECT grp, {_MEANS} FROM comp GROUP BY 1) m LEFT JOIN ({_top_sql(f'(SELECT grp, {_MEANS} FROM comp GROUP BY 1)', 'grp')}) t ON t.grp = m.grp "
    + " ".join(f"JOIN ({_mode_sql(c)}) {c}m ON {c}m.grp = m.grp" for c in _LABELS)
)


@query("a16_zone_summary", composed_sql(f"SELECT {_cols(['grp', *_LABELS, *[f'o_{b}' for b in BRANCHES], 'top_branches'])} FROM ({_ZONE})"))
def zones(r: Roles):
    return compose.zone_summary(compose.compose(r.summary, STATE), ["grp"], WEIGHTS)


@query(
    "a18_legend_counts",
    composed_sql("""SELECT grp, count(*) FILTER (WHERE tercile = 'alta') AS n_alta, count(*) FILTER (WHERE tercile = 'media') AS n_media,
    count(*) FILTER (WHERE tercile = 'baja') AS n_baja, count(*) FILTER (WHERE tercile = 'sin_datos') AS n_sin_datos, count(*) AS total,
    count(*) FILTER (WHERE tercile <> 'sin_datos' AND low_confidence) AS n_low_confidence FROM comp GROUP BY 1"""),
)
def legend(r: Roles):
    return compose.legend_counts(compose.compose(r.summary, STATE), ["grp"])


@query("p17_tercile_filter", composed_sql("SELECT unit, grp FROM comp WHERE tercile = 'alta'"))
def tercile_filter(r: Roles):
    return compose.compose(r.summary, STATE).where("tercile = 'alta'").select("unit", "grp")


@query("w09_main_branch", composed_sql(f"SELECT unit, top_branches AS main_branch FROM ({_top_sql('comp', 'unit', 1)}) RIGHT JOIN (SELECT unit FROM comp) USING (unit)"))
def main_branch(r: Roles):
    return compose.compose(r.summary, STATE).select("unit", compose.main_branch(WEIGHTS).alias("main_branch"))


_CONTR = " UNION ALL ".join(
    f"SELECT unit, '{b}' AS branch, {WEIGHTS[b]}e0 AS branch_weight, o_{b} AS o, {' + '.join(f'coalesce(o_{x} * {WEIGHTS[x]}e0, 0)' for x in BRANCHES)} AS tot FROM comp" for b in BRANCHES
)
_SHARES = f"SELECT unit, branch, branch_weight, o, CASE WHEN tot > 0 THEN branch_weight * o * 100 / tot END AS share_pct FROM ({_CONTR})"


@query("w10_contribution_shares", composed_sql(f"SELECT unit, branch, {r6('branch_weight')} AS branch_weight, {r6('o')} AS o, {r6('share_pct')} AS share_pct FROM ({_SHARES})"))
def shares(r: Roles):
    return compose.contributions(compose.compose(r.summary, STATE), WEIGHTS)


@query(
    "c11_compare_groups",
    composed_sql(
        f"SELECT field, max(v) FILTER (WHERE grp = 6) AS a, max(v) FILTER (WHERE grp = 9) AS b FROM (SELECT grp, unnest(['educacion', 'salud', 'comercio', 'verde', 'oportunidad', 'confianza']) AS field, "
        f"unnest([tercile_educacion, tercile_salud, tercile_comercio, tercile_verde, tercile, confidence]) AS v FROM ({_ZONE}) WHERE grp IN (6, 9)) GROUP BY 1"
    ),
)
def compare(r: Roles):
    return compose.compare_groups(compose.compose(r.summary, STATE), 6, 9, WEIGHTS)


@query(
    "c12_fact_sheet",
    composed_sql(
        f"SELECT c.unit, grp, reason, tercile, confidence, coalesce(top_branches, '') AS top_branches, {', '.join(f'tercile_{b}' for b in BRANCHES)} "
        f"FROM comp c LEFT JOIN ({_top_sql('comp', 'unit')}) t ON t.unit = c.unit"
    ),
)
def fact_sheet(r: Roles):
    return compose.fact_sheet(compose.compose(r.summary, STATE), WEIGHTS)


_P3 = "(SELECT * FROM pub WHERE branch = 'demanda' AND cell = 'todas' AND horizon = 'h3' AND level_base IS NOT NULL AND delta_pct IS NOT NULL)"


@query(
    "c13_zone_population",
    with_ctes(
        "pub", "dem",
        body=f"""SELECT unit, 'history' AS kind, t, {r6('v')} AS value, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM (
            SELECT unit, 1995.5e0 AS t, d0 AS v FROM dem WHERE segment = 'todas' AND d0 IS NOT NULL UNION ALL SELECT unit, 2000.5e0, d1 FROM dem WHERE segment = 'todas' AND d1 IS NOT NULL)
            WHERE unit IN (SELECT unit FROM {_P3})
        UNION ALL SELECT unit, 'base', 2001.5e0, {r6('level_base')}, NULL, NULL FROM {_P3}
        UNION ALL SELECT unit, 'projection', 2004.5e0, {r6('level_base * (1 + delta_pct / 100)')}, {r6('level_base * (1 + ci_lo / 100)')}, {r6('level_base * (1 + ci_hi / 100)')} FROM {_P3}""",
    ),
)
def zone_population(r: Roles):
    from geopanel.operators.quality import demand_points

    series = demand_points(r.demand_all, CAL.t0, CAL.t1, []).where("value IS NOT NULL")
    return compose.zone_population(r.published, series, STATE, CAL.t_base, CAL.t_base + 3)


_COVLONG = " UNION ALL ".join(f"SELECT unit, '{b}' AS branch, coverage_{b} AS coverage, weight FROM comp" for b in BRANCHES)


@query(
    "c13b_zone_services",
    composed_sql(
        f"""SELECT s.unit, s.branch, {r6('branch_weight')} AS branch_weight, {r6('o')} AS o, {r6('share_pct')} AS share_pct, {r6('coverage')} AS coverage,
        {r6('b0')} AS level_s0, {r6('ls')} AS level_s, {r6('rs')} AS rate_s, {r6('ref')} AS coverage_ref,
        CASE WHEN rs > 1 THEN 'sube' WHEN rs < -1 THEN 'baja' WHEN rs IS NOT NULL THEN 'se_mantiene' END AS verdict
        FROM ({_SHARES}) s JOIN ({_COVLONG}) c USING (unit, branch) LEFT JOIN (SELECT *, {_RS} AS rs FROM {_LS}) l USING (unit, branch)
        JOIN (SELECT branch, sum(coverage * weight) FILTER (WHERE coverage IS NOT NULL) / nullif(sum(weight) FILTER (WHERE coverage IS NOT NULL), 0) AS ref FROM ({_COVLONG}) GROUP BY 1) r USING (branch)"""
    ),
)
def zone_services(r: Roles):
    return compose.zone_services(r.summary, compose.compose(r.summary, STATE), STATE)


@query("c14_local_verdict", with_ctes("pub", body=f"SELECT unit, branch, CASE WHEN rs > 1 THEN 'sube' WHEN rs < -1 THEN 'baja' WHEN rs IS NOT NULL THEN 'se_mantiene' END AS verdict FROM (SELECT *, {_RS} AS rs FROM {_LS})"))
def local_verdict(r: Roles):
    return compose.branch_levels(r.published, STATE).select("unit", "branch", compose.local_verdict(F.col("rate_s")).alias("verdict"))


_ROOT = "SELECT horizon, delta_pct, ci_lo, ci_hi FROM pub_root WHERE branch = 'demanda' AND cell = 'todas'"


@query(
    "c15_headline",
    with_ctes(
        "pub", "pub_root",
        body=f"SELECT v.*, {r6('delta_pct')} AS delta_pct, {r6('ci_lo')} AS ci_lo, {r6('ci_hi')} AS ci_hi FROM ("
        + verdict_sql("horizon", "(SELECT * FROM pub WHERE branch = 'demanda' AND cell = 'todas')")
        + f") v LEFT JOIN ({_ROOT}) r USING (horizon)",
    ),
)
def headline(r: Roles):
    records = r.published.where("branch = 'demanda' AND cell = 'todas'")
    root = r.root_summary.where("branch = 'demanda' AND cell = 'todas'")
    return compose.headline(records, root, ["horizon"])


# --- T -----------------------------------------------------------------------------------------


@query("t01_top_by_value", composed_sql(f"SELECT unit, {r6('value')} AS value FROM comp ORDER BY comp.value DESC NULLS LAST, unit LIMIT 20"))
def top_value(r: Roles):
    return compose.ranking(compose.compose(r.summary, STATE), "value", 20).select("unit", "value")


@query("t02_top_by_group_name", composed_sql("SELECT unit, n_name AS name FROM comp JOIN nation ON n_nationkey = grp ORDER BY n_name, unit LIMIT 25"))
def top_name(r: Roles):
    names = r.table("nation").selectExpr("n_nationkey AS grp", "n_name AS name")
    named = compose.compose(r.summary, STATE).join(names, "grp")
    return compose.ranking(named, "group", 25, "name").select("unit", "name")


@query(
    "t03_top_by_confidence",
    composed_sql("SELECT unit, confidence FROM comp ORDER BY CASE confidence WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END, comp.value DESC NULLS LAST, unit LIMIT 30"),
)
def top_confidence(r: Roles):
    return compose.ranking(compose.compose(r.summary, STATE), "confidence", 30).select("unit", "confidence")


_CHG = "(SELECT * FROM pub WHERE branch = 'educacion' AND cell = 'A__F' AND horizon = 'h3')"


def _changes(r: Roles):
    return r.published.where("branch = 'educacion' AND cell = 'A__F' AND horizon = 'h3'")


@query("t04_change_table", with_ctes("pub", body=f"SELECT unit, {r6('delta_pct')} AS delta_pct FROM {_CHG} p ORDER BY p.delta_pct ASC NULLS LAST, unit"))
def changes(r: Roles):
    return compose.change_table(_changes(r), "change").select("unit", "delta_pct")


@query("t04b_change_by_confidence", with_ctes("pub", body=f"SELECT unit, confidence FROM {_CHG} ORDER BY CASE confidence WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END, delta_pct ASC NULLS LAST, unit"))
def changes_confidence(r: Roles):
    return compose.change_table(_changes(r), "confidence").select("unit", "confidence")


@query("t08_canonical_order", with_ctes("plong", body="SELECT unit, t, s, s_last FROM plong ORDER BY unit, t"))
def canonical(r: Roles):
    return panel.supply_long(r.part_supply, CAL.cuts).select("unit", "t", "s", "s_last").orderBy("unit", "t")
