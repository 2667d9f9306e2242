"""A: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.operators import compose, estimate, panel, profile, quality, trend
from geopanel.operators.compose import State
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CAL, Roles


@query(
    "a01_distinct_entities",
    with_ctes("ent", body="SELECT l_partkey AS unit, cell, cut + 0.5e0 AS t, count(DISTINCT entity_id) AS s FROM ent WHERE cut IN (1996, 1998, 2000) GROUP BY ALL"),
)
def distinct_entities(r: Roles):
    return panel.entity_counts(r.entities().where(F.col("t").isNotNull()), ["unit", "cell"])


@query(
    "a02_eligible_group_sums",
    with_ctes("dem", body=f"SELECT segment, grp, {r6('sum(d0)')} AS sum_d0, {r6('sum(d1)')} AS sum_d1 FROM dem WHERE reason IS NULL AND d0 IS NOT NULL GROUP BY 1, 2"),
)
def eligible_sums(r: Roles):
    return estimate.group_rates(estimate.eligible(r.demand()), ["segment"], CAL.dt).select("segment", "grp", "sum_d0", "sum_d1")


@query("a03_null_preserving_sum", with_ctes("dem", body=f"SELECT segment, grp, {r6('sum(d0)')} AS d0, {r6('sum(d1)')} AS d1 FROM dem GROUP BY 1, 2"))
def null_sum(r: Roles):
    return r.demand().groupBy("segment", "grp").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))


_GREEN = ["n_cobertura_verde", "area_cobertura_verde_m2", "n_areas_recreativas", "area_areas_recreativas_m2", "n_espacios_publicos", "area_espacios_publicos_m2"]
_G = lambda agg: ", ".join((r6(agg.format(c)) if c.startswith("area") else f"CAST({agg.format(c)} AS BIGINT)") + f" AS {c}" for c in _GREEN)


@query("a04_green_per_unit", with_ctes("green", body=f"SELECT unit, {_G('{}')} FROM green"))
def green(r: Roles):
    return r.green.select("unit", *_GREEN)


@query("a05_green_rollup", with_ctes("green", body=f"SELECT CASE WHEN grouping(grp) = 1 THEN 'root' ELSE CAST(grp AS VARCHAR) END AS grp, {_G('sum({})')} FROM green GROUP BY ROLLUP (grp)"))
def green_rollup(r: Roles):
    return panel.green_rollup(r.green)


@query(
    "a06_conditional_sums",
    with_ctes("ent", body=f"SELECT l_suppkey AS unit, cut AS year, {r6('sum(l_quantity) FILTER (WHERE sector = ' + chr(39) + 'F' + chr(39) + ')')} AS pop_0_14, {r6('sum(l_quantity)')} AS pop_total FROM ent GROUP BY 1, 2"),
)
def conditional(r: Roles):
    e = r.entities("l_suppkey")
    return e.groupBy("unit", F.col("cut").alias("year")).agg(
        F.sum(F.when(F.col("sector") == "F", F.col("l_quantity"))).alias("pop_0_14"), F.sum("l_quantity").alias("pop_total")
    )


@query(
    "a07_verdict_distribution",
    with_ctes(
        "pub",
        body="""SELECT branch, cell, grp, horizon, count(*) FILTER (WHERE verdict = 'sube') AS sube, count(*) FILTER (WHERE verdict = 'se_mantiene') AS se_mantiene,
        count(*) FILTER (WHERE verdict = 'baja') AS baja, count(*) FILTER (WHERE verdict = 'sin_datos') AS sin_datos
        FROM pub WHERE branch <> 'verde' GROUP BY 1, 2, 3, 4""",
    ),
)
def distribution(r: Roles):
    return quality.verdict_distribution(r.published.where("branch <> 'verde'"), ["branch", "cell"])


@query(
    "a12_coverage_report",
    with_ctes(
        "dem", "stot", "supps",
        body="""SELECT 'universo' AS metric, ambit AS item, count(*) AS n FROM supps GROUP BY 2
        UNION ALL SELECT 'motivo', coalesce(reason, 'con_dato'), count(*) FROM dem WHERE segment = 'todas' GROUP BY 2
        UNION ALL SELECT 'relacion', relation, count(*) FROM dem WHERE segment = 'todas' AND ambit = 'urbano' GROUP BY 2
        UNION ALL SELECT 'oferta_por_corte', '1996.5', sum(s0)::BIGINT FROM stot UNION ALL SELECT 'oferta_por_corte', '1998.5', sum(s1)::BIGINT FROM stot
        UNION ALL SELECT 'oferta_por_corte', '2000.5', sum(s2)::BIGINT FROM stot
        UNION ALL SELECT 'sin_oferta_en_ningun_corte', 'total', count(*) FILTER (WHERE s0 + s1 + s2 = 0) FROM stot""",
    ),
)
def coverage_report(r: Roles):
    return panel.coverage_report(r.demand_all, panel.supply_long(r.supply_total, CAL.cuts), r.suppliers)


_GAP = with_ctes("pwide", "pdem", body="SELECT w.unit, w.grp, w.s2 AS s_last, d.d1, CASE WHEN d.d1 > 0 THEN s2 * 1000e0 / d1 END AS gap FROM pwide w LEFT JOIN pdem d USING (unit)")


def _gap(r: Roles):
    supply = r.part_supply.select("unit", "grp", F.element_at("s", -1).alias("s_last"))
    return panel.gap_by_unit(supply, r.part_demand)


@query("a13_supply_gap_per_unit", f"SELECT unit, grp, s_last, d1, {r6('gap')} AS gap FROM ({_GAP})")
def gap_unit(r: Roles):
    return _gap(r)


@query("a13b_supply_gap_per_group", f"SELECT grp, CAST(sum(s_last) AS BIGINT) AS s_last, {r6('coalesce(sum(d1), 0)')} AS d1, {r6('sum(s_last) * 1000e0 / nullif(sum(d1), 0)')} AS gap FROM ({_GAP}) GROUP BY 1")
def gap_group(r: Roles):
    return panel.gap_by_group(_gap(r))


@query(
    "a14_weighted_mean",
    f"""SELECT c_nationkey AS zone, {r6('sum(v * w) FILTER (WHERE v IS NOT NULL) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0)')} AS mean
    FROM (SELECT c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 END AS v, greatest(c_acctbal, 0) AS w FROM customer) GROUP BY 1""",
)
def weighted_mean(r: Roles):
    k = F.col("c_custkey")
    rows = r.table("customer").select(F.col("c_nationkey").alias("zone"), F.when(k % 7 != 0, k % 50).alias("v"), F.col("c_acctbal").alias("w"))
    return rows.groupBy("zone").agg(compose.weighted_mean("v", "w").alias("mean"))


@query(
    "a15_weighted_mode",
    """WITH x AS (SELECT c_nationkey AS zone, c_custkey AS unit, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'sin_datos' ELSE c_mktsegment END AS v,
        CASE WHEN c_nationkey % 5 = 0 THEN 0e0 ELSE greatest(c_acctbal, 0) END AS w FROM customer),
    t AS (SELECT zone, sum(w) AS tot FROM x GROUP BY 1),
    p AS (SELECT zone, v, sum(w) AS w, count(*) AS c, min(unit) AS f FROM x GROUP BY 1, 2)
    SELECT t.zone, coalesce(m.v, 'sin_datos') AS mode FROM t LEFT JOIN (
        SELECT zone, v, row_number() OVER (PARTITION BY zone ORDER BY CASE WHEN tot > 0 THEN w ELSE c END DESC, f) AS k
        FROM p JOIN t USING (zone) WHERE v <> 'sin_datos') m ON m.zone = t.zone AND k = 1""",
)
def weighted_mode(r: Roles):
    seg = F.col("c_mktsegment")
    rows = r.table("customer").select(
        F.col("c_nationkey").alias("zone"),
        F.col("c_custkey").alias("unit"),
        F.when(seg == "MACHINERY", "sin_datos").otherwise(seg).alias("v"),
        F.when(F.col("c_nationkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("w"),
    )
    return compose.weighted_mode(rows, ["zone"], "v", "w", "mode")


_VSUM = """SELECT {keys}, count(*) AS total, u + d + f AS valid, u AS n_up, d AS n_down, f AS n_flat, count(*) - u - d - f AS n_none,
    CASE WHEN u + d + f > 0 THEN CAST(floor(u * 100e0 / (u + d + f) + 0.5) AS BIGINT) ELSE 0 END AS pct_up,
    CASE WHEN u + d + f > 0 THEN CAST(floor(d * 100e0 / (u + d + f) + 0.5) AS BIGINT) ELSE 0 END AS pct_down,
    CASE WHEN u + d + f > 0 THEN CAST(floor(f * 100e0 / (u + d + f) + 0.5) AS BIGINT) ELSE 0 END AS pct_flat,
    u + d + f > 0 AND low >= 0.5 * (u + d + f) AS low_confidence,
    CASE WHEN u + d + f < 8 THEN 'insuficiente' WHEN d >= 0.6e0 * (u + d + f) AND u <= 0.15e0 * (u + d + f) THEN 'baja'
         WHEN u >= 0.6e0 * (u + d + f) AND d <= 0.15e0 * (u + d + f) THEN 'sube' WHEN u >= 0.25e0 * (u + d + f) AND d >= 0.25e0 * (u + d + f) THEN 'polarizado'
         WHEN f >= 0.5e0 * (u + d + f) THEN 'mantiene' ELSE 'mixto' END AS scenario
    FROM (SELECT {keys}, count(*) FILTER (WHERE verdict = 'sube') AS u, count(*) FILTER (WHERE verdict = 'baja') AS d,
        count(*) FILTER (WHERE verdict = 'se_mantiene') AS f, count(*) FILTER (WHERE verdict IN ('sube', 'baja', 'se_mantiene') AND confidence = 'baja') AS low,
        count(*) AS n FROM {src} GROUP BY {keys}) GROUP BY ALL"""


def verdict_sql(keys: str, src: str) -> str:
    return _VSUM.format(keys=keys, src=src).replace("count(*) AS total", "n AS total").replace("count(*) - u - d - f", "n - u - d - f")


@query("a17_verdict_summary", with_ctes("pub", body=verdict_sql("branch, cell, horizon", "(SELECT * FROM pub WHERE branch <> 'verde')")))
def verdicts(r: Roles):
    return compose.verdict_summary(r.published.where("branch <> 'verde'"), ["branch", "cell", "horizon"])


@query(
    "a19_units_per_group",
    with_ctes("pub", "supps", body=verdict_sql("grp", "(SELECT u.grp, p.verdict, p.confidence FROM supps u LEFT JOIN (SELECT * FROM pub WHERE branch = 'educacion' AND cell = 'A__F' AND horizon = 'h3') p USING (unit))")),
)
def per_group(r: Roles):
    """From the universe: units without a record count as no-data."""
    records = r.published.where("branch = 'educacion' AND cell = 'A__F' AND horizon = 'h3'").select("unit", "verdict", "confidence")
    return compose.verdict_summary(r.suppliers.join(records, "unit", "left"), ["grp"])


@query(
    "a21_composition_by_subcategory",
    f"SELECT c_nationkey AS zone, c_mktsegment AS part, count(*) AS n, {r6('count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY c_nationkey)')} AS share_pct FROM customer GROUP BY 1, 2",
)
def composition(r: Roles):
    rows = r.table("customer").select(F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("part"))
    return trend.composition(rows, "zone", "part")


@query(
    "a23_key_checks",
    with_ctes("kparts", body="""SELECT count(*) AS n_units, count(*) FILTER (WHERE ambit = 'urbano') AS n_urban, count(*) FILTER (WHERE ambit <> 'urbano') AS n_rural,
    count(*) FILTER (WHERE length(unit) <> CASE WHEN ambit = 'urbano' THEN 13 ELSE 9 END) AS n_bad_length, count(*) - count(DISTINCT unit) AS n_duplicate FROM kparts"""),
)
def key_checks(r: Roles):
    return quality.key_checks(r.keyed_parts)


@query("a24_listed_counts", "SELECT string_agg(c || ' ' || n, ', ' ORDER BY n DESC, c) AS listed FROM (SELECT p_brand AS c, count(*) AS n FROM part GROUP BY 1)")
def listed(r: Roles):
    return profile.listed_counts(r.table("part"), "p_brand")


@query(
    "a25_reference_coverage_by_branch",
    with_ctes(
        "pub",
        body=f"""SELECT branch, {r6('sum(cov * w) FILTER (WHERE cov IS NOT NULL) / nullif(sum(w) FILTER (WHERE cov IS NOT NULL), 0)')} AS coverage_ref FROM (
        SELECT b.branch, greatest(coalesce(ld, 0), 0) AS w, CASE WHEN ld > 0 THEN ls / ld * 1000 END AS cov
        FROM (SELECT unit, level_base * (1 + coalesce(delta_pct, 0) / 100) AS ld FROM pub WHERE branch = 'demanda' AND cell = 'todas' AND horizon = 'h3') d
        CROSS JOIN (VALUES ('educacion'), ('salud'), ('comercio'), ('verde')) b(branch)
        LEFT JOIN (SELECT unit, branch, sum(coalesce(level_base * (1 + coalesce(delta_pct, 0) / 100), 0)) AS ls FROM pub
            WHERE (branch IN ('educacion', 'salud', 'comercio') AND horizon = 'h3') OR branch = 'verde' GROUP BY 1, 2) s USING (unit, branch)) GROUP BY 1""",
    ),
)
def reference(r: Roles):
    cov = compose.coverage_by_branch(r.published, State())
    weighted = cov.withColumn("weight", F.coalesce("level_d", F.lit(0.0)))
    return weighted.groupBy("branch").agg(compose.weighted_mean("coverage", "weight").alias("coverage_ref"))
