"""Q: contract assembly and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.operators import panel, quality
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CAL, CELLS, Roles
from geopanel.sources import catalog

H5, H3 = ("h1", "h3", "h5"), ("h1", "h3")


@query(
    "q01_demand_series",
    with_ctes("dem", body="SELECT segment, unit, list_filter([CASE WHEN d0 IS NOT NULL THEN 1995.5e0 END, CASE WHEN d1 IS NOT NULL THEN 2000.5e0 END], lambda x: x IS NOT NULL)::VARCHAR AS t, list_filter([d0, d1], lambda x: x IS NOT NULL)::VARCHAR AS valor FROM dem"),
)
def demand_series(r: Roles):
    s = quality.series(quality.demand_points(r.demand(), CAL.t0, CAL.t1), ["segment", "unit"])
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    return s.select("segment", "unit", text(F.col("serie.t")).alias("t"), text(F.col("serie.valor")).alias("valor"))


@query("q01b_group_demand_points", with_ctes("dem", body=f"SELECT segment, grp, t, {r6('round_even(v, 1)')} AS value FROM (SELECT segment, grp, 1995.5e0 AS t, sum(d0) AS v FROM dem GROUP BY 1, 2 UNION ALL SELECT segment, grp, 2000.5e0, sum(d1) FROM dem GROUP BY 1, 2)"))
def group_points(r: Roles):
    return quality.demand_points(r.demand(), CAL.t0, CAL.t1, by_group=True)


@query("q01c_supply_series", with_ctes("swide", body="SELECT cell, unit, '[' || s0 || ', ' || s1 || ', ' || s2 || ']' AS valor FROM swide"))
def supply_series(r: Roles):
    s = quality.series(quality.supply_points(panel.supply_long(r.supply_cells, CAL.cuts), ["cell"]), ["cell", "unit"])
    return s.select("cell", "unit", F.concat(F.lit("["), F.array_join(F.transform("serie.valor", lambda x: x.cast("string")), ", "), F.lit("]")).alias("valor"))


@query("q01d_group_supply_points", with_ctes("plong", body="SELECT grp, t, CAST(sum(s) AS BIGINT) AS value FROM plong GROUP BY 1, 2"))
def group_supply(r: Roles):
    return quality.supply_points(panel.supply_long(r.part_supply, CAL.cuts), by_group=True)


def _demand_layer(r: Roles):
    """Demand layer from the published rates of the usable units; everything else becomes no-data."""
    pub = r.summary.where("branch = 'demanda' AND verdict <> 'sin_datos'").withColumnRenamed("cell", "segment")
    levels = pub.where("horizon = 'h1'").select("segment", "unit", "level_base")
    reasons = r.demand().select("segment", "unit", "reason")
    return quality.layer(r.suppliers, pub, levels, reasons, ["segment"], {"segment": list(catalog.SEGMENTS)}, H5)


_DEMAND_LAYER = """SELECT n.segment, u.unit, u.grp, h.horizon, CASE WHEN p.verdict <> 'sin_datos' THEN p.n_obs ELSE 0 END AS n_obs, d.reason,
    CASE WHEN p.verdict <> 'sin_datos' THEN p.level_base END AS level_base, p.rate_pct, p.delta_pct, p.ci_lo, p.ci_hi, p.verdict, p.confidence
    FROM supps u CROSS JOIN segnames n CROSS JOIN (VALUES ('h1'), ('h3'), ('h5')) h(horizon)
    LEFT JOIN pub p ON p.branch = 'demanda' AND p.cell = n.segment AND p.unit = u.unit AND p.horizon = h.horizon
    LEFT JOIN dem d ON d.segment = n.segment AND d.unit = u.unit"""
_NUM = ", ".join(f"{r6(c)} AS {c}" for c in ("level_base", "rate_pct", "delta_pct", "ci_lo", "ci_hi"))


@query("q02_demand_layer", with_ctes("pub", "supps", "segnames", body=f"SELECT segment, unit, grp, horizon, n_obs, reason, {_NUM}, verdict, confidence FROM ({_DEMAND_LAYER})"))
def demand_layer(r: Roles):
    return _demand_layer(r)


def _supply_layer(r: Roles):
    """Six cells; rural suppliers and empty cells are no-data with their own reason and observation count."""
    pub = r.summary.where("branch IN ('educacion', 'salud', 'comercio') AND verdict <> 'sin_datos'")
    levels = pub.where("horizon = 'h1'").select("cell", "unit", "level_base")
    total = r.supply_cells.selectExpr("cell", "unit", "s[0] + s[1] + s[2] AS total")
    grid = r.suppliers.withColumn("cell", F.explode(F.array(*[F.lit(c) for c in CELLS])))
    from geopanel.functions.rules import supply_reason

    reasons = grid.join(total, ["cell", "unit"], "left").select("cell", "unit", supply_reason(F.col("ambit"), F.col("total")).alias("reason"))
    return quality.layer(r.suppliers, pub, levels, reasons, ["cell"], {"cell": list(CELLS)}, H3)


_SUPPLY_LAYER = """SELECT c.cell, u.unit, u.grp, h.horizon, CASE WHEN p.verdict <> 'sin_datos' THEN p.n_obs WHEN u.ambit = 'rural' THEN 0 WHEN s0 + s1 + s2 = 0 THEN 3 ELSE 0 END AS n_obs,
    CASE WHEN u.ambit = 'rural' THEN 'rural' WHEN s0 + s1 + s2 = 0 THEN 'sin_establecimientos' END AS reason, p.level_base, p.rate_pct, p.delta_pct, p.ci_lo, p.ci_hi,
    coalesce(p.verdict, 'sin_datos') AS verdict, coalesce(p.confidence, 'baja') AS confidence
    FROM supps u CROSS JOIN cells c CROSS JOIN (VALUES ('h1'), ('h3')) h(horizon) LEFT JOIN swide w ON w.unit = u.unit AND w.cell = c.cell
    LEFT JOIN pub p ON p.cell = c.cell AND p.unit = u.unit AND p.horizon = h.horizon AND p.branch <> 'demanda'"""


@query("q02b_supply_layer", with_ctes("pub", "supps", "cells", "swide", body=f"SELECT cell, unit, grp, horizon, n_obs, reason, {_NUM}, verdict, confidence FROM ({_SUPPLY_LAYER})"))
def supply_layer(r: Roles):
    return _supply_layer(r)


_POINTS = "SELECT cell, unit, len([s0, s1, s2]) AS n_points, s0 + s1 + s2 AS points FROM swide"


def _supply_series(r: Roles):
    return quality.series(quality.supply_points(panel.supply_long(r.supply_cells, CAL.cuts), ["cell"]), ["cell", "unit"])


def _demand_series(r: Roles):
    return quality.series(quality.demand_points(r.demand(), CAL.t0, CAL.t1), ["segment", "unit"])


_total = lambda field, zero: F.aggregate(F.flatten(F.transform(F.map_values(field), lambda v: F.coalesce(v["serie"]["valor"], F.array()))), zero, lambda a, x: a + x)


@query("q03_nested_by_cell", with_ctes("pub", "supps", "cells", "swide", body=f"""SELECT unit, grp, count(DISTINCT cell) AS n_cells, count(*) AS n_records, max(CASE WHEN cell = 'A__F' AND horizon = 'h3' THEN verdict END) AS verdict,
    {r6("max(CASE WHEN cell = 'A__F' AND horizon = 'h3' THEN delta_pct END)")} AS delta_pct, CAST(coalesce(any_value(t.points), 0) AS BIGINT) AS points
    FROM ({_SUPPLY_LAYER}) LEFT JOIN (SELECT unit, sum(points) AS points FROM ({_POINTS}) GROUP BY 1) t USING (unit) GROUP BY 1, 2"""))
def nested(r: Roles):
    """Cells of a unit with their observed series; ``points`` adds up all observed values."""
    n = quality.nested(_supply_layer(r), "cell", "celdas", _supply_series(r))
    at = lambda c: F.element_at(F.element_at("celdas", "A__F")["h"], "h3")[c]
    sizes = F.aggregate(F.map_values("celdas"), F.lit(0), lambda a, v: a + F.size(v["h"]))
    return n.select("unit", "grp", F.size("celdas").alias("n_cells"), sizes.alias("n_records"), at("veredicto").alias("verdict"), at("delta_pct").alias("delta_pct"), _total("celdas", F.lit(0).cast("bigint")).alias("points"))


@query("q03b_nested_by_segment", with_ctes("pub", "supps", "segnames", body=f"""SELECT unit, grp, count(DISTINCT segment) AS n_segments, count(*) AS n_records, max(CASE WHEN segment = 'todas' AND horizon = 'h5' THEN verdict END) AS verdict,
    {r6('coalesce(any_value(t.points), 0)')} AS points FROM ({_DEMAND_LAYER}) LEFT JOIN (SELECT unit, sum(coalesce(d0, 0) + coalesce(d1, 0)) AS points FROM dem GROUP BY 1) t USING (unit) GROUP BY 1, 2"""))
def nested_demand(r: Roles):
    n = quality.nested(_demand_layer(r), "segment", "segmentos", _demand_series(r))
    verdict = F.element_at(F.element_at("segmentos", "todas")["h"], "h5")["veredicto"]
    sizes = F.aggregate(F.map_values("segmentos"), F.lit(0), lambda a, v: a + F.size(v["h"]))
    return n.select("unit", "grp", F.size("segmentos").alias("n_segments"), sizes.alias("n_records"), verdict.alias("verdict"), _total("segmentos", F.lit(0.0)).alias("points"))


@query("q04_green_layer", with_ctes("greencells", body=f"SELECT unit, grp, cell, CASE WHEN ambit <> 'rural' THEN level_base END AS level_base, CASE WHEN ambit <> 'rural' THEN {r6('area')} END AS area, CASE WHEN ambit = 'rural' THEN 'rural' END AS reason FROM greencells"))
def green(r: Roles):
    return quality.green_records(r.green)


@query(
    "q05_root_aggregate",
    with_ctes(
        "pub_root",
        body=f"""SELECT c.cell, h.horizon, coalesce(n_obs, 0) AS n_obs, {_NUM}, coalesce(verdict, 'sin_datos') AS verdict, coalesce(confidence, 'baja') AS confidence
        FROM (SELECT cell FROM cells UNION ALL SELECT 'X__X') c CROSS JOIN (VALUES ('h1'), ('h3')) h(horizon) LEFT JOIN (SELECT * FROM pub_root WHERE branch <> 'demanda') p USING (cell, horizon)""",
    ),
)
def root(r: Roles):
    """From the replicates of the groups. A member no unit has (``X__X``) stays as a no-data record."""
    rows = r.root_summary.where("branch <> 'demanda'")
    out = quality.root_records(rows, ["cell"], {"cell": [*CELLS, "X__X"]}, H3)
    return out.select("cell", "horizon", "n_obs", "level_base", "rate_pct", "delta_pct", "ci_lo", "ci_hi", "verdict", "confidence")


@query("q05b_root_demand", with_ctes("pub_root", body=f"SELECT cell AS segment, horizon, n_obs, {_NUM}, verdict, confidence FROM pub_root WHERE branch = 'demanda'"))
def root_demand(r: Roles):
    rows = r.root_summary.where("branch = 'demanda'")
    return rows.select(F.col("cell").alias("segment"), "horizon", "n_obs", "level_base", "rate_pct", "delta_pct", "ci_lo", "ci_hi", "verdict", "confidence")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ("sube", "se_mantiene", "baja", "sin_datos"))


@query(
    "q06_group_distribution",
    with_ctes("pub", "pub_group", "supps", "segnames", body=f"""SELECT d.*, {r6('g.delta_pct')} AS delta_pct, coalesce(g.verdict, 'sin_datos') AS verdict
    FROM (SELECT segment, grp, horizon, {_COUNTS} FROM ({_DEMAND_LAYER}) GROUP BY 1, 2, 3) d
    LEFT JOIN (SELECT * FROM pub_group WHERE branch = 'demanda') g ON g.cell = d.segment AND g.unit = d.grp AND g.horizon = d.horizon"""),
)
def group_distribution(r: Roles):
    """Verdicts of the units of every group next to the group's own change and verdict, all segments."""
    counts = quality.verdict_distribution(_demand_layer(r), ["segment"])
    own = r.group_summary.where("branch = 'demanda'").select(F.col("cell").alias("segment"), "grp", "horizon", "delta_pct", "verdict")
    return counts.join(own, ["segment", "grp", "horizon"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("sin_datos")))


def _broken(r: Roles):
    """The demand layer with errors planted by unit number."""
    bad = _demand_layer(r)
    return bad.withColumns(
        {
            "verdict": F.expr("if(unit % 11 = 3, 'otro', verdict)"),
            "confidence": F.expr("if(unit % 13 = 5, 'total', confidence)"),
            "ci_lo": F.expr("if(unit % 7 = 2, NULL, ci_lo)"),
            "ci_hi": F.expr("if(unit % 5 = 1, ci_lo, ci_hi)"),
            "unit": F.expr("lpad(string(unit), if(unit % 17 = 4, 5, 9), '0')"),
        }
    )


_BROKEN = f"""SELECT *, lpad(CAST(unit AS VARCHAR), CASE WHEN unit % 17 = 4 THEN 5 ELSE 9 END, '0') AS key, CASE WHEN unit % 11 = 3 THEN 'otro' ELSE verdict END AS v, CASE WHEN unit % 13 = 5 THEN 'total' ELSE confidence END AS c,
    CASE WHEN unit % 7 = 2 THEN NULL ELSE ci_lo END AS lo, CASE WHEN unit % 5 = 1 THEN ci_lo ELSE ci_hi END AS hi FROM ({_DEMAND_LAYER})"""


@query(
    "q07_record_violations",
    with_ctes(
        "pub", "supps", "segnames",
        body=f"""SELECT key AS unit, segment, horizon, rule FROM (SELECT *, unnest(list_filter([CASE WHEN length(key) NOT IN (3, 9, 13) THEN 'key_length' END, CASE WHEN v NOT IN ('sube', 'se_mantiene', 'baja', 'sin_datos') THEN 'verdict_domain' END,
        CASE WHEN c NOT IN ('alta', 'media', 'baja') THEN 'confidence_domain' END, CASE WHEN delta_pct IS NOT NULL AND (lo IS NULL OR hi IS NULL) THEN 'interval_missing' END,
        CASE WHEN delta_pct IS NOT NULL AND NOT (lo <= delta_pct AND delta_pct <= hi) THEN 'interval_misses_point' END], lambda x: x IS NOT NULL)) AS rule FROM ({_BROKEN}))""",
    ),
)
def violations(r: Roles):
    return quality.record_violations(_broken(r), "segment", supply=False).select("unit", "segment", "horizon", "rule")


@query(
    "q07d_supply_violations",
    with_ctes("pub", "supps", "cells", "swide", body=f"""SELECT key AS unit, cell, horizon, rule FROM (SELECT *, unnest(list_filter([CASE WHEN length(key) NOT IN (3, 9, 13) THEN 'key_length' END,
        CASE WHEN c = 'alta' THEN 'supply_never_high' END, CASE WHEN delta_pct IS NOT NULL AND NOT (ci_lo <= d AND d <= ci_hi) THEN 'interval_misses_point' END], lambda x: x IS NOT NULL)) AS rule FROM (
        SELECT *, lpad(CAST(unit AS VARCHAR), CASE WHEN unit % 17 = 4 THEN 5 ELSE 9 END, '0') AS key, CASE WHEN unit % 13 = 5 THEN 'alta' ELSE confidence END AS c, CASE WHEN unit % 7 = 2 THEN ci_hi + 1 ELSE delta_pct END AS d FROM ({_SUPPLY_LAYER})))"""),
)
def supply_violations(r: Roles):
    """All cells of the supply layer, errors planted by unit number; supply is never of high confidence."""
    bad = _supply_layer(r).withColumns(
        {"confidence": F.expr("if(unit % 13 = 5, 'alta', confidence)"), "delta_pct": F.expr("if(unit % 7 = 2 AND delta_pct IS NOT NULL, ci_hi + 1, delta_pct)"), "unit": F.expr("lpad(string(unit), if(unit % 17 = 4, 5, 9), '0')")}
    )
    return quality.record_violations(bad, "cell", supply=True).select("unit", "cell", "horizon", "rule")


@query(
    "q07b_completeness_violations",
    with_ctes(
        "pub", "supps", "segnames",
        body=f"""SELECT CAST(unit AS VARCHAR) AS unit, segment, horizon, 'missing_pair' AS rule FROM supps CROSS JOIN (SELECT unnest({list(catalog.SEGMENTS)}) AS segment) CROSS JOIN (SELECT unnest({list(H5)}) AS horizon)
        WHERE unit % 12 <> 7 AND ((unit % 9 = 4 AND segment = 'primaria') OR (unit % 8 = 1 AND horizon = 'h5') OR (unit % 10 = 3 AND segment = 'todas' AND horizon = 'h1'))
        UNION ALL SELECT CAST(unit AS VARCHAR), NULL, NULL, 'outside_catalogue' FROM supps WHERE unit % 12 <> 7 AND unit % 15 = 2
        UNION ALL SELECT CAST(unit AS VARCHAR), NULL, NULL, 'no_records' FROM supps WHERE unit % 12 = 7""",
    ),
)
def completeness(r: Roles):
    """A missing member, a missing horizon, one missing pair, a record outside the catalogue, and units without records."""
    layer = _demand_layer(r).where("unit % 12 <> 7").select("unit", "segment", "horizon")
    extra = layer.where("unit % 15 = 2 AND segment = 'todas' AND horizon = 'h3'").withColumn("segment", F.lit("otra"))
    gaps = layer.where("NOT (unit % 9 = 4 AND segment = 'primaria') AND NOT (unit % 8 = 1 AND horizon = 'h5') AND NOT (unit % 10 = 3 AND segment = 'todas' AND horizon = 'h1')")
    return quality.completeness_violations(gaps.unionAll(extra), "segment", list(catalog.SEGMENTS), H5, r.suppliers.select("unit"))


@query("q07c_header_violations", with_ctes("kparts", body="""SELECT unnest(list_filter([CASE WHEN min(grp) <> 'zzz' THEN 'version' END, CASE WHEN list_sort(list(DISTINCT grp)) <> list_transform(range(2, 18), lambda i: lpad(CAST(i AS VARCHAR), 3, '0')) THEN 'group_keys' END], lambda x: x IS NOT NULL)) AS rule FROM kparts"""))
def header(r: Roles):
    """The groups of the keyed parts go beyond the sixteen expected codes, and the version is old."""
    head = r.keyed_parts.agg(F.collect_set("grp").alias("groups")).select(  # one entry per group code
        F.lit("1.2").alias("version"), F.array(*[F.lit(h) for h in H5]).alias("horizons"), "groups"
    )
    return quality.header_violations(head, group_level=True)


@query("q08_reconcile_levels", with_ctes("pub", "pub_group", body=f"""SELECT branch, cell, horizon, grp, {r6('e')} AS expected, {r6('o')} AS obtained, {r6('abs(o - e) / nullif(abs(e), 0)')} AS rel_error, coalesce(abs(o - e) / nullif(abs(e), 0) <= 0.05e0, true) AS ok FROM (
    SELECT u.*, g.level_base * (1 + g.delta_pct / 100) AS o FROM (SELECT branch, cell, horizon, grp, sum(level_base * (1 + delta_pct / 100)) AS e FROM pub WHERE delta_pct IS NOT NULL GROUP BY 1, 2, 3, 4) u
    JOIN pub_group g ON g.branch = u.branch AND g.cell = u.cell AND g.horizon = u.horizon AND g.unit = u.grp)"""))
def reconcile(r: Roles):
    """Levels of the units against the level of their group, which comes from the group's own replicates."""
    return quality.reconcile_levels(r.published, r.group_summary, keys=("branch", "cell", "horizon"))


@query("q10_duplicate_ids", "SELECT year(l_shipdate) AS cut, l_orderkey AS entity_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(r: Roles):
    return quality.duplicate_keys(r.entities(), ["cut", "entity_id"])


@query("q11_unique_grid", with_ctes("plong", body="SELECT unit, t, count(*) AS n FROM (SELECT unit, t FROM plong UNION ALL SELECT unit, t FROM plong WHERE unit % 50 = 3 UNION ALL SELECT unit, t FROM plong WHERE unit % 70 = 9 AND t = 1998.5e0) GROUP BY 1, 2 HAVING count(*) > 1"))
def unique_grid(r: Roles):
    """Repeated points planted by unit number in a grid that has none."""
    grid = panel.supply_long(r.part_supply, CAL.cuts)
    return quality.duplicate_keys(grid.unionAll(grid.where("unit % 50 = 3")).unionAll(grid.where("unit % 70 = 9 AND t = 1998.5D")), ["unit", "t"])


@query("q12_key_and_box_checks", with_ctes("squares", body="""SELECT count(*) AS n_units, count(*) FILTER (WHERE ambit = 'urbano') AS n_urban, count(*) FILTER (WHERE ambit <> 'urbano') AS n_rural,
    count(*) FILTER (WHERE (CASE WHEN unit % 19 = 6 THEN 12 WHEN ambit = 'urbano' THEN 13 ELSE 9 END) <> CASE WHEN ambit = 'urbano' THEN 13 ELSE 9 END) AS n_bad_length, 0 AS n_duplicate,
    count(*) FILTER (WHERE x1 < 5 OR y1 < 0 OR x2 > 195 OR y2 > 1000) AS n_outside FROM squares"""))
def box(r: Roles):
    keyed = r.squares(r.suppliers).withColumn("unit", F.expr("lpad(string(unit), if(unit % 19 = 6, 12, if(ambit = 'urbano', 13, 9)), '0')"))
    return quality.key_checks(keyed, (5.0, 0.0, 195.0, 1000.0))


@query("q13_disjoint_cells", "SELECT l_orderkey AS entity_id, year(l_shipdate) AS cut, count(DISTINCT l_returnflag || '__' || l_linestatus) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag || '__' || l_linestatus) > 1")
def disjoint(r: Roles):
    return quality.cell_overlaps(r.entities(), ["entity_id", "cut"])


@query("q13b_cells_against_total", with_ctes("swide", "stot", body="SELECT unit, s2 AS total, CAST(p AS BIGINT) AS parts FROM stot JOIN (SELECT unit, sum(s2) AS p FROM swide GROUP BY 1) USING (unit) WHERE p <> s2"))
def partition(r: Roles):
    last = lambda df: df.withColumn("s", F.element_at("s", -1))
    return quality.partition_gap(last(r.supply_cells), last(r.supply_total), ["unit"])


@query("q13c_segments_against_total", with_ctes("dem", body="SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE t <> p) AS n_off FROM (SELECT unit, max(d1) FILTER (WHERE segment = 'todas') AS t, sum(d1) FILTER (WHERE segment <> 'todas') AS p FROM dem GROUP BY 1) WHERE t IS NOT NULL"))
def segments(r: Roles):
    sums = r.demand().groupBy("unit").agg(F.expr("max(d1) FILTER (WHERE segment = 'todas')").alias("t"), F.expr("sum(d1) FILTER (WHERE segment <> 'todas')").alias("p"))
    return sums.where("t IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") != F.col("p")).alias("n_off"))
