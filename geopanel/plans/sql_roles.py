"""The same roles as SQL blocks for the oracle engine, written independently of the DataFrame plans."""

SEGMENT_SUMS = {
    "todas": "p_0a2 + p_3a5 + p_6a11 + p_12a14 + p_15a17",
    "primera_infancia": "p_0a2",
    "preescolar": "p_3a5",
    "primaria": "p_6a11",
    "secundaria": "p_12a14",
    "adolescencia": "p_15a17",
}

BANDS = ["p_0a2", "p_3a5", "p_6a11", "p_12a14", "p_15a17"]


def _band(i: int, name: str) -> str:
    n = f"count(*) FILTER (WHERE l_quantity > {10 * i} AND l_quantity <= {10 * i + 10})"
    return f"CASE WHEN {n} >= 8 THEN {n} END AS {name}"


_segments = " UNION ALL ".join(
    f"SELECT unit, yr, '{s}' AS segment, CAST({e} AS DOUBLE) AS v FROM census" for s, e in SEGMENT_SUMS.items()
)

BLOCKS = {
    "parts": "SELECT p_partkey AS unit, p_brand AS grp, CASE WHEN p_size < 4 THEN 'rural' ELSE 'urbano' END AS ambit FROM part",
    "supps": "SELECT s_suppkey AS unit, s_nationkey AS grp, CASE WHEN s_acctbal < 300 THEN 'rural' ELSE 'urbano' END AS ambit FROM supplier",
    "kparts": """SELECT p_partkey,
        (CASE WHEN p_partkey % 97 = 5 THEN '15' ELSE '09' END) || lpad(CAST(CAST(substr(p_brand, 7) AS INT) + 1 AS VARCHAR), 3, '0')
        || CASE WHEN p_size < 4 THEN lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') ELSE lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS unit,
        lpad(CAST(CAST(substr(p_brand, 7) AS INT) + 1 AS VARCHAR), 3, '0') AS grp,
        CASE WHEN p_size < 4 THEN 'rural' ELSE 'urbano' END AS ambit FROM part""",
    "ent": """SELECT l_orderkey AS entity_id, l_partkey, l_suppkey, year(l_shipdate) AS cut, l_returnflag AS lvl, l_linestatus AS sector,
        l_returnflag || '__' || l_linestatus AS cell, CASE WHEN l_linenumber <= 5 THEN 'Principal' ELSE 'Complementario' END AS scope,
        l_quantity FROM lineitem""",
    # supplier × cell, one column per cut
    "cells": "SELECT * FROM (VALUES ('A__F'), ('A__O'), ('N__F'), ('N__O'), ('R__F'), ('R__O')) v(cell)",
    "swide": """SELECT u.unit, u.grp, c.cell,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 1996) AS s0,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 1998) AS s1,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 2000) AS s2
        FROM (SELECT * FROM supps WHERE ambit = 'urbano') u CROSS JOIN cells c
        LEFT JOIN ent e ON e.l_suppkey = u.unit AND e.cell = c.cell GROUP BY ALL""",
    "stot": """SELECT u.unit, u.grp,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 1996) AS s0,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 1998) AS s1,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 2000) AS s2
        FROM (SELECT * FROM supps WHERE ambit = 'urbano') u LEFT JOIN ent e ON e.l_suppkey = u.unit GROUP BY ALL""",
    "pwide": """SELECT u.unit, u.grp,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 1996) AS s0,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 1998) AS s1,
        count(DISTINCT e.entity_id) FILTER (WHERE cut = 2000) AS s2
        FROM (SELECT * FROM parts WHERE ambit = 'urbano') u LEFT JOIN ent e ON e.l_partkey = u.unit GROUP BY ALL""",
    "plong": """SELECT unit, grp, t, s, s2 AS s_last FROM (
        SELECT unit, grp, 1996.5e0 AS t, s0 AS s, s2 FROM pwide UNION ALL SELECT unit, grp, 1998.5e0, s1, s2 FROM pwide
        UNION ALL SELECT unit, grp, 2000.5e0, s2, s2 FROM pwide)""",
    "pdem": """SELECT p.unit, p.grp, p.ambit, e.d1 FROM parts p LEFT JOIN
        (SELECT l_partkey AS unit, count(*) AS d1 FROM ent WHERE cut = 2000 GROUP BY 1) e USING (unit)""",
    "census": "SELECT l_suppkey AS unit, year(l_shipdate) AS yr, "
    + ", ".join(_band(i, b) for i, b in enumerate(BANDS))
    + " FROM lineitem WHERE year(l_shipdate) IN (1995, 2000) GROUP BY 1, 2",
    "xwalk": """SELECT unit, CASE WHEN unit % 10 = 1 THEN unit - 1 ELSE unit END AS unit_prev,
        CASE WHEN unit % 10 = 1 THEN 'division' WHEN unit % 10 = 4 THEN 'cambio_limites' ELSE 'misma' END AS relation
        FROM supps WHERE unit % 10 <> 7""",
    "segs": _segments,
    "segnames": "SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in SEGMENT_SUMS) + ") v(segment)",
    "dem": """SELECT n.segment, u.unit, u.grp, u.ambit,
        CASE WHEN u.ambit <> 'rural' THEN coalesce(x.relation, 'sin_contraparte') END AS relation,
        e.v AS d0, l.v AS d1,
        CASE WHEN u.ambit = 'rural' THEN 'rural' WHEN l.unit IS NULL THEN 'sin_censo' WHEN l.v IS NULL THEN 'suprimido_inegi'
             WHEN l.v < 20 THEN 'd2020_menor_20' END AS reason
        FROM supps u CROSS JOIN segnames n
        LEFT JOIN segs l ON l.unit = u.unit AND l.segment = n.segment AND l.yr = 2000
        LEFT JOIN xwalk x ON x.unit = u.unit
        LEFT JOIN segs e ON e.unit = x.unit_prev AND e.segment = n.segment AND e.yr = 1995""",
    "ctl": "SELECT s.grp, cut AS yr, sum(l_quantity) AS population FROM ent JOIN supps s ON s.unit = l_suppkey GROUP BY 1, 2",
    "green": """SELECT u.unit, u.grp, u.ambit,
        count(*) FILTER (WHERE k = 1) AS n_cobertura_verde, round_even(coalesce(sum(q) FILTER (WHERE k = 1), 0), 1) AS area_cobertura_verde_m2,
        count(*) FILTER (WHERE k = 2) AS n_areas_recreativas, round_even(coalesce(sum(q) FILTER (WHERE k = 2), 0), 1) AS area_areas_recreativas_m2,
        count(*) FILTER (WHERE k = 3) AS n_espacios_publicos, round_even(coalesce(sum(q) FILTER (WHERE k = 3), 0), 1) AS area_espacios_publicos_m2
        FROM supps u LEFT JOIN (SELECT l_suppkey AS unit, l_quantity AS q,
            CASE WHEN l_tax < 0.03e0 THEN 1 WHEN l_tax < 0.06e0 THEN 2 ELSE 3 END AS k
            FROM lineitem WHERE year(l_shipdate) = 2000) g USING (unit) GROUP BY ALL""",
    "greencells": """SELECT unit, grp, ambit, 'cobertura_verde' AS cell, n_cobertura_verde AS level_base, area_cobertura_verde_m2 AS area FROM green
        UNION ALL SELECT unit, grp, ambit, 'areas_recreativas', n_areas_recreativas, area_areas_recreativas_m2 FROM green
        UNION ALL SELECT unit, grp, ambit, 'espacios_publicos', n_espacios_publicos, area_espacios_publicos_m2 FROM green""",
    # dashboard
    "zpts": """SELECT c_nationkey AS zone, o_orderpriority AS category, year(o_orderdate) AS x, count(*) AS y
        FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3""",
    "zpop": "SELECT c_nationkey AS zone, count(*) AS population FROM customer GROUP BY 1",
    # geometry
    "squares": """SELECT *, (unit % 20) * 10e0 AS x1, (unit // 20) * 10e0 AS y1, (unit % 20) * 10e0 + 10 AS x2, (unit // 20) * 10e0 + 10 AS y2 FROM supps""",
    "pts": """SELECT c_custkey AS point, (c_custkey * 37) % 2100 / 10e0 + 0.05e0 AS x, (c_custkey * 11) % 600 / 10e0 + 0.05e0 AS y,
        c_acctbal AS value, c_nationkey AS nation, c_mktsegment AS segment FROM customer""",
}

NEEDS = {
    "swide": ("supps", "cells", "ent"),
    "stot": ("supps", "ent"),
    "pwide": ("parts", "ent"),
    "plong": ("pwide",),
    "pdem": ("parts", "ent"),
    "xwalk": ("supps",),
    "segs": ("census",),
    "dem": ("supps", "segnames", "segs", "xwalk"),
    "ctl": ("ent", "supps"),
    "green": ("supps",),
    "greencells": ("green",),
    "squares": ("supps",),
}
