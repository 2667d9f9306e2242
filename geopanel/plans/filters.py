"""P: filters, cells and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.functions import rules
from geopanel.operators import compose, panel, quality, spatial, trend
from geopanel.operators.compose import State
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CELLS, Roles
from geopanel.sources import catalog


@query(
    "p01_territory_filter",
    with_ctes(
        "kparts", "ent",
        body="""SELECT k.grp, count(*) AS n, count(DISTINCT k.unit) AS n_units FROM ent e JOIN kparts k ON k.p_partkey = e.l_partkey
        WHERE length(k.unit) = 13 AND k.unit LIKE '09%' AND k.grp BETWEEN '002' AND '017' AND k.ambit = 'urbano' GROUP BY 1""",
    ),
)
def territory(r: Roles):
    keyed = r.keyed_parts
    rows = r.entities().join(keyed.select(F.col("p_partkey").alias("unit"), F.col("unit").alias("key"), "grp"), "unit")
    rows = rows.drop("unit").withColumnRenamed("key", "unit")
    kept = panel.territory_filter(rows, keyed.select("unit", "ambit").distinct())
    return kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("n_units"))


@query(
    "p02_education_cells",
    with_ctes(
        "ent",
        body="""SELECT lower(lvl) || '__' || CASE sector WHEN 'F' THEN 'publico' ELSE 'privado' END AS cell, count(*) AS n
        FROM ent WHERE (lvl IN ('A', 'N') AND scope = 'Principal') OR (lvl = 'R' AND scope = 'Complementario') GROUP BY 1""",
    ),
)
def education(r: Roles):
    code = F.ascii("level")
    rows = r.entities().withColumn("code", code)
    cells = catalog.education_cells(
        r.spark,
        {"a": ("Principal", (65,)), "n": ("Principal", (78,)), "r": ("Complementario", (82,))},
        {"publico": "F", "privado": "O"},
    )
    return panel.education_membership(rows.drop("cell"), cells).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p03_health_cells",
    with_ctes(
        "ent",
        body="""SELECT t || '__' || CASE sector WHEN 'F' THEN 'publico' ELSE 'privado' END AS cell, count(*) AS n FROM (
            SELECT sector, unnest(list_filter([CASE WHEN l_quantity > 25 THEN 'clinicas' END, CASE WHEN l_quantity % 2 = 0 THEN 'hospitales' END,
                CASE WHEN lvl = 'N' THEN 'farmacias' END], lambda x: x IS NOT NULL)) AS t FROM ent) GROUP BY 1""",
    ),
)
def health(r: Roles):
    one = lambda cond: F.when(cond, 1).otherwise(0)
    rows = r.entities().withColumns(
        {
            "es_clinica": one(F.col("l_quantity") > 25),
            "es_hospital": one(F.col("l_quantity") % 2 == 0),
            "es_farmacia": one(F.col("level") == "N"),
        }
    )
    types = {"clinicas": "es_clinica", "hospitales": "es_hospital", "farmacias": "es_farmacia"}
    cells = catalog.health_cells(r.spark, types, {"publico": "F", "privado": "O"})
    return panel.health_membership(rows.drop("cell"), cells, list(types.values())).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p04_commerce_cells",
    """SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'super' ELSE 'otros' END AS cell, count(*) AS n
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE', 'MEDIUM') GROUP BY 1""",
)
def commerce(r: Roles):
    rows = r.entities().join(r.table("part").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("subcategory")), "unit")
    cells = catalog.commerce_cells(r.spark, {"super": ("ECONOMY", "SMALL"), "otros": ("LARGE", "MEDIUM")})
    return panel.commerce_membership(rows.drop("cell"), cells).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("p05_green_cells", with_ctes("greencells", body=f"SELECT unit, cell, level_base, {r6('area')} AS area FROM greencells"))
def green(r: Roles):
    return panel.green_cells(r.green).select("unit", "cell", "level_base", "area")


@query("p06_segment_projection", with_ctes("segs", body=f"SELECT unit, yr AS year, segment, {r6('v')} AS value FROM segs"))
def segments(r: Roles):
    return r.census.select("unit", "year", F.inline(catalog.segment_structs()))


@query(
    "p07_scope_filter",
    with_ctes("ent", body="SELECT l_partkey AS unit, cut, count(DISTINCT entity_id) AS n FROM ent WHERE scope = 'Principal' GROUP BY 1, 2"),
)
def scope(r: Roles):
    rows = r.entities().where(F.col("scope") == "Principal")
    return rows.groupBy("unit", "cut").agg(F.count_distinct("entity_id").alias("n"))


@query("p08_no_data_reason", with_ctes("dem", body="SELECT segment, unit, relation, reason FROM dem"))
def reasons(r: Roles):
    return r.demand().select("segment", "unit", "relation", "reason")


@query(
    "p09_public_reason",
    with_ctes(
        "dem",
        body="SELECT segment, unit, CASE reason WHEN 'd2020_menor_20' THEN 'poblacion_menor_20' ELSE reason END AS reason FROM dem",
    ),
)
def public_reasons(r: Roles):
    return r.demand().select("segment", "unit", rules.public_reason("reason").alias("reason"))


def _supply_reasons(r: Roles):
    """Every part with its supply reason; rural parts never enter the supply grid."""
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = r.part_supply.select("unit", total.alias("total"))
    return r.parts.join(sums, "unit", "left").select("unit", rules.supply_reason(F.col("ambit"), F.col("total")).alias("reason"))


_SUPPLY_REASON = with_ctes(
    "parts", "pwide",
    body="""SELECT p.unit, CASE WHEN p.ambit = 'rural' THEN 'rural' WHEN s0 + s1 + s2 = 0 THEN 'sin_establecimientos' END AS reason
    FROM parts p LEFT JOIN pwide w USING (unit)""",
)


@query("p10_supply_reason", _SUPPLY_REASON)
def supply_reason(r: Roles):
    return _supply_reasons(r)


@query(
    "p11_observed_when_missing",
    f"SELECT unit, CASE WHEN reason = 'sin_establecimientos' THEN 3 ELSE 0 END AS n_obs FROM ({_SUPPLY_REASON}) WHERE reason IS NOT NULL",
)
def observed(r: Roles):
    missing = _supply_reasons(r).where(F.col("reason").isNotNull())
    return missing.select("unit", rules.observed_when_missing("reason").alias("n_obs"))


@query(
    "p12_optional_filters",
    with_ctes("zpts", body="SELECT zone, category, CAST(sum(y) AS BIGINT) AS y FROM zpts WHERE category = '2-HIGH' GROUP BY 1, 2 HAVING sum(y) % 3 IN (0, 1)"),
)
def optional_filters(r: Roles):
    zones = r.zone_points.groupBy("zone", "category").agg(F.sum("y").alias("y"))
    lit = zones.withColumn("light", F.element_at(F.array(F.lit("verde"), F.lit("amarillo"), F.lit("rojo")), (F.col("y") % 3 + 1).cast("int")))
    return trend.dashboard_filter(lit, "2-HIGH", ("verde", "amarillo")).select("zone", "category", "y")


@query(
    "p13_risk_filter",
    with_ctes(
        "pub",
        body="""SELECT unit, confidence FROM pub WHERE branch = 'demanda' AND cell = 'todas' AND horizon = 'h3'
        AND CASE confidence WHEN 'alta' THEN 1 WHEN 'media' THEN 0.5 ELSE 0 END >= 0.5""",
    ),
)
def risk(r: Roles):
    rows = r.published.where("branch = 'demanda' AND cell = 'todas' AND horizon = 'h3'")
    return compose.risk_filter(rows, 0.5).select("unit", "confidence")


@query("p14_substring_search", "SELECT c_name AS name FROM customer WHERE contains(lower(c_name), 'r#00000001') ORDER BY c_name LIMIT 20")
def substring(r: Roles):
    names = r.table("customer").select(F.col("c_name").alias("name"))
    return compose.search(names, " R#00000001 ", "name", 20)


@query(
    "p15_cell_selection",
    with_ctes("swide", body="SELECT unit, CAST(sum(s2) AS BIGINT) AS s_last FROM swide WHERE cell IN ('A__F', 'N__F') GROUP BY 1"),
)
def selection(r: Roles):
    cells = [c for c in CELLS if c.split("__")[0] in ("A", "N") and c.endswith("F")]
    rows = panel.in_selection(r.supply_cells, cells)
    return rows.groupBy("unit").agg(F.sum(F.element_at("s", -1)).alias("s_last"))


@query(
    "p16_essential_goods",
    f"""SELECT cell, count(*) AS n FROM (SELECT {list(catalog.cell_names('comercio'))}[p_size % {len(catalog.cell_names('comercio'))} + 1] AS cell FROM lineitem JOIN part ON p_partkey = l_partkey)
    WHERE cell IN {catalog.ESSENTIAL_GOODS} GROUP BY 1""",
)
def essential(r: Roles):
    """The preset keeps four of the commerce cells; part sizes are dealt to the cells."""
    cells = F.array(*[F.lit(c) for c in catalog.cell_names("comercio")])
    part = r.table("part").select(F.col("p_partkey").alias("unit"), F.get(cells, F.col("p_size") % F.size(cells)).alias("cell"))
    return r.entities().drop("cell").join(part, "unit").where(F.col("cell").isin(*catalog.ESSENTIAL_GOODS)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p18_horizon_fallback",
    with_ctes(
        "pub",
        body=f"SELECT unit, cell, {r6('delta_pct')} AS delta_pct FROM pub WHERE branch = 'educacion' AND horizon = 'h3'",
    ),
)
def fallback(r: Roles):
    """Supply has no h5: asking for it answers with h3."""
    at = State(horizon="h5").supply_horizon
    return r.published.where((F.col("branch") == "educacion") & (F.col("horizon") == at)).select("unit", "cell", "delta_pct")


@query(
    "p19_coordinate_quality",
    with_ctes(
        "pts",
        body="""SELECT segment, count(*) AS n, count(*) FILTER (WHERE value > 0) AS n_valid,
        count(*) FILTER (WHERE value > 0 AND NOT (x BETWEEN 5 AND 195 AND y BETWEEN 2 AND 40)) AS n_outside FROM pts GROUP BY 1""",
    ),
)
def coordinates(r: Roles):
    return spatial.outside_box(r.customers, (5.0, 2.0, 195.0, 40.0), F.col("value") > 0, "segment")


_RAW = """SELECT event_id, CASE event_type WHEN 'view' THEN 'sube' WHEN 'click' THEN 'baja' WHEN 'signup' THEN 'se_mantiene'
    WHEN 'error' THEN 'raro' END AS verdict, CASE WHEN user_id % 4 = 0 THEN 'alta' WHEN user_id % 4 = 1 THEN 'otra' ELSE 'media' END AS confidence,
    CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id % 100 AS VARCHAR) END AS num FROM events"""


def _raw_records(r: Roles):
    """Untrusted records made of events: text fields, some broken."""
    kind = F.col("event_type")
    verdict = (
        F.when(kind == "view", "sube").when(kind == "click", "baja").when(kind == "signup", "se_mantiene").when(kind == "error", "raro")
    )
    conf = F.when(F.col("user_id") % 4 == 0, "alta").when(F.col("user_id") % 4 == 1, "otra").otherwise("media")
    num = F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.col("event_id") % 100).cast("string"))
    return r.table("events").select(
        F.col("event_id").alias("unit"), verdict.alias("verdict"), conf.alias("confidence"),
        num.alias("delta_pct"), num.alias("rate_pct"), num.alias("ci_lo"), num.alias("ci_hi"),
        F.lit(2).alias("n_obs"), F.lit(10.0).alias("level_base"), F.lit(None).cast("string").alias("reason"), F.lit("h1").alias("horizon"),
    )


_NORMAL = f"""SELECT event_id AS unit, CASE WHEN ok THEN verdict ELSE 'sin_datos' END AS verdict,
    CASE WHEN ok AND confidence IN ('alta', 'media', 'baja') THEN confidence ELSE 'baja' END AS confidence,
    CASE WHEN ok THEN TRY_CAST(num AS DOUBLE) END AS delta_pct
    FROM (SELECT *, coalesce(verdict IN ('sube', 'baja', 'se_mantiene'), false) AS ok FROM ({_RAW}))"""


@query("p20_record_normalisation", f"SELECT *, delta_pct AS ci_lo FROM ({_NORMAL})")
def normalise(r: Roles):
    return quality.normalised(_raw_records(r)).select("unit", "verdict", "confidence", "delta_pct", "ci_lo")


@query(
    "p21_version_adapters",
    f"""SELECT unit, segment, CASE WHEN segment = 'todas' THEN verdict ELSE 'sin_datos' END AS verdict,
    CASE WHEN segment = 'todas' THEN delta_pct END AS delta_pct, CASE WHEN segment = 'todas' THEN 2 ELSE 0 END AS n_obs,
    CASE WHEN segment <> 'todas' THEN 'contrato_v1.2' END AS reason, 'hU' AS horizon
    FROM ({_NORMAL}) CROSS JOIN (VALUES ('todas'), ('primera_infancia'), ('preescolar'), ('primaria'), ('secundaria'), ('adolescencia')) s(segment)""",
)
def adapters(r: Roles):
    up = quality.upgraded_single_horizon(_raw_records(r), "segment", list(catalog.SEGMENTS), catalog.DEFAULT_SEGMENT)
    return up.select("unit", "segment", "verdict", "delta_pct", "n_obs", "reason", "horizon")
