"""S: every source and sink, fed with files Spark writes from the given tables into scratch space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.functions import geometry as g
from geopanel.operators import quality, spatial
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CELL_SIZE, CUT_YEARS, Roles
from geopanel.session import scratch_path
from geopanel.sources import readers, sinks
from geopanel.sources.catalog import BANDS

CUTS = {f"{y}-01": y + 0.5 for y in CUT_YEARS}
EDITIONS = tuple(range(1995, 2002))


def _edition_files(r: Roles, rows: DataFrame, kind: str, write) -> list[str]:
    """One folder per edition, named ``<kind>_<year>_01``, from one pass over the rows: the reader takes the label from the path."""
    path = scratch_path(r.spark, kind)
    named = rows.withColumn("edition", F.concat(F.lit(f"{kind}_"), F.col("cut").cast("string"), F.lit("_01"))).drop("cut")
    write(named.where(F.col("edition").isNotNull()), path)
    return [f"{path}/edition={kind}_{year}_01" for year in EDITIONS]


def _base_columns(r: Roles):
    return r.table("lineitem").selectExpr(
        "year(l_shipdate) AS cut",
        "string(l_orderkey * 10 + l_linenumber) AS ID",
        "concat('09', lpad(string(l_suppkey % 16 + 2), 3, '0'), lpad(string(l_partkey), 8, '0')) AS `Clave geográfica AGEB`",
        "if(l_linenumber <= 5, 'Principal', 'Complementario') AS Alcance",
        "l_linestatus AS Sector",
        "string(611000 + int(l_quantity)) AS `Código SCIAN`",
        "l_returnflag AS `Subcategoría`",
        "'x' AS `Edición DENUE`",
        "string(int(l_quantity) % 2) AS `Es hospital`",
        "string(int(l_quantity > 25)) AS `Es clínica o consultorio`",
        "'0' AS `Es salud mental o psicológica`",
        "string(int(l_tax > 0.04D)) AS `Es farmacia`",
    )


def _csv(df: DataFrame, path: str) -> None:
    out = df.write.option("header", True)
    (out.partitionBy("edition") if "edition" in df.columns else out).csv(path)


_ED = "year(l_shipdate) || '-01'"
_T = "CASE WHEN year(l_shipdate) IN (1996, 1998, 2000) THEN year(l_shipdate) + 0.5e0 END"
_GRP = "lpad(CAST(l_suppkey % 16 + 2 AS VARCHAR), 3, '0')"
_WHERE = ""


def _read_editions(r: Roles, columns, header_rows: DataFrame):
    """All editions in one scan; the label comes from the folder of each file. Line numbers repeat in the given table, so
    the check for repeated ids, on by default, is q10's here."""
    paths = _edition_files(r, header_rows, "denue", _csv)
    header = [c for c in header_rows.columns if c != "cut"]
    return readers.entity_editions(r.spark, paths, columns, header, CUTS, check=False)


@query("s01_multi_edition_csv", f"SELECT {_ED} AS edition, {_T} AS t, {_GRP} AS grp, count(*) AS n, count(DISTINCT l_orderkey * 10 + l_linenumber) AS n_ids FROM lineitem {_WHERE} GROUP BY 1, 2, 3")
def editions(r: Roles):
    out = _read_editions(r, readers.EDUCATION_COLUMNS, _base_columns(r))
    return out.groupBy("edition", "t", "grp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("n_ids"))


@query("s02_education_entities", f"SELECT {_ED} AS edition, l_orderkey * 10 + l_linenumber AS entity_id, CASE WHEN l_linenumber <= 5 THEN 'Principal' ELSE 'Complementario' END AS scope, 611000 + CAST(l_quantity AS INT) AS code, l_linestatus AS sector FROM lineitem {_WHERE}")
def education(r: Roles):
    out = _read_editions(r, readers.EDUCATION_COLUMNS, _base_columns(r))
    return out.select("edition", "entity_id", "scope", "code", "sector")


@query("s03_health_entities", f"""SELECT {_ED} AS edition, count(*) FILTER (WHERE CAST(l_quantity AS INT) % 2 = 1) AS es_hospital, count(*) FILTER (WHERE l_quantity > 25) AS es_clinica, 0 AS es_salud_mental,
    count(*) FILTER (WHERE l_tax > 0.04e0) AS es_farmacia FROM lineitem {_WHERE} GROUP BY 1""")
def health(r: Roles):
    columns = {**readers.EDUCATION_COLUMNS, **readers.HEALTH_FLAGS}
    out = _read_editions(r, columns, _base_columns(r))
    return out.groupBy("edition").agg(*[F.sum(f).alias(f) for f, _ in readers.HEALTH_FLAGS.values()])


def _features(r: Roles) -> str:
    """Customers as newline-delimited point features."""
    props = F.struct(
        F.col("point").alias("id"), F.concat(F.lit("09"), F.lpad(F.col("point").cast("string"), 11, "0")).alias("cve_geo_ageb"),
        F.lit("Principal").alias("alcance_analitico"), F.lit("c").alias("categoria_proyecto"), F.col("segment").alias("subcategoria_proyecto"),
        F.expr("if(value > 0, 'SI', 'NO')").alias("es_primera_necesidad"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    path = scratch_path(r.spark, "comercios_1998_01")
    r.customers.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value")).write.text(path)
    return path


@query("s04_geojson_properties", with_ctes("pts", body="SELECT point AS entity_id, '09' || lpad(CAST(point AS VARCHAR), 11, '0') AS unit, segment AS subcategory, CASE WHEN value > 0 THEN 'SI' ELSE 'NO' END AS essential FROM pts"))
def commerce(r: Roles):
    return readers.commerce_entities(r.spark, _features(r)).select("entity_id", "unit", "subcategory", "essential")


@query("s05_geojson_inferred", with_ctes("pts", body="SELECT segment AS subcategoria_proyecto, count(*) AS n, min(point) AS first_id FROM pts GROUP BY 1"))
def inferred(r: Roles):
    rows = readers.inferred_properties(r.spark, _features(r))
    return rows.groupBy("subcategoria_proyecto").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _polygon_file(r: Roles) -> str:
    """Squares as features: polygons, multipolygons, and every 23rd without geometry."""
    ring = F.col("geom")[0][0]
    props = F.struct(F.col("unit").alias("cvegeo"), F.col("grp").alias("cve_mun"), F.col("ambit").alias("ambito"))
    body = lambda kind, coords: F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry")))
    empty = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties")))
    value = F.when(F.col("unit") % 23 == 7, empty).when(F.col("unit") % 2 == 0, body("Polygon", F.array(ring))).otherwise(body("MultiPolygon", F.col("geom")))
    path = scratch_path(r.spark, "ageb")
    r.squares(r.suppliers).select(value.alias("value")).write.text(path)
    return path


@query("s06_geojson_polygons", with_ctes("squares", body="SELECT CAST(unit AS VARCHAR) AS cvegeo, CASE WHEN unit % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind, 100e0 AS area, x1, y1 FROM squares WHERE unit % 23 <> 7"))
def polygons(r: Roles):
    rows = readers.geojson_polygons(r.spark, _polygon_file(r), {"cvegeo": "string"})
    b = rows.select("cvegeo", "kind", g.area("geom").alias("area"), g.bounds("geom").alias("b"))
    return b.select("cvegeo", "kind", "area", "b.x1", "b.y1")


@query("s06b_polygon_rejects", with_ctes("supps", body="""SELECT CASE unit % 10 WHEN 0 THEN 'no_geometry' WHEN 1 THEN 'other_type' WHEN 2 THEN 'empty' WHEN 3 THEN 'short_ring' WHEN 4 THEN 'open_ring' END AS reject,
    count(*) AS n FROM supps GROUP BY 1"""))
def rejects(r: Roles):
    """Usable and unusable features of one layer from one scan, counted by reason."""
    x, y = F.col("x1").cast("string"), F.col("y1").cast("string")
    point = lambda dx, dy: F.concat(F.lit("["), (F.col("x1") + dx).cast("string"), F.lit(","), (F.col("y1") + dy).cast("string"), F.lit("]"))
    ring = lambda *ps: F.concat(F.lit("[["), F.concat_ws(",", *[point(*p) for p in ps]), F.lit("]]"))
    kind = F.col("unit") % 10
    geometry = lambda t, c: F.concat(F.lit(f'{{"type":"{t}","coordinates":'), c, F.lit("}"))
    shape = (
        F.when(kind == 0, "null")
        .when(kind == 1, geometry("Point", F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))))
        .when(kind == 2, geometry("Polygon", F.lit("[]")))
        .when(kind == 3, geometry("Polygon", ring((0, 0), (9, 0), (0, 0))))
        .when(kind == 4, geometry("Polygon", ring((0, 0), (9, 0), (9, 9), (0, 9))))
        .otherwise(geometry("Polygon", ring((0, 0), (9, 0), (9, 9), (0, 9), (0, 0))))
    )
    path = scratch_path(r.spark, "layer")
    key = F.concat(F.lit('{"type":"Feature","properties":{"cvegeo":"'), F.col("unit").cast("string"), F.lit('"},"geometry":'), shape, F.lit("}"))
    r.squares(r.suppliers).select(key.alias("value")).write.text(path)
    return readers.polygon_layer(r.spark, path, {"cvegeo": "string"}).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


_BLOCK_HEADER = ["mun", "loc", "ageb", "mza", "pobtot", *BANDS, "pob0_14"]


def _blocks(r: Roles) -> str:
    """Parts as census rows: one total row and one block row each, some values suppressed."""
    rows = r.table("part").selectExpr(
        "lpad(string(int(substr(p_brand, 7)) + 1), 3, '0') AS mun", "'0001' AS loc", "if(p_partkey % 50 = 0, '0000', lpad(string(p_partkey), 6, '0')) AS ageb",
        "explode(array('000', '001')) AS mza", "string(p_size * 10) AS pobtot",
        "if(p_size % 10 = 3, '*', string(p_size)) AS p_0a2", "if(p_size % 10 = 4, 'N/D', string(p_size + 1)) AS p_3a5",
        "string(p_size + 2) AS p_6a11", "string(p_size + 3) AS p_12a14", "string(p_size + 4) AS p_15a17", "string(4 * p_size + 6) AS pob0_14",
    )
    path = scratch_path(r.spark, "censo_2010")
    _csv(rows, path)
    return path


@query("s07_census_blocks", """SELECT '09' || lpad(CAST(CAST(substr(p_brand, 7) AS INT) + 1 AS VARCHAR), 3, '0') || '0001' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS unit, p_size * 10 AS population,
    CASE WHEN p_size % 10 <> 3 THEN p_size END AS p_0a2, CASE WHEN p_size % 10 NOT IN (3, 4) THEN 4 * p_size + 6 END AS pop_0_14, 4 * p_size + 6 AS published_0_14 FROM part WHERE p_partkey % 50 <> 0""")
def census(r: Roles):
    rows = readers.census_blocks(r.spark, _blocks(r), 2010, _BLOCK_HEADER)
    return rows.select("unit", "population", "p_0a2", "pop_0_14", "published_0_14")


def _tidy(r: Roles):
    """Nation × year quantities as a wide projection file with three age columns."""
    wide = (
        r.entities("l_suppkey")
        .join(r.suppliers.select("unit", "grp"), "unit")
        .groupBy("grp", "cut")
        .agg(*[F.expr(f"string(bigint(sum(l_quantity) FILTER (WHERE level = '{v}')))").alias(c) for v, c in (("A", "POB_00_04"), ("N", "POB_010_014"), ("R", "POB_015_019"))])
        .selectExpr("'9' AS CLAVE_ENT", "string(9000 + grp) AS CLAVE", "string(cut) AS ANO", "'HOMBRES' AS SEXO", "POB_00_04", "POB_010_014", "POB_015_019")
    )
    path = scratch_path(r.spark, "pobproy")
    _csv(wide, path)
    return readers.projection_tidy(r.spark, path, wide.columns)


@query("s08_wide_projection", with_ctes("ent", "supps", body="""SELECT lpad(CAST(grp AS VARCHAR), 3, '0') AS grp, cut AS year, 'hombres' AS sex, CASE lvl WHEN 'A' THEN '00_04' WHEN 'N' THEN '10_14' ELSE '15_19' END AS age,
    CAST(sum(l_quantity) AS BIGINT) AS population FROM ent JOIN supps ON unit = l_suppkey GROUP BY grp, cut, lvl"""))
def projection(r: Roles):
    return _tidy(r)


@query("s08b_control_series", with_ctes("ent", "supps", body="SELECT lpad(CAST(grp AS VARCHAR), 3, '0') AS grp, cut AS year, CAST(sum(l_quantity) FILTER (WHERE lvl IN ('A', 'N')) AS BIGINT) AS pop_0_14, CAST(sum(l_quantity) AS BIGINT) AS pop_total FROM ent JOIN supps ON unit = l_suppkey GROUP BY grp, cut"))
def control(r: Roles):
    return readers.control_series(_tidy(r))


@query("s09_parquet_projection", f"SELECT l_partkey, l_returnflag, {r6('l_quantity')} AS l_quantity FROM lineitem")
def parquet(r: Roles):
    return readers.parquet_columns(r.spark, f"{r.dir}/lineitem.parquet", "l_partkey bigint, l_returnflag string, l_quantity double")


@query("s10_unit_universe", with_ctes("supps", body="SELECT CAST(unit AS VARCHAR) AS unit, CAST(grp AS VARCHAR) AS grp, ambit FROM supps"))
def universe(r: Roles):
    return readers.unit_universe(r.spark, _polygon_file(r))


@query("s11_reference_dimensions", "SELECT n_nationkey AS code, n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def dimensions(r: Roles):
    path = scratch_path(r.spark, "alcaldias")
    r.table("nation").selectExpr("n_nationkey AS code", "n_name AS name").write.option("header", True).csv(path)
    dim = readers.dimension(r.spark, path, "code int, name string")
    n = r.suppliers.groupBy(F.col("grp").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("s12_ordered_parquet", with_ctes("plong", body="SELECT unit, t, s FROM plong"))
def ordered(r: Roles):
    from geopanel.operators.panel import supply_long
    from geopanel.plans.roles import CAL

    path = scratch_path(r.spark, "panel")
    sinks.ordered_parquet(supply_long(r.part_supply, CAL.cuts).select("unit", "t", "s"), path, ["unit", "t"])
    return r.spark.read.schema("unit bigint, t double, s bigint").parquet(path)


@query("s13_contract_documents", with_ctes("pub", "pub_group", "pub_root", "supps", "cells", "swide", body="""
    SELECT 'ageb' AS level, CAST(u.unit AS VARCHAR) AS unit, '1.4' AS version, 6 AS n_cells, coalesce(t.points, 0) AS points, CAST(NULL AS BIGINT) AS n_counted FROM supps u LEFT JOIN (SELECT unit, CAST(sum(s0 + s1 + s2) AS BIGINT) AS points FROM swide GROUP BY 1) t USING (unit)
    UNION ALL SELECT 'alcaldia', CAST(g.unit AS VARCHAR), '1.4', g.n, t.points, n.n FROM (SELECT unit, count(DISTINCT cell) AS n FROM pub_group WHERE branch <> 'demanda' GROUP BY 1) g
    JOIN (SELECT grp, CAST(sum(s0 + s1 + s2) AS BIGINT) AS points FROM swide GROUP BY 1) t ON t.grp = g.unit JOIN (SELECT grp, 12 * count(*) AS n FROM supps GROUP BY 1) n ON n.grp = g.unit
    UNION ALL SELECT 'cdmx', 'root', '1.4', count(DISTINCT cell), (SELECT CAST(sum(s0 + s1 + s2) AS BIGINT) FROM swide), NULL FROM pub_root WHERE branch <> 'demanda'"""))
def documents(r: Roles):
    """Documents of the units, the groups (with the verdicts of their units) and the root, written as one JSON line each under a header and parsed back.

    ``points`` adds up the observed series of all cells, ``n_counted`` the verdicts in a group's distribution."""
    from geopanel.operators.panel import supply_long
    from geopanel.plans.contract import _supply_layer
    from geopanel.plans.roles import CAL

    long, layer = supply_long(r.supply_cells, CAL.cuts), _supply_layer(r)
    points = lambda key: long.groupBy("cell", key.alias("unit"), "t").agg(F.sum("s").alias("value"))
    series = lambda key: quality.series(points(key), ["cell", "unit"])
    units = quality.document_rows(quality.nested(layer, "cell", "celdas", series(F.col("unit"))), "celdas")
    upper = lambda rows: rows.where("branch <> 'demanda'").withColumn("reason", F.lit(None).cast("string"))
    groups = quality.nested(upper(r.group_summary), "cell", "celdas", series(F.col("grp")))
    groups = quality.group_documents(groups, quality.verdict_distribution(layer, ["cell"]), "cell", "celdas")
    root = quality.document_rows(quality.nested(upper(r.root_summary), "cell", "celdas", series(F.lit("root"))), "celdas")
    rows = None
    for level, docs in (("ageb", units), ("alcaldia", groups), ("cdmx", root)):
        part = docs.select(F.lit(level).alias("level"), F.col("unit").cast("string").alias("unit"), "doc")
        rows = part if rows is None else rows.unionAll(part)
    path = scratch_path(r.spark, "prediccion")
    sinks.documents(rows.withColumn("doc", F.concat(F.lit('{"cabecera":'), F.to_json(quality.header()), F.lit(","), F.substring("doc", 2, 2**31 - 1))), path)
    cell = "struct<serie: struct<t: array<double>, valor: array<bigint>>>"
    kind = f"map<string, struct<cabecera: struct<version: string>, celdas: map<string, {cell}>, distribucion_ageb: map<string, map<string, map<string, bigint>>>>>"
    rows = sinks.read_documents(r.spark, path).select("level", F.explode(F.from_json("value", kind)).alias("unit", "d"))
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
    observed = F.flatten(F.transform(F.map_values("d.celdas"), lambda c: F.coalesce(c["serie"]["valor"], F.array())))
    counted = F.flatten(F.flatten(F.transform(F.map_values("d.distribucion_ageb"), lambda h: F.transform(F.map_values(h), lambda v: F.map_values(v)))))
    return rows.select("level", "unit", F.col("d.cabecera.version").alias("version"), F.size("d.celdas").alias("n_cells"), total(observed).alias("points"), total(counted).alias("n_counted"))


@query("s14_block_upsert", "SELECT block, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'keep' AS block, n_nationkey AS v FROM nation UNION ALL SELECT 'replace', n_nationkey * 2 FROM nation WHERE n_nationkey > 3) GROUP BY 1")
def upsert(r: Roles):
    path = scratch_path(r.spark, "diagnostico")
    rows = lambda block, expr: r.table("nation").selectExpr(f"'{block}' AS block", f"{expr} AS v")
    sinks.upsert_blocks(rows("keep", "n_nationkey").union(rows("replace", "n_nationkey")), path)
    sinks.upsert_blocks(r.table("nation").where("n_nationkey > 3").selectExpr("'replace' AS block", "n_nationkey * 2 AS v"), path)
    table = r.spark.read.schema("v int, block string").parquet(path)
    return table.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("s15_lookup_sink", with_ctes("squares", body="SELECT CAST(unit AS VARCHAR) AS unit, CAST(unit AS VARCHAR) AS other FROM squares"))
def lookup(r: Roles):
    """Best match per unit, written as table and JSON lines; read back from the lines."""
    own = r.squares(r.suppliers).select("unit", "geom")
    other = r.squares(r.suppliers, 2.5).select(F.col("unit").alias("other"), "geom")
    pairs = spatial.overlay(own, other, CELL_SIZE, "unit", "other")
    matches = spatial.best_match(pairs, r.suppliers, "unit", "other")
    path = scratch_path(r.spark, "colonias_ageb")
    sinks.lookup(matches, path, "unit", ["other", "coverage_pct"])
    parsed = F.from_json("value", "map<string, struct<other: string, coverage_pct: double>>")
    return r.spark.read.text(f"{path}/json").select(F.explode(parsed).alias("unit", "d")).select("unit", F.col("d.other").alias("other"))
