"""Readers with explicit schemas. CSV is read as text and cast afterwards, since types drift between editions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.functions import geometry as g
from geopanel.functions.scalars import age_label, edition_label, group_of_key, padded_group, token_int, unit_key
from geopanel.operators.calendar import CUT_LABELS
from geopanel.operators.quality import duplicate_keys, require_none
from geopanel.sources.catalog import BANDS

# Raw column -> role name and type of the entity snapshots.
EDUCATION_COLUMNS = {
    "ID": ("entity_id", "bigint"),
    "Clave geográfica AGEB": ("unit", "string"),
    "Alcance": ("scope", "string"),
    "Sector": ("sector", "string"),
    "Código SCIAN": ("code", "int"),
    "Subcategoría": ("subcategory", "string"),
    "Edición DENUE": ("edition_raw", "string"),
}
HEALTH_FLAGS = {
    "Es hospital": ("es_hospital", "int"),
    "Es clínica o consultorio": ("es_clinica", "int"),
    "Es salud mental o psicológica": ("es_salud_mental", "int"),
    "Es farmacia": ("es_farmacia", "int"),
}
COMMERCE_PROPERTIES = {
    "id": ("entity_id", "bigint"),
    "cve_geo_ageb": ("unit", "string"),
    "alcance_analitico": ("scope", "string"),
    "categoria_proyecto": ("category", "string"),
    "subcategoria_proyecto": ("subcategory", "string"),
    "es_primera_necesidad": ("essential", "string"),
}


def _text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def text_csv(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str], wanted: Sequence[str] = (), **options) -> DataFrame:
    """All-text CSV with a known header; only ``wanted`` columns are parsed. Headers are checked by name."""
    keep = list(wanted) or list(header)
    df = spark.read.schema(_text_schema(header)).csv(paths, header=True, enforceSchema=False, **options)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col("_metadata.file_path").alias("_file"))


def _cut_time(edition: Column, cuts: dict[str, float]) -> Column:
    if not cuts:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), edition)


def _labelled(df: DataFrame) -> DataFrame:
    """``edition`` of each row, worked out once for each file that ``df`` reads instead of for each row."""
    listed = df.inputFiles()
    forms = dict.fromkeys([*listed, *(f.replace(":///", ":/", 1) for f in listed)])  # rows have paths without an empty host
    files = df.sparkSession.createDataFrame([(f,) for f in forms], "_file string")
    labels = files.withColumn("edition", edition_label("_file"))
    rows = df.join(F.broadcast(labels), "_file", "left")
    return rows.withColumn("edition", F.coalesce("edition", edition_label("_file")))  # should a path be listed in another form


def tagged(df: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """Edition from the file's path (its own name or its folder's), group key from the unit key, decimal year when it is a supply cut."""
    names = [c for c in df.columns if c != "_file"]
    return (
        _labelled(df)
        .select(*names, "edition")
        .withColumn("grp", group_of_key("unit"))
        .withColumn("t", _cut_time(F.col("edition"), cuts))
    )


def entity_editions(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: dict[str, tuple[str, str]],
    header: Sequence[str] | None = None,
    cuts: dict[str, float] = CUT_LABELS,
    check: bool = True,
) -> DataFrame:
    """Any number of edition files in one scan. An id repeated within an edition fails, unless ``check`` is off."""
    raw = text_csv(spark, paths, list(header or columns), list(columns))
    named = raw.select(*[F.col(f"`{c}`").cast(kind).alias(name) for c, (name, kind) in columns.items()], "_file")
    out = tagged(named, cuts)
    if check:
        require_none(duplicate_keys(out, ["edition", "entity_id"]), "duplicate ids within an edition")
    return out


def education_entities(spark: SparkSession, paths, **kw) -> DataFrame:
    return entity_editions(spark, paths, EDUCATION_COLUMNS, **kw)


def health_entities(spark: SparkSession, paths, **kw) -> DataFrame:
    return entity_editions(spark, paths, {**EDUCATION_COLUMNS, **HEALTH_FLAGS}, **kw)


# --- GeoJSON -----------------------------------------------------------------------------------


def _features(spark: SparkSession, paths, feature: str, lines: bool) -> DataFrame:
    """One row per feature. ``lines`` reads newline-delimited features, whose scan splits; otherwise a
    FeatureCollection per file, each parsed by one task."""
    if lines:
        return spark.read.schema(feature).json(paths).select("*", F.col("_metadata.file_path").alias("_file"))
    whole = spark.read.schema(f"features array<struct<{feature}>>").json(paths, multiLine=True)
    return whole.select(F.col("_metadata.file_path").alias("_file"), F.inline("features"))


def geojson_properties(spark: SparkSession, paths, properties: Sequence[str], lines: bool = True) -> DataFrame:
    """Properties as text, geometry never parsed."""
    inner = ", ".join(f"`{p}`: string" for p in properties)
    spec = f"properties struct<{inner}>" if lines else f"properties: struct<{inner}>"
    return _features(spark, paths, spec, lines).select("properties.*", "_file")


def commerce_entities(spark: SparkSession, paths, lines: bool = True, cuts: dict[str, float] = CUT_LABELS, check: bool = True) -> DataFrame:
    raw = geojson_properties(spark, paths, list(COMMERCE_PROPERTIES), lines)
    named = raw.select(*[F.col(c).cast(kind).alias(name) for c, (name, kind) in COMMERCE_PROPERTIES.items()], "_file")
    out = tagged(named, cuts)
    if check:
        require_none(duplicate_keys(out, ["edition", "entity_id"]), "duplicate ids within an edition")
    return out


def inferred_properties(spark: SparkSession, paths, lines: bool = True) -> DataFrame:
    """Profiling path: property names and types are inferred from the data."""
    df = spark.read.json(paths) if lines else spark.read.json(paths, multiLine=True).select(F.inline("features"))
    return df.select("properties.*")


def polygon_layer(spark: SparkSession, paths, properties: dict[str, str], lines: bool = True) -> DataFrame:
    """Every feature, usable or not, from one scan: properties, ``kind``, ``geom`` (MultiPolygon arrays) and ``reject``, NULL for a usable
    polygon, else the first of: ``no_geometry``, ``other_type``, ``empty``, ``short_ring`` (fewer than four points), ``open_ring``."""
    sep = " " if lines else ": "
    inner = ", ".join(f"`{p}`: {t}" for p, t in properties.items())
    spec = f"properties{sep}struct<{inner}>, geometry{sep}struct<type: string, coordinates: string>"
    kind = F.col("geometry.type")
    raw = _features(spark, paths, spec, lines).select("properties.*", kind.alias("kind"), g.parse_multipolygon("geometry.type", "geometry.coordinates").alias("geom"))
    every = lambda test: F.forall("geom", lambda p: F.forall(p, test))
    holds = lambda test: F.coalesce(test, F.lit(False))
    reject = (
        F.when(F.col("kind").isNull(), "no_geometry")
        .when(~F.col("kind").isin("Polygon", "MultiPolygon"), "other_type")
        .when(~holds((F.size("geom") > 0) & F.forall("geom", lambda p: F.size(p) > 0)), "empty")
        .when(~holds(every(lambda r: F.size(r) >= 4)), "short_ring")
        .when(~holds(every(lambda r: F.get(r, F.lit(0)) == F.element_at(r, -1))), "open_ring")
    )
    return raw.withColumn("reject", reject)


def geojson_polygons(spark: SparkSession, paths, properties: dict[str, str], lines: bool = True) -> DataFrame:
    """Properties plus ``kind`` and ``geom`` of the usable polygons; :func:`polygon_layer` has the others too, with reasons."""
    return polygon_layer(spark, paths, properties, lines).where("reject IS NULL").drop("reject")


def unit_universe(spark: SparkSession, paths, lines: bool = True) -> DataFrame:
    """``unit, grp, ambit`` from the polygon layer's properties."""
    raw = geojson_properties(spark, paths, ["cvegeo", "cve_mun", "ambito"], lines)
    return raw.select(F.col("cvegeo").alias("unit"), F.col("cve_mun").alias("grp"), F.col("ambito").alias("ambit"))


# --- census and control series -----------------------------------------------------------------


def census_blocks(spark: SparkSession, paths, year: int, header: Sequence[str], state: str = "09") -> DataFrame:
    """Block file -> unit rows: totals only, concatenated key, suppressed tokens NULL, 0-14 sum."""
    wanted = ["mun", "loc", "ageb", "mza", "pobtot", *BANDS, "pob0_14"]
    raw = text_csv(spark, paths, header, [c for c in wanted if c in header])
    rows = raw.where((F.col("mza") == "000") & (F.col("ageb") != "0000"))
    young = token_int(BANDS[0])
    for b in BANDS[1:4]:
        young = young + token_int(b)
    published = token_int("pob0_14") if "pob0_14" in header else F.lit(None).cast("int")
    return rows.select(
        unit_key(state, "mun", "loc", "ageb").alias("unit"),
        F.lit(year).alias("year"),
        F.col("mun").alias("grp"),
        token_int("pobtot").alias("population"),
        *[token_int(b).alias(b) for b in BANDS],
        published.alias("published_0_14"),
        young.alias("pop_0_14"),
    )


def census_panel(*years: DataFrame) -> DataFrame:
    """Append census years by name, whatever columns each one has."""
    out = years[0]
    for y in years[1:]:
        out = out.unionByName(y, allowMissingColumns=True)
    return out


def projection_tidy(spark: SparkSession, paths, header: Sequence[str], state: str = "9") -> DataFrame:
    """Wide age columns -> ``grp, year, sex, age, population``."""
    ages = [c for c in header if c.startswith("POB_") and c != "POB_TOTAL"]
    raw = text_csv(spark, paths, header, ["CLAVE_ENT", "CLAVE", "ANO", "SEXO", *ages], quote='"')
    long = raw.where(F.col("CLAVE_ENT") == state).unpivot(["CLAVE", "ANO", "SEXO"], ages, "band", "people")
    return long.select(
        padded_group("CLAVE").alias("grp"),
        F.col("ANO").cast("int").alias("year"),
        F.lower("SEXO").alias("sex"),
        age_label("band").alias("age"),
        F.col("people").cast("bigint").alias("population"),
    )


def control_series(tidy: DataFrame, young: Sequence[str] = ("00_04", "05_09", "10_14")) -> DataFrame:
    """Group × year with the 0-14 subset and the total in one pass."""
    pop = F.col("population")
    return tidy.groupBy("grp", "year").agg(
        F.sum(F.when(F.col("age").isin(list(young)), pop)).alias("pop_0_14"), F.sum(pop).alias("pop_total")
    )


def parquet_columns(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """Typed projection of a parquet table; decimals are cast, filters and columns reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    fields = T.StructType.fromDDL(schema).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small code/name reference file."""
    return spark.read.schema(schema).csv(path, header=True)
