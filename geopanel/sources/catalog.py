"""Cell, segment and branch catalogues, as literal dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Age bands of each demand segment.
BANDS = ("p_0a2", "p_3a5", "p_6a11", "p_12a14", "p_15a17")
SEGMENTS = {
    "todas": ("p_0a2", "p_3a5", "p_6a11", "p_12a14", "p_15a17"),
    "primera_infancia": ("p_0a2",),
    "preescolar": ("p_3a5",),
    "primaria": ("p_6a11",),
    "secundaria": ("p_12a14",),
    "adolescencia": ("p_15a17",),
}
DEFAULT_SEGMENT = "todas"

# Branches and sectors.
BRANCHES = ("educacion", "salud", "comercio", "verde")
PROJECTED_BRANCHES = ("educacion", "salud", "comercio")
SECTORS = {"publico": "Público", "privado": "Privado", "no_especificado": "No especificado"}

# Education levels -> scope and activity codes.
EDUCATION_LEVELS = {
    "guarderia": ("Principal", (624411, 624412)),
    "preescolar": ("Principal", (611111, 611112)),
    "primaria": ("Principal", (611121, 611122)),
    "secundaria": ("Principal", (611131, 611132, 611141, 611142)),
    "educacion_especial": ("Principal", (611181, 611182)),
    "varios_niveles": ("Principal", (611171, 611172)),
    "media_superior_tecnica": ("Complementario", (611151, 611152, 611161, 611162, 611512)),
    "recreacion_cultura": (
        "Complementario",
        (611611, 611612, 611621, 611622, 611631, 611632, 611691, 611698, 611699),
    ),
}
# Health types -> flag column.
HEALTH_TYPES = {
    "clinicas": "es_clinica",
    "hospitales": "es_hospital",
    "salud_mental": "es_salud_mental",
    "farmacias": "es_farmacia",
}
# Commerce cells -> subcategories.
COMMERCE_CELLS = {
    "supermercados_minisupers": ("Minisúper", "Supermercado"),
    "abarrotes": ("Abarrotes, ultramarinos y misceláneas",),
    "frutas_verduras": ("Frutas y verduras",),
    "carnes_otros_alimentos": (
        "Carne de aves",
        "Carnes rojas",
        "Pescados y mariscos",
        "Otros alimentos",
        "Leche, lácteos y embutidos",
        "Semillas, granos, especias y chiles secos",
    ),
    "farmacias": ("Farmacia con minisúper", "Farmacia sin minisúper"),
}
# The commerce cells of the essential-goods preset.
ESSENTIAL_GOODS = ("supermercados_minisupers", "abarrotes", "frutas_verduras", "carnes_otros_alimentos")
# Green cells -> count and area columns.
GREEN_CELLS = {
    "cobertura_verde": ("n_cobertura_verde", "area_cobertura_verde_m2"),
    "areas_recreativas": ("n_areas_recreativas", "area_areas_recreativas_m2"),
    "espacios_publicos": ("n_espacios_publicos", "area_espacios_publicos_m2"),
}


def cell_names(branch: str) -> list[str]:
    if branch == "educacion":
        return [f"{lv}__{s}" for lv in EDUCATION_LEVELS for s in SECTORS]
    if branch == "salud":
        return [f"{ty}__{s}" for ty in HEALTH_TYPES for s in SECTORS]
    return list(COMMERCE_CELLS if branch == "comercio" else GREEN_CELLS)


def education_cells(spark: SparkSession, levels: dict = EDUCATION_LEVELS, sectors: dict = SECTORS) -> DataFrame:
    """``cell, scope, code, sector``: one row per code, joined to entities with equality only."""
    rows = [
        (f"{lv}__{key}", scope, code, raw)
        for lv, (scope, codes) in levels.items()
        for code in codes
        for key, raw in sectors.items()
    ]
    return spark.createDataFrame(rows, "cell string, scope string, code int, sector string")


def health_cells(spark: SparkSession, types: dict = HEALTH_TYPES, sectors: dict = SECTORS) -> DataFrame:
    rows = [(f"{ty}__{key}", flag, raw) for ty, flag in types.items() for key, raw in sectors.items()]
    return spark.createDataFrame(rows, "cell string, flag string, sector string")


def commerce_cells(spark: SparkSession, cells: dict = COMMERCE_CELLS) -> DataFrame:
    rows = [(cell, sub) for cell, subs in cells.items() for sub in subs]
    return spark.createDataFrame(rows, "cell string, subcategory string")


def selected_cells(branch: str, levels: tuple[str, ...] = (), sector: str = "todos", catalogue: tuple[str, ...] = ()) -> list[str]:
    """Levels × sector -> cell list. Nothing chosen, or everything chosen, is the empty list: no filter."""
    known = catalogue or tuple(dict.fromkeys(c.split("__")[0] for c in cell_names(branch)))
    chosen = tuple(levels) or known
    everything = len(chosen) == len(known)
    if branch not in ("educacion", "salud"):
        return [] if everything else list(chosen)
    if everything and sector == "todos":
        return []
    keys = list(SECTORS) if sector == "todos" else [sector]
    return [f"{lv}__{s}" for lv in chosen for s in keys]


def segment_structs(segments: dict = SEGMENTS) -> Column:
    """array<struct<segment, value>>; a segment is NULL as soon as one of its bands is."""
    parts = [f"struct('{name}' AS segment, double({' + '.join(bands)}) AS value)" for name, bands in segments.items()]
    return F.expr(f"array({', '.join(parts)})")
