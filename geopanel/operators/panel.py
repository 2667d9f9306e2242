"""Demand and supply panels over a universe of units.

Columns are named by role: ``unit, grp, ambit`` (universe), ``entity_id, unit, grp, t`` (entities),
``unit, year, p_*`` (census), ``unit, unit_prev, relation`` (crosswalk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.functions import rules
from geopanel.functions.scalars import array_of, per_thousand
from geopanel.sources import catalog


# --- filters and cells -------------------------------------------------------------------------


def territory_filter(entities: DataFrame, universe: DataFrame, state: str = "09", lo: str = "002", hi: str = "017") -> DataFrame:
    """13-character keys of the state, group codes in range, and member of the urban universe."""
    urban = universe.where(F.col("ambit") == "urbano").select("unit")
    kept = entities.where(
        (F.length("unit") == 13) & F.col("unit").startswith(state) & F.col("grp").between(lo, hi)
    )
    return kept.join(urban, "unit", "left_semi")


def education_membership(entities: DataFrame, cells: DataFrame) -> DataFrame:
    return entities.join(F.broadcast(cells), ["scope", "code", "sector"])  # literal catalogue


def health_membership(entities: DataFrame, cells: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Every raised flag of an entity, matched to its cell by flag and sector."""
    names = F.filter(
        F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags]), lambda x: x.isNotNull()
    )
    return entities.withColumn("flag", F.explode(names)).join(F.broadcast(cells), ["flag", "sector"])


def commerce_membership(entities: DataFrame, cells: DataFrame) -> DataFrame:
    return entities.join(F.broadcast(cells), "subcategory")


def in_selection(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Keep the selected cells; an empty selection keeps all."""
    return df.where(F.col("cell").isin(list(cells))) if cells else df


# --- supply ------------------------------------------------------------------------------------


def entity_counts(entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct entities per key and cut. The distinct is two-phase, so a hot unit is spread by id."""
    return entities.groupBy(*keys, "t").agg(F.count_distinct("entity_id").alias("s"))


def supply_wide(entities: DataFrame, units: DataFrame, cuts: Sequence[float], cells: Sequence[str] | None = None) -> DataFrame:
    """One row per unit (× cell) with an array ``s`` of one count per cut, zeros explicit."""
    keys = ["unit", "cell"] if cells is not None else ["unit"]
    counts = entity_counts(entities.where(F.col("t").isin([float(c) for c in cuts])), keys)
    at = [f"coalesce(max(s) FILTER (WHERE t = {float(c)}D), 0L)" for c in cuts]
    wide = counts.groupBy(*keys).agg(F.expr(f"array({', '.join(at)})").alias("s"))
    grid = units.select("unit", "grp")
    if cells is not None:
        grid = grid.withColumn("cell", F.explode(array_of(list(cells), "string")))
    zeros = array_of([0] * len(cuts), "bigint")
    return grid.join(wide, keys, "left").withColumn("s", F.coalesce("s", zeros))


def supply_long(wide: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Unit × cut grid; the latest count is repeated on every row of its unit."""
    keep = [c for c in wide.columns if c != "s"]
    rows = F.arrays_zip(array_of(list(cuts)).alias("t"), F.col("s").alias("s"))
    return wide.select(
        *keep, F.element_at("s", -1).alias("s_last"), F.explode(rows).alias("_r")
    ).select(*keep, F.col("_r.t").alias("t"), F.col("_r.s").alias("s"), "s_last")


def dense_grid(units: DataFrame, cuts: Sequence[float]) -> DataFrame:
    return units.withColumn("t", F.explode(array_of(list(cuts))))


def fill_grid(grid: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid.join(counts, list(keys), "left").withColumn("s", F.coalesce("s", F.lit(0)))


# --- demand ------------------------------------------------------------------------------------


def census_segments(census: DataFrame, year: int, segments: dict = catalog.SEGMENTS) -> DataFrame:
    return census.where(F.col("year") == year).select("unit", catalog.segment_structs(segments).alias("segs"))


def demand_panel(
    census: DataFrame, crosswalk: DataFrame, universe: DataFrame, year0: int, year1: int, segments: dict = catalog.SEGMENTS
) -> DataFrame:
    """One row per unit × segment: ``d0`` through the predecessor key (never rescaled), ``d1``,
    relation and the reason why a unit has no usable demand."""
    later = census_segments(census, year1, segments).select(
        "unit", F.col("segs").alias("_segs1"), F.lit(True).alias("_in_census")
    )
    earlier = census_segments(census, year0, segments).select(F.col("unit").alias("unit_prev"), F.col("segs").alias("_segs0"))
    # Units without predecessor share the NULL key: a salt, zero for all others, keeps them from meeting in one task.
    earlier = earlier.withColumn("_salt", F.pmod(F.xxhash64("unit_prev"), F.lit(1)))
    salt = F.when(F.col("unit_prev").isNull(), F.pmod(F.xxhash64("unit"), F.lit(64))).otherwise(F.lit(0))
    joined = (
        universe.select("unit", "grp", "ambit")
        .join(later, "unit", "left")
        .join(crosswalk.select("unit", "unit_prev", "relation"), "unit", "left")
        .withColumn("_salt", salt)
        .join(earlier, ["unit_prev", "_salt"], "left")
        .withColumn("relation", F.expr("if(ambit = 'rural', NULL, coalesce(relation, 'sin_contraparte'))"))
    )
    names = ", ".join(f"'{n}'" for n in segments)
    out = joined.selectExpr("*", f"posexplode(array({names})) AS (_i, segment)").selectExpr(
        "segment", "unit", "grp", "ambit", "relation", "_in_census",
        "if(relation = 'sin_contraparte', NULL, _segs0[_i].value) AS d0",
        "_segs1[_i].value AS d1",
    )
    reason = rules.demand_reason(F.col("ambit"), F.col("_in_census").isNotNull(), F.col("d1"))
    return out.withColumn("reason", reason).drop("_in_census")


# --- reports -----------------------------------------------------------------------------------


def coverage_report(demand: DataFrame, supply: DataFrame, universe: DataFrame) -> DataFrame:
    """``metric, item, n``: universe by ambit, reasons, relations, totals per cut, units never supplied."""
    row = lambda df, metric, item, n: df.select(F.lit(metric).alias("metric"), item.cast("string").alias("item"), n.cast("bigint").alias("n"))
    sizes = universe.groupBy("ambit").agg(F.count(F.lit(1)).alias("n"))
    by = (
        demand.withColumn("reason", F.coalesce("reason", F.lit("con_dato")))
        .groupingSets([["reason"], ["relation"]], "reason", "relation")
        .agg(F.grouping_id().alias("g"), F.count(F.when(F.col("ambit") == "urbano", 1)).alias("urban"), F.count(F.lit(1)).alias("n"))
    )
    cuts = supply.groupBy("t").agg(F.sum("s").alias("n"))
    never = supply.groupBy("unit").agg(F.sum("s").alias("s")).agg(F.count_if(F.col("s") == 0).alias("n"))
    return (
        row(sizes, "universo", F.col("ambit"), F.col("n"))
        .unionByName(row(by.where("reason is not null"), "motivo", F.col("reason"), F.col("n")))
        .unionByName(row(by.where("relation is not null and urban > 0"), "relacion", F.col("relation"), F.col("urban")))
        .unionByName(row(cuts, "oferta_por_corte", F.col("t"), F.col("n")))
        .unionByName(row(never, "sin_oferta_en_ningun_corte", F.lit("total"), F.col("n")))
    )


def gap_by_unit(supply: DataFrame, demand: DataFrame) -> DataFrame:
    """Latest supply per 1,000 demand. ``supply``: one row per urban unit with ``s_last``."""
    return supply.join(demand.select("unit", "d1"), "unit", "left").select(
        "unit", "grp", "s_last", "d1", per_thousand("s_last", "d1").alias("gap")
    )


def gap_by_group(gap: DataFrame) -> DataFrame:
    """Sum both sides, divide last."""
    sums = gap.groupBy("grp").agg(F.sum("s_last").alias("s_last"), F.coalesce(F.sum("d1"), F.lit(0.0)).alias("d1"))
    return sums.withColumn("gap", per_thousand("s_last", "d1"))


def green_layer(points: DataFrame, universe: DataFrame) -> DataFrame:
    """``layer, unit, area`` points -> count and area per unit and layer, zeros for empty units."""
    aggs = []
    for layer, (n, area) in catalog.GREEN_CELLS.items():
        aggs.append(F.expr(f"count_if(layer = '{layer}')").alias(n))
        aggs.append(F.expr(f"sum(area) FILTER (WHERE layer = '{layer}')").alias(area))
    sums = points.where("unit IS NOT NULL").groupBy("unit").agg(*aggs)
    filled = [
        f"{x} AS {name}"
        for n, area in catalog.GREEN_CELLS.values()
        for x, name in ((f"coalesce({n}, 0L)", n), (f"bround(coalesce({area}, 0D), 1)", area))
    ]
    return universe.select("unit", "grp", "ambit").join(sums, "unit", "left").selectExpr("unit", "grp", "ambit", *filled)


def green_cells(layer: DataFrame) -> DataFrame:
    """Wide counts -> one row per cell."""
    cells = ", ".join(f"struct('{c}' AS cell, {n} AS level_base, {a} AS area)" for c, (n, a) in catalog.GREEN_CELLS.items())
    keep = [c for c in ("unit", "grp", "ambit") if c in layer.columns]
    return layer.selectExpr(*keep, f"inline(array({cells}))")


def green_rollup(layer: DataFrame) -> DataFrame:
    """Group totals plus the root row (``grp`` NULL -> ``root``)."""
    cols = [x for pair in catalog.GREEN_CELLS.values() for x in pair]
    return (
        layer.rollup("grp")
        .agg(F.grouping("grp").alias("_root"), *[F.sum(c).alias(c) for c in cols])
        .withColumn("grp", F.when(F.col("_root") == 1, "root").otherwise(F.col("grp").cast("string")))
        .drop("_root")
    )
