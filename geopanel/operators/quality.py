"""Contract assembly, validation and consistency checks.

Checks never raise inside a plan: they return a table of violations, and :func:`require_none`
turns a non-empty one into an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import rules
from geopanel.functions.scalars import array_of, half_even
from geopanel.sources import catalog

# Fixed values of the contract.
VERSION = "1.4"
BASE_DATE = "2026-06"
HORIZONS = (("h1", 1, "2027-06"), ("h3", 3, "2029-06"), ("h5", 5, "2031-06"))
SUPPLY_HORIZONS = ("h1", "h3")
GROUP_CODES = tuple(f"{i:03d}" for i in range(2, 18))


class ContractError(ValueError):
    """A document or table breaks a contract rule."""


def require_none(violations: DataFrame, what: str) -> None:
    found = violations.limit(10).collect()
    if found:
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")


# --- series and layers -------------------------------------------------------------------------


def series(points: DataFrame, keys: Sequence[str], t: str = "t", value: str = "value") -> DataFrame:
    """struct<t: array, valor: array> per key, in time order, observed points only.

    One entry per cut: bounded by the number of cuts, not by the data.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))))
    packed = points.groupBy(*keys).agg(rows.alias("_r"))
    return packed.select(
        *keys,
        F.struct(
            F.transform("_r", lambda x: x["t"]).alias("t"), F.transform("_r", lambda x: x["v"]).alias("valor")
        ).alias("serie"),
    )


def demand_points(demand: DataFrame, t0: float, t1: float, keys: Sequence[str] = ("segment",), by_group: bool = False) -> DataFrame:
    """Long observed demand, one decimal; group sums are NULL only when all their units are."""
    rows = F.array(
        F.struct(F.lit(t0).alias("t"), F.col("d0").cast("double").alias("value")),
        F.struct(F.lit(t1).alias("t"), F.col("d1").cast("double").alias("value")),
    )
    if by_group:
        sums = demand.groupBy(*keys, "grp").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
        return sums.select(*keys, "grp", F.inline(rows)).withColumn("value", F.bround("value", 1))
    return demand.select(*keys, "unit", F.inline(rows)).withColumn("value", F.bround("value", 1))


def supply_points(long: DataFrame, keys: Sequence[str] = (), by_group: bool = False) -> DataFrame:
    if by_group:
        return long.groupBy(*keys, "grp", "t").agg(F.sum("s").alias("value"))
    return long.select(*keys, "unit", "t", F.col("s").alias("value"))


def layer(
    universe: DataFrame, summary: DataFrame, levels: DataFrame, reasons: DataFrame, keys: Sequence[str], members: dict[str, Sequence[str]], horizons: Sequence[str]
) -> DataFrame:
    """Every unit × key member × horizon, missing ones as no-data records; published rounding.

    ``members`` lists the literal values of each key column (segments or cells).
    """
    keys = list(keys)
    grid = universe.select("unit", "grp")
    for k in keys:
        grid = grid.withColumn(k, F.explode(array_of(list(members[k]), "string")))
    base = grid.join(levels.select(*keys, "unit", "level_base"), [*keys, "unit"], "left").join(
        reasons.select(*[k for k in keys if k in reasons.columns], "unit", "reason"),
        [*[k for k in keys if k in reasons.columns], "unit"],
        "left",
    )
    rows = base.withColumn("horizon", F.explode(array_of(list(horizons), "string")))
    found = summary.select(*keys, "unit", "horizon", "n_obs", "rate_pct", "delta_pct", "ci_lo", "ci_hi", "verdict", "confidence")
    out = rows.join(found, [*keys, "unit", "horizon"], "left")
    r1 = lambda c: half_even(c, 1).alias(c)
    return out.select(
        *keys, "unit", "grp", "horizon",
        F.coalesce("n_obs", rules.observed_when_missing("reason")).alias("n_obs"),
        "reason", "level_base", r1("rate_pct"), r1("delta_pct"), r1("ci_lo"), r1("ci_hi"),
        F.coalesce("verdict", F.lit("sin_datos")).alias("verdict"),
        F.coalesce("confidence", F.lit("baja")).alias("confidence"),
    )


def green_records(green: DataFrame) -> DataFrame:
    """``unit, grp, ambit`` and green counts -> one record per cell; rural units carry a reason instead."""
    from geopanel.operators.panel import green_cells

    rural = F.col("ambit") == "rural"
    return green_cells(green).select(
        "unit", "grp", "cell",
        F.when(~rural, F.col("level_base")).alias("level_base"),
        F.when(~rural, half_even("area", 1)).alias("area"),
        F.when(rural, "rural").alias("reason"),
    )


def _record() -> Column:
    """Published record of one member; fields in alphabetical order, explicit nulls."""
    ic = F.when(F.col("ci_lo").isNotNull(), F.array("ci_lo", "ci_hi"))
    return F.struct(
        F.col("confidence").alias("confianza"),
        F.col("delta_pct").alias("delta_pct"),
        ic.alias("ic95"),
        F.col("rate_pct").alias("tasa_anual_pct"),
        F.col("verdict").alias("veredicto"),
    )


def nested(layer_rows: DataFrame, member: str, field: str, series_by: DataFrame | None = None) -> DataFrame:
    """Flat layer -> one row per unit: ``unit, grp, <field>: map<member, struct<h: map<horizon, record>, …>>``.

    Collected lists hold the members and horizons of one unit: sizes of the catalogue, not of the data.
    """
    by_member = layer_rows.groupBy("unit", "grp", member).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", _record())))).alias("h"),
        F.max("n_obs").alias("n_obs"),
        F.max("reason").alias("motivo_sin_datos"),
        F.max("level_base").alias("nivel_base"),
    )
    if series_by is not None:
        by_member = by_member.join(series_by, ["unit", member], "left")
    else:
        empty = F.struct(F.array().cast("array<double>").alias("t"), F.array().cast("array<double>").alias("valor"))
        by_member = by_member.withColumn("serie", empty)
    item = F.struct("h", "motivo_sin_datos", "n_obs", "nivel_base", "serie")
    entries = F.collect_list(F.struct(F.col(member).alias("k"), item.alias("v")))
    by_key = F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return by_member.groupBy("unit", "grp").agg(F.map_from_entries(by_key).alias(field))


def document_rows(nested_rows: DataFrame, field: str) -> DataFrame:
    """``unit, doc``: one compact JSON record per unit, keys sorted, nulls explicit."""
    body = F.struct(F.col("grp").alias("cve_mun"), F.col(field))
    return nested_rows.select("unit", F.to_json(body, {"ignoreNullFields": "false"}).alias("doc"))


def verdict_distribution(layer_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Units per group × horizon (× keys) × verdict, absent verdicts as zeros."""
    return layer_rows.groupBy(*keys, "grp", "horizon").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in rules.VERDICTS])


def group_documents(nested_rows: DataFrame, distribution: DataFrame, member: str, field: str) -> DataFrame:
    """``unit, doc`` of every group: its own nested record next to the verdicts of its units, by member and horizon.

    Collected lists hold the members and horizons of one group: sizes of the catalogue.
    """
    counts = F.struct(*[F.col(v) for v in rules.VERDICTS])
    by_member = distribution.groupBy("grp", member).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("horizon"), counts.alias("n"))), lambda a, b: F.when(a["horizon"] < b["horizon"], -1).otherwise(1))).alias("h"))
    packed = by_member.groupBy(F.col("grp").cast("string").alias("unit")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(member).alias("k"), F.col("h"))), lambda a, b: F.when(a["k"] < b["k"], -1).otherwise(1))).alias("distribucion_ageb"))
    rows = nested_rows.withColumn("unit", F.col("unit").cast("string")).join(packed, "unit", "left")
    return rows.select("unit", F.to_json(F.struct("distribucion_ageb", field), {"ignoreNullFields": "false"}).alias("doc"))


def header() -> Column:
    """Version, base date and horizons that open every document."""
    return F.struct(F.lit(VERSION).alias("version"), F.lit(BASE_DATE).alias("fecha_base"), F.array(*[F.struct(F.lit(h).alias("clave"), F.lit(y).alias("anios"), F.lit(d).alias("fecha")) for h, y, d in HORIZONS]).alias("horizontes"))


def root_records(summary: DataFrame, keys: Sequence[str], members: dict[str, Sequence[str]], horizons: Sequence[str]) -> DataFrame:
    """Root records for every key member × horizon; members without any unit are no-data.

    ``summary`` holds the root roll-up: one row per member and horizon at most.
    """
    grid = summary.sparkSession.range(1).select(F.lit("root").alias("unit"), F.lit("root").alias("grp"))
    none = grid.where(F.lit(False)).select("unit", F.lit(None).cast("string").alias("reason"))
    levels = summary.groupBy(*keys, "unit").agg(F.max("level_base").alias("level_base"))
    return layer(grid, summary, levels, none, keys, members, horizons)


# --- validation --------------------------------------------------------------------------------


def _broken(checks: dict[str, Column]) -> Column:
    """Names of the broken rules of a row."""
    return F.filter(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks.items()]),
        lambda x: x.isNotNull(),
    )


def record_violations(records: DataFrame, member: str, supply: bool, key_lengths: Sequence[int] = (3, 9, 13)) -> DataFrame:
    """``unit, <member>, horizon, rule`` for every broken record rule, in one scan."""
    checks = {
        "key_length": ~F.length("unit").isin(list(key_lengths)),
        "n_obs_missing": F.col("n_obs").isNull(),
        "verdict_domain": ~F.coalesce(F.col("verdict").isin(*rules.VERDICTS), F.lit(False)),
        "confidence_domain": ~F.coalesce(F.col("confidence").isin(*rules.CONFIDENCES), F.lit(False)),
        "interval_missing": F.col("delta_pct").isNotNull() & (F.col("ci_lo").isNull() | F.col("ci_hi").isNull()),
        "interval_misses_point": F.col("delta_pct").isNotNull()
        & ~((F.col("ci_lo") <= F.col("delta_pct")) & (F.col("delta_pct") <= F.col("ci_hi"))),
    }
    if supply:
        checks["supply_never_high"] = F.col("confidence") == "alta"
    return records.select(F.col("unit").cast("string").alias("unit"), member, "horizon", F.explode(_broken(checks)).alias("rule"))


def completeness_violations(records: DataFrame, member: str, expected: Sequence[str], horizons: Sequence[str], universe: DataFrame | None = None) -> DataFrame:
    """``unit, <member>, horizon, rule``: every expected pair that a unit lacks, every record outside the catalogue (with the
    number of such records, not their names), and the units of ``universe`` without any record."""
    pairs = [(m, h) for m in expected for h in horizons]
    known = F.coalesce(F.col(member).isin(list(expected)) & F.col("horizon").isin(list(horizons)), F.lit(False))
    held = lambda m, h: F.count_if((F.col(member) == m) & (F.col("horizon") == h))
    per_unit = records.groupBy("unit").agg(
        F.array(*[F.when(held(m, h) == 0, F.struct(F.lit(m).alias("m"), F.lit(h).alias("h"), F.lit("missing_pair").alias("rule"))) for m, h in pairs]).alias("missing"),
        F.count_if(~known).alias("unknown"),
    )
    null = F.lit(None).cast("string")
    outside = F.when(F.col("unknown") > 0, F.array(F.struct(null.alias("m"), null.alias("h"), F.lit("outside_catalogue").alias("rule")))).otherwise(F.array())
    broken = per_unit.select(F.col("unit").cast("string").alias("unit"), F.explode(F.concat(F.filter("missing", lambda x: x.isNotNull()), outside)).alias("x"))
    out = broken.select("unit", F.col("x.m").alias(member), F.col("x.h").alias("horizon"), F.col("x.rule").alias("rule"))
    if universe is None:
        return out
    absent = universe.join(records.select("unit").distinct(), "unit", "left_anti")
    return out.unionAll(absent.select(F.col("unit").cast("string"), null.alias(member), null.alias("horizon"), F.lit("no_records").alias("rule")))


def header_violations(headers: DataFrame, group_level: bool = False) -> DataFrame:
    """``version, horizons (array in order), groups (array)`` headers of documents -> broken rules."""
    checks = {
        "version": F.coalesce(F.col("version") != VERSION, F.lit(True)),
        "horizon_order": F.coalesce(F.col("horizons") != array_of([h for h, _, _ in HORIZONS], "string"), F.lit(True)),
    }
    if group_level:
        checks["group_keys"] = F.array_sort("groups") != array_of(list(GROUP_CODES), "string")
    return headers.select(F.explode(_broken(checks)).alias("rule"))


def green_violations(records: DataFrame) -> DataFrame:
    """``unit, horizons_available, cells (map), has_projection`` of the unprojected branch."""
    checks = {
        "green_horizons": F.size("horizons_available") != 0,
        "green_cells": F.array_sort(F.map_keys("cells")) != array_of(sorted(catalog.GREEN_CELLS), "string"),
        "green_projected": F.col("has_projection"),
    }
    return records.select("unit", F.explode(_broken(checks)).alias("rule"))


def reconcile_levels(units: DataFrame, groups: DataFrame, rtol: float = 0.05, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Σ unit levels against the group's own level: relative error and whether it is within tolerance."""
    level = F.col("level_base") * (F.lit(1.0) + F.col("delta_pct") / 100.0)
    sums = units.where(level.isNotNull()).groupBy(*keys, "grp").agg(F.sum(level).alias("expected"))
    own = groups.select(*keys, F.col("unit").alias("grp"), level.alias("obtained")).where(F.col("obtained").isNotNull())
    err = F.try_divide(F.abs(F.col("obtained") - F.col("expected")), F.abs(F.nullif(F.col("expected"), F.lit(0.0))))
    return own.join(sums, [*keys, "grp"]).select(
        *keys, "grp", "expected", "obtained", err.alias("rel_error"), F.coalesce(err <= rtol, F.lit(True)).alias("ok")
    )


def replicate_additivity(sim: DataFrame, rolled: DataFrame, keys: Sequence[str], span: float, tol: float = 1e-9) -> DataFrame:
    """Per group: largest relative gap, over replicates, between summed unit levels and the group level."""
    from geopanel.operators.replicate import vector_sums

    shape = lambda x: F.col("base") * F.exp(x * span)
    sums = vector_sums(sim, [*keys, "grp"], {"total": F.col("r")}, shape, {}, ["base"])
    own = rolled.select(*keys, "grp", F.transform("r", shape).alias("level"))
    gap = F.zip_with("total", "level", lambda a, b: F.abs(a - b) / F.abs(a))
    return own.join(sums, [*keys, "grp"]).select(*keys, "grp", (F.array_max(gap) < tol).alias("additive"), F.size("total").cast("long").alias("n_rep"))


# --- keys and cells ----------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def key_checks(universe: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row of counts: units by ambit, key length against ambit, optional bounding-box misses."""
    urban = F.col("ambit") == "urbano"
    size = F.when(urban, 13).otherwise(9)
    aggs = [
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(urban).alias("n_urban"),
        F.count_if(~urban).alias("n_rural"),
        F.count_if(F.length("unit") != size).alias("n_bad_length"),
        (F.count(F.lit(1)) - F.count_distinct("unit")).alias("n_duplicate"),
    ]
    if box:
        x1, y1, x2, y2 = box
        aggs.append(F.count_if((F.col("x1") < x1) | (F.col("y1") < y1) | (F.col("x2") > x2) | (F.col("y2") > y2)).alias("n_outside"))
    return universe.agg(*aggs)


def cell_overlaps(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities that fall into more than one cell."""
    return members.groupBy(*keys).agg(F.count_distinct("cell").alias("n")).where(F.col("n") > 1)


def partition_gap(cells: DataFrame, whole: DataFrame, keys: Sequence[str], part: str = "s", total: str = "s") -> DataFrame:
    """Keys where the cells' sum differs from the branch total."""
    sums = cells.groupBy(*keys).agg(F.sum(part).alias("parts"))
    return whole.select(*keys, F.col(total).alias("total")).join(sums, list(keys), "left").where(
        F.coalesce("parts", F.lit(0)) != F.coalesce("total", F.lit(0))
    )


def match_quality(matches: DataFrame, partner: str) -> DataFrame:
    return matches.agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col(partner).isNull()).alias("n_unmatched"),
        F.avg("coverage_pct").alias("mean_coverage"),
        F.coalesce(F.avg("coverage_pct") > 50, F.lit(False)).alias("ok"),
    )


# --- record normalisation and versions ---------------------------------------------------------


def normalised(records: DataFrame) -> DataFrame:
    """Untrusted records (all text) -> valid ones. An unknown verdict becomes a full no-data record,
    an unknown confidence the lowest level, a non-number NULL; half an interval is none."""
    known = F.col("verdict").isin("sube", "se_mantiene", "baja")
    num = lambda c: F.when(known, F.col(c).try_cast("double"))
    lo, hi = F.col("ci_lo").try_cast("double"), F.col("ci_hi").try_cast("double")
    pair = known & lo.isNotNull() & hi.isNotNull()
    conf = F.when(known & F.col("confidence").isin(*rules.CONFIDENCES), F.col("confidence")).otherwise("baja")
    fixed = {
        "verdict": F.when(known, F.col("verdict")).otherwise("sin_datos"),
        "delta_pct": num("delta_pct"),
        "rate_pct": num("rate_pct"),
        "ci_lo": F.when(pair, lo),
        "ci_hi": F.when(pair, hi),
        "confidence": conf,
    }
    return records.withColumns(fixed)


def upgraded(records: DataFrame, member: str, members: Sequence[str], default: str, reason: str = "contrato_v1.2") -> DataFrame:
    """Records of an older contract (no member dimension) -> one record per member: the old one stays
    under ``default``, the others become no-data."""
    rows = normalised(records).withColumn(member, F.explode(array_of(list(members), "string")))
    own = F.col(member) == default
    blank = {c: F.when(own, F.col(c)) for c in ("delta_pct", "rate_pct", "ci_lo", "ci_hi", "level_base")}
    return rows.withColumns(
        {
            **blank,
            "n_obs": F.when(own, F.col("n_obs")).otherwise(0),
            "verdict": F.when(own, F.col("verdict")).otherwise("sin_datos"),
            "confidence": F.when(own, F.col("confidence")).otherwise("baja"),
            "reason": F.when(own, F.col("reason")).otherwise(reason),
        }
    )


def upgraded_single_horizon(records: DataFrame, member: str, members: Sequence[str], default: str) -> DataFrame:
    """The oldest contract has one unnamed horizon and no levels: name it, then upgrade."""
    named = records.withColumns({"horizon": F.lit("hU"), "level_base": F.lit(None).cast("double"), "reason": F.lit(None).cast("string")})
    return upgraded(named, member, members, default)
