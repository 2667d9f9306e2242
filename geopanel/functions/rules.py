"""Decision rules: verdicts, confidence, reasons, scenarios, boundary relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geopanel.functions.scalars import col

# Fixed values of the published contract.
VERDICTS = ("sube", "se_mantiene", "baja", "sin_datos")
CONFIDENCES = ("alta", "media", "baja")
P_DECISION = 0.80
P_HIGH = 0.95
MIN_CONFIDENT_BASE = 100
MIN_COUNT = 20
DEAD_BAND = 0.01
PUBLIC_REASONS = {
    "rural": "rural",
    "suprimido_inegi": "suprimido_inegi",
    "d2020_menor_20": "poblacion_menor_20",
    "sin_poligono": "sin_poligono",
    "sin_censo": "sin_censo",
}
CONFIDENCE_SCORE = {"alta": 1.0, "media": 0.5, "baja": 0.0}
SCENARIO_LIMITS = {
    "min_valid": 8,
    "majority": 0.60,
    "counterweight": 0.15,
    "polarised": 0.25,
    "flat_majority": 0.50,
    "low_confidence": 0.50,
}


def verdict(p_up: str | Column, p_down: str | Column) -> Column:
    return (
        F.when(col(p_up) >= P_DECISION, "sube").when(col(p_down) >= P_DECISION, "baja").otherwise("se_mantiene")
    )


def decided_probability(p_up: str | Column, p_down: str | Column, p_flat: str | Column) -> Column:
    return (
        F.when(col(p_up) >= P_DECISION, col(p_up)).when(col(p_down) >= P_DECISION, col(p_down)).otherwise(col(p_flat))
    )


def _rank(level: Column) -> Column:
    return F.when(level == "alta", 2).when(level == "media", 1).when(level == "baja", 0)


def confidence(p_dec: Column, stable: Column, n_obs: Column, conf_base: Column, cap: Column) -> Column:
    """Base level, minus one when unstable, floored by thin evidence, then capped."""
    base = F.when(p_dec >= P_HIGH, 2).when(p_dec >= P_DECISION, 1).otherwise(0)
    stepped = F.greatest(F.lit(0), base - F.when(stable, 0).otherwise(1))
    thin = (n_obs == 1) | F.coalesce(conf_base < MIN_CONFIDENT_BASE, F.lit(False))
    floored = F.when(thin, 0).otherwise(stepped)
    capped = F.least(floored, F.coalesce(_rank(cap), F.lit(2)))
    return F.element_at(F.array(F.lit("baja"), F.lit("media"), F.lit("alta")), capped + 1)


def confidence_score(level: str | Column) -> Column:
    c = col(level)
    return F.when(c == "alta", 1.0).when(c == "media", 0.5).when(c == "baja", 0.0)


def confidence_order(level: str | Column) -> Column:
    """0 = best, unknown last."""
    c = col(level)
    return F.when(c == "alta", 0).when(c == "media", 1).when(c == "baja", 2).otherwise(3)


def dead_band_class(rate: str | Column, delta: float = DEAD_BAND) -> Column:
    r = col(rate)
    return F.when(r > delta, "sube").when(r < -delta, "baja").otherwise("se_mantiene")


def demand_reason(ambit: Column, has_census: Column, later: Column) -> Column:
    return (
        F.when(ambit == "rural", "rural")
        .when(~has_census, "sin_censo")
        .when(later.isNull(), "suprimido_inegi")
        .when(later < MIN_COUNT, "d2020_menor_20")
    )


def public_reason(reason: str | Column) -> Column:
    pairs = [F.lit(x) for kv in PUBLIC_REASONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(reason))


def supply_reason(ambit: Column, total: Column) -> Column:
    return F.when(ambit == "rural", "rural").when(total == 0, "sin_establecimientos")


def observed_when_missing(reason: str | Column) -> Column:
    return F.when(col(reason) == "sin_establecimientos", 3).otherwise(0)


def scenario(n_up: Column, n_down: Column, n_flat: Column) -> Column:
    """Overall verdict of a set of units; the first matching rule wins."""
    v, lim = n_up + n_down + n_flat, SCENARIO_LIMITS
    return (
        F.when(v < lim["min_valid"], "insuficiente")
        .when((n_down >= v * lim["majority"]) & (n_up <= v * lim["counterweight"]), "baja")
        .when((n_up >= v * lim["majority"]) & (n_down <= v * lim["counterweight"]), "sube")
        .when((n_up >= v * lim["polarised"]) & (n_down >= v * lim["polarised"]), "polarizado")
        .when(n_flat >= v * lim["flat_majority"], "mantiene")
        .otherwise("mixto")
    )


def boundary_relation(own: Column, partner: Column, frac_own: Column, frac_partner: Column, children: Column) -> Column:
    """How a unit relates to its predecessor, from the two overlap fractions."""
    return (
        F.when(partner.isNull(), "sin_contraparte")
        .when((frac_own >= 0.95) & (frac_partner >= 0.95), F.when(own == partner, "misma").otherwise("misma_otra_clave"))
        .when((frac_own >= 0.95) & (children > 1), "division")
        .when(frac_partner >= 0.95, "fusion_o_expansion")
        .otherwise("cambio_limites")
    )


def confidence_cap(relation: str | Column) -> Column:
    return F.when(col(relation).isin("division", "fusion_o_expansion", "cambio_limites"), "media")
