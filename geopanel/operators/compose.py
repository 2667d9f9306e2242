"""Composition queries over the flat summary table.

Summary columns: ``branch`` (``demanda`` or a supply branch), ``cell`` (segment or cell), ``unit,
grp, horizon`` (``actual`` for a branch without projection), ``n_obs, reason, level_base,
delta_pct, rate_pct, ci_lo, ci_hi, verdict, confidence``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import rules
from geopanel.functions.scalars import array_of, clip, implied_rate_pct, level_at_horizon, per_thousand
from geopanel.operators import rank
from geopanel.session import materialised
from geopanel.sources.catalog import BRANCHES, PROJECTED_BRANCHES

# Fixed values of the index.
K_DEFAULT = 5.0
K_SENSITIVITY = (3.0, 5.0, 8.0)
MAX_ADJUSTMENT = 0.15
SUBSTANTIAL_MOVE = 0.10
YEARS = {"h1": 1, "h3": 3, "h5": 5}
SUPPLY_HORIZONS = ("h1", "h3")
UNPROJECTED = "verde"


@dataclass(frozen=True)
class State:
    """What a user has selected."""

    horizon: str = "h3"
    segment: str = "todas"
    cells: dict[str, Sequence[str]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(BRANCHES, 1.0))
    view: str = "general"
    search: str = "oportunidad"
    min_confidence: float | None = None
    zero_missing_demand_rate: bool = True
    only_published: bool = False

    @property
    def supply_horizon(self) -> str:
        """A horizon the supply side lacks falls back to its last one."""
        return self.horizon if self.horizon in SUPPLY_HORIZONS else SUPPLY_HORIZONS[-1]


# --- levels ------------------------------------------------------------------------------------


def demand_levels(summary: DataFrame, state: State) -> DataFrame:
    """Level and rate at the horizon; with ``only_published`` a unit without a published change has neither."""
    change = "delta_pct" if state.only_published else "coalesce(delta_pct, 0D)"
    rate = "coalesce(rate_pct, 0D)" if state.zero_missing_demand_rate else "if(delta_pct IS NULL, NULL, rate_pct)" if state.only_published else "rate_pct"
    own = (F.col("branch") == "demanda") & (F.col("cell") == F.lit(state.segment)) & (F.col("horizon") == F.lit(state.horizon))
    return summary.where(own).selectExpr(
        "unit", "grp", f"level_base * (1 + {change} / 100) AS level_d", f"{rate} AS rate_d",
        "coalesce(confidence, 'baja') AS confidence", "reason",
    )


def branch_levels(summary: DataFrame, state: State) -> DataFrame:
    """Base and horizon level per unit × branch, summed over the selected cells, with the implied rate."""
    wanted = F.lit(False)
    for b in BRANCHES:
        own = (F.col("branch") == b) & (F.col("horizon") == ("actual" if b == UNPROJECTED else state.supply_horizon))
        chosen = list(state.cells.get(b, ()))
        wanted = wanted | (own & F.col("cell").isin(chosen) if chosen else own)
    sums = (
        summary.where(wanted)
        .groupBy("unit", "branch")
        .agg(
            F.expr("sum(coalesce(level_base, 0D))").alias("level_s0"),
            F.sum(level_at_horizon("level_base", "delta_pct")).alias("level_s"),
        )
    )
    rate = implied_rate_pct("level_s0", "level_s", float(YEARS[state.supply_horizon]))
    return sums.withColumn("rate_s", F.when(F.col("branch") != UNPROJECTED, rate))


def coverage_by_branch(summary: DataFrame, state: State) -> DataFrame:
    """Unit × branch rows: every unit of the demand layer. Where a branch is absent, coverage is NULL, or with
    ``only_published`` the branch counts as level and rate zero."""
    d = demand_levels(summary, state).withColumn("branch", F.explode(array_of(BRANCHES, "string")))
    joined = d.join(branch_levels(summary, state), ["unit", "branch"], "left")
    if state.only_published:
        joined = joined.withColumns({"rate_s": F.when(F.col("level_s").isNull(), F.lit(0.0)).otherwise(F.col("rate_s")), "level_s": F.coalesce("level_s", F.lit(0.0))})
    return joined.withColumn("coverage", per_thousand("level_s", "level_d"))


# --- indices -----------------------------------------------------------------------------------


def opportunity(pct_rank: Column, rate_d: Column, rate_s: Column, trend: Column | bool = True, k: float | Column = K_DEFAULT) -> Column:
    """1 − rank, moved by the bounded rate gap; a branch without trend is not moved."""
    adjust = clip((rate_d - rate_s) / k, -MAX_ADJUSTMENT, MAX_ADJUSTMENT)
    if trend is not True:
        adjust = F.when(trend, adjust).otherwise(F.lit(0.0))
    return clip(F.lit(1.0) - pct_rank + adjust, 0.0, 1.0)


def availability(pct_rank: Column, rate_s: Column, conf: Column, trend: Column | bool = True, k: float = K_DEFAULT) -> Column:
    adjust = clip(rate_s / k, -MAX_ADJUSTMENT, MAX_ADJUSTMENT) * F.coalesce(rules.confidence_score(conf), F.lit(0.0))
    if trend is not True:
        adjust = F.when(trend, adjust).otherwise(F.lit(0.0))
    return clip(pct_rank + adjust, 0.0, 1.0)


def branch_indices(summary: DataFrame, state: State) -> DataFrame:
    ranked = rank.percentile_rank(coverage_by_branch(summary, state), ["branch"], "coverage", "rank")
    has_trend = F.col("branch") != UNPROJECTED
    return ranked.withColumn(
        "o", opportunity(F.col("rank"), F.col("rate_d"), F.col("rate_s"), has_trend)
    ).withColumn("f", availability(F.col("rank"), F.col("rate_s"), F.col("confidence"), has_trend))


def weight_of(branch: Column, weights: dict[str, float]) -> Column:
    expr = F.when(F.lit(False), F.lit(0.0))
    for b, w in weights.items():
        expr = expr.when(branch == b, F.lit(float(w)))
    return expr.otherwise(F.lit(0.0))


def weighted_index(value: str, weights: dict[str, float]) -> Column:
    """Aggregate: weighted mean over the branches that have a value, NULL if none has."""
    w = F.when(F.col(value).isNotNull(), weight_of(F.col("branch"), weights))
    return F.try_divide(F.sum(w * F.col(value)), F.when(F.sum(w) > 0, F.sum(w)))


def composite_of(prefix: str, weights: dict[str, float]) -> Column:
    """Row form of :func:`weighted_index`. The fixed branch order keeps equal inputs bit-equal, so that
    ties stay ties whatever order rows arrived in."""
    present = {b: f"if({prefix}_{b} IS NULL, 0D, {float(weights[b])}D)" for b in BRANCHES}
    top = " + ".join(f"{present[b]} * coalesce({prefix}_{b}, 0D)" for b in BRANCHES)
    return F.expr(f"try_divide({top}, nullif({' + '.join(present.values())}, 0D))")


def compose(summary: DataFrame, state: State = State()) -> DataFrame:
    """Per unit: value, percentile, quintile, tercile, weight, and per-branch index, tercile, coverage.

    The unit table feeds the ranks, the cuts and the result, so it is materialised once.
    """
    idx = branch_indices(summary, state)
    chosen = "f" if state.search == "disponibilidad" else "o"
    pick = lambda c: [F.expr(f"max({c}) FILTER (WHERE branch = '{b}')").alias(f"{c}_{b}") for b in BRANCHES]
    wide = idx.groupBy("unit", "grp", "confidence").agg(
        F.max("level_d").alias("level_d"), F.max("reason").alias("reason"), *pick("o"), *pick("f"), *pick("coverage")
    )
    value = composite_of(chosen, state.weights) if state.view == "general" else F.col(f"{chosen}_{state.view}")
    wide = materialised(wide.withColumn("value", value).drop(*[f"f_{b}" for b in BRANCHES]))

    scopes = ", ".join(f"struct('{s}' AS scope, {s} AS x)" for s in _scopes())
    dist = rank.distribution(wide.selectExpr(f"inline(array({scopes}))"), ["scope"], "x")
    cuts = [("t", 3, i) for i in (1, 2)] + [("q", 5, i) for i in (1, 2, 3, 4)]
    per_scope = dist.groupBy("scope").agg(
        *[F.expr(f"min(x) FILTER (WHERE cum > floor({i / n!r}D * n))").alias(f"{p}{i}") for p, n, i in cuts]
    )
    # All cuts as one struct value: five scopes, six cuts each.
    wanted = [(s, f"{p}{i}") for s in _scopes() for p, _, i in cuts if p == "t" or s == "value"]
    flat = per_scope.groupBy().agg(*[F.expr(f"max({c}) FILTER (WHERE scope = '{s}')").alias(f"{s}_{c}") for s, c in wanted])
    one = flat.select(F.struct(*flat.columns))
    pct = dist.where("scope = 'value'").select(
        F.col("x").alias("value"), "cnt", rank.percentile_of(F.col("cnt"), F.col("cum"), F.col("n")).alias("percentile")
    )
    out = rank.join_by_value(wide, pct, [], "value", "percentile").select("*", one.scalar().alias("_c")).select("*", "_c.*")

    def tercile(s: str) -> str:
        return f"CASE WHEN {s} IS NULL THEN 'sin_datos' WHEN {s} <= {s}_t1 THEN 'baja' WHEN {s} <= {s}_t2 THEN 'media' ELSE 'alta' END"

    quintile = " ".join(f"WHEN value <= value_q{i} THEN {i}" for i in range(1, 5))
    return out.selectExpr(
        "unit", "grp", "value", "percentile",
        f"CASE WHEN value IS NULL THEN NULL {quintile} ELSE 5 END AS quintile",
        f"{tercile('value')} AS tercile",
        "confidence", "reason", "confidence = 'baja' AS low_confidence", "coalesce(level_d, 0D) AS weight",
        *[f"o_{b}" for b in BRANCHES],
        *[f"{tercile(f'o_{b}')} AS tercile_{b}" for b in BRANCHES],
        *[f"coverage_{b}" for b in BRANCHES],
    )


def _scopes() -> list[str]:
    return ["value", *[f"o_{b}" for b in BRANCHES]]


# --- per-row branch algebra --------------------------------------------------------------------


def _scored(weights: dict[str, float]) -> Column:
    """Branches with a value as structs ordered by score; earlier branches win ties."""
    items = [
        F.when(
            F.col(f"o_{b}").isNotNull(),
            F.struct((F.col(f"o_{b}") * float(weights[b])).alias("score"), F.lit(-i).alias("order"), F.lit(b).alias("branch")),
        )
        for i, b in enumerate(BRANCHES)
    ]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def main_branch(weights: dict[str, float]) -> Column:
    return F.array_max(_scored(weights))["branch"]


def top_branches(weights: dict[str, float], n: int = 2) -> Column:
    ordered = F.sort_array(_scored(weights), asc=False)
    return F.array_join(F.transform(F.slice(ordered, 1, n), lambda x: x["branch"]), ",")


def contributions(composed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Share of each branch in a unit's composite, in percent."""
    total = F.aggregate(_scored(weights), F.lit(0.0), lambda a, x: a + x["score"])
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("branch"), F.lit(float(weights[b])).alias("branch_weight"), F.col(f"o_{b}").alias("o"))
            for b in BRANCHES
        ]
    )
    long = composed.select("unit", total.alias("_total"), F.inline(rows))
    share = F.when(F.col("_total") > 0, F.col("branch_weight") * F.col("o") * 100.0 / F.col("_total"))
    return long.select("unit", "branch", "branch_weight", "o", share.alias("share_pct"))


# --- summaries of sets of units ----------------------------------------------------------------


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: NULL values skipped, negative weights count as 0."""
    w = F.when(F.col(value).isNotNull(), F.greatest(F.col(weight), F.lit(0.0)))
    return F.try_divide(F.sum(w * F.col(value)), F.when(F.sum(w) > 0, F.sum(w)))


def weighted_mode(df: DataFrame, zone: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Heaviest category per zone, no-data excluded; plain counts when all weights are 0. The category
    seen first in unit order wins ties."""
    zone = list(zone)
    w = F.greatest(F.col(weight), F.lit(0.0))
    parts = df.groupBy(*zone, value).agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_c"), F.min("unit").alias("_first"))
    real = F.col(value).isNotNull() & (F.col(value) != "sin_datos")
    best = lambda score: F.min_by(F.when(real, F.col(value)), F.when(real, F.struct(-score, F.col("_first"))))
    heavy, plain = best(F.col("_w")), best(F.col("_c").cast("double"))
    return parts.groupBy(*zone).agg(
        F.coalesce(F.when(F.sum("_w") > 0, heavy).otherwise(plain), F.lit("sin_datos")).alias(out)
    )


def zone_summary(composed: DataFrame, zone: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Modal tercile and confidence, the two most influential branches and the modal tercile per branch."""
    zone = list(zone)
    labels = ["tercile", "confidence", *[f"tercile_{b}" for b in BRANCHES]]
    items = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("v")) for c in labels])
    long = composed.select(*zone, "unit", "weight", F.inline(items))
    modes = weighted_mode(long, [*zone, "label"], "v", "weight", "mode")
    packed = modes.groupBy(*zone).agg(*[F.max(F.when(F.col("label") == c, F.col("mode"))).alias(c) for c in labels])
    means = composed.groupBy(*zone).agg(*[weighted_mean(f"o_{b}", "weight").alias(f"o_{b}") for b in BRANCHES])
    return packed.join(means, zone).withColumn("top_branches", top_branches(weights))


def verdict_counts(valid_conf: str = "confidence") -> list[Column]:
    v = F.col("verdict")
    known = v.isin("sube", "se_mantiene", "baja")
    return [
        F.count_if(v == "sube").alias("n_up"),
        F.count_if(v == "baja").alias("n_down"),
        F.count_if(v == "se_mantiene").alias("n_flat"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_none"),
        F.count_if(known & (F.col(valid_conf) == "baja")).alias("n_low"),
        F.count(F.lit(1)).alias("total"),
    ]


def verdict_summary(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, rounded percentages, scenario and low-confidence flag per key."""
    c = records.groupBy(*keys).agg(*verdict_counts())
    v = F.col("n_up") + F.col("n_down") + F.col("n_flat")
    pct = lambda n: F.when(v > 0, F.floor(F.try_divide(F.col(n) * 100.0, v) + 0.5)).otherwise(0).cast("bigint")
    low = (v > 0) & (F.col("n_low") >= v * rules.SCENARIO_LIMITS["low_confidence"])
    return c.select(
        *keys, "total", v.alias("valid"), "n_up", "n_down", "n_flat", "n_none",
        pct("n_up").alias("pct_up"), pct("n_down").alias("pct_down"), pct("n_flat").alias("pct_flat"),
        low.alias("low_confidence"),
        rules.scenario(F.col("n_up"), F.col("n_down"), F.col("n_flat")).alias("scenario"),
    )


def legend_counts(composed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    t = F.coalesce("tercile", F.lit("sin_datos"))
    known = t.isin("alta", "media", "baja")
    return composed.groupBy(*keys).agg(
        *[F.count_if(t == c).alias(f"n_{c}") for c in ("alta", "media", "baja")],
        F.count_if(~known).alias("n_sin_datos"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(known & F.col("low_confidence")).alias("n_low_confidence"),
    )


def coverage_reference(composed: DataFrame, zone: Sequence[str] = ()) -> DataFrame:
    """Population-weighted coverage of each branch over everything (or per zone)."""
    items = F.array(*[F.struct(F.lit(b).alias("branch"), F.col(f"coverage_{b}").alias("coverage")) for b in BRANCHES])
    long = composed.select(*zone, "weight", F.inline(items))
    return long.groupBy(*zone, "branch").agg(weighted_mean("coverage", "weight").alias("coverage_ref"))


# --- rankings ----------------------------------------------------------------------------------


def risk_filter(composed: DataFrame, threshold: float | None) -> DataFrame:
    if threshold is None:
        return composed
    score = F.coalesce(rules.confidence_score(F.coalesce("confidence", F.lit("baja"))), F.lit(0.0))
    return composed.where(score >= threshold)


def ranking(composed: DataFrame, by: str = "value", n: int | None = 20, name: str = "grp") -> DataFrame:
    """Top rows by value, by group name (Spanish collation) or by confidence; the unit breaks ties."""
    value = [F.col("value").desc_nulls_last(), F.col("unit").asc()]
    order = {
        "value": value,
        "group": [F.collate(F.col(name).cast("string"), "es").asc(), F.col("unit").asc()],
        "confidence": [rules.confidence_order("confidence").asc(), *value],
    }[by]
    out = composed.orderBy(*order)
    return out.limit(n) if n is not None else out


def change_table(records: DataFrame, by: str = "change", n: int | None = None, name: str = "name") -> DataFrame:
    change = [F.col("delta_pct").asc_nulls_last(), F.col("unit").asc()]
    order = {
        "change": change,
        "name": [F.collate(F.col(name).cast("string"), "es").asc(), F.col("unit").asc()],
        "confidence": [rules.confidence_order("confidence").asc(), *change],
    }[by]
    out = records.orderBy(*order)
    return out.limit(n) if n is not None else out


def search(rows: DataFrame, text: str, column: str, limit: int | None = None) -> DataFrame:
    """Case-insensitive substring; an empty query with a limit matches nothing."""
    q = text.strip().lower()
    if not q:
        return rows.limit(0) if limit is not None else rows
    hits = rows.where(F.contains(F.lower(F.col(column).cast("string")), F.lit(q)))
    return hits.orderBy(column).limit(limit) if limit is not None else hits


# --- sensitivity and comparison ----------------------------------------------------------------


def sensitivity(coverage: DataFrame, keys: Sequence[str], ks: Sequence[float] = K_SENSITIVITY) -> DataFrame:
    """Per unit: rank of the index under the smallest and largest K, and whether it moves substantially.

    Input: keys, ``unit, coverage, rate_d, rate_s``.
    """
    keys = list(keys)
    lo, hi = min(ks), max(ks)
    base = rank.percentile_rank(coverage, keys, "coverage", "rank")
    o = lambda k: opportunity(F.col("rank"), F.col("rate_d"), F.col("rate_s"), True, k)
    both_k = F.array(*[F.struct(F.lit(float(k)).alias("k"), o(k).alias("o")) for k in (lo, hi)])
    long = materialised(base.select(*keys, "unit", F.inline(both_k)))  # ranked and joined back
    ranked = rank.percentile_rank(long, [*keys, "k"], "o", "o_rank")
    at = lambda k: F.max(F.when(F.col("k") == float(k), F.col("o_rank")))
    both = ranked.groupBy(*keys, "unit").agg(at(lo).alias("rank_lo"), at(hi).alias("rank_hi"))
    moved = F.abs(F.col("rank_lo") - F.col("rank_hi")) > SUBSTANTIAL_MOVE
    return both.withColumn("moves", F.coalesce(moved, F.lit(False)))


def sensitivity_totals(moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    return moves.groupBy(*keys).agg(
        F.count_if("moves").alias("n_moved"), F.count_if(F.col("rank_lo").isNotNull() & F.col("rank_hi").isNotNull()).alias("n_evaluated")
    )


def published_sensitivity(summary: DataFrame, state: State = State(zero_missing_demand_rate=False, only_published=True)) -> DataFrame:
    """Sensitivity on published levels, for the projected branches."""
    cov = coverage_by_branch(summary, state).where(F.col("branch").isin(*PROJECTED_BRANCHES))
    return sensitivity(cov, ["branch"])


def compare_groups(composed: DataFrame, a: Column | str, b: Column | str, weights: dict[str, float]) -> DataFrame:
    """Two groups side by side: one row per field."""
    zones = zone_summary(composed.where(F.col("grp").isin(a, b)), ["grp"], weights)
    fields = F.array(
        *[F.struct(F.lit(x).alias("field"), F.col(f"tercile_{x}").alias("v")) for x in BRANCHES],
        F.struct(F.lit("oportunidad").alias("field"), F.col("tercile").alias("v")),
        F.struct(F.lit("confianza").alias("field"), F.col("confidence").alias("v")),
    )
    long = zones.select("grp", F.inline(fields))
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("v")))
    return long.groupBy("field").agg(side(a).alias("a"), side(b).alias("b"))


def fact_sheet(composed: DataFrame, weights: dict[str, float]) -> DataFrame:
    return composed.select(
        "unit", "grp", "reason", "tercile", "confidence",
        top_branches(weights).alias("top_branches"),
        *[f"tercile_{b}" for b in BRANCHES],
    )


def local_verdict(rate_pct: Column, band: float = 1.0) -> Column:
    return F.when(rate_pct > band, "sube").when(rate_pct < -band, "baja").when(rate_pct.isNotNull(), "se_mantiene")


def zone_population(summary: DataFrame, series: DataFrame, state: State, t_base: float, t_horizon: float) -> DataFrame:
    """Chart points of each unit: history, base, projection with interval levels.

    ``series``: ``unit, t, value`` of the active segment.
    """
    s = summary.where(
        (F.col("branch") == "demanda") & (F.col("cell") == state.segment) & (F.col("horizon") == state.horizon)
        & F.col("level_base").isNotNull() & F.col("delta_pct").isNotNull()
    )
    at = lambda c: F.col("level_base") * (F.lit(1.0) + F.col(c) / 100.0)
    null = F.lit(None).cast("double")
    point = lambda kind, t, v, lo, hi: F.struct(
        F.lit(kind).alias("kind"), F.lit(float(t)).alias("t"), v.alias("value"), lo.alias("lo"), hi.alias("hi")
    )
    marks = s.select(
        "unit",
        F.inline(
            F.array(
                point("base", t_base, F.col("level_base"), null, null),
                point("projection", t_horizon, at("delta_pct"), at("ci_lo"), at("ci_hi")),
            )
        ),
    )
    history = series.join(s.select("unit"), "unit", "left_semi").select(
        "unit", F.lit("history").alias("kind"), "t", F.col("value").cast("double").alias("value"), null.alias("lo"), null.alias("hi")
    )
    return history.unionByName(marks)


def zone_services(summary: DataFrame, composed: DataFrame, state: State) -> DataFrame:
    """Per unit × branch: levels, implied rate, local verdict, coverage against the root, contribution."""
    levels = branch_levels(summary, state)
    shares = contributions(composed, state.weights)
    items = F.array(*[F.struct(F.lit(b).alias("branch"), F.col(f"coverage_{b}").alias("coverage")) for b in BRANCHES])
    cov = composed.select("unit", F.inline(items))
    return (
        shares.join(cov, ["unit", "branch"])
        .join(levels, ["unit", "branch"], "left")
        .join(F.broadcast(coverage_reference(composed)), "branch")  # one row per branch
        .withColumn("verdict", local_verdict(F.col("rate_s")))
    )


def headline(records: DataFrame, root: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scenario of all groups next to the root's change and interval. ``root``: keys, delta and interval."""
    s = verdict_summary(records, keys)
    return s.join(root.select(*keys, "delta_pct", "ci_lo", "ci_hi"), list(keys), "left")


def unit_index(summary: DataFrame) -> DataFrame:
    """Every unit of any layer with its group: demand's group first, else the education branch's."""
    g = lambda b: F.max(F.when(F.col("branch") == b, F.col("grp")))
    return summary.groupBy("unit").agg(F.coalesce(g("demanda"), g("educacion")).alias("grp"))


def group_sizes(index: DataFrame) -> DataFrame:
    return index.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.count(F.lit(1)).alias("n_units"))


def modal_group(links: DataFrame, key: str, group: str) -> DataFrame:
    """Most frequent group per key; smallest group name on ties."""
    counts = links.where(F.col(group).isNotNull()).groupBy(key, group).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(key).agg(F.min_by(F.col(group), F.struct(-F.col("_c"), F.col(group))).alias(group))
