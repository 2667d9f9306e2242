"""J: joins (spatial ones are in :mod:`geopanel.plans.space`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.operators import compose, estimate, panel, profile
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import CAL, Roles


@query(
    "j01_match_indicator",
    with_ctes("supps", "segs", body=f"""SELECT u.unit, l.unit IS NOT NULL AS has_row, {r6('v')} AS value
    FROM supps u LEFT JOIN (SELECT * FROM segs WHERE yr = 2000 AND segment = 'todas' AND unit % 13 <> 5) l USING (unit)"""),
)
def indicator(r: Roles):
    """Telling "no census row" from "row with a suppressed value"."""
    seg = panel.census_segments(r.census, 2000, {"todas": ("p_0a2", "p_3a5", "p_6a11", "p_12a14", "p_15a17")})
    later = seg.where(F.col("unit") % 13 != 5).select("unit", F.col("segs")[0]["value"].alias("value"), F.lit(True).alias("_in"))
    return r.suppliers.join(later, "unit", "left").select("unit", F.coalesce("_in", F.lit(False)).alias("has_row"), "value")


@query("j02_crosswalk_two_hops", with_ctes("dem", body=f"SELECT segment, unit, relation, {r6('d0')} AS d0, {r6('d1')} AS d1 FROM dem"))
def two_hops(r: Roles):
    return r.demand().select("segment", "unit", "relation", "d0", "d1")


@query("j03_dense_grid", with_ctes("parts", body="SELECT unit, t FROM parts CROSS JOIN (VALUES (1996.5e0), (1998.5e0), (2000.5e0)) c(t)"))
def grid(r: Roles):
    return panel.dense_grid(r.parts.select("unit"), CAL.cuts)


@query("j04_zero_fill", with_ctes("plong", body="SELECT unit, t, s FROM plong"))
def zero_fill(r: Roles):
    counts = panel.entity_counts(r.entities().where(F.col("t").isNotNull()), ["unit"])
    return panel.fill_grid(panel.dense_grid(r.urban(r.parts).select("unit"), CAL.cuts), counts, ["unit", "t"])


@query("j05_repeat_last_cut", with_ctes("plong", body="SELECT unit, grp, t, s, s_last FROM plong"))
def last_cut(r: Roles):
    return panel.supply_long(r.part_supply, CAL.cuts)


_ELIG = "(SELECT * FROM dem WHERE reason IS NULL)"
_RHO = f"SELECT segment, grp, ln((sum(d1) + 0.5) / (sum(d0) + 0.5)) / 5 AS rho FROM {_ELIG} WHERE d0 IS NOT NULL GROUP BY 1, 2"


@query(
    "j06_group_lookup",
    with_ctes("dem", body=f"SELECT e.segment, e.unit, {r6('rho')} AS rho FROM {_ELIG} e LEFT JOIN ({_RHO}) g USING (segment, grp)"),
)
def group_lookup(r: Roles):
    units = estimate.eligible(r.demand())
    rates = estimate.group_rates(units, ["segment"], CAL.dt).select("segment", "grp", "rho")
    return units.join(rates, ["segment", "grp"], "left").select("segment", "unit", "rho")


@query(
    "j11_anti_keys",
    "SELECT DISTINCT l_partkey AS unit FROM lineitem WHERE year(l_shipdate) = 1995 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 2000)",
)
def anti(r: Roles):
    e = r.entities()
    return profile.anti_keys(e.where("cut = 1995"), e.where("cut = 2000"), "unit")


@query(
    "j12_membership_rate",
    f"""SELECT count(*) AS n_keys, {r6('avg(CASE WHEN k IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 2000) THEN 1e0 ELSE 0e0 END)')} AS rate
    FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE year(l_shipdate) = 1995)""",
)
def membership(r: Roles):
    e = r.entities()
    return profile.membership_rate(e.where("cut = 1995"), e.where("cut = 2000"), "unit")


@query(
    "j14_common_keys",
    with_ctes("pdem", "pwide", body=f"SELECT unit, {r6('s2 * 1.0 / d1')} AS ratio FROM pwide JOIN pdem USING (unit) WHERE d1 IS NOT NULL AND s2 > 0"),
)
def common(r: Roles):
    s = r.part_supply.select("unit", F.nullif(F.element_at("s", -1), F.lit(0)).alias("s"))
    d = r.part_demand.select("unit", "d1")
    return s.join(d, "unit").dropna().select("unit", (F.col("s") / F.col("d1")).alias("ratio"))


@query("j15_unit_index", with_ctes("pub", body="SELECT unit, any_value(grp) AS grp FROM pub GROUP BY 1"))
def index(r: Roles):
    return compose.unit_index(r.published)


@query("j15b_units_per_group", with_ctes("pub", body="SELECT grp, count(DISTINCT unit) AS n_units FROM pub GROUP BY 1"))
def per_group(r: Roles):
    return compose.group_sizes(compose.unit_index(r.published))


@query(
    "j16_modal_group",
    """SELECT category AS key, zone AS grp FROM (SELECT p_type AS category, p_brand AS zone, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS k
    FROM part GROUP BY 1, 2) WHERE k = 1""",
)
def modal(r: Roles):
    return compose.modal_group(r.table("part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("grp")), "key", "grp")


_A = "(SELECT grp AS k, sum(d1) AS x FROM dem WHERE segment = 'todas' GROUP BY 1)"
_B = "(SELECT grp AS k, sum(d0) AS y FROM dem WHERE segment = 'todas' GROUP BY 1)"


@query(
    "j17_source_contrast",
    with_ctes("dem", body=f"""SELECT {r6('max(abs(x / nullif(y, 0) - 1)) * 100')} AS max_pct,
    count(*) FILTER (WHERE y IS NULL OR abs(x / nullif(y, 0) - 1) >= 0.01) AS n_off FROM {_A} a LEFT JOIN {_B} b USING (k)"""),
)
def contrast(r: Roles):
    d = r.demand_all
    return profile.contrast(d.select("grp", F.col("d1").alias("v")), d.select("grp", F.col("d0").alias("v")), "grp", "v")


@query(
    "j18_deviating_groups",
    with_ctes("dem", body=f"SELECT k AS grp, {r6('(x / nullif(y, 0) - 1) * 100')} AS deviation_pct FROM {_A} a JOIN {_B} b USING (k) WHERE abs(x / nullif(y, 0) - 1) > 0.05"),
)
def deviating(r: Roles):
    d = r.demand_all
    return profile.deviating(d.select("grp", F.col("d1").alias("v")), d.select("grp", F.col("d0").alias("v")), "grp", "v")


@query(
    "j19_total_mismatches",
    with_ctes("swide", "stot", body="""SELECT count(*) AS n_compared, count(*) FILTER (WHERE p <> s2) AS n_different
    FROM stot t LEFT JOIN (SELECT unit, sum(s2) AS p FROM swide GROUP BY 1) c USING (unit)"""),
)
def mismatches(r: Roles):
    last = F.element_at("s", -1)
    return profile.total_mismatches(
        r.supply_cells.select("unit", last.alias("part")), r.supply_total.select("unit", last.alias("total")), ["unit"], "part", "total"
    )


@query(
    "j20_display_names",
    with_ctes("supps", body="SELECT unit, n_name AS group_name, s_name AS unit_name FROM supps LEFT JOIN nation ON n_nationkey = grp LEFT JOIN supplier ON s_suppkey = unit"),
)
def names(r: Roles):
    nations = r.table("nation").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("group_name"))
    own = r.table("supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("unit_name"))
    return r.suppliers.join(nations, "grp", "left").join(own, "unit", "left").select("unit", "group_name", "unit_name")

