"""D, U, F and the profiling part of T and W: profiles, drift, unions and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geopanel.functions import rules, scalars
from geopanel.operators import profile
from geopanel.plans.registry import query, r6, with_ctes
from geopanel.plans.roles import Roles

_MC = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _profile_sql(table: str, cols: dict[str, tuple[str, bool]], by: str = "") -> str:
    rows = []
    for c, (kind, ordered) in cols.items():
        blanks = "CAST(NULL AS BIGINT)" if ordered else f"count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '')"
        rows.append(f"SELECT {by + ', ' if by else ''}'{c}' AS \"column\", '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, {blanks} AS blanks, count(DISTINCT {c}) AS distincts, {f'CAST(min({c}) AS VARCHAR)' if ordered else 'NULL'} AS min, {f'CAST(max({c}) AS VARCHAR)' if ordered else 'NULL'} AS max FROM {table} {'GROUP BY ' + by if by else ''}")
    return " UNION ALL ".join(rows)


_CUST = {"c_custkey": ("bigint", True), "c_name": ("string", False), "c_nationkey": ("int", True), "c_acctbal": ("double", True), "c_mktsegment": ("string", False)}


@query("d01_column_profile", _profile_sql("customer", _CUST))
def column_profile(r: Roles):
    return profile.column_profile(r.table("customer"))


_SUPP = {"s_suppkey": ("bigint", True), "s_name": ("string", False), "s_nationkey": ("int", True), "s_acctbal": ("double", True)}


@query("d01b_column_ranges", f"SELECT \"column\", min, max FROM ({_profile_sql('supplier', _SUPP)})")
def column_ranges(r: Roles):
    return profile.column_profile(r.table("supplier")).select("column", "min", "max")


@query("d02_grouped_column_table", f"""SELECT CASE WHEN "column" IN ('c_nationkey', 'c_custkey') THEN 'agrupadas' ELSE "column" END AS line, count(*) AS n_columns, {r6('min(nulls * 100e0 / rows)')} AS null_pct_min,
    {r6('max(nulls * 100e0 / rows)')} AS null_pct_max, CAST(sum(distincts) AS BIGINT) AS distincts FROM ({_profile_sql('customer', _CUST)}) GROUP BY 1""")
def grouped(r: Roles):
    return profile.grouped_profile(profile.column_profile(r.table("customer")), ("c_nationkey", "c_custkey"))


_FAM = "SELECT year(l_shipdate) AS edition, l_partkey, CASE WHEN year(l_shipdate) < 1998 AND l_quantity < 10 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_tax > 0.06e0 THEN '' ELSE l_returnflag END AS flag FROM lineitem"


@query(
    "d03_family_drift",
    f"""WITH f AS ({_FAM}), p AS (SELECT edition, count(*) AS n, count(DISTINCT l_partkey) AS n_keys, 0e0 AS k, (count(*) - count(qty)) * 100e0 / count(*) AS q, count(*) FILTER (WHERE flag = '') * 100e0 / count(*) AS g FROM f GROUP BY 1),
    ref AS (SELECT max_by(q, edition) AS q, max_by(g, edition) AS g FROM p)
    SELECT p.edition, n, n_keys, {r6('(n - lag(n) OVER (ORDER BY p.edition)) * 100e0 / lag(n) OVER (ORDER BY p.edition)')} AS change_pct,
    concat_ws(',', CASE WHEN abs(p.g - ref.g) >= 2 THEN 'flag' END, CASE WHEN abs(p.q - ref.q) >= 2 THEN 'qty' END) AS drifting FROM p CROSS JOIN ref""",
)
def family(r: Roles):
    rows = r.table("lineitem").selectExpr(
        "year(l_shipdate) AS edition", "l_partkey", "if(year(l_shipdate) < 1998 AND l_quantity < 10, NULL, l_quantity) AS qty", "if(l_tax > 0.06D, '', l_returnflag) AS flag"
    )
    return profile.family_profile(rows, "edition", "l_partkey", ("qty", "flag"))


@query("d04_census_summary", with_ctes("census", "supps", body="""SELECT yr AS year, count(*) AS n, count(DISTINCT grp) AS n_groups, CAST(sum(p_0a2) AS BIGINT) AS total,
    count(*) FILTER (WHERE p_0a2 + p_3a5 + p_6a11 + p_12a14 IS NULL) AS n_suppressed FROM census JOIN supps USING (unit) GROUP BY 1"""))
def census(r: Roles):
    rows = r.census.join(r.suppliers.select("unit", "grp"), "unit")
    return rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("n_groups"), F.sum("p_0a2").alias("total"),
        F.expr("count_if(p_0a2 + p_3a5 + p_6a11 + p_12a14 IS NULL)").alias("n_suppressed"),
    )


@query("d05_concentration", f"""SELECT cut, count(*) AS n_units, max(c) AS max, {r6('avg(CASE WHEN c <= 2 THEN 1e0 ELSE 0e0 END)')} AS share_small, {r6('quantile_cont(c, 0.25)')} AS q25, {r6('quantile_cont(c, 0.5)')} AS median,
    {r6('quantile_cont(c, 0.95)')} AS p95 FROM (SELECT year(l_shipdate) AS cut, l_partkey, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def concentration(r: Roles):
    return profile.concentration(r.entities(), ["cut"])


@query("d06_drop_between_cuts", f"SELECT l_returnflag AS level, a AS n_first, b AS n_last, {r6('(b - a) * 100e0 / nullif(a, 0)')} AS change_pct FROM (SELECT l_returnflag, count(*) FILTER (WHERE year(l_shipdate) = 1996) AS a, count(*) FILTER (WHERE year(l_shipdate) = 2000) AS b FROM lineitem GROUP BY 1)")
def drops(r: Roles):
    return profile.drop_between(r.entities(), "level", "cut", 1996, 2000)


@query("w07_edition_change", f"SELECT cut, n, {r6('(n - lag(n) OVER (ORDER BY cut)) * 100e0 / lag(n) OVER (ORDER BY cut)')} AS change_pct FROM (SELECT year(l_shipdate) AS cut, count(*) AS n FROM lineitem GROUP BY 1)")
def row_change(r: Roles):
    return profile.row_change(r.entities().groupBy("cut").agg(F.count(F.lit(1)).alias("n")), "cut")


@query(
    "w08_entity_churn",
    """WITH s AS (SELECT DISTINCT l_orderkey AS id, year(l_shipdate) AS cut FROM lineitem WHERE year(l_shipdate) IN (1996, 1998, 2000)),
    c AS (SELECT * FROM (VALUES (1996, NULL), (1998, 1996), (2000, 1998)) v(cut, prev)),
    x AS (SELECT c.cut, c.prev, i.id, cur.id IS NOT NULL AS here, pre.id IS NOT NULL AS was, EXISTS (SELECT 1 FROM s b WHERE b.id = i.id AND b.cut < c.cut) AS ever
          FROM c CROSS JOIN (SELECT DISTINCT id FROM s) i LEFT JOIN s cur ON cur.id = i.id AND cur.cut = c.cut LEFT JOIN s pre ON pre.id = i.id AND pre.cut = c.prev)
    SELECT cut, count(*) FILTER (WHERE here) AS n, count(*) FILTER (WHERE here AND was) AS stayed, count(*) FILTER (WHERE here AND NOT ever) AS new,
    count(*) FILTER (WHERE was AND NOT here) AS gone, count(*) FILTER (WHERE here AND NOT was AND ever) AS back FROM x GROUP BY 1""",
)
def churn(r: Roles):
    return profile.churn(r.entities(), (1996, 1998, 2000), ident="entity_id")


@query("t06_top_values", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 4")
def top_values(r: Roles):
    return profile.top_values(r.table("part"), "p_type", 4)


_TEXT_COLUMNS = {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_linenumber": "l_linenumber", "l_quantity": "CAST(l_quantity AS INTEGER)", "l_suppkey": "l_suppkey", "l_partkey": "l_partkey"}
_TOP = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM (
    SELECT CAST({e} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1) WHERE n * 1000 > (SELECT count(*) FROM lineitem)) WHERE rank <= 4"""
    for c, e in _TEXT_COLUMNS.items()
)


@query("t06b_frequent_values", _TOP)
def frequent(r: Roles):
    """Frequent values of several columns at once, few or many distinct values."""
    return profile.frequent_values(r.table("lineitem").withColumn("l_quantity", F.col("l_quantity").cast("int")), tuple(_TEXT_COLUMNS))


@query("t07_sample_rows", "SELECT n_nationkey, 'n_nationkey=' || n_nationkey || '; n_name=' || n_name || '; n_regionkey=' || n_regionkey AS sample FROM nation ORDER BY n_nationkey LIMIT 2")
def samples(r: Roles):
    return profile.samples(r.table("nation"), 2, ["n_nationkey"])


# --- U -----------------------------------------------------------------------------------------


@query("u01_union_of_editions", "SELECT year(l_shipdate) AS cut, count(*) AS n, count(DISTINCT l_orderkey) AS n_ids FROM lineitem WHERE year(l_shipdate) IN (1996, 1998, 2000) GROUP BY 1")
def editions(r: Roles):
    parts = [r.entities().where(f"cut = {y}") for y in (1996, 1998, 2000)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("n_ids"))


@query("u02_union_by_name", with_ctes("census", body="SELECT unit, yr AS year, p_0a2, CASE WHEN yr = 2000 THEN p_15a17 END AS p_15a17 FROM census"))
def by_name(r: Roles):
    from geopanel.sources.readers import census_panel

    a = r.census.where("year = 1995").select("unit", "year", "p_0a2")
    b = r.census.where("year = 2000").select("p_15a17", "p_0a2", "year", "unit")
    return census_panel(a, b)


@query("u03_tagged_union", with_ctes("supps", body="SELECT unit, ambit AS tag FROM supps"))
def tagged(r: Roles):
    s = r.suppliers
    return s.where("ambit = 'urbano'").select("unit", F.lit("urbano").alias("tag")).union(s.where("ambit = 'rural'").select("unit", F.lit("rural").alias("tag")))


@query("u05_schema_difference", """SELECT * FROM (VALUES ('l_linenumber', 'faltan'), ('note', 'añadidas'), ('l_quantity', 'double→string')) v("column", change)
    WHERE (SELECT count(l_linenumber) FROM lineitem WHERE year(l_shipdate) = 1996) > 0""")
def schema_difference(r: Roles):
    """Columns with any value in one edition against another edition that lost, gained and retyped one."""
    filled = lambda df: profile.column_profile(df).where("nulls < rows").select("column", "type")
    a = r.table("lineitem").where("year(l_shipdate) = 1996").select("l_partkey", "l_linenumber", "l_quantity")
    b = r.table("lineitem").where("year(l_shipdate) = 2000").selectExpr(
        "l_partkey", "int(NULL) AS l_linenumber", "string(l_quantity) AS l_quantity", "'x' AS note"
    )
    return profile.schema_difference(filled(a), filled(b))


# --- F -----------------------------------------------------------------------------------------


@query("f01_token_to_null", "SELECT event_id, TRY_CAST(nullif(nullif(v, '*'), 'N/D') AS INTEGER) AS n FROM (SELECT event_id, CASE event_type WHEN 'view' THEN '*' WHEN 'click' THEN 'N/D' WHEN 'error' THEN 'x1' ELSE CAST(user_id AS VARCHAR) END AS v FROM events)")
def tokens(r: Roles):
    v = F.expr("CASE event_type WHEN 'view' THEN '*' WHEN 'click' THEN 'N/D' WHEN 'error' THEN 'x1' ELSE string(user_id) END")
    return r.table("events").select("event_id", scalars.token_int(v).alias("n"))


@query("f02_key_strings", "SELECT p_partkey, '09' || lpad(CAST(p_size AS VARCHAR), 3, '0') || p_type AS key, lpad(CAST(p_size AS VARCHAR), 3, '0') AS grp, lpad(substr(CAST(9000 + p_size AS VARCHAR), 2), 3, '0') AS padded FROM part")
def keys(r: Roles):
    size = F.lpad(F.col("p_size").cast("string"), 3, "0")
    key = scalars.unit_key("09", size, "p_type")
    return r.table("part").select("p_partkey", key.alias("key"), scalars.group_of_key(key).alias("grp"), scalars.padded_group((F.col("p_size") + 9000).cast("string")).alias("padded"))


@query("f03_age_labels", "SELECT p_partkey, CASE WHEN p_size < 10 THEN '0' || p_size || '_' || '0' || p_size ELSE p_size || '_' || (p_size + 5) END AS age FROM part")
def ages(r: Roles):
    band = F.expr("if(p_size < 10, concat('POB_0', p_size, '_0', p_size), concat('POB_0', p_size, '_0', p_size + 5))")
    return r.table("part").select("p_partkey", scalars.age_label(band).alias("age"))


@query("f04_edition_from_name", "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m') AS edition FROM lineitem")
def edition(r: Roles):
    path = F.concat(F.lit("denue_"), F.date_format("l_shipdate", "yyyy_MM"), F.lit(".csv"))
    return r.table("lineitem").select("l_orderkey", "l_linenumber", scalars.edition_label(path).alias("edition"))


@query("f05_decimal_year", f"SELECT o_orderkey, {r6('year(o_orderdate) + (month(o_orderdate) - 0.5e0) / 12')} AS t FROM orders")
def decimal_year(r: Roles):
    return r.table("orders").select("o_orderkey", scalars.decimal_year(F.date_format("o_orderdate", "yyyy-MM")).alias("t"))


@query("f06_horizon_years", "SELECT o_orderkey, greatest(1, CAST(floor(((2003 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) / 12e0 + 0.5e0) AS BIGINT)) AS years FROM orders")
def horizon_years(r: Roles):
    issued = F.date_format("o_orderdate", "yyyy-MM")
    return r.table("orders").select("o_orderkey", scalars.horizon_years(F.lit(None).cast("int"), F.lit("2003-06"), issued).alias("years"))


@query("f07_clip", f"SELECT c_custkey, {r6('CASE WHEN c_custkey % 9 <> 0 THEN greatest(0, least(5000, c_acctbal)) END')} AS v FROM customer")
def clipped(r: Roles):
    x = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    return r.table("customer").select("c_custkey", scalars.clip(x, 0, 5000).alias("v"))


@query("f08_log_ratio", with_ctes("pwide", body=f"SELECT unit, {r6('ln((s2 + 0.5e0) / (s0 + 0.5e0)) / 4')} AS rate, {r6('exp(ln((s2 + 0.5e0) / (s0 + 0.5e0)) / 4 * 3)')} AS factor FROM pwide"))
def log_ratio(r: Roles):
    rate = scalars.log_rate(F.col("s")[0], F.col("s")[2], 4.0)
    return r.part_supply.select("unit", rate.alias("rate"), F.exp(rate * 3).alias("factor"))


@query("f09_half_even_rounding", f"SELECT l_orderkey, l_linenumber, {r6('round_even(l_quantity / 4, 1)')} AS r1, {r6('round_even(l_quantity / 8, 2)')} AS r2 FROM lineitem")
def half_even(r: Roles):
    return r.table("lineitem").select("l_orderkey", "l_linenumber", scalars.half_even(F.col("l_quantity") / 4, 1).alias("r1"), scalars.half_even(F.col("l_quantity") / 8, 2).alias("r2"))


@query("f14_confidence_score", with_ctes("pub", body=f"SELECT branch, cell, unit, horizon, {r6('CASE confidence WHEN ' + chr(39) + 'alta' + chr(39) + ' THEN 1 WHEN ' + chr(39) + 'media' + chr(39) + ' THEN 0.5 ELSE 0 END')} AS score FROM pub"))
def score(r: Roles):
    return r.published.select("branch", "cell", "unit", "horizon", rules.confidence_score("confidence").alias("score"))


@query("f15_names_per_key", "SELECT p_brand AS k, count(DISTINCT p_name) AS n_names, min(p_name) AS first_name FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def names(r: Roles):
    return profile.names_per_key(r.table("part").select(F.col("p_brand").alias("k"), "p_name"), "k", "p_name")


@query("f16_json_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"t\":\"' || event_type || '\",\"x\":null}' AS doc FROM events")
def json_records(r: Roles):
    parsed = r.table("events").withColumn("p", F.from_json("props", "k bigint"))
    doc = F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"), F.lit(None).cast("string").alias("x")), {"ignoreNullFields": "false"})
    return parsed.select("event_id", F.col("p.k").alias("k"), doc.alias("doc"))


@query("b06_dead_band_class", with_ctes("pwide", body="SELECT unit, CASE WHEN r > 0.01e0 THEN 'sube' WHEN r < -0.01e0 THEN 'baja' ELSE 'se_mantiene' END AS class FROM (SELECT unit, ln((s2 + 0.5e0) / (s0 + 0.5e0)) / 4 AS r FROM pwide)"))
def dead_band(r: Roles):
    return r.part_supply.select("unit", rules.dead_band_class(scalars.log_rate(F.col("s")[0], F.col("s")[2], 4.0)).alias("class"))
