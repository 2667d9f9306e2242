"""Panels, contract checks, readers and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from geopanel.operators import panel, profile, quality
from geopanel.sources import catalog, readers, sinks

CUTS = (2016.79, 2019.87, 2024.87)
ENTITY = "entity_id bigint, unit string, grp string, t double, cell string"


@pytest.fixture(scope="module")
def universe(spark):
    rows = [("0900200011991", "002", "urbano"), ("0901700012345", "017", "urbano"), ("090150001", "015", "rural")]
    return spark.createDataFrame(rows, "unit string, grp string, ambit string")


def test_territory_noise_is_dropped(spark, universe):
    keys = ["0900200011991", "090150001", "1500200011991", "0900100011991", "0901700099999", "0901700012345"]
    rows = [(i, k, k[2:5], CUTS[0], "a") for i, k in enumerate(keys)]
    got = panel.territory_filter(spark.createDataFrame(rows, ENTITY), universe)
    assert sorted(r["entity_id"] for r in got.collect()) == [0, 5]


def test_supply_counts_distinct_ids_and_keeps_zeros(spark, universe):
    a = "0900200011991"
    rows = [(1, a, "002", CUTS[0], "x"), (1, a, "002", CUTS[0], "x"), (2, a, "002", CUTS[0], "y"), (1, a, "002", CUTS[2], "x"), (9, a, "002", 2020.0, "x")]
    urban = universe.where("ambit = 'urbano'")
    wide = panel.supply_wide(spark.createDataFrame(rows, ENTITY), urban, CUTS)
    got = {(r["unit"], r["t"]): (r["s"], r["s_last"]) for r in panel.supply_long(wide, CUTS).collect()}
    assert len(got) == 6
    assert [got[a, t] for t in CUTS] == [(2, 1), (0, 1), (1, 1)]
    assert all(got["0901700012345", t] == (0, 0) for t in CUTS)
    cells = panel.supply_wide(spark.createDataFrame(rows, ENTITY), urban, CUTS, ("x", "y", "never"))
    assert cells.count() == 6 and quality.partition_gap(cells.withColumn("s", F.col("s")[0]), wide.withColumn("s", F.col("s")[0]), ["unit"]).count() == 0


def test_demand_panel_branches(spark):
    uni = spark.createDataFrame([("a", "g", "urbano"), ("b", "g", "urbano"), ("c", "g", "urbano"), ("d", "g", "urbano"), ("e", "g", "urbano"), ("r", "g", "rural")], "unit string, grp string, ambit string")
    bands = ", ".join(f"{b} int" for b in catalog.BANDS)
    census = spark.createDataFrame(
        [("p", 2010, 50, 1, 1, 1, 1), ("c", 2010, 9, 9, 9, 9, 9), ("a", 2020, 20, 5, 5, 5, 5), ("b", 2020, 30, 1, None, 1, 1), ("c", 2020, 19, 0, 0, 0, 0), ("e", 2020, 40, 1, 1, 1, 1)],
        f"unit string, year int, {bands}",
    )
    cross = spark.createDataFrame([("a", "p", "division"), ("b", "p", "division"), ("c", "c", "misma"), ("d", "d", "misma")], "unit string, unit_prev string, relation string")
    got = {(r["segment"], r["unit"]): r for r in panel.demand_panel(census, cross, uni, 2010, 2020).collect()}
    assert len(got) == 36
    assert got["primera_infancia", "a"]["d0"] == got["primera_infancia", "b"]["d0"] == 50.0  # never rescaled
    assert got["todas", "b"]["d1"] is None and got["todas", "b"]["reason"] == "suprimido_inegi"
    assert got["primera_infancia", "b"]["reason"] is None
    assert got["todas", "c"]["reason"] == "d2020_menor_20" and got["todas", "d"]["reason"] == "sin_censo"
    assert got["todas", "e"]["relation"] == "sin_contraparte" and got["todas", "e"]["d0"] is None
    assert got["todas", "r"]["reason"] == "rural" and got["todas", "r"]["relation"] is None


def test_gap_divides_after_summing(spark):
    gap = spark.createDataFrame([("a", "g", 1, 10.0), ("b", "g", 3, 30.0), ("c", "g", 5, None), ("d", "h", 2, 0.0)], "unit string, grp string, s_last bigint, d1 double")
    got = {r["grp"]: r["gap"] for r in panel.gap_by_group(gap).collect()}
    assert got["g"] == pytest.approx(9 / 40 * 1000) and got["h"] is None


# --- contract ----------------------------------------------------------------------------------

GOOD = {"unit": "0900200011991", "segment": "todas", "horizon": "h1", "n_obs": 2, "delta_pct": 1.0, "ci_lo": 0.0, "ci_hi": 2.0, "verdict": "sube", "confidence": "media"}
SCHEMA = "unit string, segment string, horizon string, n_obs int, delta_pct double, ci_lo double, ci_hi double, verdict string, confidence string"


@pytest.mark.parametrize(
    "change,rule",
    [
        ({}, None), ({"unit": "12345"}, "key_length"), ({"n_obs": None}, "n_obs_missing"), ({"verdict": "otro"}, "verdict_domain"), ({"verdict": None}, "verdict_domain"),
        ({"confidence": "total"}, "confidence_domain"), ({"ci_hi": None}, "interval_missing"), ({"ci_hi": 0.5}, "interval_misses_point"), ({"confidence": "alta"}, "supply_never_high"),
        ({"delta_pct": None, "ci_lo": None, "ci_hi": None, "verdict": "sin_datos", "confidence": "baja"}, None),
    ],
)
def test_each_broken_rule_is_one_violation(spark, change, rule):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    got = [r["rule"] for r in quality.record_violations(df, "segment", supply=True).collect()]
    assert got == ([rule] if rule else [])
    if rule:
        with pytest.raises(quality.ContractError):
            quality.require_none(quality.record_violations(df, "segment", supply=True), "contract")


def test_completeness_and_headers(spark):
    rows = [("a", s, h) for s in ("x", "y") for h in ("h1", "h3")] + [("b", "x", "h1"), ("b", "x", "h3"), ("c", "x", "h1"), ("c", "y", "h1")]
    df = spark.createDataFrame(rows, "unit string, segment string, horizon string")
    got = sorted(tuple(r) for r in quality.completeness_violations(df, "segment", ("x", "y"), ("h1", "h3")).collect())
    assert got == [("b", "y", "h1", "missing_pair"), ("b", "y", "h3", "missing_pair"), ("c", "x", "h3", "missing_pair"), ("c", "y", "h3", "missing_pair")]
    planted = spark.createDataFrame([*rows[:4], ("d", "x", "h1"), ("d", "x", "h3"), ("d", "y", "h1"), ("e", "x", "h1"), ("e", "x", "h3"), ("e", "y", "h1"), ("e", "y", "h3"), ("e", "z", "h1")], df.schema)
    universe = spark.createDataFrame([(u,) for u in "adef"], "unit string")
    got = sorted((r.unit, r.rule) for r in quality.completeness_violations(planted, "segment", ("x", "y"), ("h1", "h3"), universe).collect())
    assert got == [("d", "missing_pair"), ("e", "outside_catalogue"), ("f", "no_records")]
    heads = spark.createDataFrame([("1.4", ["h1", "h3", "h5"], list(quality.GROUP_CODES)), ("1.2", ["h3", "h1", "h5"], ["002"])], "version string, horizons array<string>, groups array<string>")
    assert sorted(r["rule"] for r in quality.header_violations(heads, group_level=True).collect()) == ["group_keys", "horizon_order", "version"]


def test_green_contract(spark):
    cells = {c: 1 for c in catalog.GREEN_CELLS}
    rows = [("a", [], cells, False), ("b", ["h1"], {"cobertura_verde": 1}, True)]
    df = spark.createDataFrame(rows, "unit string, horizons_available array<string>, cells map<string,int>, has_projection boolean")
    assert sorted(r["rule"] for r in quality.green_violations(df).collect()) == ["green_cells", "green_horizons", "green_projected"]


def test_documents_are_deterministic_with_sorted_keys_and_nulls(spark, tmp_path):
    rows = [("b", "002", "y", "h1", 2, None, 5.0, 1.0, 0.0, 2.0, "sube", "media"), ("b", "002", "x", "h1", 0, "rural", None, None, None, None, "sin_datos", "baja"), ("a", "003", "x", "h1", 0, None, None, None, None, None, "sin_datos", "baja")]
    schema = "unit string, grp string, cell string, horizon string, n_obs int, reason string, level_base double, delta_pct double, ci_lo double, ci_hi double, verdict string, confidence string"
    df = spark.createDataFrame(rows, schema).withColumn("rate_pct", F.col("delta_pct"))
    texts = []
    for n in (1, 3):
        docs = quality.document_rows(quality.nested(df.repartition(n), "cell", "celdas"), "celdas").withColumn("level", F.lit("ageb"))
        path = str(tmp_path / f"d{n}")
        sinks.documents(docs, path)
        texts.append(sorted(r["value"] for r in sinks.read_documents(spark, path).collect()))
    assert texts[0] == texts[1]
    b = json.loads(texts[0][1])["b"]
    assert list(b["celdas"]) == ["x", "y"] and b["celdas"]["x"]["h"]["h1"]["ic95"] is None and b["celdas"]["y"]["h"]["h1"]["ic95"] == [0.0, 2.0]


def test_upsert_keeps_other_blocks(spark, tmp_path):
    path = str(tmp_path / "diag")
    frame = lambda rows: spark.createDataFrame(rows, "block string, v int")
    sinks.upsert_blocks(frame([("a", 1), ("b", 2)]), path)
    sinks.upsert_blocks(frame([("b", 3), ("b", 4)]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("block", "v").collect()) == [("a", 1), ("b", 3), ("b", 4)]


# --- readers -----------------------------------------------------------------------------------


def entity_csv(folder, name, ids):
    head = list(readers.EDUCATION_COLUMNS)
    lines = [",".join(head)] + [f"{i},0900200011991,Principal,Público,611111,guarderia,x" for i in ids]
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder / name)


def test_editions_are_tagged_from_file_names(spark, tmp_path):
    paths = [entity_csv(tmp_path, "denue_infancias_cdmx_2016_10.csv", [1, 2]), entity_csv(tmp_path, "denue_infancias_cdmx_2020_11.csv", [1])]
    got = {(r["edition"], r["entity_id"]): r for r in readers.education_entities(spark, paths, check=True).collect()}
    assert len(got) == 3 and got["2016-10", 1]["t"] == 2016.79 and got["2020-11", 1]["t"] is None
    assert got["2016-10", 1]["grp"] == "002" and got["2016-10", 1]["code"] == 611111 and got["2016-10", 1]["sector"] == "Público"


def test_duplicate_ids_fail_instead_of_being_dropped(spark, tmp_path):
    path = entity_csv(tmp_path, "denue_infancias_cdmx_2016_10.csv", [7, 7])
    with pytest.raises(quality.ContractError):
        readers.education_entities(spark, path, check=True)


FEATURES = [
    {"type": "Feature", "properties": {"cvegeo": "A", "cve_mun": "002", "ambito": "urbano"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}},
    {"type": "Feature", "properties": {"cvegeo": "B", "cve_mun": "003", "ambito": "rural"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[9, 9], [10, 9], [10, 10], [9, 9]]], [[[5.5, 5], [6, 5], [6, 6], [5.5, 5]]]]}},
    {"type": "Feature", "properties": {"cvegeo": "C", "cve_mun": "003", "ambito": "urbano"}, "geometry": None},
    {"type": "Feature", "properties": {"cvegeo": "D", "cve_mun": "003", "ambito": "urbano"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}},
]


@pytest.mark.parametrize("lines", [True, False])
def test_geojson_in_both_layouts(spark, tmp_path, lines):
    from geopanel.functions import geometry as g

    path = tmp_path / "ageb.geojson"
    text = "\n".join(json.dumps(f) for f in FEATURES) if lines else json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1)
    path.write_text(text)
    rows = readers.geojson_polygons(spark, str(path), {"cvegeo": "string"}, lines=lines).select("cvegeo", "kind", g.area("geom").alias("a")).collect()
    assert sorted(map(tuple, rows)) == [("A", "Polygon", 15.0), ("B", "MultiPolygon", 0.75)]
    uni = readers.unit_universe(spark, str(path), lines=lines).collect()
    assert sorted(tuple(r) for r in uni)[0] == ("A", "002", "urbano") and len(uni) == 4


def test_profile_counts_blanks_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (None, None), (2, "")], "n int, s string")
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (got["n"]["nulls"], got["n"]["distincts"], got["n"]["min"], got["n"]["max"], got["n"]["blanks"]) == (1, 2, "1", "2", None)
    assert (got["s"]["nulls"], got["s"]["blanks"], got["s"]["distincts"]) == (1, 2, 3)
