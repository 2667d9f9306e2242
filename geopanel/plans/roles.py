"""Role-named inputs derived from the test star schema.

part / supplier stand for small areas, brand / nation for their groups, order lines for dated
entities (and, counted by quantity band, for people).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.functions import geometry as g
from geopanel.operators import estimate, panel, publish, replicate
from geopanel.operators.calendar import Calendar
from geopanel.operators.simulation import Simulation
from geopanel.session import scratch_path
from geopanel.sources.catalog import BANDS, SEGMENTS

CAL = Calendar(t0=1995.5, t1=2000.5, t_base=2001.5, cuts=(1996.5, 1998.5, 2000.5), control_from=2000.5)
CUT_YEARS = (1996, 1998, 2000)
CELLS = tuple(f"{a}__{b}" for a in "ANR" for b in "FO")
H5, H3 = ("h1", "h3", "h5"), ("h1", "h3")
BRANCH_OF = "CASE left(cell, 1) WHEN 'A' THEN 'educacion' WHEN 'N' THEN 'salud' ELSE 'comercio' END"
#: Where the tables of a run were written, by application, data folder and kind.
_WRITTEN: dict[tuple[str, str, str], str] = {}
SUPPRESS_BELOW = 8
CELL_SIZE = 10.0
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    # universes

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey AS unit", "p_brand AS grp", "if(p_size < 4, 'rural', 'urbano') AS ambit")

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey AS unit", "s_nationkey AS grp", "if(s_acctbal < 300, 'rural', 'urbano') AS ambit")

    def urban(self, units: DataFrame) -> DataFrame:
        return units.where(F.col("ambit") == "urbano")

    @cached_property
    def keyed_parts(self) -> DataFrame:
        """Parts under string keys: state + group + number, shorter for rural ones."""
        group = F.lpad((F.substring("p_brand", 7, 3).cast("int") + 1).cast("string"), 3, "0")
        rural = F.col("p_size") < 4
        tail = F.when(rural, F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")).otherwise(
            F.lpad(F.col("p_partkey").cast("string"), 8, "0")
        )
        state = F.when(F.col("p_partkey") % 97 == 5, "15").otherwise("09")
        return self.table("part").select(
            "p_partkey",
            F.concat(state, group, tail).alias("unit"),
            group.alias("grp"),
            F.when(rural, "rural").otherwise("urbano").alias("ambit"),
        )

    # entities

    def entities(self, unit: str = "l_partkey") -> DataFrame:
        cuts = ", ".join(map(str, CUT_YEARS))
        return self.table("lineitem").selectExpr(
            "l_orderkey AS entity_id", f"{unit} AS unit", "year(l_shipdate) AS cut",
            f"if(year(l_shipdate) IN ({cuts}), double(year(l_shipdate)) + 0.5D, NULL) AS t",
            "l_returnflag AS level", "l_linestatus AS sector", "concat_ws('__', l_returnflag, l_linestatus) AS cell",
            "if(l_linenumber <= 5, 'Principal', 'Complementario') AS scope", "l_quantity",
        )

    @cached_property
    def supply_cells(self) -> DataFrame:
        """Suppliers × six cells, zeros explicit."""
        return panel.supply_wide(self.entities("l_suppkey"), self.urban(self.suppliers), CAL.cuts, CELLS)

    @cached_property
    def supply_total(self) -> DataFrame:
        return panel.supply_wide(self.entities("l_suppkey"), self.urban(self.suppliers), CAL.cuts)

    @cached_property
    def part_supply(self) -> DataFrame:
        return panel.supply_wide(self.entities("l_partkey"), self.urban(self.parts), CAL.cuts)

    # demand

    @cached_property
    def census(self) -> DataFrame:
        n = lambda i: f"count_if(l_quantity > {10 * i} AND l_quantity <= {10 * i + 10})"
        counts = [F.expr(f"if({n(i)} >= {SUPPRESS_BELOW}, {n(i)}, NULL)").alias(b) for i, b in enumerate(BANDS)]
        rows = self.entities("l_suppkey").where("cut IN (1995, 2000)")
        return rows.groupBy("unit", F.col("cut").alias("year")).agg(*counts)

    @cached_property
    def crosswalk(self) -> DataFrame:
        return self.suppliers.where("unit % 10 <> 7").selectExpr(
            "unit",
            "if(unit % 10 = 1, unit - 1, unit) AS unit_prev",
            "CASE unit % 10 WHEN 1 THEN 'division' WHEN 4 THEN 'cambio_limites' ELSE 'misma' END AS relation",
        )

    def demand(self, segments: dict = SEGMENTS) -> DataFrame:
        return panel.demand_panel(self.census, self.crosswalk, self.suppliers, 1995, 2000, segments)

    @cached_property
    def demand_all(self) -> DataFrame:
        return self.demand({"todas": SEGMENTS["todas"]})

    @cached_property
    def part_demand(self) -> DataFrame:
        """People per part at the later date, no suppression."""
        later = self.entities("l_partkey").where(F.col("cut") == 2000).groupBy("unit").agg(F.count(F.lit(1)).alias("d1"))
        return self.parts.join(later, "unit", "left")

    @cached_property
    def control(self) -> DataFrame:
        """Nation × year."""
        rows = self.entities("l_suppkey").join(self.suppliers.select("unit", "grp"), "unit")
        return rows.groupBy("grp", F.col("cut").alias("year")).agg(F.sum("l_quantity").alias("population"))

    # the run: simulations and published tables

    @cached_property
    def _inputs(self) -> DataFrame:
        return replicate.demand_inputs(self.demand(), self.control, CAL, ["segment"])

    @cached_property
    def _posterior(self) -> DataFrame:
        return estimate.supply_posterior(estimate.fit_supply(self.supply_cells, CAL), ["cell"], CAL)

    @cached_property
    def demand_sim(self) -> DataFrame:
        return replicate.simulate_demand(self._inputs, CAL, ["segment"], source="r2", group_id=F.col("grp"))

    @cached_property
    def supply_sim(self) -> DataFrame:
        return replicate.simulate_supply(self._posterior, ["cell"], source="r2")

    @cached_property
    def demand_run(self) -> Simulation:
        return replicate.demand_simulation(self._inputs, CAL, ["segment"], source="r2", group_id=F.col("grp"))

    @cached_property
    def supply_run(self) -> Simulation:
        return replicate.supply_simulation(self._posterior, ["cell"], source="r2")

    def _written(self, kind: str, rows) -> DataFrame:
        """A table of the run, written once for each application and data folder, by branch and horizon, so that a query reads only those it names."""
        key = self.spark.sparkContext.applicationId, self.dir, kind
        if key not in _WRITTEN:
            path = scratch_path(self.spark, kind)
            rows().write.partitionBy("branch", "horizon").parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    @cached_property
    def summary(self) -> DataFrame:
        """Published records of the units: demand segments, six supply cells in three branches, green cells."""
        return self._written("run-units", self._units)

    @property
    def published(self) -> DataFrame:
        return self.summary

    @cached_property
    def group_summary(self) -> DataFrame:
        """Published records of the groups, from their own replicates."""
        return self._written("run-groups", lambda: self._upper("group"))

    @cached_property
    def root_summary(self) -> DataFrame:
        return self._written("run-root", lambda: self._upper("root"))

    def _units(self) -> DataFrame:
        demand = publish.records(self.demand_run, "segment", CAL, H5, CAL.t1)
        demand = publish.with_missing(self.demand().select(F.col("segment").alias("cell"), "unit", "grp", "reason"), demand, H5)
        total = "s[0] + s[1] + s[2]"
        frame = self.supply_cells.selectExpr("cell", "unit", "grp", f"if({total} = 0, 'sin_establecimientos', NULL) AS reason")
        # A simulation holds fitted units only, that is those with an establishment in some cut.
        supply = publish.with_missing(frame, publish.records(self.supply_run, "cell", CAL, H3, CAL.cuts[-1]), H3)
        green = panel.green_cells(self.green).where("ambit = 'urbano'").selectExpr(
            "'verde' AS branch", "cell", "unit", "grp", "'actual' AS horizon", "1 AS n_obs", "string(NULL) AS reason", "double(level_base) AS level_base",
            *[f"double(NULL) AS {c}" for c in publish.VALUES], "string(NULL) AS verdict", "'baja' AS confidence",
        )
        rows = publish.flatten(demand, F.lit("demanda")).unionByName(publish.flatten(supply, F.expr(BRANCH_OF)))
        return rows.unionByName(green)

    def _upper(self, level: str) -> DataFrame:
        demand = publish.upper_levels(self.demand_run, "segment", CAL.demand_span, True)[level]
        supply = publish.upper_levels(self.supply_run, "cell", CAL.supply_span, False)[level]
        rows = publish.flatten(publish.records(demand, "segment", CAL, H5, CAL.t1), F.lit("demanda"))
        return rows.unionByName(publish.flatten(publish.records(supply, "cell", CAL, H3, CAL.cuts[-1]), F.expr(BRANCH_OF)))

    @cached_property
    def green_points(self) -> DataFrame:
        """Lines of the last cut as green points with an area."""
        tax = F.col("l_tax")
        layer = F.when(tax < 0.03, "cobertura_verde").when(tax < 0.06, "areas_recreativas").otherwise("espacios_publicos")
        return (
            self.table("lineitem")
            .where(F.year("l_shipdate") == 2000)
            .select(layer.alias("layer"), F.col("l_suppkey").alias("unit"), F.col("l_quantity").alias("area"))
        )

    @cached_property
    def green(self) -> DataFrame:
        return panel.green_layer(self.green_points, self.suppliers)

    # geometry: suppliers as 10 × 10 squares on a grid 20 wide, customers as points

    def squares(self, units: DataFrame, shift: float = 0.0, key: str = "unit") -> DataFrame:
        x = (F.col(key) % 20) * 10.0 + shift
        y = F.floor(F.col(key) / 20) * 10.0 + shift
        return units.withColumns({"x1": x.cast("double"), "y1": y.cast("double"), "x2": x + 10.0, "y2": y + 10.0}).withColumn(
            "geom", g.rectangle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        )

    @cached_property
    def customers(self) -> DataFrame:
        """Points whose x and y are arithmetic on the key; some lie outside every square."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("point"),
            ((k * 37) % 2100 / 10.0 + 0.05).alias("x"),
            ((k * 11) % 600 / 10.0 + 0.05).alias("y"),
            F.col("c_acctbal").alias("value"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_mktsegment").alias("segment"),
        )

    # dashboard

    @cached_property
    def zone_points(self) -> DataFrame:
        """Nation × priority × year order counts, full years only."""
        o = self.table("orders").join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        year = F.year("o_orderdate")
        return (
            o.where(year.between(1995, 2000))
            .groupBy(F.col("c_nationkey").alias("zone"), F.col("o_orderpriority").alias("category"), year.alias("x"))
            .agg(F.count(F.lit(1)).alias("y"))
        )

    @cached_property
    def zone_population(self) -> DataFrame:
        return self.table("customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.count(F.lit(1)).alias("population"))
