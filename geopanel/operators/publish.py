"""From simulations to published tables: unit, group and root records of one run.

Levels add, rates never do. Group records come from the groups' own replicates (unit levels added up within each replicate),
root records from the groups' replicates, so intervals, verdicts and confidence of every level follow from its own
distribution. Values are rounded once, when they are published.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.functions.scalars import array_of, half_even
from geopanel.operators import replicate
from geopanel.operators.calendar import Calendar
from geopanel.operators.simulation import Simulation
from geopanel.session import materialised

VALUES = ("delta_pct", "rate_pct", "ci_lo", "ci_hi")


def records(sim: DataFrame | Simulation, member: str, cal: Calendar, horizons: Sequence[str], since: float) -> DataFrame:
    """``cell, unit, grp, horizon, n_obs, level_base, delta_pct, rate_pct, ci_lo, ci_hi, verdict, confidence`` of every simulated
    row, published rounding. ``level_base`` is the level at the base date, carried from ``since`` at the median rate."""
    rows = replicate.summarise(sim, [member], cal, horizons)
    level = F.bround(F.col("base") * F.exp(F.col("rate_pct") / 100.0 * (cal.t_base - since)), 1)
    return rows.select(F.col(member).alias("cell"), "unit", "grp", "horizon", "n_obs", level.alias("level_base"), *[half_even(v, 1).alias(v) for v in VALUES], "verdict", "confidence")


def with_missing(frame: DataFrame, found: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Every row of ``frame`` (``cell, unit, grp, reason``) at every horizon: its record, or one without data."""
    grid = frame.withColumn("horizon", F.explode(array_of(list(horizons), "string")))
    rows = grid.join(found.drop("grp"), ["cell", "unit", "horizon"], "left")
    return rows.select(
        "cell", "unit", "grp", "horizon", F.coalesce("n_obs", F.lit(0)).alias("n_obs"), "reason", "level_base", *VALUES,
        F.coalesce("verdict", F.lit("sin_datos")).alias("verdict"), F.coalesce("confidence", F.lit("baja")).alias("confidence"),
    )


def upper_levels(sim: DataFrame | Simulation, member: str, span: float, demand: bool, root: str = "root") -> dict[str, DataFrame]:
    """Simulations of the groups and of the root; the root is added up from the groups, not from the units again."""
    groups = materialised(replicate.roll_up(sim, [member], span, demand))
    return {"group": groups, "root": replicate.roll_up(groups, [member], span, demand, root=root)}


def flatten(member_rows: DataFrame, branch) -> DataFrame:
    """Records under their branch, in the order of the published table."""
    first = ["branch", "cell", "unit", "grp", "horizon", "n_obs"]
    rows = member_rows.withColumn("branch", branch)
    return rows.select(*first, *[c for c in rows.columns if c not in first])
