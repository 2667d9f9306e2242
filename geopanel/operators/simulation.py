"""Simulations that are never written out.

A replicate rate follows from a few numbers of its unit, its group's shift and a keyed draw. Where only a summary or a sum is
wanted, tasks make the rates of a few rows at a time, reduce them and forget them, so what moves between tasks are parameters and
results: per row some hundred bytes instead of ``n_sim`` numbers for each persistence.

Rows are dealt into slices of their group, all rows of a unit into one. A slice is the unit of work: it meets the shifts of its group once,
and gives one row of sums for each of its keys.

Columns of ``units``: keys, ``unit, grp, n_obs, base, conf_base, cap``, the centre and spread of the draw ``mid, sd``, its seeds ``seed1, seed2``,
for demand ``rho, rho_future``, and ``slice, slices``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopanel.functions import draws
from geopanel.operators.meet import with_groups
from geopanel.session import materialised

MAX_RATE = 20.0  # fixed value: numeric guard before exp()
#: Rows in a slice, as far as the rows of a unit allow.
SLICE = 2048
#: Rows whose replicates are held at once.
BLOCK = 32
QUANTILES = (0.5, 0.025, 0.975)
CARRIED = ("unit", "grp", "n_obs", "base", "conf_base", "cap")


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _unit_blocks(table: pa.Table, n: int, source: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows block by block with their draws; a draw is made once for all rows of a unit in a block."""
    first, second = _numbers(table, "seed1"), _numbers(table, "seed2")
    order = np.lexsort((second, first))
    for at in range(0, order.size, BLOCK):
        rows = order[at : at + BLOCK]
        a, b = first[rows], second[rows]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        yield rows, draws.normals(a[fresh], b[fresh], n, source)[np.cumsum(fresh) - 1]


@dataclass(frozen=True)
class Rates:
    """What tasks know of a simulation."""

    keys: tuple[str, ...]
    n_sim: int
    source: str
    #: Persistences of demand: the drawn ones and the fixed ones, each of one number or one a replicate.
    shares: tuple = ()

    @property
    def width(self) -> int:
        return max(len(self.shares), 1)

    def _members(self, table: pa.Table) -> tuple[list[tuple], np.ndarray]:
        rows = list(zip(*[table.column(k).to_pylist() for k in self.keys])) if self.keys else [()] * table.num_rows
        names = list(dict.fromkeys(rows))
        place = {name: i for i, name in enumerate(names)}
        return names, np.array([place[r] for r in rows], dtype=int)

    def pulls(self, table: pa.Table) -> Iterator[tuple[np.ndarray, Iterator[np.ndarray]]]:
        """Rows with their rates before any shift, one array for each persistence."""
        mid, sd = (_numbers(table, c)[:, None] for c in ("mid", "sd"))
        rho, future = (_numbers(table, c)[:, None] for c in ("rho", "rho_future")) if self.shares else (None, None)
        for rows, z in _unit_blocks(table, self.n_sim, self.source):
            z *= sd[rows]
            z += mid[rows]
            if not self.shares:
                yield rows, iter([z])
                continue
            z -= rho[rows]
            yield rows, (future[rows] + share * z for share in self.shares)

    def rates(self, table: pa.Table, shifts: pa.Table | None) -> Iterator[tuple[np.ndarray, Iterator[np.ndarray]]]:
        """Rows with their final rates, one array for each persistence."""
        names, member = self._members(table)
        added = None
        if shifts is not None:
            added = np.full((self.width, len(names), self.n_sim), np.nan)
            place = {name: i for i, name in enumerate(names)}
            for j, name in enumerate(self._members(shifts)[0]):
                for i in range(len(self.shares)):
                    values = shifts.column(f"_k{i}")[j].values
                    if name in place and values is not None and len(values) == self.n_sim:
                        added[i, place[name]] = values.to_numpy(zero_copy_only=False)

        def bounded(i: int, rows: np.ndarray, r: np.ndarray) -> np.ndarray:
            if added is not None:
                r += added[i, member[rows]]
            return np.fmin(np.fmax(r, -MAX_RATE, out=r), MAX_RATE, out=r)  # as in SQL, a missing rate ends at the bound

        for rows, pulls in self.pulls(table):
            yield rows, (bounded(i, rows, r) for i, r in enumerate(pulls))

    def reduce(self, table: pa.Table, shifts: pa.Table | None, delta: float) -> pa.Table:
        n = self.n_sim
        places = [int(np.floor((n - 1) * q)) for q in QUANTILES]
        above = [min(p + 1, n - 1) for p in places]
        out = {c: np.full(table.num_rows, np.nan) for c in ("p_up", "p_down", "p_flat")}
        low, high = (np.full((table.num_rows, len(QUANTILES)), np.nan) for _ in range(2))
        fixed = max(len(self.shares) - 1, 0)
        up, down = (np.full((table.num_rows, fixed), np.nan) for _ in range(2))
        for rows, rates in self.rates(table, shifts):
            for i, r in enumerate(rates):
                more, less = np.count_nonzero(r > delta, axis=1) / n, np.count_nonzero(r < -delta, axis=1) / n
                if i:
                    up[rows, i - 1], down[rows, i - 1] = more, less
                    continue
                out["p_up"][rows], out["p_down"][rows] = more, less
                out["p_flat"][rows] = np.count_nonzero(np.abs(r) <= delta, axis=1) / n
                r.sort(axis=1)
                low[rows], high[rows] = r[:, places], r[:, above]
        lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) if m.shape[1] else pa.array([[]] * len(m), pa.list_(pa.float64()))
        kept = table.select([*self.keys, *CARRIED])
        for name, values in [*((c, pa.array(v)) for c, v in out.items()), ("low", lists(low)), ("high", lists(high)), ("up", lists(up)), ("down", lists(down))]:
            kept = kept.append_column(name, values)
        return kept

    def add_up(self, table: pa.Table, found: Iterator, span: float) -> pa.Table:
        """For each key the sums of ``base · exp(rate · span)`` of the rows, an array for each persistence."""
        names, member = self._members(table)
        width = self.width
        base, sums = _numbers(table, "base").astype(float), np.full((width, len(names), self.n_sim), np.nan)
        started = np.zeros((width, len(names)), dtype=bool)
        for rows, rates in found:
            for i, r in enumerate(rates):
                r *= span
                np.exp(r, out=r)
                for j, row in enumerate(rows):
                    # A sum leaves out what is missing.
                    if np.isnan(base[row]) or np.isnan(r[j, 0]):
                        continue
                    m = member[row]
                    sums[i, m] = sums[i, m] + base[row] * r[j] if started[i, m] else base[row] * r[j]
                    started[i, m] = True
        columns = {k: pa.array([name[p] for name in names], table.schema.field(k).type) for p, k in enumerate(self.keys)}
        columns["grp"] = table.column("grp").slice(0, 1).combine_chunks().take(pa.array([0] * len(names), pa.int64()))
        for i in range(width):
            rows = [sums[i, m] if started[i, m] else [] for m in range(len(names))]
            columns[f"_t{i}"] = pa.array(rows, pa.list_(pa.float64()))
        return pa.table(columns)


@dataclass(frozen=True)
class Simulation:
    units: DataFrame
    made: Rates
    #: Shifts ``_k0, _k1, …`` of a group, one array for each persistence; None for supply.
    shifts: DataFrame | None = None

    def _types(self, *columns: str) -> str:
        fields = {f.name: f.dataType.simpleString() for f in self.units.schema.fields}
        return ", ".join(f"`{c}` {fields[c]}" for c in columns)

    def _dealt(self, df: DataFrame):
        return df.groupBy("grp", "slice")

    def _apply(self, work, schema: str) -> DataFrame:
        """``work(rows, shifts)`` of every slice."""
        units = self._dealt(_spread(self.units))
        if self.shifts is None:
            return units.applyInArrow(lambda table: work(table, None), schema)
        counts = self.units.select("grp", "slices").distinct()
        copies = with_groups(self.shifts, counts, ["grp"], width=2, salt="grp")
        copies = copies.withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)"))).drop("slices")

        return units.cogroup(self._dealt(copies)).applyInArrow(lambda rows, shifts: work(rows, shifts), schema)

    def statistics(self, delta: float) -> DataFrame:
        """Shares of replicates above, below and within ``delta``, the shares ``up, down`` for each fixed persistence, and the replicates next to
        the quantiles: ``low, high``."""
        made = self.made
        schema = self._types(*made.keys, *CARRIED) + ", p_up double, p_down double, p_flat double, low array<double>, high array<double>, up array<double>, down array<double>"
        return self._apply(lambda table, shifts: made.reduce(table, shifts, delta), schema)

    def _sums(self, span: float, final: bool) -> DataFrame:
        made = self.made
        schema = self._types(*made.keys, "grp") + "".join(f", _t{i} array<double>" for i in range(made.width))
        if final:
            return self._apply(lambda table, shifts: made.add_up(table, made.rates(table, shifts), span), schema)
        return self._dealt(_spread(self.units)).applyInArrow(lambda table: made.add_up(table, made.pulls(table), span), schema)

    def level_sums(self, span: float) -> DataFrame:
        """One row of sums for each key and slice: levels after ``span``, an array ``_t0, _t1, …`` for each persistence."""
        return self._sums(span, True)

    def unshifted_sums(self, span: float) -> DataFrame:
        """The same before any shift."""
        return self._sums(span, False)

    def shifted(self, shifts: DataFrame) -> Simulation:
        return replace(self, shifts=materialised(shifts))

    def where(self, condition: str) -> Simulation:
        """The rows of some keys or groups; their shifts stay what they are."""
        return replace(self, units=self.units.where(condition), shifts=None if self.shifts is None else self.shifts.where(condition))


@dataclass(frozen=True)
class Levels:
    """Levels of a simulation's rows after ``span``, by the first persistence; with a ``universe``, its units' sums."""

    sim: Simulation
    span: float
    universe: DataFrame | None = None


def _levels(made: Rates, table: pa.Table, shifts: pa.Table | None, span: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    base = _numbers(table, "base").astype(float)
    for rows, rates in made.rates(table, shifts):
        level = next(rates)
        level *= span
        np.exp(level, out=level)
        level *= base[rows][:, None]
        yield rows, level


def _unit_sums(made: Rates, table: pa.Table, names: list, rows_of: dict, span: float) -> np.ndarray:
    """Levels added up within each unit of ``names``: zero without rows, missing where all rows are."""
    sums, started = np.zeros((len(names), made.n_sim)), np.zeros(len(names), dtype=bool)
    member = np.array([i for i, name in enumerate(names) for _ in rows_of.get(name, ())], dtype=int)
    found = table.take(pa.array([r for name in names for r in rows_of.get(name, ())], pa.int64()))
    for rows, level in _levels(made, found, None, span):
        for j, row in enumerate(rows):
            if not np.isnan(level[j, 0]):
                sums[member[row]] += level[j]
                started[member[row]] = True
    sums[[i for i, name in enumerate(names) if name in rows_of and not started[i]]] = np.nan
    return sums


def _medians(values: np.ndarray) -> np.ndarray:
    """Median of each row's numbers, missing ones left out; NaN if there are none."""
    values.sort(axis=1)
    n = np.count_nonzero(~np.isnan(values), axis=1)
    at = np.maximum(n - 1, 0) * 0.5
    low = np.floor(at).astype(int)
    high, every = np.minimum(low + 1, np.maximum(n - 1, 0)), np.arange(len(values))
    return values[every, low] + (at - low) * (values[every, high] - values[every, low])


def median_ratios(over: Levels, under: Levels, factor: float) -> DataFrame:
    """Of each row of ``under`` (keys, ``unit``) the median over replicates, ``median``, of the summed levels of its unit's rows in ``over`` by its
    own level, times ``factor``. A unit without rows in ``over`` has zeros; replicates without a positive level below are left out, and the
    median is NULL if none is left. Rows of both meet in the slices of ``under``, so no levels move between tasks."""
    top, low, spans = over.sim, under.sim, (float(over.span), float(under.span))
    if top.shifts is not None or (top.made.n_sim, top.made.source) != (low.made.n_sim, low.made.source):
        raise ValueError("levels to be summed must come without shifts and from the same draws")
    drawn = ["unit", "base", "mid", "sd", "seed1", "seed2"]
    places = low.units.select("unit", "grp", "slice", "slices").distinct()
    rows = low.units.select(*low.made.keys, *drawn, *(("rho", "rho_future") if low.made.shares else ()), "grp", "slice", "slices", F.lit(False).alias("_over"))
    both = rows.unionByName(top.units.select(*drawn, F.lit(True).alias("_over")).join(places, "unit"), allowMissingColumns=True)
    summed, own = replace(top.made, keys=()), low.made

    def work(table: pa.Table, shifts: pa.Table | None) -> pa.Table:
        above = table.column("_over")
        table, added = table.filter(pc.invert(above)), table.filter(above)
        names, rows_of, out = table.column("unit").to_pylist(), defaultdict(list), np.full(table.num_rows, np.nan)
        for i, name in enumerate(added.column("unit").to_pylist()):
            rows_of[name].append(i)
        for rows, level in _levels(own, table, shifts, spans[1]):
            block = list(dict.fromkeys(names[r] for r in rows))
            place = {name: i for i, name in enumerate(block)}
            sums = _unit_sums(summed, added, block, rows_of, spans[0])[[place[names[r]] for r in rows]]
            level[~(level > 0)] = np.nan
            sums /= level
            sums *= factor
            out[rows] = _medians(sums)
        return table.select([*own.keys, "unit"]).append_column("median", pa.array(out, from_pandas=True))

    return replace(low, units=both)._apply(work, low._types(*own.keys, "unit") + ", median double")


def _spread(units: DataFrame) -> DataFrame:
    slots = units.sparkSession.sparkContext.defaultParallelism
    return units.repartition(max(2 * slots, -(-units.count() // (4 * SLICE))), "grp", "slice")


def sliced(units: DataFrame) -> DataFrame:
    """``slice`` of every row and how many ``slices`` its group has; written, as every pass reads it."""
    counts = units.groupBy("grp").agg(F.expr(f"bigint(ceil(count(1) / {SLICE}D))").alias("slices"))
    dealt = with_groups(units, counts, ["grp"], width=2).withColumn("slice", F.pmod(F.xxhash64("unit"), F.col("slices")))
    return materialised(dealt)


def simulation(units: DataFrame, keys: Sequence[str], n_sim: int, source: str, seed: int, ident: Column, stream: int, shares: Sequence = ()) -> Simulation:
    seed1, seed2 = draws.seeds(ident, stream, source, seed)
    return Simulation(sliced(units.withColumns({"seed1": seed1, "seed2": seed2})), Rates(tuple(keys), n_sim, source, tuple(shares)))
