"""Time parameters of a run, in decimal years."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Calendar:
    # Census dates, base date, supply cuts and control origin.
    t0: float = 2010.44
    t1: float = 2020.20
    t_base: float = 2026.5
    horizons: tuple[tuple[str, int], ...] = (("h1", 1), ("h3", 3), ("h5", 5))
    supply_horizons: tuple[str, ...] = ("h1", "h3")
    cuts: tuple[float, ...] = (2016.79, 2019.87, 2024.87)
    control_from: float = 2020.5

    @property
    def dt(self) -> float:
        return self.t1 - self.t0

    @property
    def t_far(self) -> float:
        return self.t_base + self.horizons[-1][1]

    @property
    def centre(self) -> float:
        return self.cuts[1]

    @property
    def demand_span(self) -> float:
        """Years over which the demand projection is tied to the control series."""
        return self.t_far - self.t1

    @property
    def supply_span(self) -> float:
        years = dict(self.horizons)
        return self.t_base + years[self.supply_horizons[-1]] - self.cuts[-1]


# Edition label of each supply cut.
CUT_LABELS = {"2016-10": 2016.79, "2019-11": 2019.87, "2024-11": 2024.87}
