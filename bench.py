"""Benchmark: headline queries on ``$BENCH_SF_DIR`` (default sf0.1), one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

from geopanel.plans import load
from geopanel.session import local_session

HEADLINE = (
    "c00_top_opportunities", "a01_distinct_entities", "a12_coverage_report", "a13_supply_gap_per_unit", "j02_crosswalk_two_hops", "j05_repeat_last_cut",
    "j07b_points_per_unit", "j08_overlay_areas", "w01_pct_rank_avg", "w03_terciles_quintiles", "c05_opportunity_index", "c08_full_composition",
    "c10_sensitivity_totals", "a16_zone_summary", "t01_top_by_value", "e03_shrinkage", "e08b_poisson_fit_sparse", "e12_supply_posterior",
    "e14_ols_projection", "m02_demand_projection", "m06_replicate_summary", "m06c_group_summary", "m12_level_per_replicate", "b02_thinning_folds",
    "b03_leave_group_out", "b11_adoption_decision", "d01_column_profile", "d03_family_drift", "w08_entity_churn", "q02_demand_layer", "q07_record_violations",
    "s01_multi_edition_csv",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]:.2f}", file=sys.stderr, flush=True)
    sf = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    chosen = sys.argv[1:]
    main(sorted(load()[0]) if chosen == ["all"] else chosen or list(HEADLINE))
