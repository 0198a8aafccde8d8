"""Time the headline queries over landed microdata; prints one JSON line.

Every query runs three times and its median counts, so neither the first query nor the first run of a plan is
charged with starting the session or compiling code. What a run stages is deleted before the next.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyframe.session import local_session, release_staged, scratch_path, staging
from tallyframe.workload import catalog, views

RUNS = 3
HEADLINE = (
    "D3_unit_counts_se", "A2_survey_count_se", "A3_survey_mean_se", "D8_headship_table",
    "D9_missing_households_by_cell", "J5_baseline_rates_joined_back", "D10_metro_totals",
    "D12_all_totals_recomputed", "D14_long_run_vacancy_shortfall", "D16_sweep_of_end_years",
    "D19_survey_against_projection", "A8_weighted_median", "D23_baseline_cost_burden",
    "D25_counterfactual_rates", "D27_decomposition_of_one_year", "D28_decomposition_of_all_years",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    spark = local_session("bench")
    views.land_views(spark, sf_dir, scratch_path(spark, "bench"))
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        if only and not any(name.startswith(o) for o in only):
            continue
        runs = []
        for _ in range(RUNS):
            with staging():
                start = time.perf_counter()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    release_staged()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
