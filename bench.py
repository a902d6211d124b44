"""Time the headline queries and print one line of JSON.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] (default 8). Each query runs
to the end into a sink that keeps nothing; the better of $BENCH_RUNS runs (default 2) counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattframe import get_session  # noqa: E402
from wattframe.catalog.queries import QUERIES, new_folder  # noqa: E402
from wattframe.operators import dispatch, profiles  # noqa: E402
from wattframe.operators import results as res  # noqa: E402
from wattframe.plans import studies  # noqa: E402
from wattframe.plans.sweep import STUDY  # noqa: E402
from wattframe.sources import country_period, read_hourly, read_results, tables, write_results  # noqa: E402

CHECKED = (
    "storage_stats",
    "storage_stats_by_year",
    "hour_profile",
    "stacked_profile",
    "resample_days",
    "resample_days_percent",
    "capacity_stats",
    "implied_capacity",
    "circular_lag",
    "dispatch_hourly",
    "sweep_totals",
    "sweep_study",
    "result_join",
    "annual_results",
    "heatmap_pivot",
    "category_rollup",
    "bar_reports",
    "spread_reports",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # The hourly table as a file, as users of the library have it.
    hours_path, results_path = new_folder(spark, "hours"), new_folder(spark, "results")
    tables.hourly_shipments(spark, folder).write.parquet(hours_path)
    hours = read_hourly(spark, hours_path)
    one_year = hours.filter("dateTime >= '1999-01-01' AND dateTime < '2000-01-01'")
    month = tables.hourly_events(spark, folder)

    jobs = {name: (lambda n=name: drain(QUERIES[n](spark, folder))) for name in CHECKED}
    jobs["scan_period_file"] = lambda: drain(
        country_period(hours, "EUROPE", "1998/06/01 00:00", "1999/05/31 23:00")
    )
    jobs["profiles_file"] = lambda: drain(profiles.all_profiles(hours))
    jobs["study_year_5_places_1210_scenarios_totals"] = lambda: drain(
        dispatch.sweep_totals(one_year, **STUDY, total_demand=100)
    )
    jobs["study_year_5_places_1210_scenarios_hourly"] = lambda: drain(
        dispatch.dispatch_hourly(one_year, **STUDY, total_demand=100)
    )
    jobs["study_month_1210_scenarios_written"] = lambda: write_results(
        dispatch.dispatch_hourly(month, **STUDY, total_demand=100), results_path
    )
    jobs["study_rollup_file"] = lambda: drain(res.annual_results(read_results(spark, results_path)))
    jobs["study_hourly_lookup_file"] = lambda: drain(
        res.hourly_results(read_results(spark, results_path), "1", "0.00005", "0.5")
    )
    jobs["study_heatmap_file"] = lambda: drain(
        studies.result_study(read_results(spark, results_path), STUDY["share_renewable"])["heatmap"]
    )
    jobs["profile_statistics_file"] = lambda: drain(
        studies.profile_study(hours, tables.capacity(spark, folder))["statistics"]
    )

    seconds = {}
    for name, job in jobs.items():
        best = None
        for _ in range(runs):
            began = time.perf_counter()
            job()
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
