from wattframe.sources.readers import (
    bad_cells,
    check_comparison,
    country_list,
    country_period,
    read_by_day,
    read_capacity,
    read_comparison,
    read_hourly,
    read_results,
    read_runs,
    within,
)
from wattframe.sources.schemas import CAPACITY, COMPARISON, HOURLY, RESULTS
from wattframe.sources.sinks import store_by_day, store_by_hour, store_hourly, write_results

__all__ = [
    "CAPACITY",
    "COMPARISON",
    "HOURLY",
    "RESULTS",
    "bad_cells",
    "check_comparison",
    "country_list",
    "country_period",
    "read_by_day",
    "read_capacity",
    "read_comparison",
    "read_hourly",
    "read_results",
    "read_runs",
    "store_by_day",
    "store_by_hour",
    "store_hourly",
    "within",
    "write_results",
]
