"""Scenario sweep: from the hourly table to scenario results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions import decimal_range
from wattframe.operators.dispatch import AMOUNTS, ATTRIBUTES, dispatch_hourly, rejected_scenarios
from wattframe.operators.grid import DEFAULT_COSTS, Share, check_grid
from wattframe.sources import country_period, read_hourly, read_results, write_results
from wattframe.sources.layout import MANIFEST, records

# The grid of the full study, 5 x 11 x 11 x 2 scenarios.
STUDY = {
    "share_generation": decimal_range("1", "1.25", "0.05"),
    "share_renewable": decimal_range("0", "1.1", "0.1"),
    "share_storage": decimal_range("0", "0.00011", "0.00001"),
    "cost_curtailment": [{"nuclear": 1, "renewable": 0}, {"nuclear": 0, "renewable": 1}],
}

_NOTE = "run STRING, part INT, parts INT"


def simulate(
    spark: SparkSession,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
    total_demand: float | None = None,
    *,
    country: str,
    start: str,
    end: str,
    renewable: str = "windOnshore",
    hourly_path: str | None = None,
    out_path: str | None = None,
    partitions: int | None = None,
    parts: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Dispatch every scenario of the grid for one country and period.

    Two rows for one hour stop the query when it runs; no job runs while the plan is built. Scenarios
    without a feasible dispatch are left out; ``rejected`` lists them.

    With ``out_path`` the results are written there and read back, so that further queries start from
    the written table instead of running the sweep again. What was there before is replaced.

    With ``parts`` the sweep is written in that many parts, each some of the renewable shares in folders
    of their own, and each is noted next to the table when it is whole. A call for the same sweep goes
    on after the parts noted: a part that was stopped half-way is written again, folder by folder, and
    the others are left alone. ``at_most`` ends a call after so many new parts. A folder that holds
    another sweep is not touched.
    """
    check_grid(share_generation, share_renewable, share_storage, cost_curtailment)
    hourly = country_period(read_hourly(spark, hourly_path), country, start, end)
    grid = {
        "share_generation": list(share_generation),
        "share_renewable": list(share_renewable),
        "share_storage": list(share_storage),
    }

    def dispatched(first: int, last: int) -> DataFrame:
        results = dispatch_hourly(
            hourly,
            share_generation,
            share_renewable[first:last],
            share_storage,
            cost_curtailment,
            total_demand,
            renewable,
            partitions=partitions,
            unique=True,
        )
        # Scenarios are numbered over the whole grid, the renewable share first.
        before = first * len(share_generation) * len(share_storage) * len(cost_curtailment)
        number = (F.col("scenario_id") + before).cast("int")
        return results.withColumn("scenario_id", number).select(
            "country", "scenario_id", *AMOUNTS, *ATTRIBUTES, "date"
        )

    if out_path is None:
        return dispatched(0, len(share_renewable))
    if parts is None:
        write_results(dispatched(0, len(share_renewable)), out_path, grid=grid)
        return read_results(spark, out_path)

    parts = max(1, min(parts, len(share_renewable)))
    asked = [{k: list(map(str, v)) for k, v in grid.items()}, list(map(dict, cost_curtailment)), total_demand]
    asked += [country, start, end, renewable, parts]
    run = hashlib.sha256(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()
    notes = records(spark, out_path, MANIFEST, _NOTE)
    if any(note["run"] != run for note in notes):
        raise ValueError(f"{out_path} holds another sweep")
    done = {note["part"] for note in notes}
    new = [part for part in range(parts) if part not in done][:at_most]
    for part in new:
        first, last = (len(share_renewable) * p // parts for p in (part, part + 1))
        write_results(
            dispatched(first, last),
            out_path,
            partition_by=["share_renewable"],
            grid=grid,
            # Before anything is noted, nothing there is known to belong to this sweep.
            replace="dynamic" if done else "static",
        )
        note = spark.createDataFrame([(run, part, parts)], _NOTE)
        note.coalesce(1).write.mode("append").json(f"{out_path}/{MANIFEST}")
        done.add(part)
    return read_results(spark, out_path)


def rejected(
    spark: SparkSession,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
    total_demand: float | None = None,
    *,
    country: str,
    start: str,
    end: str,
    renewable: str = "windOnshore",
    hourly_path: str | None = None,
) -> DataFrame:
    """The scenarios that ``simulate`` leaves out for the same arguments, and why."""
    check_grid(share_generation, share_renewable, share_storage, cost_curtailment)
    hourly = country_period(read_hourly(spark, hourly_path), country, start, end)
    return rejected_scenarios(
        hourly, share_generation, share_renewable, share_storage, cost_curtailment, total_demand, renewable
    )
