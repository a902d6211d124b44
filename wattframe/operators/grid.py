"""Scenario grids: the product of four lists, spread over the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import SHARE_TYPE

Share = float | str | Decimal
DEFAULT_COSTS = ({"nuclear": 1, "renewable": 0},)


def check_grid(
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]],
) -> None:
    """Reject a bad grid before any plan is built."""
    if not (len(share_generation) and len(share_renewable) and len(share_storage) and len(cost_curtailment)):
        raise ValueError("every list of the grid needs at least one value")
    if any(not 0 <= Decimal(str(s)) <= 1 for s in share_renewable):
        raise ValueError("the renewable share must be within 0 and 1")
    for costs in cost_curtailment:
        unknown = set(costs) - {"nuclear", "renewable"}
        if unknown:
            raise ValueError(f"no such technology: {', '.join(sorted(unknown))}")


def _level(values: Sequence[Share], kept: Callable[[Column], Column] | None = None) -> Column:
    places = F.array(
        *(
            F.struct(
                F.lit(i).alias("i"),
                F.lit(str(v)).cast(SHARE_TYPE).alias("key"),
                F.lit(float(v)).alias("x"),
            )
            for i, v in enumerate(values)
        )
    )
    return F.explode(places if kept is None else F.filter(places, lambda place: kept(place["x"])))


def spread_scenarios(
    df: DataFrame,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
    kept_energy: Callable[[Column], Column] | None = None,
    kept_storage: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Repeat every row for each scenario and add ``scenario_id``, shares and curtailment costs.

    The lists are literals in the plan: rows are multiplied in place, with no join and no shuffle.
    ``x_generation``, ``x_renewable`` and ``x_storage`` hold the shares as doubles, for arithmetic.

    ``kept_energy`` says of a generation share, next to the row and its renewable share (the column
    ``_ren.x``), whether that pair is wanted, ``kept_storage`` the same of a storage share. Others are
    taken out of the lists before these repeat the row.
    """
    check_grid(share_generation, share_renewable, share_storage, cost_curtailment)
    costs = F.array(
        *(
            F.struct(
                F.lit(float(c.get("nuclear", 0))).alias("nuclear"),
                F.lit(float(c.get("renewable", 0))).alias("renewable"),
            )
            for c in cost_curtailment
        )
    )
    kept = [F.col(c) for c in df.columns]
    out = df.select("*", _level(share_renewable).alias("_ren"))
    out = out.select("*", _level(share_generation, kept_energy).alias("_gen"))
    out = out.select("*", _level(share_storage, kept_storage).alias("_sto"))
    out = out.select("*", F.posexplode(costs).alias("_i_cost", "_cost"))
    position = F.col("_ren.i") * len(share_generation) + F.col("_gen.i")
    position = position * len(share_storage) + F.col("_sto.i")
    position = position * len(cost_curtailment) + F.col("_i_cost")
    return out.select(
        *kept,
        position.alias("scenario_id"),
        F.col("_gen.key").alias("share_generation"),
        F.col("_ren.key").alias("share_renewable"),
        F.col("_sto.key").alias("share_storage"),
        F.col("_gen.x").alias("x_generation"),
        F.col("_ren.x").alias("x_renewable"),
        F.col("_sto.x").alias("x_storage"),
        F.col("_cost.nuclear").alias("costCurtailNuclear"),
        F.col("_cost.renewable").alias("costCurtailRenewable"),
    )


def scenario_attributes(
    scenario_id: Column,
    share_generation: Sequence[Share],
    share_renewable: Sequence[Share],
    share_storage: Sequence[Share],
    cost_curtailment: Sequence[Mapping[str, float]] = DEFAULT_COSTS,
) -> dict[str, Column]:
    """Shares and curtailment costs of a scenario, looked up by its number in the grid."""

    def place(later: int, length: int) -> Column:
        return F.floor(scenario_id / later).cast("int") % length

    n_gen, n_sto, n_cost = len(share_generation), len(share_storage), len(cost_curtailment)
    i_ren = place(n_gen * n_sto * n_cost, len(share_renewable))
    i_gen, i_sto, i_cost = place(n_sto * n_cost, n_gen), place(n_cost, n_sto), place(1, n_cost)

    def share(values: Sequence[Share], i: Column) -> Column:
        return F.get(F.array(*(F.lit(str(v)).cast(SHARE_TYPE) for v in values)), i)

    def cost(technology: str) -> Column:
        return F.get(F.array(*(F.lit(float(c.get(technology, 0))) for c in cost_curtailment)), i_cost)

    return {
        "share_generation": share(share_generation, i_gen),
        "share_renewable": share(share_renewable, i_ren),
        "share_storage": share(share_storage, i_sto),
        "costCurtailNuclear": cost("nuclear"),
        "costCurtailRenewable": cost("renewable"),
    }
