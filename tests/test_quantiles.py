"""Quantiles by rank against numpy, and the plan behind them."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, records
from wattframe.operators.compare import spread
from wattframe.operators.quantiles import quantiles, with_ordered_number

FRACTIONS, NAMES = (0.25, 0.5, 0.75), ("q1", "q2", "q3")


def test_ordered_number_is_the_order_of_doubles(spark):
    draw = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.7976931348623157e308, math.inf, -math.inf]
    values += [s * math.nextafter(2.0**e, to) for e in range(-60, 60, 3) for to in (0, math.inf) for s in (1, -1)]
    values += [s * 2.0**e for e in range(-1074, 1024, 37) for s in (1, -1)]
    while len(values) < 2000:
        x = struct.unpack("d", struct.pack("q", draw.getrandbits(63)))[0]
        if not math.isnan(x):
            values += [x, -x]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "v double")
    got = {(r["v"], math.copysign(1, r["v"])): r["n"] for r in with_ordered_number(df, "v", "n").collect() if r["n"] is not None}
    for v in values:
        bits = struct.unpack("q", struct.pack("d", abs(v)))[0]
        assert got[v, math.copysign(1, v)] == (-bits if v < 0 else bits), v
    missing = with_ordered_number(df.filter("v IS NULL OR isnan(v)"), "v", "n").collect()
    assert [r["n"] for r in missing] == [None, None]


@pytest.mark.parametrize("few", [True, False])
def test_against_numpy(spark, few):
    draw = random.Random(2)
    groups = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "ties": [1.0] * 30 + [2.0] * 30 + [-1.0],
        "spread": [draw.gauss(0, 1) * 10 ** draw.randrange(-20, 20) for _ in range(500)],
        "near": [1 + draw.randrange(1000) * 2.0**-52 for _ in range(300)],
        None: [draw.random() for _ in range(77)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    rows += [("empty", None), ("empty", float("nan")), ("two", None), ("ties", float("nan"))]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    out = {r["k"]: r for r in quantiles(df, ["k"], "v", FRACTIONS, NAMES, few_groups=few).collect()}
    assert out.pop("empty").asDict() == {
        "k": "empty", "n": 0, "lowest": None, "q1": None, "q2": None, "q3": None, "highest": None
    }
    assert set(out) == set(groups)
    for k, values in groups.items():
        r = out[k]
        assert (r["n"], r["lowest"], r["highest"]) == (len(values), min(values), max(values))
        for f, name in zip(FRACTIONS, NAMES):
            assert r[name] == pytest.approx(np.quantile(values, f), rel=1e-12), (k, name)
    assert quantiles(df.limit(0), ["k"], "v", FRACTIONS, NAMES).collect() == []


def test_a_category_of_a_million_values(spark):
    n = 1_000_000
    values = spark.range(n, numPartitions=8).select(
        F.lit("r").alias("report"),
        F.lit(0).alias("position"),
        F.when(F.col("id") < 0, "b").otherwise("a").alias("category"),
        # Every number from 0 to n - 1 once, in an order of no meaning.
        (((F.col("id") * 7919 + 12345) % n) / 8).alias("value"),
    )
    out = spread(values)
    assert records(out) == [
        {
            "report": "r", "position": 0, "category": "a", "n": n, "lowest": 0.0,
            "lowerQuartile": (n - 1) / 32, "median": (n - 1) / 16, "upperQuartile": 3 * (n - 1) / 32,
            "highest": (n - 1) / 8,
        }
    ]
    plan = plan_of(out)
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan and "collect_" not in plan
