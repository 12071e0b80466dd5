"""Percentiles of large groups by range counts, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import selection, telemetry


def data(rng):
    rows = [("wide", rng.uniform(-1, 1) * 10.0 ** rng.randrange(-9, 9)) for _ in range(3000)]
    rows += [("ties", float(rng.randrange(3))) for _ in range(2000)] + [("one", 7.0)] * 1500 + [("few", x) for x in (3.0, 1.0)] + [("two", float(k >= 700)) for k in range(1400)]
    rows += [(None, rng.gauss(5, 2)) for _ in range(1000)] + [("none", None), ("wide", None), ("wide", float("nan")), ("ends", -1.7e308), ("ends", 1.7e308)] + [("ends", float(x)) for x in range(900)]
    return rows


@pytest.mark.parametrize("limit", [10, 200, 100_000])
def test_same_as_numpy(spark, limit):
    rows = data(random.Random(7))
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r.k: r for r in selection.percentiles(df, ["k"], {n: (F.col("v"), s) for n, s in shares.items()}, limit).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        values = [v for x, v in rows if x == k and v is not None and v == v]
        for name, share in shares.items():
            assert (got[k][name] is None) == (not values)
            if values:
                assert np.isclose(got[k][name], np.percentile(values, share * 100), rtol=1e-9, atol=1e-12), (k, name)


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1001)], "v double")
    assert [tuple(r) for r in selection.percentiles(df, [], {"m": (F.col("v"), 0.5)}, 50).collect()] == [(500.0,)]
    assert selection.percentiles(df.limit(0), [], {"m": (F.col("v"), 0.5)}).collect() == []
    runs = spark.createDataFrame([], "status string, duration_ms double, ttft_ms double, tokens long, day string")
    assert tuple(telemetry.kpis(runs).select("runs", "p50").first()) == (0, None) and telemetry.outcomes(runs, "day").collect() == []
