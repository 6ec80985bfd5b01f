"""Values at places of sorted groups, against plain sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import metrics as M


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [("hot", rng.randint(0, 40) if rng.random() < 0.5 else rng.random() * 1000) for _ in range(3000)] + [(None, float(i)) for i in range(7)]
    return [*out, ("one", 5.0), ("none", None), ("ties", 3.0), ("ties", 3.0), ("ties", 3.0), ("hot", None)]


def groups(rows):
    out = {}
    for g, v in rows:
        out.setdefault(g, []).append(v)
    return {g: sorted(float(v) for v in vs if v is not None) for g, vs in out.items()}


@pytest.mark.parametrize("parts", [2, 8, 256])
def test_every_place(spark, rows, parts):
    frame = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    places = {"first": F.lit(0), "last": F.col("n") - 1, "some": F.floor((F.col("n") - 1) * 0.37), "beyond": F.col("n")}
    got = {r.g: (r.n, r.first, r.last, r.some, r.beyond) for r in M.at_places(frame, "v", places, "g", parts=parts).collect()}
    assert got == {g: (len(x), x[0], x[-1], x[int((len(x) - 1) * 0.37)], None) for g, x in groups(rows).items() if x}
    (whole,) = M.at_places(frame, "v", places, parts=parts).collect()
    every = sorted(x for own in groups(rows).values() for x in own)
    assert (whole.n, whole.first, whole.some) == (len(every), every[0], every[int((len(every) - 1) * 0.37)])
    assert M.at_places(frame.limit(0), "v", places, "g").collect() == []


def test_percentiles_and_ranks(spark, rows):
    frame = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    got = {r.g: r for r in M.latencies(frame, "v", "g").collect()}
    for g, x in groups(rows).items():
        r = got[g]
        assert r.n == len(x)
        if x:
            assert np.allclose([r["mean"], r.median, r.p50, r.p95, r.p99], [np.mean(x), np.median(x), *np.percentile(x, [50, 95, 99])], rtol=1e-12)
        else:
            assert (r["mean"], r.median) == (-1.0, -1.0) and math.isnan(r.p95)
    ranks = {r.g: r.value for r in M.nearest_rank(frame, "v", 0.95, "g").collect()}
    assert ranks == {g: x[round(0.95 * (len(x) - 1))] for g, x in groups(rows).items() if x}


def test_no_task_holds_a_group(spark):
    """Of a group of all rows, what is put in order is one bucket for each place."""
    frame = spark.range(50_000).select(F.lit("all").alias("g"), F.xxhash64("id").alias("v"))
    plan = M.at_places(frame, "v", {"p": F.col("n") - 1}, "g")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    assert M.at_places(frame, "v", {"p": F.floor(F.col("n") / 2)}, "g").first().p == sorted(r.v for r in frame.collect())[25_000]
