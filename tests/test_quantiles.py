"""Quantiles by bracket and count against percentile(), and the size of what a task sorts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles as q


def frame(spark):
    rng = random.Random(1)
    values = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: None, lambda: 5.0, lambda: float("nan"), lambda: -1e300]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, None]), rng.choice(values[:4])(), rng.choice(values)()) for _ in range(4000)]
    rows += [("one", 1, 3.0, None), ("none", 1, None, None)]
    return spark.createDataFrame(rows, "k string, m int, x double, y double").repartition(5)


@pytest.mark.parametrize("fits", [10, 200, None])
def test_groups_with_ties_nulls_and_null_keys(spark, fits):
    df, probs = frame(spark), (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["k"], r["m"]): (r["x"], r["y"]) for r in q.quantiles(df, ["k", "m"], ["x", "y"], probs, fits).collect()}
    want = df.groupBy("k", "m").agg(*(F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in "xy")).collect()
    assert got.keys() == {(r["k"], r["m"]) for r in want if r["x"] or r["y"]}
    for r in want:
        if r["x"] or r["y"]:
            for mine, theirs in zip(got[r["k"], r["m"]], (r["x"], r["y"]), strict=True):
                assert (mine is None and theirs is None) or mine == pytest.approx(theirs, nan_ok=True, rel=1e-12)


@pytest.mark.parametrize("fits", [5, None])
def test_no_keys_and_no_rows(spark, fits):
    df = frame(spark)
    assert q.quantiles(df, [], ["x"], fits=fits).first()["x"] == [df.agg(F.median("x")).first()[0]]
    assert q.quantiles(df.limit(0), [], ["x"], fits=fits).collect() == [(None,)]
    assert q.quantiles(df.limit(0), ["k"], ["x"], fits=fits).count() == 0


def test_ten_million_values_of_one_period(spark, monkeypatch):
    """No task sorts more than a few thousand of them, and the median is exact."""
    sizes = []
    largest = q._largest
    monkeypatch.setattr(q, "_largest", lambda rows: sizes.append(largest(rows)) or sizes[-1])
    n = 10_000_000
    df = spark.range(0, n, 1, 16).select(F.lit("m").alias("period"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert q.median_of(df, ["period"], "x", "mid", fits=5_000).first()["mid"] == (n - 1) / 2
    assert sizes and sizes[-1] <= 5_000 and max(sizes) < n / 500


def test_ranks_among_earlier_places(spark):
    rng = random.Random(3)
    rows = [("g", rng.randint(0, 9), float(rng.randint(0, 40)), 1) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, p int, v double, w bigint")
    targets = [("g", t, k) for t in range(1, 11) for k in (0, 30, sum(p < t for _, p, _, _ in rows) - 1)]
    got = {(r["t"], r["k"]): r["v"] for r in q.order_statistics(df, spark.createDataFrame(targets, "g string, t int, k bigint"), fits=60).collect()}
    for _, t, k in targets:
        assert got[t, k] == sorted(v for _, p, v, _ in rows if p < t)[k]
