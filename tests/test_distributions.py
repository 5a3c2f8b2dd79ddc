"""Tail probabilities against tables and numeric integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as d


def of(spark, rows, names, value):
    return [r[0] for r in spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in rows], ", ".join(f"{n} double" for n in names)).select(value).collect()]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 55.5, 1000.0, 1e6]
    assert of(spark, [(x,) for x in xs], ["x"], d.log_gamma(F.col("x"))) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


def test_normal_tails(spark):
    zs = [0.0, 1e-9, 0.3, 1.0, 1.959963984540054, -2.5758293035489, 2.8284271, 3.5, 8.0, -20.0, 37.0]
    got = of(spark, [(z,) for z in zs], ["z"], d.two_sided_normal(F.col("z")))
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-9, abs=1e-300)
    assert of(spark, [(None,)], ["z"], d.two_sided_normal(F.col("z"))) == [None]


def test_f_tails_equal_the_tables(spark):
    """Upper five and one per cent points of printed tables."""
    points = [(161.4476, 1, 1), (4.9646, 1, 10), (3.3158, 2, 30), (2.0868, 7, 120), (9.2766, 3, 3)]
    got = of(spark, [(f, a, b) for f, a, b in points], ["f", "a", "b"], d.f_upper(F.col("f"), F.col("a"), F.col("b")))
    assert got == pytest.approx([0.05] * 5, abs=4e-5)
    assert of(spark, [(10.0443, 1, 10)], ["f", "a", "b"], d.f_upper(F.col("f"), F.col("a"), F.col("b"))) == pytest.approx([0.01], abs=4e-5)
    assert of(spark, [(-1.0, 1.0, 1.0), (1.0, 0.0, 5.0)], ["f", "a", "b"], d.f_upper(F.col("f"), F.col("a"), F.col("b"))) == [None, None]


def test_incomplete_beta_equals_an_integral(spark):
    rows = [(a, b, x) for a in (0.5, 1.0, 2.5, 40.0) for b in (0.5, 3.0, 300.0) for x in (0.0, 0.01, 0.2, 0.7, 0.99, 1.0)]
    # with x = sin^2(u) the integrand has no pole at either end
    u = lambda x: np.linspace(0, math.asin(math.sqrt(x)), 200_001)
    area = lambda a, b, x: np.trapezoid(2 * np.sin(u(x)) ** (2 * a - 1) * np.cos(u(x)) ** (2 * b - 1), u(x))
    want = [area(a, b, x) / area(a, b, 1.0) for a, b, x in rows]
    assert of(spark, rows, "abx", d.incomplete_beta(F.col("a"), F.col("b"), F.col("x"))) == pytest.approx(want, abs=2e-7)


def test_t_tails(spark):
    rows = [(12.706, 1.0), (2.228, 10.0), (2.042, 30.0), (-1.980, 120.0)]
    assert of(spark, rows, ["t", "n"], d.two_sided_t(F.col("t"), F.col("n"))) == pytest.approx([0.05] * 4, abs=5e-5)
