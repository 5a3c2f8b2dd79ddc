"""Tail probabilities as column expressions: sums and continued fractions of a fixed number of terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos series for the gamma function with g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TERMS = 200
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, for x > 0; good to about 13 digits from 0.5 on."""
    z = x.cast("double") - 1
    series = sum((F.lit(c) / (z + i) for i, c in enumerate(_LANCZOS[1:], 1)), F.lit(_LANCZOS[0]))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def two_sided_normal(z: Column) -> Column:
    """Probability that a standard normal lies as far out as z, on either side."""
    x = F.abs(z.cast("double")) / math.sqrt(2)
    # near 0: 1 - erf by a series of positive terms; farther out the continued fraction, from its last term inwards
    term = F.struct(x.alias("term"), x.alias("sum"))
    added = lambda acc, n: acc["term"] * 2 * x * x / (2 * n + 1)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), term, lambda acc, n: F.struct(added(acc, n).alias("term"), (acc["sum"] + added(acc, n)).alias("sum")))["sum"]
    inner = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, n: n / (2 * x * x) / (1 + acc))
    near = F.greatest(1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series, F.lit(0.0))
    far = F.exp(-x * x) / (x * math.sqrt(math.pi)) / (1 + inner)
    return F.when(x < 2.0, near).otherwise(far)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz method: two steps for each term."""
    kept = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    d = 1 / kept(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

    def stepped(acc: Column, part: Column) -> Column:
        d, c = 1 / kept(1 + part * acc["d"]), kept(1 + part / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    def both(acc: Column, i: Column) -> Column:
        m = F.ceil(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return stepped(acc, F.when(i % 2 == 1, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * _TERMS)), start, both)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = x < (a + 1) / (a + b + 2)  # where the fraction of x converges fast; else that of 1 - x
    part = front * _beta_fraction(F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)) / F.when(low, a).otherwise(b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.when(low, part).otherwise(1 - part))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """Probability that F of (df1, df2) degrees of freedom exceeds f; null for a negative f or no degrees of freedom."""
    d1, d2 = df1.cast("double"), df2.cast("double")
    return F.when((f >= 0) & (d1 > 0) & (d2 > 0), incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def two_sided_t(t: Column, df: Column) -> Column:
    """Probability that Student's t lies as far out as t, on either side."""
    return f_upper(t * t, F.lit(1), df)
