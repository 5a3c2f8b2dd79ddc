"""As-of joins without a range join: probe rows and data rows are united, sorted by time within a key, and aggregated running.

One shuffle on the key, linear in the rows. Rows of a probe's own instant count or don't by their place in the sort, so the
strict form can't look at what happens at the cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Running = Callable[[Column], Column]


def asof_aggregate(probes: DataFrame, rows: DataFrame, keys: list[str], probe_time: str, row_time: str, aggregates: dict[str, tuple[Running, Column]], inclusive: bool = True) -> DataFrame:
    """probes with the aggregates of the rows of their keys up to (inclusive) or before their time.

    aggregates: name -> (function such as F.sum, column of rows). Columns of rows other than keys may bear any name.
    """
    first, second = (0, 1) if inclusive else (1, 0)
    values = {f"__v{i}": column for i, (_, column) in enumerate(aggregates.values())}
    data = rows.select(*keys, F.col(row_time).alias("__t"), F.lit(first).alias("__side"), *(c.alias(n) for n, c in values.items()))
    asked = probes.select(*keys, F.col(probe_time).alias("__t"), F.lit(second).alias("__side"), F.struct(*probes.columns).alias("__probe"))
    both = data.unionByName(asked, allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [fn(F.col(v)).over(window).alias(name) for (name, (fn, _)), v in zip(aggregates.items(), values, strict=True)]
    return both.select("__probe", *running).where(F.col("__probe").isNotNull()).select("__probe.*", *aggregates)


def asof_totals(probes: DataFrame, rows: DataFrame, keys: list[str], probe_time: str, row_time: str, kind: Column, kinds: list[int], totals: dict[str, tuple[Running, Column]], inclusive: bool = True) -> DataFrame:
    """probes with a struct `of_<kind>` of the totals of each kind's rows up to (inclusive) or before their time, null without such a row.

    totals: name -> (F.sum, F.min or F.max, column of rows). kinds: numbers from 0 on. Rows travel and are sorted with the columns they
    have; rows of a kind between two probes become one before anything runs over them, so no row is as wide as kinds times totals.
    """
    first, second = (0, 1) if inclusive else (1, 0)
    others = [c for c in probes.columns if c not in keys]
    data = rows.withColumns({"__t": F.col(row_time), "__side": F.lit(first), "__kind": kind.cast("int")}).where(F.col("__kind").isin(*kinds))
    asked = probes.select(*keys, F.col(probe_time).alias("__t"), F.lit(second).alias("__side"), F.lit(-1).alias("__kind"), *(F.col(c).alias(f"__p_{c}") for c in others))
    asks = F.col("__kind") == -1
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(asks.cast("int")).over(to_here(Window.partitionBy(*keys).orderBy("__t", "__side")))
    placed = data.unionByName(asked, allowMissingColumns=True).withColumn("__next", before + F.when(asks, 0).otherwise(1))  # a row counts from the next probe on
    between = placed.groupBy(*keys, "__next", "__kind").agg(*(F.first(f"__p_{c}", ignorenulls=True).alias(f"__p_{c}") for c in others), *(fn(column).alias(f"__v{i}") for i, (fn, column) in enumerate(totals.values())))
    own = to_here(Window.partitionBy(*keys, "__kind").orderBy("__next"))
    sums = between.select(*keys, "__next", "__kind", *(f"__p_{c}" for c in others), F.struct(*(fn(F.col(f"__v{i}")).over(own).alias(name) for i, (name, (fn, _)) in enumerate(totals.items()))).alias("__s"))
    whole = to_here(Window.partitionBy(*keys).orderBy("__next", F.col("__kind").desc()))  # the probe comes after its rows
    known = sums.select("*", *(F.last(F.when(F.col("__kind") == k, F.col("__s")), ignorenulls=True).over(whole).alias(f"of_{k}") for k in kinds))
    named = [F.col(c) if c in keys else F.col(f"__p_{c}").alias(c) for c in probes.columns]
    return known.where(asks).select(*named, *(f"of_{k}" for k in kinds))


def stats_to_date(cuts: DataFrame, logs: DataFrame, keys: list[str], cut: str, date: str, counts: list[str]) -> DataFrame:
    """Sums of the counts over rows dated up to the cut; 0 before the first row. n_rows counts them."""
    return _late(cuts, logs, keys, cut, date, {c: F.col(c) for c in counts} | {"n_rows": F.lit(1)})


def _late(cuts: DataFrame, logs: DataFrame, keys: list[str], cut: str, date: str, wanted: dict[str, Column]) -> DataFrame:
    """Sums to date; the 0 of no rows is put on afterwards, as a window takes a plain aggregate."""
    found = asof_aggregate(cuts, logs, keys, cut, date, {name: (F.sum, column) for name, column in wanted.items()})
    return found.withColumns({name: F.coalesce(name, F.lit(0)) for name in wanted})


def last_before(probes: DataFrame, rows: DataFrame, keys: list[str], probe_time: str, row_time: str, value: str, to: str) -> DataFrame:
    """probes with the last value that isn't null strictly before their time."""
    return asof_aggregate(probes, rows, keys, probe_time, row_time, {to: (lambda c: F.last(c, ignorenulls=True), F.col(value))}, inclusive=False)


def count_to_date(cuts: DataFrame, events: DataFrame, keys: list[str], cut: str, date: str, to: str) -> DataFrame:
    """How many events a key has up to the cut."""
    return _late(cuts, events, keys, cut, date, {to: F.lit(1)})


def form_delta(cuts: DataFrame, logs: DataFrame, keys: list[str], cut: str, date: str, numerator: str, denominator: str, days: int = 14) -> DataFrame:
    """Recent rate less the rate to date at the cut: form_delta, null without a denominator, and form_games."""
    return stats_with_form(cuts, logs, keys, cut, date, [], numerator, denominator, days).drop("n_rows")


def stats_with_form(cuts: DataFrame, logs: DataFrame, keys: list[str], cut: str, date: str, counts: list[str], numerator: str, denominator: str, days: int = 14) -> DataFrame:
    """Sums of the counts up to the cut (n_rows counts the rows), and how the rate of the last `days` differs from the rate to date:
    form_delta, null without a denominator, and form_games. Both frames run over one sort of the rows and cuts."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    names = [*dict.fromkeys([*counts, numerator, denominator])]
    data = logs.select(*keys, at(date).alias("__t"), F.lit(1).alias("__n"), *(F.col(c).alias(f"__{c}") for c in names))
    asked = cuts.select(*keys, at(cut).alias("__t"), F.struct(*cuts.columns).alias("__probe"))
    ordered = Window.partitionBy(*keys).orderBy("__t")
    frames = {"all": ordered.rangeBetween(Window.unboundedPreceding, 0), "new": ordered.rangeBetween(1 - days * 86_400_000_000, 0)}
    sums = [F.sum(f"__{c}").over(frames[k]).alias(f"__{k}_{c}") for k, wanted in (("all", ["n", *names]), ("new", ["n", numerator, denominator])) for c in wanted]
    rows = data.unionByName(asked, allowMissingColumns=True).select("__probe", *sums).where(F.col("__probe").isNotNull())
    recent = F.col(f"__new_{numerator}") / F.col(f"__new_{denominator}")
    delta = F.when(F.col(f"__new_{denominator}") > 0, recent - F.col(f"__all_{numerator}") / F.nullif(F.col(f"__all_{denominator}"), F.lit(0)))
    nought = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("__probe.*", *(nought(f"__all_{c}").alias(c) for c in counts), nought("__all_n").alias("n_rows"), delta.alias("form_delta"), nought("__new_n").alias("form_games"))
