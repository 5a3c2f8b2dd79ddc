"""Exact quantiles of groups of any size, by bracket and count.

A mergeable sketch brackets the wanted ranks; a second pass counts what lies in each cell between the brackets, and only the rows of
the cells that hold a rank are kept, as distinct values with their numbers. Cells that are still large are split again. So no task
holds a group: a sketch is a few KB, a count a row for each group and cell, and what is sorted at last has at most `FITS` values.
Joins of targets are merges: several broadcasts of many groups at a time would fill a small driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch, written

#: Values that one task may sort; larger groups are narrowed first.
FITS = 1_000_000
#: A sketch's ranks are off by one in so many rows, at most.
ACCURACY = 4_000
#: Splitters of a cell that is still too large.
SPLITTERS = 31


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, to be read several times."""
    return written(rows, scratch(rows.sparkSession, "quantiles"))


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    """For each probability, the ranks from 0 on between which it lies, and how far it is from the lower one."""
    at = [F.lit(float(p)) * (n - 1) for p in probs]
    return F.array(*(F.struct(F.lit(i).alias("i"), F.floor(a).alias("low"), F.ceil(a).alias("high"), (a - F.floor(a)).alias("part")) for i, a in enumerate(at)))


def narrowed(rows: DataFrame, targets: DataFrame, splitters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and targets of the cells that hold a wanted rank.

    rows: (g, p, v, w), the value v w times in group g at place p. targets: (g, t, k), wanted is the value of rank k (from 0) among
    the group's rows with p < t. splitters: (g, s), ascending values; they may be any, only the sizes of cells depend on them.
    """
    marked = rows.join(splitters, "g").withColumn("cell", F.size(F.filter("s", lambda s: s < F.col("v"))))
    counts = marked.groupBy("g", "cell", "p").agg(F.sum("w").alias("n"))
    met = targets.join(counts.hint("merge"), "g").where("p < t").groupBy("g", "t", "k", "cell").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "t", "k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = met.withColumn("before", before).where("k >= before AND k < before + n")
    inner = F.struct(F.col("g"), F.col("cell")).alias("g")
    told = found.select("g", "t", "k", "cell", inner.alias("inner"), (F.col("k") - F.col("before")).alias("rest"))
    kept = marked.join(told.select("g", "cell").distinct(), ["g", "cell"], "left_semi").groupBy("g", "cell", "p", "v").agg(F.sum("w").alias("w"))
    return kept.select(inner, "p", "v", "w"), told


def order_statistics(rows: DataFrame, targets: DataFrame, splitters: DataFrame | None = None, fits: int | None = None) -> DataFrame:
    """(g, t, k, v): the value of rank k among rows of group g with p < t; rows and targets as in narrowed()."""
    fits = FITS if fits is None else fits
    told = targets.withColumns({"inner": F.col("g"), "rest": F.col("k")})
    while splitters is not None or (_largest(rows) > fits):
        if splitters is None:
            probs = [i / (SPLITTERS + 1) for i in range(1, SPLITTERS + 1)]
            splitters = rows.groupBy("g").agg(F.array_distinct(F.percentile_approx("v", F.array(*map(F.lit, probs)), ACCURACY)).alias("s"))
        wanted = told.select(F.col("inner").alias("g"), "t", F.col("rest").alias("k")).distinct()
        rows, found = narrowed(rows, wanted, splitters)
        rows, found = stored(rows), stored(found)
        step = found.select(F.col("g").alias("inner"), "t", F.col("k").alias("rest"), F.col("inner").alias("next"), F.col("rest").alias("left"))
        told = told.join(step.hint("merge"), ["inner", "t", "rest"]).select("g", "t", "k", F.col("next").alias("inner"), F.col("left").alias("rest"))
        splitters = None
    wanted = told.select("inner", "t", "rest").distinct()
    met = rows.withColumnRenamed("g", "inner").join(wanted, "inner").where("p < t").groupBy("inner", "t", "rest", "v").agg(F.sum("w").alias("w"))
    until = F.sum("w").over(Window.partitionBy("inner", "t", "rest").orderBy("v"))  # a cell's distinct values: at most `fits`
    found = met.withColumn("until", until).where("rest >= until - w AND rest < until")
    return told.join(found.select("inner", "t", "rest", "v").hint("merge"), ["inner", "t", "rest"]).select("g", "t", "k", "v")


def _largest(rows: DataFrame) -> int:
    """Of the groups, the most rows."""
    return rows.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def quantiles(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float] = (0.5,), fits: int | None = None) -> DataFrame:
    """(keys, columns): for each column an array of the exact quantiles of its values, interpolated as percentile() does; null values
    don't count. A group without any value in all columns has no row, but without keys there is always one.

    The frame is read a few times, so give a stored one if it is costly. Where all rows together are few, groups are sorted as they
    are; else they are narrowed first, which gives the same values.
    """
    fits, names = FITS if fits is None else fits, list(columns)
    listed = F.array(*(F.lit(float(p)) for p in probs))
    if frame.count() <= fits:
        found = frame.groupBy(*keys).agg(*(F.percentile(F.col(c).cast("double"), listed).alias(c) for c in names))
        return found.where(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in names))) if keys else found
    values = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)))
    group = F.struct(*(F.col(k) for k in keys), F.col("__x.c").alias("__c"))
    rows = frame.select(*keys, F.explode(values).alias("__x")).where("__x.v IS NOT NULL").select(group.alias("g"), F.lit(0).alias("p"), F.col("__x.v").alias("v"), F.lit(1).cast("bigint").alias("w"))
    margin = 2 / ACCURACY
    near = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    stats = stored(rows.groupBy("g").agg(F.count("*").alias("n"), F.array_distinct(F.percentile_approx("v", F.array(*map(F.lit, near)), ACCURACY)).alias("s")))
    wanted = stats.select("g", F.explode(_ranks(F.col("n"), probs)).alias("r")).select("g", "r.*")
    targets = wanted.select("g", F.explode(F.array("low", "high")).alias("k")).distinct().select("g", F.lit(1).alias("t"), "k")
    at = order_statistics(rows, targets, stats.select("g", "s"), fits)
    both = wanted.join(at.select("g", F.col("k").alias("low"), F.col("v").alias("a")).hint("merge"), ["g", "low"]).join(at.select("g", F.col("k").alias("high"), F.col("v").alias("b")).hint("merge"), ["g", "high"])
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    found = both.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("q")).select("g", F.transform("q", lambda x: x["v"]).alias("q"))
    per_column = [F.max(F.when(F.col("g.__c") == i, F.col("q"))).alias(c) for i, c in enumerate(names)]
    return found.select(*(F.col(f"g.{k}").alias(k) for k in keys), "g", "q").groupBy(*keys).agg(*per_column)


def median_of(frame: DataFrame, keys: Sequence[str], column: str, to: str, fits: int | None = None) -> DataFrame:
    """(keys, to): the median of a column."""
    return quantiles(frame, keys, [column], fits=fits).select(*keys, F.col(column)[0].alias(to))
