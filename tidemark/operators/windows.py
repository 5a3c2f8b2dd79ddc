"""Ordered operators: returns between observed periods, trailing and forward features, break-outs, spikes, gap filling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import quantiles
from tidemark.session import scratch


def observed_returns(series: DataFrame, keys: list[str], period: str, price: str, unit: str = "days") -> DataFrame:
    """log_ret to the last observed period, however far back, and how far that is (days_since_prev or months_since_prev)."""
    w = Window.partitionBy(*keys).orderBy(period)
    before = F.lag(period).over(w)
    gap = F.datediff(F.col(period), before) if unit == "days" else f.month_index(F.col(period)) - f.month_index(before)
    return series.withColumns({"log_ret": F.log(F.col(price) / F.nullif(F.lag(price).over(w), F.lit(0))), f"{unit}_since_prev": gap})


def market_excess(panel: DataFrame, period: list[str], value: str = "log_ret", to: str = "excess_ret") -> DataFrame:
    """panel with market_median (over the period) and the value's excess over it; the panel is stored, and no task holds a
    period of all series."""
    panel = quantiles.stored(panel)
    medians = quantiles.median_of(panel, period, value, "market_median")
    return panel.join(medians, period, "left").withColumn(to, F.col(value) - F.col("market_median"))


def hold_returns(months: DataFrame, keys: list[str], horizons: tuple[int, ...] = (6, 12, 24, 36), entries_from: str | None = None) -> DataFrame:
    """Yearly log returns from each month to the month exactly h later; null where that month or a price is missing. The frames
    of all horizons share one sort."""
    at, now = f.month_index(F.col("month")), F.nullif("price", F.lit(0.0))
    later = {h: F.max(now).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(h, h)) for h in horizons}
    held = months.withColumns({f"ret_{h}m": F.log(p / now) / (h / 12.0) for h, p in later.items()})
    return held if entries_from is None else held.where(F.col("month") >= F.lit(entries_from).cast("timestamp"))


def trailing_features(months: DataFrame, keys: list[str]) -> DataFrame:
    """price_level: log of the median of the three months before, if all are there; ret_3m: log return from three months before."""
    at = f.month_index(F.col("month"))
    three = Window.partitionBy(*keys).orderBy(at).rangeBetween(-3, -1)
    third = Window.partitionBy(*keys).orderBy(at).rangeBetween(-3, -3)
    level = F.when(F.count("price").over(three) == 3, F.log(F.percentile("price", F.lit(0.5)).over(three)))
    return months.withColumns({"price_level": level, "ret_3m": F.log(F.col("price") / F.nullif(F.max("price").over(third), F.lit(0.0)))})


def breakouts(logs: DataFrame, score: Column, usable: Column, weight: Column, any_row: bool, baseline: int = 30, least_rows: int = 5, least_weight: float = 20, z_min: float = 2.5, order: tuple[str, ...] = ("date", "game_id")) -> DataFrame:
    """Rows whose score lies z_min deviations above the last `baseline` usable earlier rows of the entity and level.

    Usable rows are numbered, and the frame runs over the numbers, so rows in between don't take a place. A score is compared by squares
    of sums, n (n x - sum)^2 with the variance's, which are exact for whole scores: a row that lies on z_min is in.
    """
    keys = ["entity_id", "level"]
    rows = logs.withColumns({"score": score.cast("double"), "__usable": usable, "__w": weight})
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__u", F.coalesce(F.sum(F.col("__usable").cast("int")).over(before), F.lit(0)))
    frame = Window.partitionBy(*keys).orderBy("__u").rangeBetween(-baseline, -1)
    own = F.when(F.col("__usable"), F.col("score"))
    number = F.count(own).over(frame)
    sums = {"__s": F.sum(own).over(frame), "__q": F.sum(own * own).over(frame), "__low": F.min(own).over(frame), "__high": F.max(own).over(frame)}
    rows = rows.withColumns({"baseline_n": number, **sums, "__weight": F.coalesce(F.sum(F.when(F.col("__usable"), F.col("__w"))).over(frame), F.lit(0))})
    n, s = F.col("baseline_n").cast("double"), F.col("__s")
    rows = rows.withColumns({"__d": n * F.col("score") - s, "__v": F.when(F.col("__low") < F.col("__high"), F.nullif(F.greatest(n * F.col("__q") - s * s, F.lit(0.0)), F.lit(0.0)))})
    rows = rows.withColumn("z", F.when(n > 1, F.col("__d") / F.sqrt(n * F.col("__v") / (n - 1))))
    far = F.col("__d") * F.abs("__d") * (n - 1) >= z_min * abs(z_min) * n * F.col("__v")
    enough = (F.col("baseline_n") >= max(least_rows, 2)) & (F.col("__weight") >= least_weight) & far
    return rows.where(enough if any_row else enough & F.col("__usable")).drop("__usable", "__w", "__u", *sums, "__d", "__v", "__weight")


def drop_overlaps(events: DataFrame, keys: list[str], date: str, days: int = 14, order: list[str] | None = None) -> DataFrame:
    """Per key, an event within `days` days of the last kept one goes. Whole rows stay; of rows of one day the first by the date, then
    by `order` or the other columns does.

    A day's first row is found before anything is gathered, so what a key gathers has a row a day at most, however many its events
    are; from one kept day the next is the first one later than `days`, which is what the fold over the sorted days takes.
    """
    others = [c for c in events.columns if c not in (*keys, date, *(order or []))]
    item = F.struct(F.col(date), *(F.col(c) for c in order or [] if c != date), *others)
    firsts = events.where(F.col(date).isNotNull()).groupBy(*keys, F.datediff(F.col(date), F.lit("1970-01-01")).alias("__day")).agg(F.min(item).alias("__r"))
    rows = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__day", "__r"))).alias("__rows"))
    no_day = F.struct(F.lit(None).cast("int").alias("last"), F.slice("__rows", 1, 0).alias("kept"))
    later = lambda acc, r: acc["last"].isNull() | (r["__day"] - acc["last"] > days)
    kept = F.aggregate("__rows", no_day, lambda acc, r: F.when(later(acc, r), F.struct(r["__day"].alias("last"), F.array_append(acc["kept"], r).alias("kept"))).otherwise(acc))["kept"]
    return rows.select(*keys, F.explode(kept).alias("__k")).select(*(F.col(c) if c in keys else F.col(f"__k.__r.{c}").alias(c) for c in events.columns))


def spikes(snapshots: DataFrame, keys: list[str], day: str, prob: str, least: float = 0.10, rows: int = 30, times: float = 3.0, least_rows: int = 5) -> DataFrame:
    """Steps at least as large as `least` and `times` the deviation of the last `rows` steps, this one included."""
    w = Window.partitionBy(*keys).orderBy(day)
    steps = snapshots.withColumn("delta", F.col(prob) - F.lag(prob).over(w))
    frame = w.rowsBetween(-(rows - 1), 0)
    sd = F.when(F.count("delta").over(frame) >= least_rows, F.stddev_samp("delta").over(frame))
    steps = steps.withColumn("__sd", sd)
    return steps.where(F.abs("delta") >= F.greatest(F.lit(least), F.coalesce(F.col("__sd") * times, F.lit(least)))).drop("__sd")


def pick_spikes(found: DataFrame, key: str, day: str, days: int = 7) -> DataFrame:
    """Per key, largest steps first; one of the same sign within `days` of one that was picked goes. Ties: the earlier day.

    Of a key's steps of one sign and day only the largest can be picked, so it is found before anything is gathered: what a key
    gathers has two rows a day at most, however many its steps are. The days around a pick are marked, so the picking is linear.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    item = F.struct((-F.abs("delta")).alias("less"), F.col(day).alias("day"), F.col("delta"))
    largest = found.where("delta IS NOT NULL").groupBy(key, F.signum("delta").alias("__sign"), number.alias("__day")).agg(F.min(item).alias("__x"))
    gathered = largest.groupBy(key, "__sign").agg(F.array_sort(F.collect_list(F.struct("__x", "__day"))).alias("__items"))

    @F.pandas_udf("array<int>")
    def places(numbers: pd.Series) -> pd.Series:
        def of(own) -> list[int]:
            near: set[int] = set()
            out = []
            for i, d in enumerate(own):
                if d not in near:
                    near.update(range(d - days, d + days + 1))
                    out.append(i)
            return out

        return numbers.map(of)

    picked = gathered.withColumn("__at", places(F.transform("__items", lambda x: x["__day"])))
    rows = picked.select(key, F.explode(F.transform("__at", lambda i: F.get("__items", i)["__x"])).alias("__k"))
    return rows.select(key, F.col("__k.day").alias(day), F.col("__k.delta").alias("delta"))


def fill_gaps(series: DataFrame, keys: list[str], position: str, value: str, limit: int = 3, strict: bool = False) -> DataFrame:
    """Linear filling on a regular grid. As pandas does with a limit and both directions: up to `limit` cells from either side
    of any gap, and the edges by `limit`. strict: gaps of at most `limit` cells alone, no edges."""
    back = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(position))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    p0, p1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    rows = series.withColumns({"__v0": v0, "__v1": v1, "__p0": p0, "__p1": p1})
    d0, d1 = F.col(position) - F.col("__p0"), F.col("__p1") - F.col(position)
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * d0 / F.nullif(F.col("__p1") - F.col("__p0"), F.lit(0))
    if strict:
        filled = F.when(F.col("__p1") - F.col("__p0") - 1 <= limit, line)
    else:
        near = (F.coalesce(d0, F.lit(limit + 1)) <= limit) | (F.coalesce(d1, F.lit(limit + 1)) <= limit)
        filled = F.when(near, F.coalesce(line, F.col("__v0"), F.col("__v1")))
    return rows.withColumn("filled", F.coalesce(F.col(value), filled)).drop("__v0", "__v1", "__p0", "__p1")


def top_per_period(frame: DataFrame, period: list[str], score: str, k: int, tie: list[str]) -> DataFrame:
    w = Window.partitionBy(*period).orderBy(F.col(score).desc_nulls_last(), *tie)
    return frame.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def average_ranks(frame: DataFrame, period: str, value: str, to: str) -> DataFrame:
    """frame with the rank of the value in its period, ties at their average. Distinct values are counted, and the counts numbered
    by ranges that are written first, so no task holds a period, and a range that is read again is the same."""
    spark = frame.sparkSession
    path, parts = scratch(spark, "ranks"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = frame.where(F.col(value).isNotNull()).groupBy(F.col(period).alias("__period"), F.col(value).alias("__value")).agg(F.count("*").alias("__c"))
    counts.repartitionByRange(parts, "__period", "__value").withColumn("__part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.partitionBy("__period").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranged.groupBy("__period", "__part").agg(F.sum("__c").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    own = Window.partitionBy("__period", "__part").orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("__own", F.coalesce(F.sum("__c").over(own), F.lit(0))).join(sums, ["__period", "__part"])
    ranked = ranked.select("__period", "__value", (F.col("__before") + F.col("__own") + (F.col("__c") + 1) / 2).alias(to))
    return frame.join(ranked, (F.col(period) == F.col("__period")) & (F.col(value) == F.col("__value")), "left").drop("__period", "__value")


def numbered_within(frame: DataFrame, groups: list[str], order: list[Column], to: str) -> DataFrame:
    """frame with the place (from 1) in its group's order. Ranges of groups and order are written and counted, so no task holds a group,
    and a range that is read again is the same."""
    spark = frame.sparkSession
    path, parts = scratch(spark, "places"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.repartitionByRange(parts, *groups, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = ranged.groupBy(*groups, "__part").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    own = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order))
    found = ranged.withColumn("__own", own).join(F.broadcast(sizes), [*groups, "__part"])
    return found.select(*frame.columns, (F.col("__own") + F.col("__before")).cast("int").alias(to))


def quantile_spread(frame: DataFrame, score: str, target: str, period: str, q: int = 5) -> DataFrame:
    """Mean target of the top bucket less that of the bottom one, per period with at least 2 q scored rows; ties share a rank."""
    rows = frame.where(F.col(score).isNotNull())
    sizes = rows.groupBy(period).agg(F.count("*").alias("__n")).where(F.col("__n") >= 2 * q)
    ranked = average_ranks(rows, period, score, "__r").join(sizes, period)
    bucket = F.least(F.greatest(F.ceil(F.col("__r") / F.col("__n") * q), F.lit(1)), F.lit(q))
    top, bottom = (F.avg(F.when(F.col("__b") == b, F.col(target))) for b in (q, 1))
    return ranked.withColumn("__b", bucket).groupBy(period).agg((top - bottom).alias("spread"), F.count("*").alias("n"))
