"""Features of prediction markets at a grid of months, strictly before each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof


def month_features(grid: DataFrame, snapshots: DataFrame, deltas: tuple[int, ...] = (7, 30), key: str = "entity_id") -> DataFrame:
    """grid (key, entry_month, season) with odds_level, odds_delta_N and has_market.

    level: the last probability before the entry; delta_N: level less the last one before the earlier of entry - N days and the
    level's own day, null if there is none. Where nothing is earlier than the entry all are 0 without a market in the season and
    null with one. The level looks at all seasons, so it stays where an earlier season's market has ended.
    """
    rows = snapshots.select(key, F.col("day"), F.struct("day", "implied_prob").alias("__s"))
    found = asof.last_before(grid, rows, [key], "entry_month", "day", "__s", "__level")
    for n in deltas:
        cut = F.least(F.col("entry_month") - F.make_dt_interval(F.lit(n)), F.coalesce(F.col("__level.day"), F.col("entry_month")))
        found = asof.last_before(found.withColumn("__cut", cut), rows, [key], "__cut", "day", "__s", f"__d{n}").drop("__cut")
    markets = snapshots.select(key, F.year("day").alias("season")).distinct().withColumn("__m", F.lit(True))
    out = found.join(markets, [key, "season"], "left").withColumn("has_market", F.coalesce("__m", F.lit(False)))
    value = lambda c: F.when(~F.col("has_market") & F.col("__level").isNull(), F.lit(0.0)).otherwise(c)
    level = F.col("__level.implied_prob")
    return out.select(*grid.columns, "has_market", value(level).alias("odds_level"), *(value(level - F.col(f"__d{n}.implied_prob")).alias(f"odds_delta_{n}") for n in deltas))


def attach(frame: DataFrame, snapshots: DataFrame, **more) -> DataFrame:
    """frame with the odds features of its distinct (entity, entry month); its rows stay as many."""
    keys = ["entity_id", "entry_month", "season"]
    grid = frame.select(*keys).distinct()
    return frame.join(month_features(grid, snapshots, **more), keys, "left")


def acceptance(snapshots: DataFrame, prob: Column, day: Column) -> DataFrame:
    """One row of counts that must be 0: probabilities outside [0, 1] and rows without a day."""
    return snapshots.agg(F.count(F.when(~prob.between(0, 1) | prob.isNull(), 1)).alias("bad_prob"), F.count(F.when(day.isNull(), 1)).alias("no_day"), F.count("*").alias("n"))
