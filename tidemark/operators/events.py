"""Event registry, event windows over observed periods, and the price-incorporation study around events."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import asof, joins, quantiles, resample, windows


def from_logs(logs: DataFrame) -> DataFrame:
    """(entity_id, event_date, event_type, details): debut, three home runs, else four hits, ten strike-outs; a day's games
    count once, at their best."""
    days = logs.groupBy("entity_id", "date", "role").agg(F.max("home_runs").alias("hr"), F.max("hits").alias("h"), F.max("strike_outs").alias("k"))
    hitting, pitching = F.col("role") == "hitting", F.col("role") == "pitching"
    said = lambda n, what: F.concat(F.col(n).cast("string"), F.lit(what))
    kinds = F.array(
        F.when(hitting & (F.col("hr") >= 3), F.struct(F.lit("three_hr_game").alias("event_type"), said("hr", " HR").alias("details"))),
        F.when(hitting & (F.col("hr") < 3) & (F.col("h") >= 4), F.struct(F.lit("four_hit_game").alias("event_type"), said("h", " H").alias("details"))),
        F.when(pitching & (F.col("k") >= 10), F.struct(F.lit("ten_k_game").alias("event_type"), said("k", " K").alias("details"))),
    )
    games = days.select("entity_id", F.col("date").alias("event_date"), F.explode(F.array_compact(kinds)).alias("e")).select("entity_id", "event_date", "e.*")
    debuts = logs.groupBy("entity_id").agg(F.min("date").alias("event_date")).select("entity_id", "event_date", F.lit("debut").alias("event_type"), F.lit("first game").alias("details"))
    return games.unionByName(debuts)


def period_windows(events: DataFrame, panel: DataFrame, period: str, event_period: str, pre: int, post: int, gap: str, most_gap: int) -> DataFrame:
    """Panel rows around each event by observed periods: an offset counts periods that exist, not calendar ones.

    Events in a period that the panel lacks are skipped. horizon_ok: the return's gap is null or at most most_gap.
    """
    periods = panel.select(period).distinct()
    # Distinct periods are few (a calendar), so numbering them in one place is bounded.
    numbered = periods.select(period, F.dense_rank().over(Window.orderBy(period)).alias("__i"))
    at = events.join(numbered.select(F.col(period).alias(event_period), F.col("__i").alias("__c")), event_period)
    spread = at.withColumn("offset", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("__i", F.col("__c") + F.col("offset"))
    rows = spread.join(panel.join(numbered, period), ["entity_id", "__i"])
    return rows.withColumn("horizon_ok", F.col(gap).isNull() | (F.col(gap) <= most_gap)).drop("__i", "__c")


def sale_pairs(sales: DataFrame, events: DataFrame, grade: str, baseline_days: int = 56, window_days: int = 21, min_baseline: int = 3, min_window: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sales around events, each event with each of its entity's series and what becomes of the pair).

    Every series of the entity that ever sells in the grade makes a pair. status: kept, dropped_baseline (looked at first) or
    dropped_window. The baseline is [event - baseline_days, event), never after it; the window is +- window_days.
    """
    graded = sales.where(f.grade_is(F.col("grade"), grade) & F.col("price").isNotNull())
    rows = joins.event_sales(events, graded, "entity_id", baseline_days, window_days)
    near = F.abs(F.unix_micros(F.col("sale_date").cast("timestamp")) - F.unix_micros(F.col("event_date").cast("timestamp"))) <= window_days * 86_400_000_000
    before = F.col("sale_date") < F.col("event_date")
    keys = ["entity_id", "card_slug", "event_date"]
    base = rows.groupBy(*keys).agg(F.count(F.when(before, 1)).alias("n_base"), F.count(F.when(near, 1)).alias("n_window"), F.percentile(F.when(before, F.col("price")), F.lit(0.5)).alias("baseline"))
    pairs = events.select("entity_id", "event_date").join(graded.select("entity_id", "card_slug").distinct(), "entity_id")
    status = F.when(F.coalesce("n_base", F.lit(0)) < min_baseline, "dropped_baseline").when(F.col("n_window") < min_window, "dropped_window").otherwise("kept")
    return rows.where(near), pairs.join(base.hint("merge"), keys, "left").withColumn("status", status)


def sale_windows(sales: DataFrame, events: DataFrame, grade: str, **limits) -> tuple[DataFrame, DataFrame]:
    """(sales around events relative to the median before them, counts of pairs of event and series kept and dropped)."""
    rows, pairs = sale_pairs(sales, events, grade, **limits)
    return relative_windows(rows, pairs), pairs.groupBy("status").agg(F.count("*").alias("n"))


def relative_windows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    keys = ["entity_id", "card_slug", "event_date"]
    days = (F.unix_micros(F.col("sale_date").cast("timestamp")) - F.unix_micros(F.col("event_date").cast("timestamp"))) / 86_400_000_000
    kept = rows.join(pairs.where("status = 'kept'").select(*keys, "baseline").hint("merge"), keys)
    return kept.select(*keys, "sale_date", days.alias("t_days"), (F.col("price") / F.col("baseline")).alias("rel_price"))


def market_index(sales: DataFrame, grade: str, baseline_days: int = 28, min_series: int = 3) -> DataFrame:
    """Per day the median over series of their day's price relative to the median of their strictly earlier baseline_days."""
    day = F.unix_date(F.to_date("sale_date"))
    rows = sales.where(f.grade_is(F.col("grade"), grade)).withColumn("day", day)
    w = Window.partitionBy("card_slug").orderBy("day").rangeBetween(-baseline_days, -1)
    base = rows.withColumn("baseline", F.percentile("price", F.lit(0.5)).over(w))
    per_series = base.groupBy("card_slug", "day", "baseline").agg(F.median("price").alias("price")).where("baseline > 0")
    per_series = quantiles.stored(per_series.select("day", (F.col("price") / F.col("baseline")).alias("index")))
    days = per_series.groupBy("day").agg(F.count("*").alias("n_series")).where(F.col("n_series") >= min_series)
    return days.join(quantiles.median_of(per_series, ["day"], "index", "index"), "day", "left")


def on_grid(index: DataFrame, sales: DataFrame, grade: str) -> DataFrame:
    """The index with a row for each day from the grade's first sale to its last."""
    day = F.unix_date(F.to_date("sale_date"))
    bounds = sales.where(f.grade_is(F.col("grade"), grade) & F.col("price").isNotNull()).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return bounds.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day")).join(index, "day", "left")


def filled_index(sales: DataFrame, grade: str, most_gap: int = 3) -> DataFrame:
    """(day, index) of market_index() on its calendar, with gaps filled from either side; a calendar is numbered in one place."""
    grid = on_grid(market_index(sales, grade), sales, grade).withColumn("__one", F.lit(1))
    return windows.fill_gaps(grid, ["__one"], "day", "index", most_gap).select("day", F.col("filled").alias("index"))


def adjust_for_market(windows: DataFrame, index: DataFrame) -> DataFrame:
    """rel_adj: relative price over the market's (filled) index of the day; null where the index is."""
    return windows.withColumn("day", F.unix_date(F.to_date("sale_date"))).join(index.select("day", "index"), "day", "left").withColumn("rel_adj", F.col("rel_price") / F.nullif("index", F.lit(0.0))).drop("day", "index")


def lag_bins(windows: DataFrame, value: str, low: int = -14, high: int = 14) -> DataFrame:
    """Median by day relative to the event, and the sales there; a row for each day from low to high."""
    t = F.floor(F.col("t_days") + 0.5)
    rows = windows.where(F.col(value).isNotNull()).withColumn("t_bin", t).where(t.between(low, high))
    rows = quantiles.stored(rows.select("t_bin", value))
    found = rows.groupBy("t_bin").agg(F.count("*").alias("n_sales")).join(quantiles.median_of(rows, ["t_bin"], value, "median"), "t_bin")
    days = windows.sparkSession.range(low, high + 1).select(F.col("id").alias("t_bin"))
    return days.join(found, "t_bin", "left").withColumn("n_sales", F.coalesce("n_sales", F.lit(0)))


def weighted_medians(values: np.ndarray, owners: np.ndarray, weights: np.ndarray, block: int = 2048, total: np.ndarray | None = None, below: np.ndarray | None = None) -> np.ndarray:
    """For each column of weights (a row for each owner) the median of the values, each as often as its owner's weight says; NaN where
    all weights are 0. Values are sorted once; sums of weights run over blocks of them, for all columns at once.

    Where the values are only those of a bracket, `total` has the weights of all values and `below` of those under the bracket; NaN then
    says as well that the median lies elsewhere.
    """
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    if total is None:
        total = np.zeros(weights.shape[1], np.int64)
        for at in range(0, len(values), block):
            total += weights[owners[at : at + block]].sum(axis=0)
    ranks = [(total - 1) // 2, total // 2]
    found = [np.full(len(total), np.nan) for _ in ranks]
    before = np.zeros(len(total), np.int64) if below is None else below
    for at in range(0, len(values), block):
        until = before + np.cumsum(weights[owners[at : at + block]], axis=0, dtype=np.int64)
        for rank, out in zip(ranks, found, strict=True):
            here = np.flatnonzero((total > 0) & (before <= rank) & (rank < until[-1]))
            out[here] = values[at + (until[:, here] <= rank[here]).sum(axis=0)]
        before = until[-1]
    return (found[0] + found[1]) / 2


#: Steps of the grid of quantiles from which brackets are taken, and weights (of values in a bracket) that one task holds.
GRID, HELD = 200, 4_000_000


def _brackets(placed: DataFrame, spread: float) -> dict[int, tuple[float, float]]:
    """For each day the values between which the medians of resampled events lie.

    An event that comes w times moves the median's rank by at most half its sales for each time, so the deviation of that rank is at most
    half the root of the summed squares of the events' sales. The bracket is `spread` deviations wide on either side.
    """
    grid = F.percentile_approx("__v", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), quantiles.ACCURACY)
    sizes = placed.groupBy("t_bin", "__i").agg(F.count("*").alias("c")).groupBy("t_bin").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    out = {}
    for day in sizes.join(placed.groupBy("t_bin").agg(grid.alias("g")), "t_bin").collect():  # a row for each day
        share = (spread * day["q"] ** 0.5 / 2 + 1) / day["n"] + 2 / quantiles.ACCURACY
        low, high = math.floor((0.5 - share) * GRID), math.ceil((0.5 + share) * GRID)
        out[day["t_bin"]] = (day["g"][low] if low > 0 else -math.inf, day["g"][high] if high < GRID else math.inf)
    return out


def _replicated(placed: DataFrame, brackets: dict[int, tuple[float, float]], n: int, n_reps: int, seed: int, part: int) -> DataFrame:
    """(t_bin, m): the day's median of each replicate that draws a sale of the day; null where it doesn't lie in the day's bracket."""
    spark, parts, block = placed.sparkSession, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), resample.BLOCK
    of_day = spark.createDataFrame([(d, *b) for d, b in brackets.items()], "t_bin bigint, __low double, __high double")
    inner = F.col("__v").between(F.col("__low"), F.col("__high"))
    rows = placed.join(F.broadcast(of_day), "t_bin")  # a row for each day
    most = rows.groupBy("t_bin").agg(F.sum(inner.cast("int")).alias("c")).agg(F.max("c")).first()[0]
    part = max(1, min(part, HELD // max(most, 1), -(-n_reps * -(-n // block) // (2 * parts))))
    of_event = rows.groupBy("__i", "t_bin").agg(F.count("*").alias("__all"), F.sum((F.col("__v") < F.col("__low")).cast("bigint")).alias("__below"), F.collect_list(F.when(inner, F.col("__v"))).alias("__in"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        """The sales of a day and block: for each event its place, its sales and those below the bracket; for each sale in it, place and value."""
        at = (rows["__i"].to_numpy() % block).astype("<u2")
        inside, own = np.concatenate(rows["__in"].to_list()).astype("<f8"), np.repeat(at, rows["__in"].map(len))
        cells = {"at": at, "all": rows["__all"].to_numpy("<i8"), "below": rows["__below"].to_numpy("<i8"), "owners": own, "inside": inside}
        return pd.DataFrame({"block": [rows["__i"].iloc[0] // block], "t_bin": rows["t_bin"].iloc[0], **{k: [v.tobytes()] for k, v in cells.items()}})

    def weighed(draws: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        weights = np.zeros((part, block), np.uint32)
        for rep, times in zip(draws["rep"], draws["times"], strict=True):
            weights[rep % part, : len(times)] += np.frombuffer(times, np.uint8)
        out = []
        for day in days.itertuples():
            own = weights[:, np.frombuffer(day.at, "<u2")]
            sums = [(own @ np.frombuffer(x, "<i8")).astype("<i8").tobytes() for x in (day.all, day.below)]
            out.append((day.t_bin, day.part, *sums, day.inside, weights[:, np.frombuffer(day.owners, "<u2")].T.astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["t_bin", "part", "total", "below", "inside", "weights"])

    def medians(group: pd.DataFrame) -> pd.DataFrame:
        total, below = (sum(np.frombuffer(x, "<i8") for x in group[c]) for c in ("total", "below"))
        values = np.concatenate([np.frombuffer(x, "<f8") for x in group["inside"]])
        weights = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, part) for x in group["weights"]])
        found = weighted_medians(values, np.arange(len(values)), weights, total=total, below=below)
        return pd.DataFrame({"t_bin": group["t_bin"].iloc[0], "m": found[total > 0]})

    days = of_event.groupBy(F.floor(F.col("__i") / block).alias("__block"), "t_bin").applyInPandas(packed, "block bigint, t_bin bigint, at binary, all binary, below binary, owners binary, inside binary")
    copies = days.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n_reps - 1) // part).cast("bigint"))))
    draws = resample.block_weights(spark, n, n_reps, seed, part)
    met = draws.groupBy("block", "part").cogroup(copies.groupBy("block", "part")).applyInPandas(weighed, "t_bin bigint, part bigint, total binary, below binary, inside binary, weights binary")
    return met.groupBy("t_bin", "part").applyInPandas(medians, "t_bin bigint, m double")


def lag_bounds(windows: DataFrame, value: str, n_reps: int = 2000, seed: int = 42, low: int = -14, high: int = 14, least_reps: int = 20, part: int = 250, spread: float = 8.0) -> DataFrame:
    """(t_bin, ci_lo, ci_hi): bounds of the medians over resampled events; all sales of an event that is drawn come along, as
    often as it is drawn.

    Events are numbered, and what a replicate draws from a block of them is one row of a byte an event, which meets the block's sales; no
    draw is a row. Of the sales only those near the day's median are sorted: the others are counted, by replicate, below and in all. A day
    of which any replicate's median lies elsewhere is done again with all its sales, so the bounds are exact whatever the brackets are.
    """
    t = F.floor(F.col("t_days") + 0.5)
    event = ["entity_id", "event_date"]
    rows = quantiles.stored(windows.where(F.col(value).isNotNull() & t.between(low, high)).select(*event, t.alias("t_bin"), F.col(value).cast("double").alias("__v")))
    pool = resample.numbered(rows.select(*event).distinct(), event)
    # A merge: the pool's file is small beside what it takes in memory, so a broadcast by its size would fill the driver.
    placed = quantiles.stored(rows.join(pool.hint("merge"), event).select("__i", "__n", "t_bin", "__v"))
    n = placed.agg(F.max("__n")).first()[0] or 0
    left, reps = _brackets(placed, spread), windows.sparkSession.createDataFrame([], "t_bin bigint, m double")
    while left:
        found = quantiles.stored(_replicated(placed, left, n, n_reps, seed, part))
        missed = [r["t_bin"] for r in found.where("m IS NULL").select("t_bin").distinct().collect()]
        reps = reps.union(found.where(~F.col("t_bin").isin(missed)))
        left = dict.fromkeys(missed, (-math.inf, math.inf))
    return reps.groupBy("t_bin").agg(F.percentile("m", F.lit(0.025)).alias("ci_lo"), F.percentile("m", F.lit(0.975)).alias("ci_hi"), F.count("*").alias("__n")).where(F.col("__n") >= least_reps).drop("__n")


def estimate_lag(curve: DataFrame, threshold: float = 1.0, hold: int = 3, least_cover: float = 0.8) -> DataFrame:
    """One row: lag_days, the first day from 0 on from which `hold` consecutive days lie above the threshold by their lower bound;
    pre_cover_share, the share of days before 0 whose bounds hold the threshold between them; pre_ok, if that is enough."""
    w = Window.orderBy("t_bin")  # a curve has a few dozen rows
    ahead = w.rowsBetween(0, hold - 1)
    rows = curve.withColumns({"__low": F.min("ci_lo").over(ahead), "__n": F.count("ci_lo").over(ahead), "__end": F.max("t_bin").over(ahead)})
    good = (F.col("t_bin") >= 0) & (F.col("__low") > threshold) & (F.col("__n") == hold) & (F.col("__end") - F.col("t_bin") == hold - 1)
    covers = F.coalesce((F.col("ci_lo") <= threshold) & (F.col("ci_hi") >= threshold), F.lit(False))
    share = F.coalesce(F.avg(F.when(F.col("t_bin") < 0, covers.cast("double"))), F.lit(0.0))
    return rows.agg(F.min(F.when(good, F.col("t_bin"))).alias("lag_days"), (share >= least_cover).alias("pre_ok"), share.alias("pre_cover_share"))


def half_life(curve: DataFrame, low: float = 0.25, high: float = 14.0, step: float = 0.25) -> DataFrame:
    """(h, a): y = a (1 - 2^(-t / h)) for t >= 0 over a grid of h, y = median - 1; null without enough rise or days."""
    grid = curve.sparkSession.range(int(round((high - low) / step)) + 1).select((F.lit(low) + F.col("id") * step).alias("h"))
    rows = curve.where("t_bin >= 0 AND median IS NOT NULL").select(F.col("t_bin").alias("t"), (F.col("median") - 1).alias("y"))
    both = rows.crossJoin(F.broadcast(grid)).withColumn("g", 1 - F.pow(F.lit(2.0), -F.col("t") / F.col("h")))
    sums = both.groupBy("h").agg(F.sum(F.col("y") * F.col("g")).alias("yg"), F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    fit = sums.withColumn("a", F.col("yg") / F.nullif("gg", F.lit(0.0))).withColumn("sse", F.round(F.col("yy") - F.col("a") * F.col("yg"), 12))
    best = fit.agg(F.min_by(F.struct("h", "a", "sy", "n"), F.struct("sse", "h")).alias("b"))
    fine = (F.col("b.sy") > 0) & (F.col("b.n") >= 5) & (F.col("b.a") > 0.01)
    return best.select(F.when(fine, F.col("b.h")).alias("half_life"), F.when(fine, F.col("b.a")).alias("amplitude"))


def classify(windows: DataFrame, keys: list[str], value: str = "rel_adj", early: float = 3.5, late: float = 7.0, no_move: float = 0.02, late_move: float = 0.05, fast: float = 0.8) -> DataFrame:
    """By the medians before, soon after and long after: no_adjustment if the price doesn't rise by more than no_move, fast if
    most of the rise is there soon, late if next to nothing of a rise of late_move is, else intermediate; insufficient below two
    sales in a part. Sales without a value don't count, so an event with none has no row."""
    t = F.col("t_days")
    part = {"pre": t < 0, "early": (t >= 0) & (t < early), "late": t >= late}
    sums = [x for name, cond in part.items() for x in (F.percentile(F.when(cond, F.col(value)), F.lit(0.5)).alias(name), F.count(F.when(cond, 1)).alias(f"n_{name}"))]
    rows = windows.where(F.col(value).isNotNull()).groupBy(*keys).agg(*sums)
    move, soon = F.col("late") - F.col("pre"), F.col("early") - F.col("pre")
    kind = (
        F.when(F.least("n_pre", "n_early", "n_late") < 2, "insufficient")
        .when(move <= no_move, "no_adjustment")
        .when(soon / move >= fast, "fast")
        .when((F.abs(soon) <= no_move) & (move >= late_move), "late")
        .otherwise("intermediate")
    )
    return rows.withColumn("adjustment", kind)


def strata(events: DataFrame, top_logs: DataFrame) -> DataFrame:
    """(entity_id, event_date, stratum): prospect up to the end of the first season at the top level, established afterwards."""
    found = asof.asof_aggregate(events.select("entity_id", "event_date"), top_logs, ["entity_id"], "event_date", "date", {"first_season": (F.min, F.col("season"))}, inclusive=False)
    young = F.col("first_season").isNull() | (f.season_year(F.col("event_date")) == F.col("first_season"))
    return found.select("entity_id", "event_date", F.when(young, "prospect").otherwise("established").alias("stratum"))


def adjustment_grid(sales: DataFrame, events: DataFrame, of_events: DataFrame, grades: tuple[str, ...] = ("ungraded", "psa_10"), least_kept: int = 5, dead: float = 0.8, plausible: float = 0.2) -> DataFrame:
    """A row for each grade and stratum (and `all`): pairs kept and dropped, sales without an index, shares of the adjustment
    classes, and what they say. Cells with too few pairs are skipped: they have no shares.

    read_out: dead if the fast share reaches `dead`, plausible if the late share reaches `plausible`, else intermediate.
    """
    cells = of_events.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("stratum"))))
    keys, event, kinds = ["grade_class", "stratum"], ["entity_id", "event_date"], ("fast", "late", "intermediate", "no_adjustment", "insufficient")
    pairs, sold = [], []
    for grade in grades:
        rows, of_pairs = sale_pairs(sales, events, grade)
        pairs.append(of_pairs.withColumn("grade_class", F.lit(grade)))
        sold.append(adjust_for_market(relative_windows(rows, of_pairs), filled_index(sales, grade)).withColumn("grade_class", F.lit(grade)))
    of_pairs, windows = (reduce(lambda a, b: a.unionByName(b), x) for x in (pairs, sold))
    said = of_pairs.join(cells, event).groupBy(*keys).agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("kept", "dropped_baseline", "dropped_window")))
    unadjusted = windows.join(cells, event).groupBy(*keys).agg(F.count(F.when(F.col("rel_adj").isNull(), 1)).alias("n_unadjusted"))
    classes = classify(windows, ["grade_class", *event]).join(cells, event).groupBy(*keys).agg(*(F.round(F.avg((F.col("adjustment") == k).cast("double")), 4).alias(f"share_{k}") for k in kinds))
    out = said.join(unadjusted, keys, "left").join(classes, keys, "left")
    enough = F.col("kept") >= least_kept
    shares = {f"share_{k}": F.when(enough, F.col(f"share_{k}")) for k in kinds}
    read_out = F.when(~enough, "skipped").when(F.col("share_fast") >= dead, "dead").when(F.col("share_late") >= plausible, "plausible").otherwise("intermediate")
    return out.withColumns({**shares, "n_unadjusted": F.coalesce("n_unadjusted", F.lit(0)), "read_out": read_out})
