"""Grouped operators: price series, quality reports, rate statistics from summed counts, normalised odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import quantiles


def weekly_series(sales: DataFrame, series: str = "card_slug", min_sales: int = 2) -> DataFrame:
    """Median price, sales and share of best offers of each series, grade and week with enough sales."""
    week = f.week_start(F.col("sale_date")).alias("week")
    out = sales.groupBy(series, f.normalize_grade(F.col("grade")).alias("grade"), week).agg(
        F.median("price").alias("median_price"), F.count("*").alias("n_sales"), F.avg(F.col("best_offer").cast("double")).alias("best_offer_share")
    )
    return out.where(F.col("n_sales") >= min_sales)


def last_in_month(chart: DataFrame, keys: list[str], grades: list[str] | None = None) -> DataFrame:
    """The last price of each month; several prices of a day count as their median."""
    rows = chart if grades is None else chart.where(F.col("grade").isin(*grades))
    days = rows.groupBy(*keys, "date").agg(F.median("price").alias("price"))
    return days.groupBy(*keys, f.month_start(F.col("date")).alias("month")).agg(F.max_by("price", "date").alias("price"))


def flag_outliers(sales: DataFrame, keys: list[Column], price: str = "price", spread: float = 4.0, least: int = 5) -> DataFrame:
    """sales with `outlier`: outside the quartiles by more than `spread` times their distance, within a group that is large
    enough and not all alike. Null keys make a group of their own."""
    window = Window.partitionBy(*keys)
    q1, q3 = (F.percentile(price, F.lit(q)).over(window) for q in (0.25, 0.75))
    rows = sales.withColumns({"__q1": q1, "__q3": q3, "__n": F.count(price).over(window)})
    iqr = F.col("__q3") - F.col("__q1")
    outside = (F.col(price) < F.col("__q1") - spread * iqr) | (F.col(price) > F.col("__q3") + spread * iqr)
    return rows.withColumn("outlier", F.coalesce((F.col("__n") >= least) & (iqr > 0) & outside, F.lit(False))).drop("__q1", "__q3", "__n")


def sums_with_rates(logs: DataFrame, keys: list[str], role: str) -> DataFrame:
    """Season lines: OPS weighed by plate appearances, ERA by batters faced, neither rounded; (null, 0) without play."""
    if role == "hitting":
        on_base = (F.sum("hits") + F.sum("walks") + F.sum("hit_by_pitch")) / F.nullif(F.sum(F.expr("at_bats + walks + hit_by_pitch + sac_flies")), F.lit(0))
        slugging = F.sum("total_bases") / F.nullif(F.sum("at_bats"), F.lit(0))
        rate, weight = on_base + slugging, F.sum("plate_appearances")
    else:
        rate, weight = F.sum("earned_runs") * 27 / F.nullif(F.sum("outs"), F.lit(0)), F.sum("batters_faced")
    return logs.where(F.col("role") == role).groupBy(*keys).agg(rate.alias("rate"), F.coalesce(weight, F.lit(0)).alias("weight"))


def hitting_rates(sums: DataFrame) -> DataFrame:
    """avg, obp, slg of summed counts to 3 digits; ops is the sum of the rounded parts."""
    avg = f.ratio(F.col("hits"), F.col("at_bats"))
    obp = f.ratio(F.expr("hits + walks + hit_by_pitch"), F.expr("at_bats + walks + hit_by_pitch + sac_flies"))
    slg = f.ratio(F.col("total_bases"), F.col("at_bats"))
    return sums.withColumns({"avg": avg, "obp": obp, "slg": slg, "ops": F.round(obp + slg, 3)})


def pitching_rates(sums: DataFrame) -> DataFrame:
    """era, whip and strike-outs less walks a batter of summed counts to 3 digits."""
    era = f.ratio(F.col("earned_runs") * 27, F.col("outs"))
    whip = f.ratio(F.expr("(hits + walks) * 3"), F.col("outs"))
    return sums.withColumns({"era": era, "whip": whip, "k_bb_pct": f.ratio(F.expr("strike_outs - walks"), F.col("batters_faced"))})


def league_means(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the players' rates, weighed by their playing time."""
    return lines.groupBy(*keys).agg((F.sum(F.col("rate") * F.col("weight")) / F.nullif(F.sum(F.when(F.col("rate").isNotNull(), F.col("weight"))), F.lit(0))).alias("league_mean"))


#: The grades of which panels are built.
PANEL_SERIES = ("ungraded", "psa_9", "psa_10")


def liquidity(sales: DataFrame, chart: DataFrame, series: str = "card_slug", grades: tuple[str, ...] = PANEL_SERIES) -> DataFrame:
    """Sales, first and last of them, span, sales a week, points of the chart, share of outliers and flagged titles of each series
    and grade."""
    graded = sales.withColumn("grade", f.normalize_grade(F.col("grade"))).where(F.col("grade").isin(*grades))
    flagged = flag_outliers(graded, [F.col(series), F.col("grade"), f.month_start(F.col("sale_date"))])
    span = F.greatest(F.datediff(F.max("sale_date"), F.min("sale_date")), F.lit(1))
    of_sales = flagged.groupBy(series, "grade").agg(
        F.count("*").alias("n_sales"),
        F.min("sale_date").alias("first_sale"),
        F.max("sale_date").alias("last_sale"),
        span.alias("span_days"),
        (F.count("*") / (span / 7)).alias("sales_per_week"),
        F.avg(F.col("outlier").cast("double")).alias("outlier_share"),
        F.count(f.word_flag(F.col("title"))).alias("n_flagged"),
    )
    of_chart = chart.groupBy(series, "grade").agg(F.count("*").alias("n_chart_points"), F.min("date").alias("chart_first"), F.max("date").alias("chart_last"))
    return of_sales.join(of_chart, [series, "grade"], "left")


def league_means_to_date(logs: DataFrame) -> DataFrame:
    """(season, role, month, league_mean): mean of the players' season rates from rows before the month, weighed by playing time,
    for the months of the season's year. Rows are summed by month first, so a player's season is at most twelve rows; running sums hold
    from the month after to the player's next one, so no row for a player and later month travels."""
    month = F.month("date").alias("__m")
    counts = ["hits", "at_bats", "walks", "hit_by_pitch", "sac_flies", "total_bases", "plate_appearances", "earned_runs", "outs", "batters_faced"]
    months = logs.groupBy("entity_id", "season", "role", month).agg(*(F.sum(c).alias(c) for c in counts))
    ordered = Window.partitionBy("entity_id", "season", "role").orderBy("__m")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    hitting, c = F.col("role") == "hitting", {name: F.sum(name).over(so_far) for name in counts}
    on_base = (c["hits"] + c["walks"] + c["hit_by_pitch"]) / F.nullif(F.sum(F.expr("at_bats + walks + hit_by_pitch + sac_flies")).over(so_far), F.lit(0))
    ops, era = on_base + c["total_bases"] / F.nullif(c["at_bats"], F.lit(0)), c["earned_runs"] * 27 / F.nullif(c["outs"], F.lit(0))
    rate, weight = F.when(hitting, ops).otherwise(era), F.when(hitting, c["plate_appearances"]).otherwise(c["batters_faced"])
    lines = months.where("role IN ('hitting', 'pitching') AND __m IS NOT NULL").select("season", "role", "__m", F.lead("__m", 1, 12).over(ordered).alias("__until"), rate.alias("rate"), weight.alias("weight"))
    later = lines.where("weight > 0 AND __m < 12").withColumn("__to", F.explode(F.sequence(F.col("__m") + 1, F.col("__until"))))
    means = league_means(later, ["season", "role", "__to"])
    day = F.make_timestamp_ntz(F.col("season").cast("int"), F.col("__to"), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0))
    return means.select("season", "role", day.alias("month"), "league_mean")


def pedigree(logs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, minor_games, max_level, max_level_rank, rate_at_max_level) of rows below the top level: the rate (OPS, or ERA of
    pitchers) is that of the highest level alone."""
    rank = level_rank(F.col("level")).alias("__rank")
    counts = ["games", "hits", "at_bats", "walks", "hit_by_pitch", "sac_flies", "total_bases", "earned_runs", "outs", "strike_outs", "batters_faced"]
    levels = logs.where(rank.isNotNull()).groupBy(*keys, "role", "level", rank).agg(*(F.sum(c).alias(c) for c in counts))
    rated = pitching_rates(hitting_rates(levels)).withColumn("__rate", F.when(F.col("role") == "hitting", F.col("ops")).otherwise(F.col("era")))
    return rated.groupBy(*keys).agg(F.sum("games").alias("minor_games"), F.max_by("level", "__rank").alias("max_level"), F.max("__rank").alias("max_level_rank"), F.max_by("__rate", "__rank").alias("rate_at_max_level"))


#: Levels below the top one, from the lowest on.
LEVELS = ("a", "a_plus", "aa", "aaa")


def level_rank(level: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int")


def dedupe_checklist(rows: DataFrame, name: str, number: str, key: str) -> DataFrame:
    """Rows of one name and number, case and outer spaces of the name aside, keep the least key; `collides` marks numbers that
    several names have left."""
    plain = rows.withColumns({"__name": F.lower(F.trim(F.col(name))), "__number": F.lower(F.col(number).cast("string"))})
    kept = plain.groupBy("__name", "__number").agg(F.min_by(F.struct(name, number), key).alias("__r"), F.min(key).alias(key)).select("__number", f"__r.{name}", f"__r.{number}", key)
    names = kept.groupBy("__number").agg((F.count_distinct(name) > 1).alias("collides"))
    return kept.join(names, "__number").drop("__number")


def stale_series(weekly: DataFrame, as_of: Column, series: list[str], max_weeks: float = 3) -> DataFrame:
    """Series whose last week lies too far back."""
    last = weekly.groupBy(*series).agg(F.max("week").alias("last_week"))
    return last.withColumn("weeks_since", F.datediff(as_of, F.col("last_week")) / 7).where(F.col("weeks_since") > max_weeks)


def normalize_vig(prices: DataFrame, keys: list[str], raw: str = "raw_price") -> DataFrame:
    """Raw prices as shares of their event's total; totals that aren't positive are dropped."""
    total = F.sum(raw).over(Window.partitionBy(*keys))
    return prices.withColumn("__total", total).where(F.col("__total") > 0).withColumn("implied_prob", F.col(raw) / F.col("__total")).drop("__total")


def daily_last(history: DataFrame, keys: list[str], ts: str = "ts", value: str = "raw_price", tie: str = "event_id") -> DataFrame:
    """The last value of each day."""
    return history.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def abnormal_sum(windows: DataFrame, keys: list[str], offsets: list[int]) -> DataFrame:
    """Summed excess return over the offsets whose horizon holds; a group of nulls sums to 0."""
    kept = F.when(F.col("offset").isin(*offsets) & F.col("horizon_ok"), F.col("excess_ret"))
    return windows.groupBy(*keys).agg(F.coalesce(F.sum(kept), F.lit(0.0)).alias("car"))


def quartile_curve(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median, q1, q3, n): exact quartiles of groups of any size."""
    found = quantiles.quantiles(df, [by], [value], (0.25, 0.5, 0.75)).select(F.col(by).alias("__by"), F.col(value).alias("__q"))
    counts = df.groupBy(by).agg(F.count(value).alias("n")).join(found, F.col(by).eqNullSafe(F.col("__by")), "left")
    return counts.select(by, F.col("__q")[1].alias("median"), F.col("__q")[0].alias("q1"), F.col("__q")[2].alias("q3"), "n")


def value_shares(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("__all"), 4).alias("share"))


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_share), one pass."""
    wide = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return wide.select(F.stack(F.lit(len(columns)), *(x for c in columns for x in (F.lit(c), F.col(c)))).alias("column", "null_share"))
