"""Queries of the price series: aggregates, windows, as-of statistics and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import aggregates as a
from tidemark.operators import asof, windows
from tidemark.plans.registry import query
from tidemark.sources import views

KEYS = ["card_slug", "entity_id", "grade"]


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to so many digits: sums in another order differ in the last ones. Prices and medians (`exact`) don't."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


@query("SELECT card_slug, grade, week, median_price, n_sales, round(best_offer_share, 6) AS best_offer_share FROM v_weekly", "v_weekly")
def a01_weekly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.weekly_series(views.sales(spark, sf_dir)), exact=("median_price",))


@query(
    """WITH q AS (SELECT card_slug, entity_id, grade, sale_date, price, best_offer,
         quantile_cont(price, 0.25) OVER w AS q1, quantile_cont(price, 0.75) OVER w AS q3, count(price) OVER w AS n
         FROM v_sales WINDOW w AS (PARTITION BY card_slug, grade, date_trunc('month', sale_date))),
       k AS (SELECT * FROM q WHERE NOT (n >= 5 AND q3 > q1 AND (price < q1 - 4 * (q3 - q1) OR price > q3 + 4 * (q3 - q1)))),
       w AS (SELECT card_slug, coalesce(grade, 'ungraded') AS grade, CAST(date_trunc('week', sale_date) AS TIMESTAMP) AS week, median(price) AS median_price, count(*) AS n_sales FROM k GROUP BY ALL HAVING count(*) >= 2),
       r AS (SELECT *, ln(median_price / lag(median_price) OVER s) AS log_ret, CAST(date_diff('day', lag(week) OVER s, week) AS INTEGER) AS days_since_prev FROM w WINDOW s AS (PARTITION BY card_slug, grade ORDER BY week)),
       m AS (SELECT grade, week, median(log_ret) AS market_median FROM r GROUP BY ALL)
       SELECT r.card_slug, r.grade, r.week, median_price, n_sales, round(log_ret, 6) AS log_ret, days_since_prev, round(log_ret - market_median, 6) AS excess_ret
       FROM r LEFT JOIN m ON r.grade = m.grade AND r.week = m.week""",
    "v_sales",
)
def n_weekly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers out, weekly medians, returns between observed weeks, excess over the market's median of the week."""
    flagged = a.flag_outliers(views.sales(spark, sf_dir), [F.col("card_slug"), F.col("grade"), f.month_start(F.col("sale_date"))])
    weekly = a.weekly_series(flagged.where(~F.col("outlier"))).drop("best_offer_share")
    panel = windows.observed_returns(weekly, ["card_slug", "grade"], "week", "median_price")
    return rounded(windows.market_excess(panel, ["grade", "week"]).drop("market_median"), exact=("median_price",))


@query("SELECT card_slug, CAST(date_trunc('month', date) AS TIMESTAMP) AS month, max_by(price, date) AS price, min_by(entity_id, date) AS entity_id FROM v_chart WHERE grade = 'psa_10' GROUP BY 1, 2", "v_chart")
def a02_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chart(spark, sf_dir).where(F.col("grade") == "psa_10")
    return rows.groupBy("card_slug", f.month_start(F.col("date")).alias("month")).agg(F.max_by("price", "date").alias("price"), F.min_by("entity_id", "date").alias("entity_id"))


@query("SELECT * FROM v_month_ends", "v_month_ends")
def a03_series_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])


HIT_SUMS = "sum(hits) AS hits, sum(at_bats) AS at_bats, sum(walks) AS walks, sum(hit_by_pitch) AS hit_by_pitch, sum(sac_flies) AS sac_flies, sum(total_bases) AS total_bases"


@query(
    """WITH c AS (SELECT DISTINCT entity_id, season, CAST(date_trunc('month', date) AS TIMESTAMP) AS cut FROM v_logs),
       s AS (SELECT c.entity_id, c.season, c.cut, count(l.date) AS n_rows, coalesce(sum(hits), 0)::BIGINT AS hits, coalesce(sum(at_bats), 0)::BIGINT AS at_bats, coalesce(sum(walks), 0)::BIGINT AS walks,
         coalesce(sum(hit_by_pitch), 0)::BIGINT AS hit_by_pitch, coalesce(sum(sac_flies), 0)::BIGINT AS sac_flies, coalesce(sum(total_bases), 0)::BIGINT AS total_bases
         FROM c LEFT JOIN v_logs l ON l.entity_id = c.entity_id AND l.season = c.season AND l.date <= c.cut GROUP BY ALL)
       SELECT *, round(hits / nullif(at_bats, 0) + 1e-9, 3) AS avg, round((hits + walks + hit_by_pitch) / nullif(at_bats + walks + hit_by_pitch + sac_flies, 0) + 1e-9, 3) AS obp,
         round(total_bases / nullif(at_bats, 0) + 1e-9, 3) AS slg,
         round(round((hits + walks + hit_by_pitch) / nullif(at_bats + walks + hit_by_pitch + sac_flies, 0) + 1e-9, 3) + round(total_bases / nullif(at_bats, 0) + 1e-9, 3), 3) AS ops FROM s""",
    "v_logs",
)
def j04_a04_hitting_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = views.logs(spark, sf_dir)
    cuts = logs.select("entity_id", "season", f.month_start(F.col("date")).alias("cut")).distinct()
    counts = ["hits", "at_bats", "walks", "hit_by_pitch", "sac_flies", "total_bases"]
    return a.hitting_rates(asof.stats_to_date(cuts, logs, ["entity_id", "season"], "cut", "date", counts))


@query(
    """WITH c AS (SELECT DISTINCT entity_id, season, CAST(date_trunc('month', date) AS TIMESTAMP) AS cut FROM v_logs),
       s AS (SELECT c.entity_id, c.season, c.cut, count(l.date) AS n_rows, coalesce(sum(earned_runs), 0)::BIGINT AS earned_runs, coalesce(sum(outs), 0)::BIGINT AS outs, coalesce(sum(hits), 0)::BIGINT AS hits,
         coalesce(sum(walks), 0)::BIGINT AS walks, coalesce(sum(strike_outs), 0)::BIGINT AS strike_outs, coalesce(sum(batters_faced), 0)::BIGINT AS batters_faced
         FROM c LEFT JOIN v_logs l ON l.entity_id = c.entity_id AND l.season = c.season AND l.date <= c.cut GROUP BY ALL)
       SELECT *, round(earned_runs * 27 / nullif(outs, 0) + 1e-9, 3) AS era, round((hits + walks) * 3 / nullif(outs, 0) + 1e-9, 3) AS whip, round((strike_outs - walks) / nullif(batters_faced, 0), 3) AS k_bb_pct FROM s""",
    "v_logs",
)
def a05_pitching_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = views.logs(spark, sf_dir)
    cuts = logs.select("entity_id", "season", f.month_start(F.col("date")).alias("cut")).distinct()
    counts = ["earned_runs", "outs", "hits", "walks", "strike_outs", "batters_faced"]
    return a.pitching_rates(asof.stats_to_date(cuts, logs, ["entity_id", "season"], "cut", "date", counts))


@query(
    """SELECT entity_id, season, round((sum(hits) + sum(walks) + sum(hit_by_pitch)) / nullif(sum(at_bats + walks + hit_by_pitch + sac_flies), 0) + sum(total_bases) / nullif(sum(at_bats), 0), 6) AS rate,
       CAST(sum(plate_appearances) AS BIGINT) AS weight FROM v_logs WHERE role = 'hitting' GROUP BY 1, 2""",
    "v_logs",
)
def a06_season_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.sums_with_rates(views.logs(spark, sf_dir), ["entity_id", "season"], "hitting"))


@query(
    """SELECT entity_id, season, round(sum(earned_runs) * 27 / nullif(sum(outs), 0), 6) AS rate, CAST(sum(batters_faced) AS BIGINT) AS weight
       FROM v_logs WHERE role = 'pitching' AND date < make_timestamp(CAST(season AS BIGINT), 7, 1, 0, 0, 0.0) GROUP BY 1, 2""",
    "v_logs",
)
def a07_pace_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season rows strictly before the cut, here the middle of the season."""
    cut = F.make_timestamp_ntz(F.col("season").cast("int"), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0))
    return rounded(a.sums_with_rates(views.logs(spark, sf_dir).where(F.col("date") < cut), ["entity_id", "season"], "pitching"))


OPS_SQL = "(sum(hits) + sum(walks) + sum(hit_by_pitch)) / nullif(sum(at_bats + walks + hit_by_pitch + sac_flies), 0) + sum(total_bases) / nullif(sum(at_bats), 0)"
LINE_SQL = f"CASE WHEN role = 'hitting' THEN {OPS_SQL} ELSE sum(earned_runs) * 27 / nullif(sum(outs), 0) END AS rate, CAST(CASE WHEN role = 'hitting' THEN sum(plate_appearances) ELSE sum(batters_faced) END AS BIGINT) AS weight"
LEAGUE_SQL = f"""lp AS (SELECT entity_id, season, role, m, {LINE_SQL} FROM {{logs}} l, (SELECT unnest(range(2, 13)) AS m) WHERE month(l.date) < m GROUP BY entity_id, season, role, m),
       lg AS (SELECT season, role, CAST(make_timestamp(CAST(season AS BIGINT), m, 1, 0, 0, 0.0) AS TIMESTAMP) AS month, sum(rate * weight) / nullif(sum(CASE WHEN rate IS NOT NULL THEN weight END), 0) AS league_mean FROM lp WHERE weight > 0 GROUP BY ALL)"""


@query(f"WITH {LEAGUE_SQL.format(logs='v_logs')} SELECT season, role, month, round(league_mean, 6) AS league_mean FROM lg", "v_logs")
def a08_league_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hitters and pitchers, at each month from the rows before it."""
    return rounded(a.league_means_to_date(views.logs(spark, sf_dir)))


OPS3_SQL = "round(round((sum(hits) + sum(walks) + sum(hit_by_pitch)) / nullif(sum(at_bats + walks + hit_by_pitch + sac_flies), 0) + 1e-9, 3) + round(sum(total_bases) / nullif(sum(at_bats), 0) + 1e-9, 3), 3)"


@query(
    f"""WITH g AS (SELECT entity_id, level, list_position(['a', 'a_plus', 'aa', 'aaa'], level) AS rk, sum(games) AS games, CASE WHEN role = 'hitting' THEN {OPS3_SQL} ELSE round(sum(earned_runs) * 27 / nullif(sum(outs), 0) + 1e-9, 3) END AS rate
         FROM v_logs WHERE date <= TIMESTAMP '1998-12-31' AND level <> 'mlb' GROUP BY entity_id, level, role)
       SELECT entity_id, CAST(sum(games) AS BIGINT) AS minor_games, max_by(level, rk) AS max_level, CAST(max(rk) AS INTEGER) AS max_level_rank, max_by(rate, rk) AS rate_at_max_level FROM g GROUP BY 1""",
    "v_logs",
)
def a09_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games below the top level up to the cut, the highest level and the rate there."""
    rows = views.logs(spark, sf_dir).where(F.col("date") <= F.lit("1998-12-31").cast("timestamp_ntz"))
    return a.pedigree(rows, ["entity_id"])


@query("""SELECT m.card_slug, m.grade, m.month, count(r.event_date) AS n_awards FROM v_month_ends m LEFT JOIN v_registry r ON r.entity_id = m.entity_id AND r.event_date <= m.month GROUP BY ALL""", "v_month_ends", "v_registry")
def a10_awards_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])
    counted = asof.count_to_date(months, views.registry(spark, sf_dir), ["entity_id"], "month", "event_date", "n_awards")
    return counted.select("card_slug", "grade", "month", F.col("n_awards").cast("bigint").alias("n_awards"))


STAGE_SQL = """CASE WHEN first_game IS NULL THEN 'prospect' WHEN season - first_season <= 0 THEN 'rookie_year' WHEN season - first_season = 1 THEN 'sophomore' ELSE 'established' END"""


@query(
    f"""WITH e AS (SELECT m.card_slug, m.grade, m.month, min(l.date) AS first_game, min(l.season) AS first_season, year(m.month) + CASE WHEN month(m.month) >= 11 THEN 1 ELSE 0 END AS season
        FROM v_month_ends m LEFT JOIN v_logs l ON l.entity_id = m.entity_id AND l.date < m.month AND l.level = 'mlb' GROUP BY ALL)
        SELECT card_slug, grade, month, {STAGE_SQL} AS career_stage FROM e""",
    "v_month_ends",
    "v_logs",
)
def a11_career_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])
    top = views.logs(spark, sf_dir).where(F.col("level") == "mlb")
    found = asof.asof_aggregate(months, top, ["entity_id"], "month", "date", {"first_game": (F.min, F.col("date")), "first_season": (F.min, F.col("season"))}, inclusive=False)
    return found.withColumn("season", f.season_year(F.col("month"))).select("card_slug", "grade", "month", F.expr(STAGE_SQL).alias("career_stage"))


@query(
    """WITH r AS (SELECT card_slug, grade, month, price, ln(price / lag(price) OVER (PARTITION BY card_slug, grade ORDER BY month)) AS log_ret FROM v_month_ends),
       m AS (SELECT grade, month, median(log_ret) AS market_median FROM r GROUP BY ALL)
       SELECT r.card_slug, r.grade, r.month, round(market_median, 6) AS market_median, round(log_ret - market_median, 6) AS excess_ret FROM r JOIN m ON r.grade = m.grade AND r.month = m.month""",
    "v_month_ends",
)
def a12_market_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])
    panel = windows.market_excess(windows.observed_returns(months, ["card_slug", "grade"], "month", "price", "months"), ["grade", "month"])
    return rounded(panel.select("card_slug", "grade", "month", "market_median", "excess_ret"))


OUTLIER_SQL = """SELECT *, n >= 5 AND q3 > q1 AND (price < q1 - {k} * (q3 - q1) OR price > q3 + {k} * (q3 - q1)) AS outlier FROM (
    SELECT card_slug, entity_id, grade, sale_date, price, title, quantile_cont(price, 0.25) OVER w AS q1, quantile_cont(price, 0.75) OVER w AS q3, count(price) OVER w AS n
    FROM {src} WINDOW w AS (PARTITION BY card_slug, grade, date_trunc('month', sale_date)))"""


@query(
    f"""WITH g AS (SELECT card_slug, entity_id, coalesce(grade, 'ungraded') AS grade, sale_date, price, title FROM v_sales), q AS ({OUTLIER_SQL.format(k=4, src='g')}),
       s AS (SELECT card_slug, grade, count(*) AS n_sales, min(sale_date) AS first_sale, max(sale_date) AS last_sale, greatest(date_diff('day', min(sale_date), max(sale_date)), 1) AS span, avg(CASE WHEN outlier THEN 1.0 ELSE 0.0 END) AS outlier_share,
         count(*) FILTER (regexp_matches(title, '(?i)\\b({'|'.join(f.CONTAMINATED)})\\b')) AS n_flagged FROM q GROUP BY ALL),
       c AS (SELECT card_slug, grade, count(*) AS n_chart_points, min(date) AS chart_first, max(date) AS chart_last FROM v_chart GROUP BY ALL)
       SELECT s.card_slug, s.grade, n_sales, first_sale, last_sale, CAST(span AS INTEGER) AS span_days, round(n_sales / (span / 7), 6) AS sales_per_week, round(outlier_share, 6) AS outlier_share, n_flagged, n_chart_points, chart_first, chart_last
       FROM s LEFT JOIN c ON s.card_slug = c.card_slug AND s.grade = c.grade""",
    "v_sales",
    "v_chart",
)
def a13_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.liquidity(views.sales(spark, sf_dir), views.chart(spark, sf_dir)))


@query(
    """WITH s AS (SELECT card_slug, coalesce(grade, 'ungraded') AS grade, count(*) AS n_sales, count(*) / (greatest(date_diff('day', min(sale_date), max(sale_date)), 1) / 7) AS per_week FROM v_sales GROUP BY ALL),
       c AS (SELECT card_slug, grade, count(*) AS n_points FROM v_chart GROUP BY ALL)
       SELECT card_slug, grade, per_week >= 0.5 AND coalesce(n_points, 0) >= 18 AS recommended, per_week >= 0.3 OR coalesce(n_points, 0) >= 36 AS selected
       FROM s LEFT JOIN c USING (card_slug, grade) WHERE per_week >= 0.3 OR coalesce(n_points, 0) >= 18""",
    "v_sales",
    "v_chart",
)
def a14_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules: both limits for recommendation, either of two others for modelling."""
    rows = a.liquidity(views.sales(spark, sf_dir), views.chart(spark, sf_dir)).withColumn("points", F.coalesce("n_chart_points", F.lit(0)))
    kept = rows.where("sales_per_week >= 0.3 OR points >= 18")
    return kept.select("card_slug", "grade", F.expr("sales_per_week >= 0.5 AND points >= 18").alias("recommended"), F.expr("sales_per_week >= 0.3 OR points >= 36").alias("selected"))


@query(
    """SELECT card_slug, grade, max(week) AS last_week, round(date_diff('day', max(week), TIMESTAMP '2001-11-01') / 7, 6) AS weeks_since FROM v_weekly GROUP BY 1, 2
       HAVING date_diff('day', max(week), TIMESTAMP '2001-11-01') / 7 > 3""",
    "v_weekly",
)
def a15_stale_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = a.weekly_series(views.sales(spark, sf_dir))
    return rounded(a.stale_series(weekly, F.lit("2001-11-01").cast("timestamp_ntz"), ["card_slug", "grade"]))


@query(f"SELECT card_slug, grade, sale_date, price FROM ({OUTLIER_SQL.format(k=1, src='v_sales')}) WHERE outlier", "v_sales")
def a16_quarantine_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = a.flag_outliers(views.sales(spark, sf_dir), [F.col("card_slug"), F.col("grade"), f.month_start(F.col("sale_date"))], spread=1.0)
    return flagged.where("outlier").select("card_slug", "grade", "sale_date", "price")


@query(
    """WITH d AS (SELECT event, market_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, arg_max(raw_price, (ts, event_id)) AS raw_price FROM v_odds GROUP BY ALL)
       SELECT event, market_id, day, raw_price, round(raw_price / sum(raw_price) OVER (PARTITION BY event, day), 9) AS implied_prob FROM d QUALIFY sum(raw_price) OVER (PARTITION BY event, day) > 0""",
    "v_odds",
)
def a17_a18_implied_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = a.daily_last(views.odds(spark, sf_dir), ["event", "market_id"])
    return rounded(a.normalize_vig(daily, ["event", "day"]), 9).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    """SELECT CAST(year(sale_date) - 1995 AS BIGINT) AS years_since, round(median(price), 6) AS median, round(quantile_cont(price, 0.25), 6) AS q1, round(quantile_cont(price, 0.75), 6) AS q3, count(price) AS n FROM v_sales GROUP BY 1""",
    "v_sales",
)
def a20_years_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sales(spark, sf_dir).withColumn("years_since", (F.year("sale_date") - 1995).cast("bigint"))
    return rounded(a.quartile_curve(rows, "years_since", "price"))


@query(
    """SELECT lower(p_name) AS name, min(p_size) AS class_year, arg_min(p_type, (p_size, CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END, p_type)) AS pick FROM part GROUP BY 1"""
)
def a21_first_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest class of each name, and of that year the preferred family."""
    parts = views.read(spark, sf_dir, "part")
    order = F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1)
    return parts.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_size").alias("class_year"), F.min_by("p_type", F.struct("p_size", order, "p_type")).alias("pick"))


CHECKLIST_SQL = "(SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE ' ' || p_name END AS name, 'A' || CAST(p_size AS VARCHAR) AS number FROM part)"


@query(
    f"""WITH c AS {CHECKLIST_SQL}, d AS (SELECT lower(number) AS n, min_by(name, id) AS name, min_by(number, id) AS number, min(id) AS id FROM c GROUP BY lower(trim(name)), lower(number))
       SELECT id, name, number, count(DISTINCT name) OVER (PARTITION BY n) > 1 AS collides FROM d"""
)
def a22_dedupe_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    rows = views.read(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"), F.concat(F.lit("A"), F.col("p_size").cast("string")).alias("number"))
    return a.dedupe_checklist(rows, "name", "number", "id")


@query("""SELECT entity_id, min(date) AS event_date, 'debut' AS event_type FROM v_logs WHERE level = 'mlb' GROUP BY 1 UNION ALL SELECT entity_id, event_date, 'award_win' FROM v_registry""", "v_logs", "v_registry")
def a23_debuts_and_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    debuts = views.logs(spark, sf_dir).where("level = 'mlb'").groupBy("entity_id").agg(F.min("date").alias("event_date")).withColumn("event_type", F.lit("debut"))
    return debuts.unionByName(views.registry(spark, sf_dir).withColumn("event_type", F.lit("award_win")))


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1")
def a24_value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.value_shares(views.read(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT 'grade' AS column, round(avg(CASE WHEN grade IS NULL THEN 1 ELSE 0 END), 6) AS null_share FROM v_sales UNION ALL SELECT 'price', round(avg(CASE WHEN price IS NULL THEN 1 ELSE 0 END), 6) FROM v_sales""", "v_sales")
def a25_null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.null_report(views.sales(spark, sf_dir), ["grade", "price"]))


@query("SELECT entity_id, min_by(role, (date, game_id)) AS role, coalesce(min(season), 9999) AS first_season FROM v_logs GROUP BY 1", "v_logs")
def a26_first_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.logs(spark, sf_dir).groupBy("entity_id").agg(F.min_by("role", F.struct("date", "game_id")).alias("role"), F.coalesce(F.min("season"), F.lit(9999)).alias("first_season"))


@query(
    """SELECT card_slug, grade, month, round(ln(price / lag(price) OVER w), 6) AS log_ret,
       CAST((year(month) * 12 + month(month)) - lag(year(month) * 12 + month(month)) OVER w AS INTEGER) AS months_since_prev FROM v_month_ends WINDOW w AS (PARTITION BY card_slug, grade ORDER BY month)""",
    "v_month_ends",
)
def w01_w02_observed_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])
    out = windows.observed_returns(months, ["card_slug", "grade"], "month", "price", "months")
    return rounded(out.select("card_slug", "grade", "month", "log_ret", "months_since_prev"))


HOLD_SQL = """SELECT m.card_slug, m.entity_id, m.grade, m.month, m.price, {cols} FROM v_month_ends m {joins} WHERE m.month >= TIMESTAMP '1997-01-01'""".format(
    cols=", ".join(f"round(ln(nullif(m{h}.price, 0) / nullif(m.price, 0)) / ({h} / 12.0), 6) AS ret_{h}m" for h in (6, 12, 24, 36)),
    joins=" ".join(f"LEFT JOIN v_month_ends m{h} ON m{h}.card_slug = m.card_slug AND m{h}.grade = m.grade AND m{h}.month = m.month + INTERVAL {h} MONTH" for h in (6, 12, 24, 36)),
)


@query(HOLD_SQL, "v_month_ends")
def w03_j08_hold_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])
    return rounded(windows.hold_returns(months, ["card_slug", "grade"], entries_from="1997-01-01"), exact=("price",))


@query(
    """WITH i AS (SELECT *, year(month) * 12 + month(month) AS mi FROM v_month_ends)
       SELECT card_slug, grade, month, round(CASE WHEN count(price) OVER w = 3 THEN ln(quantile_cont(price, 0.5) OVER w) END, 6) AS price_level,
       round(ln(price / nullif(max(price) OVER (PARTITION BY card_slug, grade ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), 0)), 6) AS ret_3m
       FROM i WINDOW w AS (PARTITION BY card_slug, grade ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "v_month_ends",
)
def w04_trailing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])
    return rounded(windows.trailing_features(months, ["card_slug", "grade"]).select("card_slug", "grade", "month", "price_level", "ret_3m"))


@query(
    """WITH c AS (SELECT DISTINCT entity_id, season, CAST(date_trunc('month', date) AS TIMESTAMP) AS cut FROM v_logs),
       s AS (SELECT c.entity_id, c.season, c.cut, sum(hits) AS n, sum(at_bats) AS d, sum(hits) FILTER (l.date > c.cut - INTERVAL 14 DAY) AS rn, sum(at_bats) FILTER (l.date > c.cut - INTERVAL 14 DAY) AS rd,
         count(l.date) FILTER (l.date > c.cut - INTERVAL 14 DAY) AS form_games FROM c LEFT JOIN v_logs l ON l.entity_id = c.entity_id AND l.season = c.season AND l.date <= c.cut GROUP BY ALL)
       SELECT entity_id, season, cut, round(CASE WHEN rd > 0 THEN rn / rd - n / nullif(d, 0) END, 6) AS form_delta, form_games FROM s""",
    "v_logs",
)
def w05_form_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = views.logs(spark, sf_dir)
    cuts = logs.select("entity_id", "season", f.month_start(F.col("date")).alias("cut")).distinct()
    return rounded(asof.form_delta(cuts, logs, ["entity_id", "season"], "cut", "date", "hits", "at_bats"))
