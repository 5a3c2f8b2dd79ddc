"""Queries of joins, events, the lag study, odds and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import aggregates as a
from tidemark.operators import asof, events, joins, quantiles, resample, windows
from tidemark.plans.q_series import KEYS, rounded
from tidemark.plans.registry import query
from tidemark.sources import views


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])


@query("SELECT l_suppkey, n_name, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def j01_checked_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    suppliers = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nations = views.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return joins.checked_left(joins.checked_left(lines, suppliers, ["l_suppkey"]), nations, ["n_nationkey"]).select("l_suppkey", "n_name", "n")


@query("SELECT card_slug, coalesce(grade, 'ungraded') AS grade, count(*) AS n FROM v_sales WHERE (card_slug, coalesce(grade, 'ungraded')) IN (SELECT card_slug, grade FROM v_weekly GROUP BY 1, 2 HAVING count(*) >= 40) GROUP BY ALL", "v_sales", "v_weekly")
def j02_universe_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = views.sales(spark, sf_dir).withColumn("grade", f.normalize_grade(F.col("grade")))
    chosen = a.weekly_series(views.sales(spark, sf_dir)).groupBy("card_slug", "grade").agg(F.count("*").alias("w")).where("w >= 40")
    return sales.join(chosen, ["card_slug", "grade"], "left_semi").groupBy("card_slug", "grade").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT card_slug, coalesce(grade, 'ungraded') AS grade, count(*) AS n_sales FROM v_sales WHERE sale_date < TIMESTAMP '1996-01-01' GROUP BY ALL),
       c AS (SELECT card_slug, grade, count(*) AS n_points FROM v_chart WHERE date >= TIMESTAMP '2001-06-01' GROUP BY ALL)
       SELECT coalesce(s.card_slug, c.card_slug) AS card_slug, coalesce(s.grade, c.grade) AS grade, n_sales, n_points FROM s FULL JOIN c ON s.card_slug = c.card_slug AND s.grade = c.grade""",
    "v_sales",
    "v_chart",
)
def j03_liquidity_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = views.sales(spark, sf_dir).where(F.col("sale_date") < F.lit("1996-01-01").cast("timestamp_ntz")).withColumn("grade", f.normalize_grade(F.col("grade")))
    chart = views.chart(spark, sf_dir).where(F.col("date") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    return joins.liquidity_outer(sales, chart, ["card_slug", "grade"])


ENTRIES = "SELECT DISTINCT entity_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS entry FROM v_odds"


@query(
    f"""WITH e AS ({ENTRIES}) SELECT e.entity_id, e.entry, arg_max(o.raw_price, (o.ts, o.event_id)) AS level FROM e LEFT JOIN v_odds o ON o.entity_id = e.entity_id AND o.ts < e.entry GROUP BY 1, 2""",
    "v_odds",
)
def j05_asof_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    odds = views.odds(spark, sf_dir)
    entries = odds.select("entity_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("entry")).distinct()
    return asof.last_before(entries, odds, ["entity_id"], "entry", "ts", "raw_price", "level")


@query(
    """SELECT e.entity_id, e.event_date, s.card_slug, count(*) AS n, median(price) AS mid FROM v_registry e JOIN v_sales s ON s.entity_id = e.entity_id
       AND s.sale_date BETWEEN e.event_date - INTERVAL 56 DAY AND e.event_date + INTERVAL 21 DAY GROUP BY ALL""",
    "v_registry",
    "v_sales",
)
def j06_event_sales_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = joins.event_sales(views.registry(spark, sf_dir), views.sales(spark, sf_dir), "entity_id", 56, 21)
    return rounded(met.groupBy("entity_id", "event_date", "card_slug").agg(F.count("*").alias("n"), F.median("price").alias("mid")), exact=("mid",))


WINDOWS_SQL = """r AS (SELECT card_slug, entity_id, month, ln(price / lag(price) OVER w) AS log_ret, CAST(year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER w AS INTEGER) AS months_since_prev
         FROM v_month_ends WHERE grade = 'psa_10' WINDOW w AS (PARTITION BY card_slug ORDER BY month)),
       m AS (SELECT month, median(log_ret) AS med FROM r GROUP BY 1),
       p AS (SELECT r.*, log_ret - med AS excess_ret FROM r JOIN m USING (month)),
       i AS (SELECT month, dense_rank() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM p)),
       e AS (SELECT v.entity_id, v.event_date, i.k FROM v_registry v JOIN i ON i.month = date_trunc('month', v.event_date)),
       w AS (SELECT e.entity_id, e.event_date, p.card_slug, p.month, CAST(i.k - e.k AS INTEGER) AS "offset", p.excess_ret, p.months_since_prev IS NULL OR p.months_since_prev <= 2 AS horizon_ok
         FROM e JOIN p ON p.entity_id = e.entity_id JOIN i ON i.month = p.month WHERE i.k BETWEEN e.k - 2 AND e.k + 3)"""


def _excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _months(spark, sf_dir).where("grade = 'psa_10'")
    return windows.market_excess(windows.observed_returns(months, ["card_slug"], "month", "price", "months"), ["month"])


def _windows(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    panel = _excess(spark, sf_dir) if panel is None else panel
    marked = views.registry(spark, sf_dir).withColumn("event_month", f.month_start(F.col("event_date")))
    return events.period_windows(marked, panel, "month", "event_month", 2, 3, "months_since_prev", 2)


@query(f'WITH {WINDOWS_SQL} SELECT entity_id, event_date, card_slug, month, "offset", round(excess_ret, 6) AS excess_ret, horizon_ok FROM w', "v_month_ends", "v_registry")
def j07_e02_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_windows(spark, sf_dir).select("entity_id", "event_date", "card_slug", "month", "offset", "excess_ret", "horizon_ok"))


@query(f'WITH {WINDOWS_SQL} SELECT entity_id, event_date, round(coalesce(sum(excess_ret) FILTER ("offset" IN (0, 1) AND horizon_ok), 0), 6) AS car FROM w GROUP BY 1, 2', "v_month_ends", "v_registry")
def a19_abnormal_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(a.abnormal_sum(_windows(spark, sf_dir), ["entity_id", "event_date"], [0, 1]))


@query(
    f"""WITH {WINDOWS_SQL}, c AS (SELECT entity_id, event_date, coalesce(sum(excess_ret) FILTER ("offset" = 0 AND horizon_ok), 0) AS c0, coalesce(sum(excess_ret) FILTER ("offset" IN (0, 1) AND horizon_ok), 0) AS c1 FROM w GROUP BY 1, 2)
       SELECT count(*) AS n, round(avg(c1 - c0), 6) AS giveback, round(avg(CASE WHEN c1 - c0 < 0 THEN 1.0 ELSE 0 END), 6) AS share_negative FROM c WHERE c0 > 0""",
    "v_month_ends",
    "v_registry",
)
def e04_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events with a rise give back in the next period."""
    w = _windows(spark, sf_dir)
    keys = ["entity_id", "event_date"]
    both = a.abnormal_sum(w, keys, [0]).withColumnRenamed("car", "c0").join(a.abnormal_sum(w, keys, [0, 1]).withColumnRenamed("car", "c1"), keys)
    change = F.col("c1") - F.col("c0")
    return rounded(both.where("c0 > 0").agg(F.count("*").alias("n"), F.avg(change).alias("giveback"), F.avg((change < 0).cast("double")).alias("share_negative")))


PERM_DRAW = resample.draws_sql(7, 5000, "pool", "(SELECT n FROM o)")


@query(
    f"""WITH {WINDOWS_SQL},
       c AS (SELECT entity_id, event_date, coalesce(sum(excess_ret) FILTER ("offset" = 0 AND horizon_ok), 0) AS car FROM w GROUP BY 1, 2),
       o AS (SELECT avg(car) AS observed, count(*) AS n FROM c),
       pool AS (SELECT excess_ret, row_number() OVER (ORDER BY card_slug, month) - 1 AS i FROM p WHERE excess_ret IS NOT NULL),
       p2 AS ({PERM_DRAW}), d AS (SELECT p2.rep, avg(pool.excess_ret) AS m FROM p2 JOIN pool ON pool.i = p2.i GROUP BY 1)
       SELECT round(observed, 6) AS observed, o.n AS n_events, round(avg(CASE WHEN abs(m) >= abs(observed) THEN 1.0 ELSE 0 END), 6) AS p_value FROM d, o GROUP BY observed, o.n""",
    "v_month_ends",
    "v_registry",
)
def e03_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _excess(spark, sf_dir)
    cars = a.abnormal_sum(_windows(spark, sf_dir, panel), ["entity_id", "event_date"], [0])
    return rounded(resample.significance(cars, "car", panel, "excess_ret", ["card_slug", "month"], seed=7))


@query(
    """WITH d AS (SELECT entity_id, date, role, max(home_runs) AS hr, max(hits) AS h, max(strike_outs) AS k FROM v_logs GROUP BY 1, 2, 3)
       SELECT entity_id, date AS event_date, 'three_hr_game' AS event_type, CAST(hr AS VARCHAR) || ' HR' AS details FROM d WHERE role = 'hitting' AND hr >= 3
       UNION ALL SELECT entity_id, date, 'four_hit_game', CAST(h AS VARCHAR) || ' H' FROM d WHERE role = 'hitting' AND hr < 3 AND h >= 4
       UNION ALL SELECT entity_id, date, 'ten_k_game', CAST(k AS VARCHAR) || ' K' FROM d WHERE role = 'pitching' AND k >= 10
       UNION ALL SELECT entity_id, min(date), 'debut', 'first game' FROM v_logs GROUP BY 1""",
    "v_logs",
)
def e01_events_from_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.from_logs(views.logs(spark, sf_dir))


@query(
    """WITH RECURSIVE ev AS (SELECT r.entity_id, r.event_date, i.name, i.position FROM v_registry r LEFT JOIN v_info i USING (entity_id)),
       o AS (SELECT entity_id, event_date, name, position, row_number() OVER (PARTITION BY entity_id ORDER BY event_date) AS k FROM ev),
       k(entity_id, event_date, name, position, k, last, keep) AS (SELECT entity_id, event_date, name, position, k, event_date, true FROM o WHERE k = 1
         UNION ALL SELECT o.entity_id, o.event_date, o.name, o.position, o.k, CASE WHEN date_diff('day', k.last, o.event_date) > 14 THEN o.event_date ELSE k.last END, date_diff('day', k.last, o.event_date) > 14 FROM k JOIN o ON o.entity_id = k.entity_id AND o.k = k.k + 1)
       SELECT entity_id, event_date, name, position FROM k WHERE keep""",
    "v_registry",
    "v_info",
)
def w08_drop_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole event rows stay."""
    known = views.registry(spark, sf_dir).join(views.info(spark, sf_dir).drop("birth_date"), "entity_id", "left")
    return windows.drop_overlaps(known, ["entity_id"], "event_date", order=["event_date"])


#: Scores are whole numbers, so sums are exact, and squares tell a score that lies on 1.5 deviations from one just below.
Z_SQL = """SELECT entity_id, level, date, game_id, CAST(score AS DOUBLE) AS score, baseline_n, round(d / sqrt(CAST(baseline_n * v AS DOUBLE) / (baseline_n - 1)), 6) AS z
         FROM (SELECT *, baseline_n * score - s AS d, baseline_n * q - s * s AS v FROM b) WHERE baseline_n >= 5 AND v > 0 AND d > 0 AND 4 * d * d * (baseline_n - 1) >= 9 * baseline_n * v"""


@query(
    f"""WITH g AS (SELECT *, total_bases + walks + stolen_bases AS score FROM v_logs WHERE role = 'hitting'),
       u AS (SELECT *, coalesce(sum(CASE WHEN plate_appearances > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, level ORDER BY date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM g),
       b AS (SELECT *, count(CASE WHEN plate_appearances > 0 THEN score END) OVER w AS baseline_n, sum(CASE WHEN plate_appearances > 0 THEN score END) OVER w AS s, sum(CASE WHEN plate_appearances > 0 THEN score * score END) OVER w AS q,
         coalesce(sum(CASE WHEN plate_appearances > 0 THEN plate_appearances END) OVER w, 0) AS pa FROM u WINDOW w AS (PARTITION BY entity_id, level ORDER BY u RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
       {Z_SQL} AND pa >= 20""",
    "v_logs",
)
def w06_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.logs(spark, sf_dir).where("role = 'hitting'")
    score = f.hitter_game_score(F.col("total_bases"), F.col("walks"), F.col("stolen_bases"))
    found = windows.breakouts(rows, score, F.col("plate_appearances") > 0, F.col("plate_appearances"), any_row=True, z_min=1.5)
    return rounded(found.select("entity_id", "level", "date", "game_id", "score", "baseline_n", "z"))


@query(
    f"""WITH g AS (SELECT *, 50 + outs + 2 * greatest(0, floor((outs - 12) / 3.0)) + strike_outs - 2 * hits - 4 * earned_runs - 2 * greatest(0, runs - earned_runs) - walks AS score FROM v_logs WHERE role = 'pitching' AND games_started = 1),
       b AS (SELECT *, count(*) OVER w AS baseline_n, sum(score) OVER w AS s, sum(score * score) OVER w AS q FROM g WINDOW w AS (PARTITION BY entity_id, level ORDER BY date, game_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
       {Z_SQL}""",
    "v_logs",
)
def w06_pitcher_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts alone are events and baseline; five of them are enough, whatever the batters faced."""
    c = F.col
    score = f.pitcher_game_score(c("outs"), c("strike_outs"), c("hits"), c("earned_runs"), c("runs"), c("walks"))
    found = windows.breakouts(views.logs(spark, sf_dir).where("role = 'pitching'"), score, c("games_started") == 1, F.lit(1), any_row=False, least_weight=0, z_min=1.5)
    return rounded(found.select("entity_id", "level", "date", "game_id", "score", "baseline_n", "z"))


SPIKE_SQL = """d AS (SELECT event, market_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, arg_max(raw_price, (ts, event_id)) AS p FROM v_odds WHERE source = 'exchange0' GROUP BY ALL),
       t AS (SELECT *, p - lag(p) OVER (PARTITION BY event, market_id ORDER BY day) AS delta FROM d),
       s AS (SELECT *, CASE WHEN count(delta) OVER w >= 5 THEN stddev_samp(delta) OVER w END AS sd FROM t WINDOW w AS (PARTITION BY event, market_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def _spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = views.odds(spark, sf_dir).where("source = 'exchange0'")
    daily = a.daily_last(one, ["event", "market_id"]).withColumn("day", F.col("day").cast("timestamp_ntz"))
    return windows.spikes(daily, ["event", "market_id"], "day", "raw_price", times=1.5)


@query(f"WITH {SPIKE_SQL} SELECT event, market_id, day, round(delta, 9) AS delta FROM s WHERE abs(delta) >= greatest(0.10, coalesce(1.5 * sd, 0.10))", "v_odds")
def w07_o06_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one source alone: steps between sources would look like spikes."""
    return rounded(_spikes(spark, sf_dir).select("event", "market_id", "day", "delta"), 9)


@query(
    f"""WITH RECURSIVE {SPIKE_SQL}, f AS (SELECT market_id, day, delta FROM s WHERE abs(delta) >= greatest(0.10, coalesce(1.5 * sd, 0.10))),
       x AS (SELECT market_id, sign(delta) AS sg, day, delta, row_number() OVER (PARTITION BY market_id, sign(delta) ORDER BY -abs(delta), day, delta) AS k FROM f),
       g(market_id, sg, k, kept, day, delta, pick) AS (SELECT market_id, sg, k, [day], day, delta, true FROM x WHERE k = 1
         UNION ALL SELECT x.market_id, x.sg, x.k, CASE WHEN len([z FOR z IN g.kept IF abs(date_diff('day', z, x.day)) <= 7]) > 0 THEN g.kept ELSE list_append(g.kept, x.day) END, x.day, x.delta, len([z FOR z IN g.kept IF abs(date_diff('day', z, x.day)) <= 7]) = 0
           FROM g JOIN x ON x.market_id = g.market_id AND x.sg = g.sg AND x.k = g.k + 1)
       SELECT market_id, day, round(delta, 9) AS delta FROM g WHERE pick""",
    "v_odds",
)
def w07_picked_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy, largest steps first."""
    return rounded(windows.pick_spikes(_spikes(spark, sf_dir), "market_id", "day"), 9)


def index_sql(grade: str = "grade = 'psa_10'", p: str = "") -> str:
    """CTEs of the daily market index (idx) and of the filled one (fx), names with the suffix p."""
    return f"""i0{p} AS (SELECT card_slug, sale_date, price, CAST(date_diff('day', TIMESTAMP '1970-01-01', date_trunc('day', sale_date)) AS INTEGER) AS day FROM v_sales WHERE {grade}),
       i1{p} AS (SELECT card_slug, day, price, quantile_cont(price, 0.5) OVER (PARTITION BY card_slug ORDER BY day RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) AS baseline FROM i0{p}),
       i2{p} AS (SELECT card_slug, day, baseline, median(price) AS price FROM i1{p} GROUP BY ALL HAVING baseline > 0),
       idx{p} AS (SELECT day, count(*) AS n_series, median(price / baseline) AS "index" FROM i2{p} GROUP BY 1 HAVING count(*) >= 3),
       ig{p} AS (SELECT d.day, x."index" AS v FROM (SELECT unnest(range((SELECT min(day) FROM i0{p}), (SELECT max(day) FROM i0{p}) + 1)) AS day) d LEFT JOIN idx{p} x ON x.day = d.day),
       ip{p} AS (SELECT day, v, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER a AS p1
         FROM ig{p} WINDOW b AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
       fx{p} AS (SELECT CAST(day AS INTEGER) AS day, coalesce(v, CASE WHEN coalesce(day - p0, 4) <= 3 OR coalesce(p1 - day, 4) <= 3 THEN coalesce(v0 + (v1 - v0) * (day - p0) / nullif(p1 - p0, 0), v0, v1) END) AS "index" FROM ip{p})"""


def windows_sql(grade: str = "grade = 'psa_10'", p: str = "") -> str:
    """CTEs of pairs of event and series (st) and of the sales around events (sw), names with the suffix p."""
    return f"""x{p} AS (SELECT e.entity_id, e.event_date, s.card_slug, s.sale_date, s.price, (epoch_us(s.sale_date) - epoch_us(e.event_date)) / 86400000000 AS t FROM v_registry e JOIN v_sales s ON s.entity_id = e.entity_id AND s.{grade}
         AND s.sale_date BETWEEN e.event_date - INTERVAL 56 DAY AND e.event_date + INTERVAL 21 DAY),
       b{p} AS (SELECT entity_id, card_slug, event_date, count(*) FILTER (t < 0) AS n_base, count(*) FILTER (abs(t) <= 21) AS n_window, quantile_cont(CASE WHEN t < 0 THEN price END, 0.5) AS baseline FROM x{p} GROUP BY ALL),
       pr{p} AS (SELECT e.entity_id, e.event_date, s.card_slug FROM v_registry e JOIN (SELECT DISTINCT entity_id, card_slug FROM v_sales WHERE {grade}) s ON s.entity_id = e.entity_id),
       st{p} AS (SELECT pr{p}.*, baseline, CASE WHEN coalesce(n_base, 0) < 3 THEN 'dropped_baseline' WHEN n_window < 3 THEN 'dropped_window' ELSE 'kept' END AS status FROM pr{p} LEFT JOIN b{p} USING (entity_id, card_slug, event_date)),
       sw{p} AS (SELECT x.entity_id, x.card_slug, x.event_date, x.sale_date, x.t AS t_days, x.price / st.baseline AS rel_price FROM x{p} x JOIN st{p} st ON x.entity_id = st.entity_id AND x.card_slug = st.card_slug AND x.event_date = st.event_date WHERE status = 'kept' AND abs(t) <= 21)"""


def adjusted_sql(p: str = "") -> str:
    return f"""wa{p} AS (SELECT sw.*, rel_price / nullif("index", 0) AS rel_adj FROM sw{p} sw LEFT JOIN fx{p} fx ON fx.day = date_diff('day', TIMESTAMP '1970-01-01', date_trunc('day', sale_date)))"""


INDEX_SQL, SALE_WINDOWS_SQL = index_sql(), windows_sql()


@query(f'WITH {INDEX_SQL} SELECT day, n_series, round("index", 6) AS "index" FROM idx', "v_sales")
def w09_market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.market_index(views.sales(spark, sf_dir), "psa_10"))


@query(f'WITH {INDEX_SQL} SELECT day, round("index", 6) AS filled FROM fx', "v_sales")
def w10_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.filled_index(views.sales(spark, sf_dir), "psa_10").withColumnRenamed("index", "filled"))


def _sale_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return events.sale_windows(views.sales(spark, sf_dir), views.registry(spark, sf_dir), "psa_10")


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.adjust_for_market(_sale_windows(spark, sf_dir)[0], events.filled_index(views.sales(spark, sf_dir), "psa_10"))


@query(f"WITH {SALE_WINDOWS_SQL} SELECT entity_id, card_slug, event_date, sale_date, round(t_days, 6) AS t_days, round(rel_price, 6) AS rel_price FROM sw", "v_registry", "v_sales")
def e05_sale_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sale_windows(spark, sf_dir)[0])


@query(f"WITH {SALE_WINDOWS_SQL} SELECT status, count(*) AS n FROM st GROUP BY 1", "v_registry", "v_sales")
def e05_window_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sale_windows(spark, sf_dir)[1]


@query(f"WITH {SALE_WINDOWS_SQL}, {INDEX_SQL}, {adjusted_sql()} SELECT entity_id, card_slug, event_date, sale_date, round(rel_adj, 6) AS rel_adj FROM wa", "v_registry", "v_sales")
def j19_adjust_for_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_adjusted(spark, sf_dir).select("entity_id", "card_slug", "event_date", "sale_date", "rel_adj"))


BINS_SQL = "bins AS (SELECT CAST(d.t_bin AS BIGINT) AS t_bin, median(rel_adj) AS median, count(rel_adj) AS n_sales FROM (SELECT unnest(range(-14, 15)) AS t_bin) d LEFT JOIN wa ON floor(wa.t_days + 0.5) = d.t_bin AND rel_adj IS NOT NULL GROUP BY 1)"
CURVE_SQL = f"{SALE_WINDOWS_SQL}, {INDEX_SQL}, {adjusted_sql()}, {BINS_SQL}"


@query(f"WITH {CURVE_SQL} SELECT t_bin, round(median, 6) AS median, n_sales FROM bins", "v_registry", "v_sales")
def e06_lag_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.lag_bins(_adjusted(spark, sf_dir), "rel_adj"))


REPS = 2000
CLUSTER_DRAW = resample.draws_sql(42, REPS, "ev")
BOOT_SQL = f"""wb AS (SELECT *, CAST(floor(t_days + 0.5) AS BIGINT) AS t_bin FROM wa WHERE rel_adj IS NOT NULL AND floor(t_days + 0.5) BETWEEN -14 AND 14),
       ev AS (SELECT entity_id, event_date, row_number() OVER (ORDER BY entity_id, event_date) - 1 AS i FROM (SELECT DISTINCT entity_id, event_date FROM wb)),
       dr AS (SELECT rep, i, count(*) AS times FROM ({CLUSTER_DRAW}) GROUP BY ALL),
       bt AS (SELECT dr.rep, wb.t_bin, median(rel_adj) AS m FROM dr JOIN ev ON ev.i = dr.i JOIN wb ON wb.entity_id = ev.entity_id AND wb.event_date = ev.event_date, range(dr.times) GROUP BY ALL),
       ci AS (SELECT t_bin, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM bt GROUP BY 1 HAVING count(*) >= 20)"""


def _curve(spark: SparkSession, sf_dir: str, n_reps: int = REPS) -> DataFrame:
    """The lag curve with bounds from resampled events: all sales of a drawn event come along."""
    sold = quantiles.stored(_adjusted(spark, sf_dir).select("entity_id", "event_date", "t_days", "rel_adj"))
    return events.lag_bins(sold, "rel_adj").join(events.lag_bounds(sold, "rel_adj", n_reps), "t_bin", "left")


@query(f"WITH {CURVE_SQL}, {BOOT_SQL} SELECT bins.t_bin, round(median, 6) AS median, n_sales, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM bins LEFT JOIN ci USING (t_bin)", "v_registry", "v_sales")
def r02_e06_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_curve(spark, sf_dir))


@query(
    f"""WITH {CURVE_SQL}, {BOOT_SQL}, c AS (SELECT t_bin, ci_lo, ci_hi FROM bins LEFT JOIN ci USING (t_bin)),
       h AS (SELECT t_bin, ci_lo, ci_hi, min(ci_lo) OVER w AS low, count(ci_lo) OVER w AS n, max(t_bin) OVER w AS e FROM c WINDOW w AS (ORDER BY t_bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
       s AS (SELECT min(CASE WHEN t_bin >= 0 AND low > 1 AND n = 3 AND e - t_bin = 2 THEN t_bin END) AS lag_days, coalesce(avg(CASE WHEN t_bin < 0 THEN CASE WHEN ci_lo <= 1 AND ci_hi >= 1 THEN 1.0 ELSE 0 END END), 0) AS share FROM h)
       SELECT lag_days, share >= 0.8 AS pre_ok, round(share, 6) AS pre_cover_share FROM s""",
    "v_registry",
    "v_sales",
)
def e07_estimate_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.estimate_lag(_curve(spark, sf_dir)))


@query(
    f"""WITH {CURVE_SQL}, c AS (SELECT t_bin AS t, median - 1 AS y FROM bins WHERE t_bin >= 0 AND median IS NOT NULL),
       g AS (SELECT 0.25 + k * 0.25 AS h FROM range(56) r(k)), f AS (SELECT CAST(h AS DOUBLE) AS h, sum(y * (1 - pow(2.0, -t / h))) AS yg, sum(pow(1 - pow(2.0, -t / h), 2)) AS gg, sum(y * y) AS yy, sum(y) AS sy, count(*) AS n FROM c, g GROUP BY 1),
       fit AS (SELECT h, yg / nullif(gg, 0) AS a, sy, n FROM f ORDER BY round(yy - yg / nullif(gg, 0) * yg, 12), h LIMIT 1)
       SELECT CASE WHEN sy > 0 AND n >= 5 AND a > 0.01 THEN h END AS half_life, round(CASE WHEN sy > 0 AND n >= 5 AND a > 0.01 THEN a END, 6) AS amplitude FROM fit""",
    "v_registry",
    "v_sales",
)
def e08_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.half_life(events.lag_bins(_adjusted(spark, sf_dir), "rel_adj")))


CLASS_SQL = """CASE WHEN least(n_pre, n_early, n_late) < 2 THEN 'insufficient' WHEN late - pre <= 0.02 THEN 'no_adjustment' WHEN (early - pre) / (late - pre) >= 0.8 THEN 'fast'
         WHEN abs(early - pre) <= 0.02 AND late - pre >= 0.05 THEN 'late' ELSE 'intermediate' END AS adjustment"""
PARTS_SQL = """quantile_cont(CASE WHEN t_days < 0 THEN rel_adj END, 0.5) AS pre, count(*) FILTER (t_days < 0) AS n_pre, quantile_cont(CASE WHEN t_days >= 0 AND t_days < 3.5 THEN rel_adj END, 0.5) AS early,
         count(*) FILTER (t_days >= 0 AND t_days < 3.5) AS n_early, quantile_cont(CASE WHEN t_days >= 7 THEN rel_adj END, 0.5) AS late, count(*) FILTER (t_days >= 7) AS n_late"""


@query(
    f"""WITH {SALE_WINDOWS_SQL}, {INDEX_SQL}, {adjusted_sql()}, c AS (SELECT entity_id, event_date, {PARTS_SQL} FROM wa WHERE rel_adj IS NOT NULL GROUP BY 1, 2)
       SELECT entity_id, event_date, n_pre, n_early, n_late, {CLASS_SQL} FROM c""",
    "v_registry",
    "v_sales",
)
def e09_classify_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.classify(_adjusted(spark, sf_dir), ["entity_id", "event_date"]).select("entity_id", "event_date", "n_pre", "n_early", "n_late", "adjustment")


STRATA_SQL = """sx AS (SELECT e.entity_id, e.event_date, min(l.season) AS first_season FROM v_registry e LEFT JOIN v_logs l ON l.entity_id = e.entity_id AND l.level = 'mlb' AND l.date < e.event_date GROUP BY ALL),
       ss AS (SELECT entity_id, event_date, CASE WHEN first_season IS NULL OR year(event_date) + CASE WHEN month(event_date) >= 11 THEN 1 ELSE 0 END = first_season THEN 'prospect' ELSE 'established' END AS stratum FROM sx)"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.strata(views.registry(spark, sf_dir), views.logs(spark, sf_dir).where("level = 'mlb'"))


@query(f"WITH {STRATA_SQL} SELECT entity_id, event_date, stratum FROM ss", "v_registry", "v_logs")
def e10_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir)


def _shares_sql() -> str:
    return ", ".join(f"CASE WHEN kept >= 5 THEN round(avg(CASE WHEN adjustment IS NULL THEN NULL WHEN adjustment = '{k}' THEN 1.0 ELSE 0 END), 4) END AS share_{k}" for k in ("fast", "late", "intermediate", "no_adjustment", "insufficient"))


@query(
    f"""WITH {windows_sql()}, {index_sql()}, {adjusted_sql()}, {windows_sql("grade IS NULL", "u")}, {index_sql("grade IS NULL", "u")}, {adjusted_sql("u")}, {STRATA_SQL},
       k AS (SELECT entity_id, event_date, unnest(['all', stratum]) AS stratum FROM ss),
       ps AS (SELECT 'psa_10' AS grade_class, entity_id, event_date, status FROM st UNION ALL SELECT 'ungraded', entity_id, event_date, status FROM stu),
       w AS (SELECT 'psa_10' AS grade_class, * FROM wa UNION ALL SELECT 'ungraded', * FROM wau),
       dl AS (SELECT grade_class, stratum, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'dropped_baseline') AS dropped_baseline, count(*) FILTER (status = 'dropped_window') AS dropped_window FROM ps JOIN k USING (entity_id, event_date) GROUP BY 1, 2),
       un AS (SELECT grade_class, stratum, count(*) FILTER (rel_adj IS NULL) AS n_unadjusted FROM w JOIN k USING (entity_id, event_date) GROUP BY 1, 2),
       c AS (SELECT grade_class, entity_id, event_date, {PARTS_SQL} FROM w WHERE rel_adj IS NOT NULL GROUP BY 1, 2, 3),
       cl AS (SELECT grade_class, stratum, {CLASS_SQL} FROM c JOIN k USING (entity_id, event_date)),
       sh AS (SELECT dl.grade_class, dl.stratum, kept, {_shares_sql()} FROM dl LEFT JOIN cl ON cl.grade_class = dl.grade_class AND cl.stratum = dl.stratum GROUP BY 1, 2, 3)
       SELECT dl.*, coalesce(n_unadjusted, 0) AS n_unadjusted, sh.* EXCLUDE (grade_class, stratum, kept), CASE WHEN dl.kept < 5 THEN 'skipped' WHEN share_fast >= 0.8 THEN 'dead' WHEN share_late >= 0.2 THEN 'plausible' ELSE 'intermediate' END AS read_out
       FROM dl LEFT JOIN un USING (grade_class, stratum) JOIN sh USING (grade_class, stratum)""",
    "v_registry",
    "v_sales",
    "v_logs",
)
def e11_adjustment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both grades, all events and each stratum; the registered cell is (ungraded, all)."""
    return events.adjustment_grid(views.sales(spark, sf_dir), views.registry(spark, sf_dir), _strata(spark, sf_dir))
