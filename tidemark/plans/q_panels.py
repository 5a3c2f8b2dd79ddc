"""Queries of panels, model frames, odds features, walk-forward ranks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import aggregates as a
from tidemark.operators import joins, odds, panels, resample, windows
from tidemark.plans.q_scalars import GROUP_CASE
from tidemark.plans.q_series import KEYS, LEAGUE_SQL, LINE_SQL, OPS_SQL, rounded
from tidemark.plans.registry import query
from tidemark.sources import views


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.last_in_month(views.chart(spark, sf_dir), KEYS, ["psa_10", "ungraded"])


STATS_SQL = """SELECT p.{key}, p.{period}, p.stat_season, p.lag, count(l.date) AS games_to_date, sum(l.hits) AS h, sum(l.at_bats) AS ab, sum(l.walks + l.hit_by_pitch) AS free, sum(l.walks + l.hit_by_pitch + l.sac_flies) AS other, sum(l.total_bases) AS tb,
    sum(l.hits) FILTER (l.date > p.lag - INTERVAL 14 DAY) AS rh, sum(l.at_bats) FILTER (l.date > p.lag - INTERVAL 14 DAY) AS rab, count(l.date) FILTER (l.date > p.lag - INTERVAL 14 DAY) AS form_games
    FROM p LEFT JOIN v_logs l ON l.entity_id = p.entity_id AND l.season = p.stat_season AND l.date <= p.lag GROUP BY ALL"""
RATES_SQL = """games_to_date, form_games, round(CASE WHEN rab > 0 THEN rh / rab - h / nullif(ab, 0) END, 6) AS form_delta, round(h / nullif(ab, 0) + 1e-9, 3) AS avg, round((h + free) / nullif(ab + other, 0) + 1e-9, 3) AS obp, round(tb / nullif(ab, 0) + 1e-9, 3) AS slg,
    round(round((h + free) / nullif(ab + other, 0) + 1e-9, 3) + round(tb / nullif(ab, 0) + 1e-9, 3), 3) AS ops"""


@query(
    f"""WITH r AS (SELECT card_slug, entity_id, month, price, ln(price / lag(price) OVER w) AS log_ret, CAST(year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER w AS INTEGER) AS months_since_prev
         FROM v_month_ends WHERE grade = 'psa_10' WINDOW w AS (PARTITION BY card_slug ORDER BY month)), m AS (SELECT month, median(log_ret) AS med FROM r GROUP BY 1),
       fg AS (SELECT entity_id, season, min(date) AS first FROM v_logs GROUP BY 1, 2),
       p AS (SELECT r.*, log_ret - med AS excess_ret, CAST(year(r.month) AS BIGINT) AS stat_season, r.month - INTERVAL 1 DAY AS lag FROM r JOIN m USING (month) JOIN fg ON fg.entity_id = r.entity_id AND fg.season = year(r.month) AND fg.first < r.month + INTERVAL 1 MONTH),
       s AS ({STATS_SQL.format(key="card_slug", period="month")})
       SELECT p.card_slug, p.month, round(log_ret, 6) AS log_ret, months_since_prev, round(excess_ret, 6) AS excess_ret, {RATES_SQL}, round(date_diff('day', birth_date, p.month) / 365.25, 2) AS age, {GROUP_CASE} AS position_group, month(p.month) = 10 AS playoffs
       FROM p JOIN s ON s.card_slug = p.card_slug AND s.month = p.month LEFT JOIN v_info i ON i.entity_id = p.entity_id""",
    "v_month_ends",
    "v_logs",
    "v_info",
)
def n01_monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panels.monthly_panel(views.chart(spark, sf_dir), views.logs(spark, sf_dir), views.info(spark, sf_dir))
    return rounded(panel.drop("entity_id", "price", "market_median", "stat_season"))


@query(
    f"""WITH r AS (SELECT card_slug, grade, week, ln(median_price / lag(median_price) OVER w) AS log_ret, CAST(date_diff('day', lag(week) OVER w, week) AS INTEGER) AS days_since_prev FROM v_weekly WINDOW w AS (PARTITION BY card_slug, grade ORDER BY week)),
       m AS (SELECT week, median(log_ret) AS med FROM r GROUP BY 1), en AS (SELECT DISTINCT card_slug, entity_id FROM v_sales), fg AS (SELECT entity_id, season, min(date) AS first FROM v_logs GROUP BY 1, 2),
       p AS (SELECT r.*, en.entity_id, log_ret - med AS excess_ret, greatest(1996, CAST(year(r.week) AS BIGINT)) AS stat_season, r.week - INTERVAL 1 DAY AS lag FROM r JOIN m USING (week) JOIN en USING (card_slug) JOIN fg ON fg.entity_id = en.entity_id AND fg.season = greatest(1996, year(r.week)) AND fg.first <= r.week - INTERVAL 1 DAY),
       s AS ({STATS_SQL.format(key="card_slug, p.grade", period="week")})
       SELECT p.card_slug, p.grade, p.week, round(log_ret, 6) AS log_ret, days_since_prev, round(excess_ret, 6) AS excess_ret, {RATES_SQL}, round(date_diff('day', birth_date, p.week) / 365.25, 2) AS age, {GROUP_CASE} AS position_group, month(p.week) = 10 AS playoffs
       FROM p JOIN s ON s.card_slug = p.card_slug AND s.grade = p.grade AND s.week = p.week LEFT JOIN v_info i ON i.entity_id = p.entity_id""",
    "v_weekly",
    "v_sales",
    "v_logs",
    "v_info",
)
def n02_weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = views.sales(spark, sf_dir)
    weekly = a.weekly_series(sales).drop("n_sales", "best_offer_share")
    panel = panels.weekly_panel(weekly, sales.select("card_slug", "entity_id").distinct(), views.logs(spark, sf_dir), views.info(spark, sf_dir))
    return rounded(panel.drop("entity_id", "median_price", "market_median", "stat_season"))


CAREER_SUMS = ", ".join(f"sum({c}) AS {c}" for c in panels.CAREER)
RATE3 = {
    "ops": "round(round((hits + walks + hit_by_pitch) / nullif(at_bats + walks + hit_by_pitch + sac_flies, 0) + 1e-9, 3) + round(total_bases / nullif(at_bats, 0) + 1e-9, 3), 3)",
    "era": "round(earned_runs * 27 / nullif(outs, 0) + 1e-9, 3)",
    "k_bb_pct": "round((strike_outs - walks) / nullif(batters_faced, 0), 3)",
}
#: CTEs of prices (px), distinct entries (en), the role of each entity (ro), and the career at each entry (cf).
CAREER_SQL = f"""me AS (SELECT *, year(month) * 12 + month(month) AS mi FROM v_month_ends),
       tr AS (SELECT *, CASE WHEN count(price) OVER w = 3 THEN ln(quantile_cont(price, 0.5) OVER w) END AS price_level, ln(price / nullif(max(price) OVER (PARTITION BY card_slug, grade ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), 0)) AS ret_3m
         FROM me WINDOW w AS (PARTITION BY card_slug, grade ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
       mk AS (SELECT month, median(ret_3m) AS market_ret_3m FROM tr GROUP BY 1),
       px AS (SELECT tr.*, market_ret_3m, ln(h.price / tr.price) AS ret_12m FROM tr JOIN mk USING (month) LEFT JOIN me h ON h.card_slug = tr.card_slug AND h.grade = tr.grade AND h.mi = tr.mi + 12),
       en AS (SELECT DISTINCT entity_id, month FROM px),
       ro AS (SELECT entity_id, min_by(role, (date, game_id)) AS role, min(season) AS first_season, max(CASE WHEN level = 'mlb' THEN 1 ELSE 0 END) AS any_top FROM v_logs GROUP BY 1),
       c1 AS (SELECT en.entity_id, en.month, {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in panels.CAREER)}, min(l.date) AS first_top, min(l.season) AS first_top_season FROM en LEFT JOIN v_logs l ON l.entity_id = en.entity_id AND l.level = 'mlb' AND l.date <= en.month - INTERVAL 1 DAY GROUP BY 1, 2),
       c2 AS (SELECT en.entity_id, en.month, list_position(['a', 'a_plus', 'aa', 'aaa'], l.level) AS rk, {CAREER_SUMS} FROM en JOIN v_logs l ON l.entity_id = en.entity_id AND l.level <> 'mlb' AND l.date <= en.month - INTERVAL 1 DAY GROUP BY 1, 2, 3),
       c3 AS (SELECT c2.entity_id, month, CAST(sum(games) AS BIGINT) AS minor_games, CAST(max(rk) AS INTEGER) AS max_level_rank, max_by(CASE WHEN role = 'hitting' THEN {RATE3["ops"]} ELSE {RATE3["era"]} END, rk) AS rate_at_max_level FROM c2 JOIN ro USING (entity_id) GROUP BY 1, 2),
       aw AS (SELECT en.entity_id, en.month, count(r.event_date) AS awards_to_date FROM en LEFT JOIN v_registry r ON r.entity_id = en.entity_id AND r.event_date <= en.month - INTERVAL 1 DAY GROUP BY 1, 2),
       cf AS (SELECT c1.entity_id, c1.month, role, first_season, CASE WHEN any_top = 1 THEN games END AS games, CASE WHEN any_top = 1 THEN home_runs END AS home_runs, CASE WHEN role = 'hitting' THEN {RATE3["ops"]} END AS ops, CASE WHEN role = 'pitching' THEN {RATE3["era"]} END AS era, CASE WHEN role = 'pitching' THEN {RATE3["k_bb_pct"]} END AS k_bb_pct,
         coalesce(minor_games, 0) AS minor_games, coalesce(max_level_rank, 0) AS max_level_rank, rate_at_max_level, CAST(awards_to_date AS BIGINT) AS awards_to_date, date_diff('day', birth_date, c1.month) / 365.25 AS age, position, birth_date, first_top,
         CAST(year(c1.month) + CASE WHEN month(c1.month) >= 11 THEN 1 ELSE 0 END AS BIGINT) AS season,
         CASE WHEN first_top IS NULL THEN 'prospect' WHEN year(c1.month) + CASE WHEN month(c1.month) >= 11 THEN 1 ELSE 0 END - first_top_season <= 0 THEN 'rookie_year' WHEN year(c1.month) + CASE WHEN month(c1.month) >= 11 THEN 1 ELSE 0 END - first_top_season = 1 THEN 'sophomore' ELSE 'established' END AS career_stage
         FROM c1 LEFT JOIN c3 USING (entity_id, month) JOIN aw USING (entity_id, month) LEFT JOIN ro USING (entity_id) LEFT JOIN v_info i USING (entity_id))"""
MULTI_SQL = "mp AS (SELECT px.*, cf.* EXCLUDE (entity_id, month), date_diff('day', birth_date, date_trunc('day', coalesce(first_top, cf.month))) / 365.25 AS age_at_debut FROM px JOIN cf ON cf.entity_id = px.entity_id AND cf.month = px.month)"
CAREER_COLUMNS = ["games", "home_runs", "ops", "era", "k_bb_pct", "minor_games", "max_level_rank", "rate_at_max_level", "career_stage", "awards_to_date", "age", "position"]


def _out(columns: list[str], doubles: tuple[str, ...] = ("ret_12m", "price_level", "ret_3m", "market_ret_3m", "ops", "era", "k_bb_pct", "rate_at_max_level", "age", "age_at_debut")) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in columns)


def _multi(spark: SparkSession, sf_dir: str, entries_from: str | None = None) -> DataFrame:
    return panels.multi_year_panel(views.chart(spark, sf_dir), views.logs(spark, sf_dir), views.registry(spark, sf_dir), views.info(spark, sf_dir), entries_from)


MULTI_COLUMNS = ["card_slug", "grade", "month", "ret_12m", "price_level", "ret_3m", "market_ret_3m", *CAREER_COLUMNS, "age_at_debut"]


@query(f"WITH {CAREER_SQL}, {MULTI_SQL} SELECT {_out(MULTI_COLUMNS)} FROM mp WHERE month >= TIMESTAMP '1997-01-01'", "v_month_ends", "v_logs", "v_registry", "v_info")
def n03_multi_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_multi(spark, sf_dir, "1997-01-01").select(*MULTI_COLUMNS))


#: The class of an entity and its kind of item: here the year of its first row, and every other entity has first issues.
CLASSES_SQL = "cs AS (SELECT entity_id, min(season) AS class_year, CASE WHEN entity_id % 2 = 0 THEN 'first' ELSE 'later' END AS card_type FROM v_logs GROUP BY entity_id)"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.logs(spark, sf_dir).groupBy("entity_id").agg(F.min("season").alias("class_year")).withColumn("card_type", F.when(F.col("entity_id") % 2 == 0, "first").otherwise("later"))


EXPECT_SQL = """x AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS entity_id, CAST(year(o_orderdate) AS BIGINT) AS season, CASE o_orderstatus WHEN 'O' THEN 'pipeline' WHEN 'F' THEN 'scouts' ELSE 'draft' END AS source, o_orderkey % 100 AS rank, o_totalprice / 10000 AS fv, o_orderdate AS as_of FROM orders)"""


def _expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    source = F.when(F.col("o_orderstatus") == "O", "pipeline").when(F.col("o_orderstatus") == "F", "scouts").otherwise("draft")
    orders = views.read(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    return orders.select((F.col("o_custkey") % F.col("n")).alias("entity_id"), F.year("o_orderdate").cast("bigint").alias("season"), source.alias("source"), (F.col("o_orderkey") % 100).alias("rank"), (F.col("o_totalprice") / 10000).alias("fv"), F.col("o_orderdate").alias("as_of"))


KNOWN_SQL = """ex AS (SELECT e.entity_id, e.month, e.season, class_year, min(rank) FILTER (source = 'pipeline' AND x.season = e.season) AS pipeline_rank, min(rank) FILTER (source = 'pipeline' AND x.season = e.season - 1) AS before,
         max(fv) FILTER (source = 'scouts' AND x.season = e.season) AS fv, min(rank) FILTER (source = 'draft' AND x.season IN (class_year, class_year - 1)) AS draft_rank
         FROM (SELECT DISTINCT entity_id, month, CAST(year(month) + CASE WHEN month(month) >= 11 THEN 1 ELSE 0 END AS BIGINT) AS season FROM v_month_ends) e LEFT JOIN cs USING (entity_id) LEFT JOIN x ON x.entity_id = e.entity_id AND x.as_of < e.month GROUP BY 1, 2, 3, 4)"""


@query(
    f"""WITH {EXPECT_SQL}, {CLASSES_SQL}, {KNOWN_SQL} SELECT entity_id, month AS entry_month, season, class_year, pipeline_rank, round(fv, 6) AS fv, draft_rank, pipeline_rank - before AS rank_change FROM ex""",
    "v_month_ends",
    "v_logs",
)
def n05_expectation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _months(spark, sf_dir).select("entity_id", F.col("month").alias("entry_month"), f.season_year(F.col("month")).cast("bigint").alias("season")).distinct()
    entries = entries.join(_classes(spark, sf_dir).drop("card_type"), "entity_id", "left")
    return rounded(panels.expectation_features(entries, _expectations(spark, sf_dir)))


#: CTEs of the class panel (cp) after CAREER_SQL.
CLASS_SQL = f"""tl AS (SELECT * FROM v_logs WHERE level = 'mlb'), {LEAGUE_SQL.format(logs="tl")},
       sl AS (SELECT entity_id, season, {LINE_SQL} FROM tl GROUP BY entity_id, season, role),
       pr AS (SELECT t.entity_id, t.season, rate, weight, row_number() OVER (PARTITION BY t.entity_id, t.season ORDER BY sl.season DESC) AS rn FROM (SELECT DISTINCT entity_id, season FROM cf) t JOIN sl ON sl.entity_id = t.entity_id AND sl.season BETWEEN t.season - 3 AND t.season - 1 WHERE rate IS NOT NULL AND weight > 0),
       pj AS (SELECT entity_id, season, sum((6 - rn) * weight) AS played, sum((6 - rn) * rate * weight) AS recent FROM pr GROUP BY 1, 2),
       pc AS (SELECT cf.entity_id, cf.month, CASE WHEN cf.role = 'hitting' THEN {OPS_SQL} ELSE sum(earned_runs) * 27 / nullif(sum(outs), 0) END AS pace_rate FROM cf LEFT JOIN tl ON tl.entity_id = cf.entity_id AND tl.season = cf.season AND tl.date < cf.month GROUP BY cf.entity_id, cf.month, cf.role),
       ma AS (SELECT cf.entity_id, cf.month, CASE WHEN league_mean IS NOT NULL AND played > 0 THEN (recent + league_mean * 1200) / (played + 1200) END AS marcel_rate FROM cf LEFT JOIN pj ON pj.entity_id = cf.entity_id AND pj.season = cf.season LEFT JOIN lg ON lg.season = cf.season AND lg.role = cf.role AND lg.month = cf.month),
       cp AS (SELECT px.*, cf.* EXCLUDE (entity_id, month), cs.class_year, card_type, coalesce(first_season, 9999) >= 2020 AS price_visible_breakout, pipeline_rank, pipeline_rank - before AS rank_change, fv, draft_rank, marcel_rate, pace_rate,
         CASE WHEN role = 'hitting' THEN pace_rate - marcel_rate END AS surprise_ops, CASE WHEN role = 'pitching' THEN pace_rate - marcel_rate END AS surprise_era
         FROM px JOIN cf ON cf.entity_id = px.entity_id AND cf.month = px.month LEFT JOIN cs ON cs.entity_id = px.entity_id LEFT JOIN ex ON ex.entity_id = px.entity_id AND ex.month = px.month JOIN pc ON pc.entity_id = px.entity_id AND pc.month = px.month JOIN ma ON ma.entity_id = px.entity_id AND ma.month = px.month)"""
CLASS_DOUBLES = ("ret_12m", "price_level", "ret_3m", "market_ret_3m", "ops", "era", "k_bb_pct", "rate_at_max_level", "age", "fv", "marcel_rate", "pace_rate", "surprise_ops", "surprise_era")
CLASS_COLUMNS = ["card_slug", "grade", "month", "ret_12m", "price_level", "ret_3m", "market_ret_3m", *CAREER_COLUMNS, "class_year", "card_type", "price_visible_breakout", "pipeline_rank", "rank_change", "fv", "draft_rank", "marcel_rate", "pace_rate", "surprise_ops", "surprise_era"]
CLASS_WITH = f"WITH {EXPECT_SQL}, {CLASSES_SQL}, {KNOWN_SQL}, {CAREER_SQL}, {CLASS_SQL}"
CLASS_VIEWS = ("v_month_ends", "v_logs", "v_registry", "v_info")


def _class_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.class_panel(views.chart(spark, sf_dir), views.logs(spark, sf_dir), views.registry(spark, sf_dir), views.info(spark, sf_dir), _expectations(spark, sf_dir), _classes(spark, sf_dir))


@query(f"{CLASS_WITH} SELECT {_out(CLASS_COLUMNS, CLASS_DOUBLES)} FROM cp", *CLASS_VIEWS)
def n04_class_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_class_panel(spark, sf_dir).select(*CLASS_COLUMNS))


@query(f"{CLASS_WITH} SELECT DISTINCT entity_id, month, role, round(pace_rate, 6) AS pace_rate, round(marcel_rate, 6) AS marcel_rate, round(coalesce(surprise_ops, surprise_era), 6) AS surprise FROM cp", *CLASS_VIEWS)
def n04_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pace before the entry less the projection, of both groups."""
    rows = _class_panel(spark, sf_dir).select("entity_id", "month", "role", "pace_rate", "marcel_rate", F.coalesce("surprise_ops", "surprise_era").alias("surprise"))
    return rounded(rows.distinct())


@query(
    f"""WITH r AS (SELECT card_slug, entity_id, grade, month, ln(price / lag(price) OVER w) AS log_ret, year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER w AS gap FROM v_month_ends WINDOW w AS (PARTITION BY card_slug, grade ORDER BY month)),
       m AS (SELECT month, median(log_ret) AS med FROM r GROUP BY 1), fs AS (SELECT entity_id, min(season) AS rookie_year FROM v_logs GROUP BY 1)
       SELECT card_slug, grade, month, round(log_ret - med, 6) AS excess_ret, year(month) - rookie_year AS years_since_rookie, {GROUP_CASE} AS position_group FROM r JOIN m USING (month) LEFT JOIN fs USING (entity_id) LEFT JOIN v_info USING (entity_id)
       WHERE (gap IS NULL OR gap <= 2) AND log_ret - med IS NOT NULL""",
    "v_month_ends",
    "v_logs",
    "v_info",
)
def n06_modelling_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = windows.market_excess(windows.observed_returns(_months(spark, sf_dir), ["card_slug", "grade"], "month", "price", "months"), ["month"])
    first = views.logs(spark, sf_dir).groupBy("entity_id").agg(F.min("season").alias("rookie_year"))
    known = panel.join(first, "entity_id", "left").join(views.info(spark, sf_dir).select("entity_id", "position"), "entity_id", "left").withColumn("stats_season", F.year("month").cast("bigint"))
    frame = panels.modelling_frame(known, "months_since_prev", 2, season="stats_season", rookie_year="rookie_year", position="position")
    return rounded(frame.select("card_slug", "grade", "month", "excess_ret", "years_since_rookie", "position_group"))


HOLD12 = """h AS (SELECT m.card_slug, m.entity_id, m.grade, m.month, ln(l.price / m.price) AS ret_12m, ln(m.price / t.price) AS ret_3m, position FROM v_month_ends m
         LEFT JOIN v_month_ends l ON l.card_slug = m.card_slug AND l.grade = m.grade AND l.month = m.month + INTERVAL 12 MONTH LEFT JOIN v_month_ends t ON t.card_slug = m.card_slug AND t.grade = m.grade AND t.month = m.month - INTERVAL 3 MONTH LEFT JOIN v_info i ON i.entity_id = m.entity_id)"""


def _hold_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _months(spark, sf_dir)
    trailing = windows.trailing_features(months, ["card_slug", "grade"]).select("card_slug", "grade", "month", "ret_3m")
    held = windows.hold_returns(months, ["card_slug", "grade"], (12,)).join(trailing, ["card_slug", "grade", "month"])
    return held.join(views.info(spark, sf_dir).select("entity_id", "position"), "entity_id", "left")


HELD_SQL = """CASE WHEN games > 0 THEN home_runs / games ELSE 0 END AS career_hr_rate, ln(1 + games) AS log_career_games, ln(1 + minor_games) AS log_minor_games, CAST(career_stage = 'sophomore' AS INTEGER) AS sophomore, CAST(career_stage = 'established' AS INTEGER) AS established"""


@query(
    f"""WITH {CLASSES_SQL}, {CAREER_SQL}, {MULTI_SQL},
       k AS (SELECT card_slug, mp.entity_id, grade, month, CAST(year(month) AS INTEGER) AS entry_year, ret_12m, ops AS career_ops, {HELD_SQL}, max_level_rank, rate_at_max_level, awards_to_date, age, age_at_debut, price_level, ret_3m, market_ret_3m, CAST(card_type = 'first' AS INTEGER) AS first_issue, season - class_year AS years_since_rookie
         FROM mp LEFT JOIN cs ON cs.entity_id = mp.entity_id WHERE position IS DISTINCT FROM 'P' AND ret_12m IS NOT NULL),
       md AS (SELECT {", ".join(f"median({c}) AS {c}" for c in panels.HOLD_FEATURES)} FROM k)
       SELECT card_slug, k.entity_id, grade, month, entry_year, round(ret_12m, 6) AS ret_12m, {", ".join(f"round(CAST(coalesce(k.{c}, md.{c}) AS DOUBLE), 6) AS {c}" for c in panels.HOLD_FEATURES)} FROM k, md""",
    "v_month_ends",
    "v_logs",
    "v_registry",
    "v_info",
)
def n07_hold_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.hold_frame(_multi(spark, sf_dir), _classes(spark, sf_dir), "ret_12m"))


CLASS_HOLD_SQL = f"""hf AS (SELECT card_slug, cp.entity_id, grade, month, CAST(year(month) AS INTEGER) AS entry_year, ret_12m, class_year, card_type, position, career_stage, ops AS career_ops, era AS career_era, k_bb_pct AS career_k_bb_pct, {HELD_SQL}, max_level_rank, rate_at_max_level, awards_to_date, age,
         CASE WHEN debut <= month THEN date_diff('day', birth_date, date_trunc('day', debut)) / 365.25 END AS age_at_debut, price_level, ret_3m, market_ret_3m, CAST(career_stage = 'prospect' AS INTEGER) AS prospect, season - class_year AS years_since_class, surprise_ops, draft_rank, -surprise_era AS surprise_era_flipped
         FROM cp LEFT JOIN (SELECT entity_id, min(date) AS debut FROM v_logs WHERE level = 'mlb' GROUP BY 1) d ON d.entity_id = cp.entity_id WHERE ret_12m IS NOT NULL)"""
CLASS_HOLD_COLUMNS = list(dict.fromkeys([*panels.CLASS_HOLD_FEATURES, *panels.CLASS_PITCHER_FEATURES]))


def _class_hold(spark: SparkSession, sf_dir: str, pitchers: bool | None = None) -> DataFrame:
    debuts = views.logs(spark, sf_dir).where("level = 'mlb'").groupBy("entity_id").agg(F.min("date").alias("event_date"))
    return panels.class_hold_frame(_class_panel(spark, sf_dir), debuts, views.info(spark, sf_dir), "ret_12m", pitchers)


@query(
    f"""{CLASS_WITH}, {CLASS_HOLD_SQL} SELECT card_slug, entity_id, grade, month, entry_year, round(ret_12m, 6) AS ret_12m, class_year, card_type, position, career_stage, {_out(CLASS_HOLD_COLUMNS, ("career_ops", "career_era", "career_k_bb_pct", "career_hr_rate", "log_career_games", "log_minor_games", "rate_at_max_level", "age", "age_at_debut", "price_level", "ret_3m", "market_ret_3m", "surprise_ops", "surprise_era_flipped"))} FROM hf""",
    *CLASS_VIEWS,
)
def n08_class_hold_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both groups in one pass: hitters and those of null position, and pitchers."""
    return rounded(_class_hold(spark, sf_dir))


@query(
    """WITH md AS (SELECT median(c_acctbal) AS m FROM customer), f AS (SELECT c_custkey, coalesce(c_acctbal, m) AS x, CAST(5 AS DOUBLE) AS flat FROM customer, md), s AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM f)
       SELECT c_custkey, round((x - a) / s, 6) AS c_acctbal, CAST(0 AS DOUBLE) AS flat FROM f, s"""
)
def n09_n10_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(5.0).alias("flat"))
    return rounded(panels.standardize(rows, ["c_acctbal", "flat"]))


MODEL_SQL = """p AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'ungraded' ELSE 'psa_10' END AS grade, CASE WHEN l_quantity < 45 THEN l_extendedprice / 1000 END AS ret_12m, CASE l_linenumber % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'SS' WHEN 2 THEN 'OF' END AS position,
         CASE WHEN l_tax > 0.01 THEN l_discount - 0.05 END AS surprise_ops, CASE WHEN l_tax > 0.02 THEN 0.05 - l_discount END AS surprise_era, CASE WHEN l_quantity > 3 THEN l_tax END AS market_ret_3m, ln(l_quantity) AS price_level,
         CASE l_suppkey % 5 WHEN 0 THEN 'prospect' WHEN 1 THEN 'rookie_year' WHEN 2 THEN 'sophomore' WHEN 3 THEN 'established' ELSE 'other' END AS career_stage, year(l_shipdate) AS class_year, l_suppkey AS entity_id FROM lineitem),
       r AS (SELECT *, surprise_ops AS surprise FROM p WHERE grade = 'ungraded' AND ret_12m IS NOT NULL AND position IS DISTINCT FROM 'P' AND surprise_ops IS NOT NULL),
       m AS (SELECT avg(surprise) AS a1, stddev_pop(surprise) AS s1, avg(market_ret_3m) AS a2, stddev_pop(market_ret_3m) AS s2, avg(price_level) AS a3, stddev_pop(price_level) AS s3 FROM r)"""


def _model_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    kind, stage = c("l_linenumber") % 4, c("l_suppkey") % 5
    panel = views.read(spark, sf_dir, "lineitem").select(
        F.when(c("l_returnflag") == "N", "ungraded").otherwise("psa_10").alias("grade"),
        F.when(c("l_quantity") < 45, c("l_extendedprice") / 1000).alias("ret_12m"),
        F.when(kind == 0, "P").when(kind == 1, "SS").when(kind == 2, "OF").alias("position"),
        F.when(c("l_tax") > 0.01, c("l_discount") - 0.05).alias("surprise_ops"),
        F.when(c("l_tax") > 0.02, 0.05 - c("l_discount")).alias("surprise_era"),
        F.when(c("l_quantity") > 3, c("l_tax")).alias("market_ret_3m"),
        F.log("l_quantity").alias("price_level"),
        F.when(stage == 0, "prospect").when(stage == 1, "rookie_year").when(stage == 2, "sophomore").when(stage == 3, "established").otherwise("other").alias("career_stage"),
        F.year("l_shipdate").alias("class_year"),
        c("l_suppkey").alias("entity_id"),
    )
    return panels.hierarchical_frame(panel, pitchers=False)


@query(
    f"""WITH {MODEL_SQL} SELECT round(ret_12m, 6) AS y, round((surprise - a1) / s1, 6) AS surprise, round((market_ret_3m - a2) / s2, 6) AS market_ret_3m, round((price_level - a3) / s3, 6) AS price_level, nullif(career_stage, 'other') AS career_stage,
       CAST(class_year AS VARCHAR) AS class_year, CAST(class_year AS VARCHAR) || '_' || coalesce(position, 'None') AS class_position, CAST(entity_id AS VARCHAR) AS entity_id FROM r, m"""
)
def n09_hierarchical_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_model_frame(spark, sf_dir)[0])


@query(f"WITH {MODEL_SQL} SELECT 'surprise' AS predictor, round(a1, 6) AS mean, round(s1, 6) AS sd FROM m UNION ALL SELECT 'market_ret_3m', round(a2, 6), round(s2, 6) FROM m UNION ALL SELECT 'price_level', round(a3, 6), round(s3, 6) FROM m")
def n09_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the predictors were scaled by."""
    return rounded(_model_frame(spark, sf_dir)[1])


@query("SELECT card_slug AS item, month AS period, round(ln(price), 6) AS y FROM v_month_ends WHERE grade = 'psa_10'", "v_month_ends")
def n11_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_months(spark, sf_dir).where("grade = 'psa_10'").select(F.col("card_slug").alias("item"), F.col("month").alias("period"), F.log("price").alias("y")))


SNAP_SQL = """d AS (SELECT event, market_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, arg_max(raw_price, (ts, event_id)) AS raw FROM v_odds WHERE event = 'click' GROUP BY ALL),
       sn AS (SELECT market_id AS entity_id, day, raw / sum(raw) OVER (PARTITION BY event, day) AS p FROM d),
       g AS (SELECT entity_id, entry_month, season FROM (SELECT DISTINCT market_id AS entity_id FROM v_odds), (SELECT unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-10']) AS entry_month), (SELECT 2024 AS season UNION ALL SELECT 2023))"""
LEVEL_SQL = """lv AS (SELECT g.*, max(sn.day) AS ld, arg_max(sn.p, sn.day) AS lp FROM g LEFT JOIN sn ON sn.entity_id = g.entity_id AND sn.day < g.entry_month GROUP BY ALL),
       d7 AS (SELECT lv.entity_id, lv.entry_month, lv.season, arg_max(sn.p, sn.day) AS p7 FROM lv LEFT JOIN sn ON sn.entity_id = lv.entity_id AND sn.day < least(lv.entry_month - INTERVAL 7 DAY, coalesce(lv.ld, lv.entry_month)) GROUP BY ALL),
       o AS (SELECT lv.*, p7, lv.season = 2024 AND lv.entity_id IN (SELECT entity_id FROM sn) AS has_market FROM lv JOIN d7 USING (entity_id, entry_month, season))"""


def _odds_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.odds(spark, sf_dir)
    daily = a.daily_last(rows.where("event = 'click'"), ["event", "market_id"]).withColumn("day", F.col("day").cast("timestamp_ntz"))
    snapshots = a.normalize_vig(daily, ["event", "day"]).withColumnRenamed("market_id", "entity_id")
    months = F.array(*(F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-01-25", "2024-02-10")))
    grid = rows.select(F.col("market_id").alias("entity_id")).distinct().withColumn("entry_month", F.explode(months)).withColumn("season", F.explode(F.array(F.lit(2024), F.lit(2023))))
    return grid, snapshots


@query(
    f"""WITH {SNAP_SQL}, {LEVEL_SQL} SELECT entity_id, entry_month, season, has_market, round(CASE WHEN has_market OR ld IS NOT NULL THEN lp ELSE 0 END, 9) AS odds_level, round(CASE WHEN has_market OR ld IS NOT NULL THEN lp - p7 ELSE 0 END, 9) AS odds_delta_7 FROM o""",
    "v_odds",
)
def o04_odds_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(odds.month_features(*_odds_grid(spark, sf_dir), deltas=(7,)), 9)


@query(
    f"""WITH {SNAP_SQL}, {LEVEL_SQL}, fr AS (SELECT *, unnest([1, 2]) AS copy FROM g) SELECT fr.entity_id, fr.entry_month, fr.season, fr.copy, has_market, round(CASE WHEN has_market OR ld IS NOT NULL THEN lp ELSE 0 END, 9) AS odds_level FROM fr JOIN o USING (entity_id, entry_month, season)""",
    "v_odds",
)
def j20_attach_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, snapshots = _odds_grid(spark, sf_dir)
    frame = grid.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return rounded(odds.attach(frame, snapshots, deltas=(7,)).drop("odds_delta_7"), 9)


@query(f"WITH {SNAP_SQL} SELECT count(*) FILTER (p IS NULL OR NOT p BETWEEN 0 AND 1) AS bad_prob, count(*) FILTER (day IS NULL) AS no_day, count(*) AS n FROM sn", "v_odds")
def o05_odds_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odds.acceptance(_odds_grid(spark, sf_dir)[1], F.col("implied_prob"), F.col("day"))


SCORE_SQL = "qs AS (SELECT card_slug, grade, month, ret_12m, ret_3m AS score FROM h WHERE ret_3m IS NOT NULL), q AS (SELECT * FROM qs WHERE ret_12m IS NOT NULL)"


@query(
    f"""WITH {HOLD12}, {SCORE_SQL} SELECT card_slug, grade, month, rank, round(ret_12m, 6) AS ret_12m FROM (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY score DESC, card_slug, grade) AS INTEGER) AS rank FROM q) WHERE rank <= 2""",
    "v_month_ends",
    "v_info",
)
def w11_t02_top_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hold_panel(spark, sf_dir).where("ret_12m IS NOT NULL AND ret_3m IS NOT NULL")
    return rounded(windows.top_per_period(rows, ["month"], "ret_3m", 2, ["card_slug", "grade"]).select("card_slug", "grade", "month", "rank", "ret_12m"))


SPREAD_SQL = """rk AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2 AS r, count(*) OVER (PARTITION BY month) AS n FROM qs),
       sp AS (SELECT month, avg(ret_12m) FILTER (least(greatest(ceil(r / n * 5), 1), 5) = 5) - avg(ret_12m) FILTER (least(greatest(ceil(r / n * 5), 1), 5) = 1) AS spread, count(*) AS n FROM rk WHERE n >= 10 GROUP BY 1)"""


@query(f"WITH {HOLD12}, {SCORE_SQL}, {SPREAD_SQL} SELECT month, round(spread, 6) AS spread, n FROM sp", "v_month_ends", "v_info")
def w12_quantile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.quantile_spread(_hold_panel(spark, sf_dir), "ret_3m", "ret_12m", "month"))


YEAR_DRAW = resample.draws_sql(42, 10_000, "yr")


@query(
    f"""WITH {HOLD12}, {SCORE_SQL}, {SPREAD_SQL}, yr AS (SELECT y, avg(spread) AS m, row_number() OVER (ORDER BY y) - 1 AS i FROM (SELECT year(month) AS y, spread FROM sp WHERE spread IS NOT NULL) GROUP BY 1),
       dr AS ({YEAR_DRAW}), bt AS (SELECT rep, avg(yr.m) AS m FROM dr JOIN yr ON yr.i = dr.i GROUP BY 1)
       SELECT round((SELECT avg(m) FROM yr), 6) AS mean_spread, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, (SELECT count(spread) FROM sp) AS n_months, round((SELECT avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0 END) FROM sp WHERE spread IS NOT NULL), 6) AS share_positive FROM bt""",
    "v_month_ends",
    "v_info",
)
def r03_spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.spread_summary(windows.quantile_spread(_hold_panel(spark, sf_dir), "ret_3m", "ret_12m", "month"), "month"))


GATE_SQL = """pk AS (SELECT month, ret_12m - med AS realized FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, card_slug, grade) AS rank, median(ret_12m) OVER (PARTITION BY month) AS med FROM q) WHERE rank <= 2)"""
GATE_DRAW = resample.draws_sql(42, 10_000, "pl")


@query(
    f"""WITH {HOLD12}, {SCORE_SQL}, {GATE_SQL}, pl AS (SELECT month, avg(realized) AS m, row_number() OVER (ORDER BY month) - 1 AS i FROM pk GROUP BY 1),
       dr AS ({GATE_DRAW}), bt AS (SELECT rep, avg(pl.m) AS m FROM dr JOIN pl ON pl.i = dr.i GROUP BY 1),
       o AS (SELECT (SELECT avg(m) FROM pl) AS mean, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0 END) AS p FROM bt)
       SELECT round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p, round(ci_low - 0.14, 6) AS net_ci_low, CASE WHEN ci_low - 0.14 > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM o""",
    "v_month_ends",
    "v_info",
)
def r04_r05_w13_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the picks over the period's median, their bounds over resampled periods, and the verdict net of a fee."""
    rows = _hold_panel(spark, sf_dir).where("ret_12m IS NOT NULL AND ret_3m IS NOT NULL")
    excess = windows.market_excess(rows, ["month"], "ret_12m", "realized")
    picks = windows.top_per_period(excess, ["month"], "ret_3m", 2, ["card_slug", "grade"])
    gate = resample.mean_interval(picks.groupBy("month").agg(F.avg("realized").alias("m")), "m", ["month"])
    net = F.col("ci_low") - 0.14
    return rounded(gate.withColumns({"net_ci_low": net, "verdict": F.when(net > 0, "PASS").otherwise("FAIL")}))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
def t01_sorted_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last")).orderBy("l_returnflag", "l_linestatus")


@query(
    """WITH c AS (SELECT l_suppkey % 10 AS g, round(corr(l_quantity, l_discount), 6) AS quantity, round(corr(l_tax, l_discount), 6) AS tax FROM lineitem GROUP BY 1)
       SELECT g, CASE WHEN greatest(abs(quantity), abs(tax)) >= 0.01 THEN CASE WHEN abs(quantity) >= abs(tax) THEN 'quantity' ELSE 'tax' END ELSE 'none' END AS top_stat FROM c"""
)
def t03_top_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest feature above a threshold, or a fallback."""
    rows = views.read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("g")).agg(F.round(F.abs(F.corr("l_quantity", "l_discount")), 6).alias("q"), F.round(F.abs(F.corr("l_tax", "l_discount")), 6).alias("t"))
    best = F.when(F.col("q") >= F.col("t"), "quantity").otherwise("tax")
    return rows.select("g", F.when(F.greatest("q", "t") >= 0.01, best).otherwise("none").alias("top_stat"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS kind, CAST(NULL AS DOUBLE) AS discount FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT l_orderkey, NULL, l_discount FROM lineitem WHERE l_quantity = 50""")
def u01_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = views.read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    return high.unionByName(views.read(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("discount")), allowMissingColumns=True)


@query("SELECT DISTINCT card_slug, sale_date, title, price FROM (SELECT * FROM v_sales WHERE grade = 'psa_10' UNION ALL SELECT * FROM v_sales WHERE price < 2000)", "v_sales")
def u02_u04_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = views.sales(spark, sf_dir)
    keys = ["card_slug", "sale_date", "title", "price"]
    return sales.where("grade = 'psa_10'").unionByName(sales.where("price < 2000")).select(*keys).dropDuplicates(keys)


@query(
    """WITH a AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_partkey % 5 < 4 GROUP BY 1, 2),
       j AS (SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, a.p_size AS x, b.p_size AS y, n FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_size = b.p_size),
       s AS (SELECT p_brand, CAST(coalesce(sum(n), 0) AS BIGINT) AS their_total, count(x) AS our_total, list_sort(list(y) FILTER (x IS NULL)) AS t, list_sort(list(x) FILTER (y IS NULL)) AS o, count(y) AS k FROM j GROUP BY 1)
       SELECT p_brand, their_total, our_total, coalesce(array_to_string(t, ','), '') AS theirs_only, coalesce(array_to_string(o, ','), '') AS ours_only, coalesce(len(t), 0) = 0 AS ok, round(1 - coalesce(len(t), 0) / nullif(k, 0), 6) AS share, coalesce(1 - coalesce(len(t), 0) / nullif(k, 0) >= 0.85, false) AS complete FROM s"""
)
def j18_u03_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each brand's items in two lists of them."""
    parts = views.read(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")
    found = joins.reconcile(parts.where("p_partkey % 3 <> 0"), parts.where("p_partkey % 5 < 4"), ["p_brand"], "p_size")
    as_text = {c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("theirs_only", "ours_only")}
    return rounded(found.withColumns(as_text))


@query("SELECT y.season, l.level FROM (SELECT DISTINCT season FROM v_logs) y, (SELECT DISTINCT p_type AS level FROM part UNION SELECT 'mlb') l WHERE (y.season, l.level) NOT IN (SELECT season, level FROM v_logs)", "v_logs")
def u05_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = views.logs(spark, sf_dir)
    levels = views.read(spark, sf_dir, "part").select(F.col("p_type").alias("level")).union(spark.range(1).select(F.lit("mlb"))).distinct()
    return joins.missing_cells(logs.select("season").distinct(), levels, logs.select("season", "level").distinct(), ["season", "level"])
