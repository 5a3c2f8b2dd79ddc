"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.plans.registry import query
from tidemark.sources import views

ACCENT_SQL = f"translate(lower({{}}), '{f.ACCENTS[0]}', '{f.ACCENTS[1]}')"
TOKENS_SQL = "trim(regexp_replace(" + ACCENT_SQL + ", '[^a-z0-9]+', ' ', 'g'))"
GROUP_CASE = "CASE position " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in f.POSITION_GROUPS.items()) + " END"


@query("SELECT coalesce(nullif(grade, ''), 'ungraded') AS grade, count(*) AS n, min(price) AS low FROM v_sales GROUP BY 1", "v_sales")
def f01_normalize_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sales(spark, sf_dir).groupBy(f.normalize_grade(F.col("grade")).alias("grade")).agg(F.count("*").alias("n"), F.min("price").alias("low"))


@query("SELECT card_slug, count(*) FILTER (grade IS NULL) AS n_ungraded, count(*) FILTER (grade = 'psa_10') AS n_psa_10 FROM v_sales GROUP BY 1", "v_sales")
def f02_grade_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = lambda g: F.count(F.when(f.grade_is(F.col("grade"), g), 1))
    return views.sales(spark, sf_dir).groupBy("card_slug").agg(mask("ungraded").alias("n_ungraded"), mask("psa_10").alias("n_psa_10"))


@query(
    """SELECT grade, count(*) AS n FROM (SELECT CASE WHEN entity_id % 7 = 0 THEN 'key:' || grade ELSE grade END AS grade FROM v_chart)
       WHERE NOT starts_with(grade, 'key:') AND grade IN ('psa_10', 'ungraded') GROUP BY 1""",
    "v_chart",
)
def f03_drop_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = views.chart(spark, sf_dir).withColumn("grade", F.when(F.col("entity_id") % 7 == 0, F.concat(F.lit("key:"), "grade")).otherwise(F.col("grade")))
    return keyed.where(f.not_keyed(F.col("grade"), ("psa_10", "ungraded"))).groupBy("grade").agg(F.count("*").alias("n"))


@query(rf"SELECT p_partkey, p_name, nullif(regexp_extract(p_name, '(?i)\b({'|'.join(f.CONTAMINATED + ('ring', 'widget'))})\b', 1), '') AS flag_reason FROM part")
def f04_contamination_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "part").select("p_partkey", "p_name", f.word_flag(F.col("p_name"), f.CONTAMINATED + ("ring", "widget")).alias("flag_reason"))


@query(
    f"""SELECT p_partkey, contains(' ' || {TOKENS_SQL.format("p_name || ' by ' || p_brand")} || ' ', ' ' || {TOKENS_SQL.format("'Widget by brand#1'")} || ' ') AS named FROM part"""
)
def f05_name_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" by "), "p_brand")
    return views.read(spark, sf_dir, "part").select("p_partkey", f.name_in_text(F.lit("Widget by brand#1"), text).alias("named"))


@query(f"""SELECT c_custkey, replace({ACCENT_SQL.format("c_name || ' Jr. é'")}, '.', '') AS name FROM customer""")
def f06_normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "customer").select("c_custkey", f.normalize_name(F.concat("c_name", F.lit(" Jr. é"))).alias("name"))


@query(
    f"""SELECT c_custkey, array_to_string([t FOR t IN string_split_regex({TOKENS_SQL.format("c_name || ' Jr. III'")}, ' +') IF t <> '' AND t NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v')], ' ') AS tokens FROM customer"""
)
def f07_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", f.name_tokens(F.concat("c_name", F.lit(" Jr. III")))).alias("tokens"))


@query(rf"SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)\b({'|'.join(f.PARALLEL)})\b')")
def f08_drop_parallels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "part").select("p_partkey", "p_name").where(f.word_flag(F.col("p_name"), f.PARALLEL).isNull())


@query("SELECT game_id, entity_id, date, outs AS outs_back FROM v_logs", "v_logs")
def f09_innings_to_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    innings = F.concat(F.floor(F.col("outs") / 3).cast("string"), F.when(F.col("outs") % 3 > 0, F.concat(F.lit("."), (F.col("outs") % 3).cast("string"))).otherwise(F.lit("")))
    return views.logs(spark, sf_dir).select("game_id", "entity_id", "date", f.innings_to_outs(innings).alias("outs_back"))


@query(
    """SELECT CAST(year(sale_date) + CASE WHEN month(sale_date) >= 11 THEN 1 ELSE 0 END AS INTEGER) AS season, CAST(date_trunc('month', sale_date) AS TIMESTAMP) AS month,
       CAST(date_trunc('week', sale_date) AS TIMESTAMP) AS week, CAST(year(sale_date) * 12 + month(sale_date) AS INTEGER) AS month_index, count(*) AS n FROM v_sales GROUP BY ALL""",
    "v_sales",
)
def f10_f11_f18_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("sale_date")
    return views.sales(spark, sf_dir).groupBy(f.season_year(d).alias("season"), f.month_start(d).alias("month"), f.week_start(d).alias("week"), f.month_index(d).alias("month_index")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT entity_id, round(date_diff('day', birth_date, TIMESTAMP '2000-01-01') / 365.25, 2) AS age, {GROUP_CASE} AS position_group,
       CASE WHEN month(birth_date) = 10 THEN true ELSE false END AS october FROM v_info""",
    "v_info",
)
def f12_f13_age_and_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = f.years_between(F.lit("2000-01-01").cast("timestamp_ntz"), F.col("birth_date"))
    return views.info(spark, sf_dir).select("entity_id", age.alias("age"), f.position_group(F.col("position")).alias("position_group"), (F.month("birth_date") == 10).alias("october"))


@query(
    """SELECT game_id, entity_id, date, total_bases + walks + stolen_bases AS hitter_score,
       CAST(50 + outs + 2 * greatest(0, floor((outs - 12) / 3.0)) + strike_outs - 2 * hits - 4 * earned_runs - 2 * greatest(0, runs - earned_runs) - walks AS BIGINT) AS pitcher_score,
       round(hits / nullif(at_bats, 0) + 1e-9, 3) AS hit_rate FROM v_logs""",
    "v_logs",
)
def f14_f15_f16_f19_game_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return views.logs(spark, sf_dir).select(
        "game_id",
        "entity_id",
        "date",
        f.hitter_game_score(c("total_bases"), c("walks"), c("stolen_bases")).alias("hitter_score"),
        f.pitcher_game_score(c("outs"), c("strike_outs"), c("hits"), c("earned_runs"), c("runs"), c("walks")).alias("pitcher_score"),
        f.ratio(c("hits"), c("at_bats")).alias("hit_rate"),
    )


@query(
    """WITH s AS (SELECT entity_id, season, sum(hits) / nullif(sum(at_bats), 0) AS rate, CAST(sum(plate_appearances) AS DOUBLE) AS pt FROM v_logs GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY season DESC) AS rn FROM s),
       l AS (SELECT sum(rate * pt) / sum(pt) AS mean FROM s)
       SELECT entity_id, round((sum(CASE rn WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 END * rate * pt) + max(mean) * 1200) / (sum(CASE rn WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 END * pt) + 1200), 9) AS marcel
       FROM r, l WHERE rn <= 3 GROUP BY entity_id HAVING sum(pt) > 0""",
    "v_logs",
)
def f17_w15_marcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights go by the seasons found, so a missing season moves the older ones up."""
    from pyspark.sql import Window

    lines = views.logs(spark, sf_dir).groupBy("entity_id", "season").agg((F.sum("hits") / F.nullif(F.sum("at_bats"), F.lit(0))).alias("rate"), F.sum("plate_appearances").cast("double").alias("weight"))
    mean = lines.agg((F.sum(F.col("rate") * F.col("weight")) / F.sum("weight")).alias("mean"))
    recent = lines.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("season").desc()))).where("rn <= 3")
    at = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c))).alias(f"{c}{k}")
    wide = recent.groupBy("entity_id").agg(*(at(c, k) for c in ("rate", "weight") for k in (1, 2, 3))).crossJoin(F.broadcast(mean))
    value = f.marcel([F.col(f"rate{k}") for k in (1, 2, 3)], [F.col(f"weight{k}") for k in (1, 2, 3)], F.col("mean"))
    return wide.select("entity_id", F.round(value, 9).alias("marcel")).where("marcel IS NOT NULL")


@query(
    r"""SELECT p_partkey, trim(regexp_replace('  ' || p_name || '  x ..', '\s+', ' ', 'g'), ' .') AS cleaned, replace(p_brand || '/' || p_type, '/', '__') AS key FROM part"""
)
def f20_f21_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "part").select("p_partkey", f.clean_name(F.concat(F.lit("  "), "p_name", F.lit("  x .."))).alias("cleaned"), f.safe_key(F.concat("p_brand", F.lit("/"), "p_type")).alias("key"))


TITLE = "CASE p_partkey % 8 WHEN 0 THEN p_name || ' PSA ' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'SGC-9.5 ' || p_name WHEN 2 THEN p_name || ' GEM MINT 10 bgs' WHEN 3 THEN p_name || ' $1,' || CAST(100 + p_size AS VARCHAR) || '.50' WHEN 4 THEN p_name || ' PSA MINT 9' WHEN 5 THEN CAST(p_size AS VARCHAR) || ' items' WHEN 6 THEN 'CGC pristine 10 $' || CAST(p_size AS VARCHAR) ELSE p_name END"


@query(
    rf"""WITH t AS (SELECT p_partkey, {TITLE} AS title FROM part),
    g AS (SELECT *, lower(regexp_extract(title, '{f.GRADE_PATTERN}', 1)) AS house, regexp_extract(title, '{f.GRADE_PATTERN}', 2) AS num, lower(regexp_extract(title, '{f.GEM_PATTERN}', 2)) AS gem_house, regexp_extract(title, '{f.GEM_PATTERN}', 1) AS gem FROM t)
    SELECT p_partkey, CASE WHEN house <> '' THEN house || '_' || num WHEN gem_house <> '' THEN gem_house || '_' || gem END AS grade,
           TRY_CAST(replace(nullif(regexp_extract(title, '{f.MONEY_PATTERN}', 1), ''), ',', '') AS DOUBLE) AS amount FROM g"""
)
def p09_p10_title_grade_and_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr(TITLE.replace("VARCHAR", "STRING"))
    rows = views.read(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    return rows.select("p_partkey", f.grade_from_title(F.col("title")).alias("grade"), f.money(F.col("title")).alias("amount"))
