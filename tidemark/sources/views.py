"""Adapters: the given tables in the shapes that the panel operators work on, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRADES = {"A": "psa_10", "R": "psa_9"}  # the third flag is an ungraded item

#: Common table expressions of the same shapes, by name; `with_views` puts those that a query uses before it.
SQL = {
    "v_sales": """SELECT 'card-' || CAST(l_suppkey AS VARCHAR) AS card_slug, l_suppkey AS entity_id,
        CASE l_returnflag WHEN 'A' THEN 'psa_10' WHEN 'R' THEN 'psa_9' END AS grade, l_shipdate AS sale_date,
        l_extendedprice / l_quantity AS price, l_discount >= 0.05 AS best_offer, p_name AS title
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_chart": """SELECT card_slug, entity_id, coalesce(grade, 'ungraded') AS grade, sale_date AS date, max(price) AS price
        FROM v_sales GROUP BY ALL""",
    "v_logs": """SELECT *, at_bats + walks + hit_by_pitch + sac_flies AS plate_appearances, hits + doubles + 3 * home_runs AS total_bases
        FROM (SELECT l_suppkey AS entity_id, l_orderkey * 10 + l_linenumber AS game_id, l_shipdate AS date, CAST(year(l_shipdate) AS BIGINT) AS season,
        CASE WHEN l_suppkey % 3 = 0 THEN 'pitching' ELSE 'hitting' END AS role, CASE WHEN l_linestatus = 'O' THEN 'mlb' WHEN l_linenumber % 4 = 0 THEN 'a' WHEN l_linenumber % 4 = 1 THEN 'a_plus' WHEN l_linenumber % 4 = 2 THEN 'aa' ELSE 'aaa' END AS level,
        CAST(1 AS BIGINT) AS games, CAST(3 + l_linenumber % 3 AS BIGINT) AS at_bats, CAST(floor(l_quantity) AS BIGINT) % 5 AS hits,
        CAST(l_linenumber % 2 AS BIGINT) AS doubles, CAST(floor(l_quantity) AS BIGINT) % 4 AS home_runs,
        CAST(floor(l_tax * 100 + 0.5) AS BIGINT) % 3 AS walks, CAST(CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS hit_by_pitch,
        CAST(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sac_flies, CAST(l_linenumber % 3 AS BIGINT) AS stolen_bases,
        CAST(floor(l_quantity) AS BIGINT) % 13 AS strike_outs, 20 + CAST(floor(l_quantity) AS BIGINT) % 9 AS batters_faced,
        3 + CAST(floor(l_quantity) AS BIGINT) % 22 AS outs, CAST(l_linenumber % 5 AS BIGINT) AS earned_runs, CAST(l_linenumber % 5 + l_linenumber % 2 AS BIGINT) AS runs,
        CAST(CASE WHEN floor(l_quantity) % 3 > 0 THEN 1 ELSE 0 END AS BIGINT) AS games_started FROM lineitem)""",
    "v_odds": """SELECT 'exchange' || CAST(user_id % 2 AS VARCHAR) AS source, event_type AS event, user_id AS market_id, user_id % 100 AS entity_id, event_id, ts, value / 500 AS raw_price FROM events""",
    "v_registry": """SELECT DISTINCT entity_id, date AS event_date FROM v_logs WHERE role = 'hitting' AND home_runs = 3 AND hits = 4 AND stolen_bases = 2""",
    "v_info": """SELECT s_suppkey AS entity_id, s_name AS name, make_timestamp(1970 + CAST(s_suppkey % 10 AS INT), 1, 1, 0, 0, 0.0) AS birth_date,
        CASE s_nationkey % 4 WHEN 0 THEN 'SS' WHEN 1 THEN 'CF' WHEN 2 THEN 'P' END AS position FROM supplier""",
    "v_month_ends": """SELECT card_slug, entity_id, grade, month, max_by(price, date) AS price FROM (
        SELECT card_slug, entity_id, grade, date, CAST(date_trunc('month', date) AS TIMESTAMP) AS month, median(price) AS price
        FROM v_chart WHERE grade IN ('psa_10', 'ungraded') GROUP BY ALL) GROUP BY card_slug, entity_id, grade, month""",
    "v_weekly": """SELECT card_slug, coalesce(grade, 'ungraded') AS grade, CAST(date_trunc('week', sale_date) AS TIMESTAMP) AS week,
        median(price) AS median_price, count(*) AS n_sales, avg(CASE WHEN best_offer THEN 1.0 ELSE 0.0 END) AS best_offer_share
        FROM v_sales GROUP BY ALL HAVING count(*) >= 2""",
}
NEEDS = {"v_chart": ["v_sales"], "v_registry": ["v_logs"], "v_month_ends": ["v_chart"], "v_weekly": ["v_sales"]}


def with_views(query: str, *names: str) -> str:
    """The query with the views that it names, and those that they need, before it."""
    if not names:
        return query.strip()
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    heads = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = query.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{heads},\n{body[len(start) :]}"
    return f"WITH {heads}\n{body}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; NaN in its doubles becomes null, as aggregates don't skip it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    grade = F.when(F.col("l_returnflag") == "A", "psa_10").when(F.col("l_returnflag") == "R", "psa_9")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.concat(F.lit("card-"), F.col("l_suppkey").cast("string")).alias("card_slug"),
        F.col("l_suppkey").alias("entity_id"),
        grade.alias("grade"),
        F.col("l_shipdate").alias("sale_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_discount") >= 0.05).alias("best_offer"),
        F.col("p_name").alias("title"),
    )


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.coalesce("grade", F.lit("ungraded")).alias("grade")
    return sales(spark, sf_dir).groupBy("card_slug", "entity_id", grade, F.col("sale_date").alias("date")).agg(F.max("price").alias("price"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity, line = F.floor("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    base = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        (F.col("l_orderkey") * 10 + line).alias("game_id"),
        F.col("l_shipdate").alias("date"),
        F.year("l_shipdate").cast("bigint").alias("season"),
        F.when(F.col("l_suppkey") % 3 == 0, "pitching").otherwise("hitting").alias("role"),
        F.when(F.col("l_linestatus") == "O", "mlb").when(line % 4 == 0, "a").when(line % 4 == 1, "a_plus").when(line % 4 == 2, "aa").otherwise("aaa").alias("level"),
        F.lit(1).cast("bigint").alias("games"),
        (3 + line % 3).alias("at_bats"),
        (quantity % 5).alias("hits"),
        (line % 2).alias("doubles"),
        (quantity % 4).alias("home_runs"),
        (F.floor(F.col("l_tax") * 100 + 0.5).cast("bigint") % 3).alias("walks"),
        (line % 5 == 0).cast("bigint").alias("hit_by_pitch"),
        (line % 4 == 0).cast("bigint").alias("sac_flies"),
        (line % 3).alias("stolen_bases"),
        (quantity % 13).alias("strike_outs"),
        (20 + quantity % 9).alias("batters_faced"),
        (3 + quantity % 22).alias("outs"),
        (line % 5).alias("earned_runs"),
        (line % 5 + line % 2).alias("runs"),
        (quantity % 3 > 0).cast("bigint").alias("games_started"),
    )
    return base.withColumns({"plate_appearances": F.expr("at_bats + walks + hit_by_pitch + sac_flies"), "total_bases": F.expr("hits + doubles + 3 * home_runs")})


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("exchange"), (F.col("user_id") % 2).cast("string")).alias("source"),
        F.col("event_type").alias("event"),
        F.col("user_id").alias("market_id"),
        (F.col("user_id") % 100).alias("entity_id"),
        "event_id",
        "ts",
        (F.col("value") / 500).alias("raw_price"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = "role = 'hitting' AND home_runs = 3 AND hits = 4 AND stolen_bases = 2"
    return logs(spark, sf_dir).where(rare).select("entity_id", F.col("date").alias("event_date")).distinct()


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("s_nationkey") % 4
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("entity_id"),
        F.col("s_name").alias("name"),
        F.make_timestamp_ntz((1970 + F.col("s_suppkey") % 10).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).alias("birth_date"),
        F.when(kind == 0, "SS").when(kind == 1, "CF").when(kind == 2, "P").alias("position"),
    )
