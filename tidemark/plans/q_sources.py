"""Queries of sources, parsers, entity matching and streams, over payloads that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import aggregates, joins
from tidemark.plans.q_scalars import TOKENS_SQL
from tidemark.plans.q_series import rounded
from tidemark.plans.registry import query
from tidemark.session import scratch
from tidemark.sources import io, parse, views
from tidemark.streaming import jobs

# --- sources and sinks


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s01_parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "table")
    io.write_table(views.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.parquet(path)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS s_name, s_acctbal, CAST(make_timestamp(CAST(1970 + s_suppkey % 10 AS BIGINT), 1, 1, 0, 0, 0.0) AS TIMESTAMP) AS birth FROM supplier")
def s02_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("s_name"), "s_acctbal", F.make_date((1970 + F.col("s_suppkey") % 10).cast("int"), F.lit(1), F.lit(1)).alias("birth"))
    path = scratch(spark, "csv")
    io.write_csv(rows, path)
    back = io.read_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double, birth date")
    return back.withColumn("birth", F.col("birth").cast("timestamp_ntz"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("payload"), "o_orderkey")
    return io.first_by(rows, ["key", "day"], [F.col("o_orderkey")]).drop("o_orderkey")


SNAP = "sn AS (SELECT o_custkey % 50 AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, '{\"k\":' || CAST(min(o_orderkey) AS VARCHAR) || '}' AS payload FROM orders GROUP BY 1, 2)"


@query(f"WITH {SNAP} SELECT key, max(day) AS day, max_by(payload, day) AS payload FROM sn GROUP BY 1")
def s03_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.latest(_snapshots(spark, sf_dir), ["key"], "day", "payload")


@query(f"WITH {SNAP} SELECT key, day, payload FROM sn WHERE key % 5 = 0")
def s04_new_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _snapshots(spark, sf_dir)
    return io.new_snapshots(every.unionByName(every.where("key < 10")), every.where("key % 5 <> 0"), ["key", "day"], "payload")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def s05_still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = views.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return io.still_to_do(views.read(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS INTEGER) AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s06_read_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "parts")
    io.write_table(views.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), f"{path}/a")
    io.write_table(views.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), f"{path}/b")
    return io.read_parts(spark, path).select("id", "name", "region")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderstatus = 'P'")
def s07_replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return io.replace_source(old, new, F.col("o_orderstatus"), "P")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN -1.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def s08_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = views.read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = old.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 4 == 0, F.lit(-1.0)))
    return io.upsert(old, new, ["s_suppkey"], ["s_acctbal"])


@query("""WITH r AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) SELECT o_custkey, g AS chunk_start, least(g + INTERVAL 14 DAY, b) AS chunk_end FROM (SELECT o_custkey, a, b, unnest(range(a, b, INTERVAL 14 DAY)) AS g FROM r WHERE a < b)""")
def s09_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = views.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return io.chunks(ranges, "a", "b").select("o_custkey", "chunk_start", "chunk_end")


@query("SELECT horizon, role, count(*) AS n FROM v_logs, (SELECT unnest([6, 12]) AS horizon) GROUP BY 1, 2", "v_logs")
def s10_stacked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.stacked(views.logs(spark, sf_dir), [{"horizon": 6}, {"horizon": 12}]).groupBy("horizon", "role").agg(F.count("*").alias("n"))


# --- parsers


@query("SELECT entity_id, date, hits, at_bats AS \"atBats\" FROM v_logs", "v_logs")
def p01_game_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.logs(spark, sf_dir)
    split = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), F.struct(F.col("hits").cast("string").alias("hits"), F.col("at_bats").cast("string").alias("atBats")).alias("stat"))
    payloads = rows.groupBy("entity_id", "season").agg(F.to_json(F.struct(F.collect_list(split).alias("splits"))).alias("payload"))
    return parse.game_logs(payloads).drop("season").withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("SELECT s_suppkey AS id, s_name AS name, TIMESTAMP '1999-05-04' AS birth_date, CASE WHEN s_suppkey % 2 = 0 THEN 'SS' END AS position FROM supplier")
def p02_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("fullName"), F.lit("1999-05-04").alias("birthDate"), F.struct(F.when(F.col("s_suppkey") % 2 == 0, "SS").alias("abbreviation")).alias("primaryPosition"))
    payloads = views.read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(person).alias("people"))).alias("payload"))
    return parse.people(payloads).withColumn("birth_date", F.col("birth_date").cast("timestamp_ntz"))


@query("""SELECT CAST(2000 + n AS INTEGER) AS year, CASE WHEN k % 4 > 0 THEN k END AS id, name, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS rank, make_timestamp(CAST(2000 + n AS BIGINT), 7, 1, 0, 0, 0.0) AS as_of FROM (SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS n, s_name AS name FROM supplier) WHERE k % 5 > 0""")
def p03_draft_prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some entries without a person, some persons without an id, and those with one twice."""
    k = F.col("s_suppkey")
    person = F.when(k % 5 > 0, F.struct(F.when(k % 4 > 0, k).alias("id"), F.col("s_name").alias("fullName")))
    entry = F.struct(person.alias("person"), F.when(k % 3 > 0, k.cast("string")).alias("rank"), k.alias("bisPlayerId"))
    years = views.read(spark, sf_dir, "supplier").groupBy((2000 + F.col("s_nationkey")).cast("int").alias("year")).agg(F.concat(F.collect_list(entry), F.filter(F.collect_list(entry), lambda e: e["person"]["id"].isNotNull())).alias("prospects"))
    return parse.draft_prospects(years.select("year", F.to_json(F.struct("prospects")).alias("payload")), "year").withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS label, CAST(p_partkey AS VARCHAR) AS market_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS volume FROM part")
def p04_market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    market = F.struct(F.when(k % 2 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.lit(" ")).alias("title"), F.col("p_brand").alias("question"), F.when(k % 5 == 0, k.cast("string")).alias("conditionId"), F.when(k % 5 != 0, k.cast("string")).alias("id"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("volume"))
    payloads = views.read(spark, sf_dir, "part").groupBy("p_size").agg(F.to_json(F.struct(F.collect_list(market).alias("markets"))).alias("payload"))
    return parse.market_events(payloads)


@query("SELECT market_id, to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))::TIMESTAMP AS ts, raw_price FROM v_odds", "v_odds")
def p05_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes: the bare list and the object that holds it."""
    point = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("raw_price").alias("p"))
    lists = views.odds(spark, sf_dir).groupBy("market_id").agg(F.collect_list(point).alias("history"))
    payload = F.when(F.col("market_id") % 2 == 0, F.to_json("history")).otherwise(F.to_json(F.struct("history")))
    return parse.price_history(lists.select("market_id", payload.alias("payload"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT CAST(market_id AS VARCHAR) AS ticker, to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))::TIMESTAMP AS ts, round(CASE WHEN event_id % 2 = 0 AND raw_price > 1 THEN raw_price / 100 WHEN event_id % 2 > 0 AND raw_price * 100 <= 1 THEN raw_price * 100 ELSE raw_price END, 6) AS raw_price, CAST(CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN 7 ELSE 0 END AS DOUBLE) AS volume FROM v_odds WHERE event_id % 7 > 0 AND raw_price IS NOT NULL", "v_odds")
def p06_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of the close, in dollars and cents, and of the volume; a seventh of the candles has no trade."""
    k = F.col("event_id")
    price = F.when(k % 7 > 0, F.struct(F.when(k % 2 == 0, F.col("raw_price").cast("string")).alias("close_dollars"), F.when(k % 2 > 0, F.col("raw_price") * 100).alias("close")))
    candle = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("end_period_ts"), price.alias("price"), F.when(k % 3 == 0, k.cast("string")).alias("volume_fp"), F.when(k % 3 == 1, F.lit(7)).alias("volume"))
    rows = views.odds(spark, sf_dir).groupBy(F.col("market_id").cast("string").alias("ticker")).agg(F.collect_list(candle).alias("candlesticks"))
    return rounded(parse.candles(rows.select(F.to_json(F.struct("ticker", "candlesticks")).alias("payload"))).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS top_pop, CAST(p_size % 10 AS BIGINT) AS total_pop, round(3 / nullif(p_size % 10, 0), 4) AS gem_rate FROM part")
def p07_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("10"), "p_size")).otherwise(F.create_map(F.lit("9"), "p_size"))
    detail = F.struct((F.col("p_size") % 10).alias("total_population"), F.lit(3).alias("total_gems_or_greater"), F.array(F.struct(F.lit("bgs").alias("grader"), F.create_map(F.lit("10"), F.lit(1)).alias("grades")), F.struct(F.lit("psa").alias("grader"), grades.alias("grades"))).alias("population_data"))
    return parse.populations(views.read(spark, sf_dir, "part").select("p_partkey", F.to_json(detail).alias("payload")))


PAGE = "'s' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(year(l_shipdate) AS VARCHAR)"


def _sale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each supplier and year: sales in both forms of the price cell, a summary, attributes and a chart, of its lines."""
    c = F.col
    rows = views.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), c("l_suppkey").cast("string"), F.lit("/"), F.year("l_shipdate").cast("string")).alias("slug"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), "l_shipdate", "l_discount", "l_returnflag", "l_linenumber", F.round(c("l_extendedprice") * 100).cast("bigint").alias("cents")
    )
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    dollars = lambda x: F.concat(F.lit("$"), F.format_number(x / 100, 2))
    price, listed = dollars(c("cents")), dollars(c("cents") * 2)
    marked = F.concat(F.lit('<span class="js-price" title="best offer accepted price">'), price, F.lit("</span>"), F.when(c("l_discount") >= 0.05, F.concat(F.lit('<span class="js-price listed-price-inline">'), listed, F.lit("</span>"))).otherwise(F.lit("")))
    bare = F.concat(price, F.when(c("l_discount") >= 0.05, F.concat(F.lit(" <s>"), listed, F.lit("</s>"))).otherwise(F.lit("")))
    title = F.concat(F.lit("Item #"), c("k").cast("string"), F.when(c("l_returnflag") == "A", F.lit(" PSA MINT 9")).otherwise(F.lit(" &amp; more")))
    row = F.concat(F.lit("<tr>"), cell(F.date_format("l_shipdate", "yyyy-MM-dd")), cell(F.lit("<img>")), cell(title), cell(F.when(c("l_linenumber") % 2 == 0, marked).otherwise(bare)), F.lit("</tr>"))
    day = F.unix_millis(F.to_date("l_shipdate").cast("timestamp"))
    point = lambda flag: F.array_sort(F.collect_list(F.when(c("l_returnflag") == flag, F.array(day, c("cents")))))
    pages = rows.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("body"), F.count("*").alias("lines"), *(point(flag).alias(f"points_{flag}") for flag in "NAR"))
    last = lambda flag: F.element_at(F.element_at(c(f"points_{flag}"), -1), -1)
    shown = lambda flag: F.coalesce(F.concat(dollars(last(flag)), F.lit("-$0.10")), F.lit("n/a"))
    sales = F.concat(F.lit('<div class="completed-auctions-used"><table><tr><th>Date</th></tr>'), "body", F.lit("</table></div>"))
    facts = F.concat(F.lit('<table id="attribute"><tr><td>Rookie Card:</td><td>'), F.when(c("lines") % 2 == 0, "Yes").otherwise("No"), F.lit("</td></tr><tr><td>Print Run:</td><td>"), c("lines").cast("string"), F.lit("</td></tr></table>"))
    summary = F.concat(F.lit('<table id="price_data"><tr><th>Ungraded</th><th>PSA 10</th></tr><tr><td>'), shown("N"), F.lit("</td><td>"), shown("A"), F.lit("</td></tr></table>"))
    chart = F.concat(F.lit("<script>VGPC.chart_data = "), F.to_json(F.struct(c("points_N").alias("used"), c("points_A").alias("graded"), c("points_R").alias("odd"), F.array(F.array(F.lit(0), F.lit(0))).alias("none"))), F.lit(" ;</script>"))
    return pages.select("slug", F.concat(F.lit("<html><body>"), sales, facts, summary, chart, F.lit("</body></html>")).alias("html"))


SALES_SQL = f"""SELECT {PAGE} AS slug, 'used' AS bucket, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS sale_date, 'Item #' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || CASE WHEN l_returnflag = 'A' THEN ' PSA MINT 9' ELSE ' & more' END AS title, round(l_extendedprice * 100) / 100 AS price,
       CASE WHEN l_discount >= 0.05 THEN round(l_extendedprice * 100) * 2 / 100 END AS list_price, l_discount >= 0.05 AS best_offer, CASE WHEN l_returnflag = 'A' THEN 'psa_9' END AS grade FROM lineitem"""


@query(SALES_SQL)
def p08_sales_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.table_rows(_sale_pages(spark, sf_dir), "slug")
    return parse.sales(rows, "slug").withColumn("sale_date", F.col("sale_date").cast("timestamp_ntz"))


@query(f"SELECT {PAGE} AS slug, 'print_run=' || CAST(count(*) AS VARCHAR) || ',rookie_card=' || CASE WHEN count(*) % 2 = 0 THEN 'true' ELSE 'false' END AS attributes FROM lineitem GROUP BY 1")
def p11_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.attributes(parse.table_rows(_sale_pages(spark, sf_dir), "slug", tables=["attribute"]), "slug")
    return found.select("slug", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attributes"))


POINTS_SQL = f"""po AS (SELECT {PAGE} AS slug, l_returnflag AS flag, date_trunc('day', l_shipdate) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
       la AS (SELECT slug, flag, max_by(cents, (day, cents)) AS cents FROM po GROUP BY 1, 2)"""
CHART_SQL = f"""{POINTS_SQL}, na AS (SELECT la.slug, la.flag, coalesce((SELECT max_by(CASE s.flag WHEN 'N' THEN 'ungraded' ELSE 'psa_10' END, CASE s.flag WHEN 'N' THEN 0 ELSE 1 END) FROM la s WHERE s.slug = la.slug AND s.cents = la.cents AND s.flag IN ('N', 'A')), 'key:odd') AS grade FROM la),
       ch AS (SELECT slug, grade, CAST(day AS TIMESTAMP) AS date, cents / 100 AS price FROM po JOIN na USING (slug, flag) WHERE cents > 0)"""


@query(f"WITH {POINTS_SQL} SELECT slug, CASE flag WHEN 'N' THEN 'Ungraded' ELSE 'PSA 10' END AS label, CASE flag WHEN 'N' THEN 0 ELSE 1 END AS place, cents FROM la WHERE flag IN ('N', 'A')")
def p12_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.price_summary(parse.table_rows(_sale_pages(spark, sf_dir), "slug", tables=["price_data"]), "slug")


@query(f"WITH {CHART_SQL} SELECT * FROM ch")
def p13_p14_calibrated_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _sale_pages(spark, sf_dir).where("slug IS NOT NULL")  # said here, the points and the summary read one shuffle of pages
    summary = parse.price_summary(parse.table_rows(pages, "slug", tables=["price_data"]), "slug")
    return parse.calibrated(parse.chart_points(pages, "slug"), summary, "slug").withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    f"""WITH {CHART_SQL}, sa AS ({SALES_SQL}), m AS (SELECT DISTINCT {PAGE} AS slug, l_suppkey AS entity_id FROM lineitem WHERE year(l_shipdate) % 2 = 0)
       SELECT 'sale' AS kind, slug, entity_id, sale_date AS date, grade, price FROM sa JOIN m USING (slug) UNION ALL SELECT 'chart', slug, entity_id, date, grade, price FROM ch JOIN m USING (slug) WHERE NOT starts_with(grade, 'key:')"""
)
def s11_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of each page, the older one empty; those of even years have meta data."""
    pages = _sale_pages(spark, sf_dir)
    snapshots = pages.withColumn("day", F.lit("2020-02-01")).unionByName(pages.select("slug", F.lit("<p>old</p>").alias("html"), F.lit("2020-01-01").alias("day")))
    meta = views.read(spark, sf_dir, "lineitem").where(F.year("l_shipdate") % 2 == 0).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("/"), F.year("l_shipdate").cast("string")).alias("slug"), F.col("l_suppkey").alias("entity_id")).distinct()
    sold, chart = parse.rebuilt(snapshots, meta, "slug")
    one = lambda df, kind, day: df.select(F.lit(kind).alias("kind"), "slug", "entity_id", F.col(day).cast("timestamp_ntz").alias("date"), "grade", "price")
    return one(sold, "sale", "sale_date").unionByName(one(chart, "chart", "date"))


@query("SELECT p_partkey, p_name || ' #' || CAST(p_size AS VARCHAR) AS raw_title, p_name AS name, CAST(p_size AS VARCHAR) AS number FROM part WHERE p_partkey % 4 > 0")
def p15_set_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, F.lit(" [Gold]")).otherwise(F.lit("")), F.lit(" #"), F.col("p_size").cast("string"))
    return parse.set_entries(views.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), title).select("p_partkey", "raw_title", "name", "number")


SHAPES = ("bowman-chrome-prospect-autographs", "bowman-draft-chrome", "bowman-chrome-prospects", "bowman-sterling", "bowman-draft-picks-chrome-autographs", "bowman-draft-sapphire-autographs")
SHAPE_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SHAPES)) + " END"


@query(
    f"""SELECT DISTINCT 'baseball-cards-' || CAST(1990 + p_size AS VARCHAR) || '-' || {SHAPE_SQL} AS slug, CAST(1990 + p_size AS INTEGER) AS year, CASE WHEN contains({SHAPE_SQL}, 'draft') THEN 'draft' ELSE 'chrome' END AS family,
       CASE WHEN p_partkey % 6 IN (0, 4) THEN 'auto' WHEN p_partkey % 6 IN (1, 2) THEN 'base' ELSE 'other' END AS kind FROM part"""
)
def p16_set_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.get(F.array(*map(F.lit, SHAPES)), (F.col("p_partkey") % 6).cast("int"))
    href = F.concat(F.lit('<a href="/console/baseball-cards-'), (1990 + F.col("p_size")).cast("string"), F.lit("-"), shape, F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(""), F.lit('">x</a><a href="/console/other-2001">y</a>'))
    pages = views.read(spark, sf_dir, "part").groupBy("p_size").agg(F.array_join(F.collect_list(href), " ").alias("html"))
    return parse.set_slugs(pages)


@query("""SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS rank, replace(s_name, '#', ' ') AS name, CASE s_nationkey % 3 WHEN 1 THEN 'OF/1B' ELSE 'SS' END AS position, CASE WHEN s_nationkey % 3 = 0 THEN 'NYA' ELSE 'PHI' END AS team FROM supplier""")
def p17_ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the nations each has numbered lines, lines in order (every second name cut in two), and names above their lines."""
    lists = views.read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.regexp_replace("s_name", "#", " ").alias("n")))).alias("l"))
    kind = F.col("s_nationkey") % 3
    numbered = lambda x, i: F.concat((i + 1).cast("string"), F.lit(" . "), x["n"], F.when(i % 2 == 0, ", SS, ").otherwise(", SS "), F.lit("NYA"))
    ordered = lambda x, i: F.concat(F.when(i % 2 == 0, x["n"]).otherwise(F.concat(F.substring(x["n"], 1, 4), F.lit("\n\n• a note\n[x]\n"), F.substring(x["n"], 5, 99))), F.lit(", OF/1B, PHi"))
    below = lambda x, i: F.concat(F.regexp_replace(x["n"], "[0-9]", "z"), F.lit("\n, SS, PH\nsome text\n"))
    text = lambda line: F.concat(F.lit("Intro, A, BC\nStart\n"), F.array_join(F.transform("l", line), "\n"), F.lit("\nSeason-end note\nAfter, SS, NYA\n"))
    docs = lambda k, line: lists.where(kind == k).select("s_nationkey", text(line).alias("text"))
    named = views.read(spark, sf_dir, "supplier").select("s_nationkey", F.regexp_replace(F.regexp_replace("s_name", "#", " "), "[0-9]", "z").alias("z"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank"), F.regexp_replace("s_name", "#", " ").alias("real"))
    third = parse.split_list(docs(2, below), "s_nationkey", "text", "Start").join(named, ["s_nationkey", "rank"]).where("name = z").select("s_nationkey", "rank", F.col("real").alias("name"), "position", "team")
    first = parse.numbered_list(docs(0, numbered), "s_nationkey", "text")
    return first.unionByName(parse.ordered_list(docs(1, ordered), "s_nationkey", "text", "Start\n").withColumn("name", F.regexp_replace("name", "^Start", ""))).unionByName(third)


@query("SELECT s_nationkey, CAST(s_suppkey % 100 AS INTEGER) AS rank, s_suppkey AS id, CASE WHEN s_suppkey % 7 > 0 THEN s_name || ' ' || CAST(s_suppkey AS VARCHAR) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'SS' WHEN s_suppkey % 7 > 0 THEN 'P' END AS position FROM supplier WHERE s_suppkey % 5 > 0")
def p18_linked_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with and without a reference or a position of their own, and persons of whom some are missing."""
    k, t = F.col("s_suppkey").cast("string"), F.lit
    own = F.when(F.col("s_suppkey") % 2 == 0, '"position":"SS",').otherwise("")
    reference = F.when(F.col("s_suppkey") % 5 > 0, F.concat(t('"player":{"__ref":"Person:'), k, t('"}'))).otherwise(F.lit('"player":null'))
    ranked = F.concat(t('{"__typename":"RankedPlayerEntity","rank":'), (F.col("s_suppkey") % 100).cast("string"), t(',"playerEntity":{'), own, reference, t("}}"))
    person = F.when(F.col("s_suppkey") % 7 > 0, F.concat(t(',"Person:'), k, t('":{"__typename":"Person","useName":"'), "s_name", t('","useLastName":"'), k, t('","primaryPosition":{"__typename":"Position","abbreviation":"P"}}'))).otherwise("")
    docs = views.read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(F.concat(ranked, person)), ",").alias("text"))
    return parse.linked_ranks(docs.withColumn("text", F.replace("text", F.lit('"'), F.lit("&quot;"))), "s_nationkey", "text")


@query("""SELECT p_partkey, 'baseball-cards-' || CAST(1990 + p_size AS VARCHAR) || '-x/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS key, 1990 + p_size AS year, CAST(p_partkey AS VARCHAR) AS number, CAST(1990 + p_size AS VARCHAR) || ' Baseball Cards' AS set_query FROM part""")
def p19_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://x.example/game/baseball-cards-"), (1990 + F.col("p_size")).cast("string"), F.lit("-x/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("/"))
    parts = parse.url_parts(url)
    return views.read(spark, sf_dir, "part").select("p_partkey", *(parts[c].alias(c) for c in ("key", "year", "number", "set_query")))


# --- entity matching


@query(f"""WITH d AS (SELECT {TOKENS_SQL.format("p_name")} AS name, min(p_partkey) AS p_partkey FROM part WHERE p_size < 25 GROUP BY 1), q AS (SELECT DISTINCT upper(p_name) AS asked FROM part) SELECT asked, p_partkey FROM q LEFT JOIN d ON d.name = {TOKENS_SQL.format("asked")}""")
def j09_map_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.read(spark, sf_dir, "part")
    asked = parts.select(F.upper("p_name").alias("asked")).distinct()
    return joins.map_names(asked, parts.where("p_size < 25"), f.normalize_name(F.col("asked")), f.normalize_name(F.col("p_name")), "p_partkey")


@query(
    """WITH q AS (SELECT p_name AS name, min(p_size) AS class_year FROM part GROUP BY 1), c AS (SELECT q.name, q.class_year, p.p_partkey, row_number() OVER (PARTITION BY q.name ORDER BY p.p_size, CASE WHEN p.p_type = 'ECONOMY' THEN 0 ELSE 1 END, p.p_partkey) AS rn
       FROM q JOIN part p ON p.p_name = q.name AND p.p_size BETWEEN q.class_year + 1 AND q.class_year + 3) SELECT q.name, c.p_partkey FROM q LEFT JOIN c ON c.name = q.name AND c.rn = 1"""
)
def j10_base_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equi join on the name with a band of years; the earliest year, then the family, decide."""
    parts = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size", "p_type", "p_partkey")
    asked = parts.groupBy("name").agg(F.min("p_size").alias("class_year"))
    met = asked.join(parts, "name").where(F.col("p_size").between(F.col("class_year") + 1, F.col("class_year") + 3))
    best = joins.best_candidate(met, ["name"], [F.col("p_size"), F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1), F.col("p_partkey")])
    return asked.select("name").join(best.select("name", "p_partkey"), "name", "left")


@query(
    """WITH q AS (SELECT DISTINCT p_name AS name, 20 AS y FROM part), c AS (SELECT q.name, p.p_partkey, 0 AS tier, abs(p.p_size - y) AS far FROM q JOIN part p ON p.p_name = q.name UNION ALL
         SELECT q.name, p.p_partkey, 1, abs(p.p_size - y) FROM q JOIN part p ON split_part(p.p_name, ' ', 2) = split_part(q.name, ' ', 2)),
       r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY tier, far) AS rk FROM c), b AS (SELECT name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM r WHERE rk = 1 GROUP BY 1)
       SELECT q.name, CASE WHEN n = 1 THEN id END AS p_partkey, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM q LEFT JOIN b USING (name)"""
)
def j11_j14_tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("d_name"), F.element_at(F.split("p_name", " "), 2).alias("d_word"), "p_size", "p_partkey")
    asked = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("word", F.element_at(F.split("name", " "), 2))
    return joins.tiered_match(asked, parts, "name", [("name", "d_name"), ("word", "d_word")], [F.abs(F.col("p_size") - 20)], "p_partkey")


@query(
    """WITH c AS (SELECT s_nationkey AS k, s_suppkey AS entity_id, 1995 + s_nationkey % 7 AS y FROM supplier), f AS (SELECT entity_id, min(season) AS first FROM v_logs GROUP BY 1),
       p AS (SELECT k, count(DISTINCT c.entity_id) AS n, min(c.entity_id) AS id FROM c JOIN f ON f.entity_id = c.entity_id AND first BETWEEN y - 1 AND y + 0 GROUP BY 1)
       SELECT k.k, CASE WHEN n = 1 THEN id END AS entity_id, coalesce(n, 0) AS n_left FROM (SELECT DISTINCT k FROM c) k LEFT JOIN p USING (k)""",
    "v_logs",
)
def j12_career_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = views.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("entity_id"), (1995 + F.col("s_nationkey") % 7).alias("y"))
    return joins.by_career_timing(candidates, views.logs(spark, sf_dir).select("entity_id", "season"), "k", "entity_id", "y", back=1, ahead=0)


@query("SELECT p_name, array_to_string(list_sort(list_distinct(list(p_partkey))), ',') AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def j13_several_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.several_ids(views.read(spark, sf_dir, "part"), "p_name", "p_partkey")
    return found.select("p_name", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@query(
    """WITH r AS (SELECT p_size AS asked, p_partkey AS result_id, string_split(p_name, ' ') AS toks, CASE p_partkey % 4 WHEN 1 THEN 'USC3' WHEN 2 THEN '3' WHEN 3 THEN 'usc3' ELSE 'x' END AS num, p_partkey % 5 AS par, p_partkey % 2 = 0 AS uni, p_retailprice AS pop FROM part),
       t AS (SELECT *, CASE WHEN par IN (0, 3, 4) THEN 0 WHEN par = 1 THEN 1 END AS pt, CASE WHEN toks = ['widget'] THEN 0 WHEN list_contains(toks, 'widget') THEN 1 END AS st, CASE WHEN upper(num) = 'USC3' THEN 0 WHEN num = '3' THEN 1 END AS nt FROM r
         WHERE result_id % 9 > 0 AND result_id % 11 > 0)
       SELECT asked, result_id FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY pt, st, nt, uni DESC, pop DESC, result_id) AS rn FROM t WHERE pt IS NOT NULL AND st IS NOT NULL AND nt IS NOT NULL) WHERE rn = 1"""
)
def j15_pick_search_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    results = views.read(spark, sf_dir, "part").select(
        F.col("p_size").alias("asked"),
        k.alias("result_id"),
        F.lit("Name Jr.").alias("wanted_name"),
        F.when(k % 9 == 0, "Other").otherwise("name  JR").alias("name"),
        F.lit("2022").alias("wanted_year"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(2022).alias("year"),
        F.lit("Widget").alias("wanted_set"),
        F.col("p_name").alias("set_name"),
        F.lit("usc3").alias("wanted_number"),
        F.when(k % 4 == 1, "USC3").when(k % 4 == 2, "3").when(k % 4 == 3, "usc3").otherwise("x").alias("number"),
        F.when(k % 5 == 0, "Base").when(k % 5 == 1, "SP").when(k % 5 == 2, "Gold").alias("parallel"),
        (k % 2 == 0).alias("universal"),
        F.col("p_retailprice").alias("population"),
    )
    return joins.pick_search_result(results, "asked").select("asked", "result_id")


@query(
    """SELECT name, p_partkey, decision FROM (SELECT p_brand AS name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, CASE WHEN contains(p_name, 'old') THEN 0 ELSE 1 END, p_partkey) AS rn,
       CASE WHEN contains(p_name, 'old') THEN 'first_edition' ELSE 'earliest' END AS decision FROM part WHERE NOT regexp_matches(p_name, '(?i)\\b(red|blue|gold)\\b')) WHERE rn = 1"""
)
def j16_j17_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without parallels: the earliest year, in it first editions first; why it was picked goes along."""
    rows = views.read(spark, sf_dir, "part").where(~F.col("p_name").rlike(r"(?i)\b(red|blue|gold)\b")).withColumnRenamed("p_brand", "name")
    first = F.col("p_name").contains("old")
    best = joins.best_candidate(rows, ["name"], [F.col("p_size"), F.when(first, 0).otherwise(1), F.col("p_partkey")])
    return best.select("name", "p_partkey", F.when(first, "first_edition").otherwise("earliest").alias("decision"))


@query(
    """SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 2 THEN 'pitcher' ELSE 'hitter' END AS role, CASE WHEN s_suppkey % 3 = 0 THEN 'search' WHEN s_suppkey % 3 = 1 THEN 'directory' ELSE '' END AS provenance, coalesce(p_name, '') AS url FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_size < 25"""
)
def j21_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = views.read(spark, sf_dir, "supplier")
    urls = views.read(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("url"))
    status = F.when(F.col("s_suppkey") % 3 == 0, "search").when(F.col("s_suppkey") % 3 == 1, "directory").otherwise("")
    return suppliers.join(urls, "s_suppkey", "left").select("s_suppkey", F.when(F.col("s_nationkey") % 4 == 2, "pitcher").otherwise("hitter").alias("role"), status.alias("provenance"), F.coalesce("url", F.lit("")).alias("url"))


# --- streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files; the pattern keeps a single file from being taken for a base folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}[.]parquet")


@query(
    """WITH b AS (SELECT 'card-' || CAST(l_suppkey AS VARCHAR) AS card_slug, CASE l_returnflag WHEN 'A' THEN 'psa_10' WHEN 'R' THEN 'psa_9' ELSE 'ungraded' END AS grade, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week, l_extendedprice / l_quantity AS price FROM lineitem)
       SELECT card_slug, grade, week, median(price) AS median_price, count(*) AS n_sales FROM b GROUP BY ALL HAVING week + INTERVAL 7 DAY <= (SELECT max(l_shipdate) - INTERVAL 14 DAY FROM lineitem)"""
)
def q01_stream_weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _stream(spark, sf_dir, "lineitem")
    sales = lines.select(
        F.concat(F.lit("card-"), F.col("l_suppkey").cast("string")).alias("card_slug"), F.when(F.col("l_returnflag") == "A", "psa_10").when(F.col("l_returnflag") == "R", "psa_9").alias("grade"), F.col("l_shipdate").alias("sale_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    return jobs.run_available(jobs.weekly_bars(sales), scratch(spark, "bars"))


def _odds_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("user_id").alias("market_id"), "event_id", "ts", (F.col("value") / 500).alias("raw_price"))


@query(
    """WITH d AS (SELECT event, market_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, arg_max(raw_price, (ts, event_id)) AS raw_price FROM v_odds GROUP BY ALL)
       SELECT event, market_id, day, raw_price, round(raw_price / sum(raw_price) OVER (PARTITION BY event, day), 9) AS implied_prob FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM v_odds) QUALIFY sum(raw_price) OVER (PARTITION BY event, day) > 0""",
    "v_odds",
)
def q02_stream_daily_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's rows come in one batch, when no more can come, so each batch normalises its days."""
    return rounded(jobs.run_batches(jobs.daily_odds(_odds_stream(spark, sf_dir)), lambda batch: aggregates.normalize_vig(batch, ["event", "day"]), scratch(spark, "daily")), 9, exact=("raw_price",))


@query()
def q03_stream_spike_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by market; a test holds it against a loop."""
    return jobs.run_available(jobs.spike_alerts(_odds_stream(spark, sf_dir)), scratch(spark, "alerts"))


@query("SELECT event_id, event, market_id FROM v_odds", "v_odds")
def q04_stream_distinct_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is sent twice."""
    twice = _odds_stream(spark, sf_dir).withColumn("__n", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.run_available(jobs.distinct_snapshots(twice, ["event_id"]).select("event_id", "event", "market_id"), scratch(spark, "distinct"))
