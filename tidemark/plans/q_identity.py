"""Queries of identity resolution, over people, directories and listings made of the parts: whole tables, names that one side alone has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import identity
from tidemark.plans.registry import query
from tidemark.sources import views

NAMES_SQL = """n AS (SELECT p_partkey AS id, p_size, p_type, p_name, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand, p_name || ' b' || replace(p_brand, 'Brand#', '') AS name FROM part),
       asked AS (SELECT name, CAST(2000 + min(p_size) % 20 AS INTEGER) AS class_year, arg_min(p_type, id) AS family, 'auto-' || CAST(min(id) AS VARCHAR) AS auto_card_url FROM n GROUP BY 1)"""

RESOLVE_SQL = """people AS (SELECT CASE WHEN p_size % 2 = 0 THEN name ELSE name || ' else' END AS full_name, id, p_size % 3 = 0 AS validated FROM n),
       nick AS (SELECT DISTINCT name, p_name || ' b' || CAST(brand + 1 AS VARCHAR) AS search FROM n WHERE brand % 2 = 0),
       f1 AS (SELECT a.name, p.id, bool_or(p.validated) AS v FROM asked a JOIN people p ON p.full_name = a.name GROUP BY 1, 2),
       ag AS (SELECT a.name, k.search FROM asked a JOIN nick k USING (name) WHERE a.name NOT IN (SELECT name FROM f1 WHERE v)),
       f2 AS (SELECT ag.name, p.id, bool_or(p.validated) AS v FROM ag JOIN people p ON p.full_name = ag.search GROUP BY 1, 2),
       fo AS (SELECT *, 'search' AS stage FROM f1 WHERE name NOT IN (SELECT name FROM ag) UNION ALL SELECT *, 'nickname' FROM f2),
       se AS (SELECT a.name, a.class_year, coalesce(list_sort(list(id) FILTER (id IS NOT NULL)), []) AS ids, coalesce(list_sort(list(id) FILTER (v)), []) AS valid FROM asked a LEFT JOIN fo USING (name) GROUP BY 1, 2),
       di AS (SELECT id, 11 + p_size % 4 AS sport, 2000 + p_size % 13 AS season, name AS short, p_size % 5 < 2 AS longer FROM n),
       hs AS (SELECT s.name, s.class_year, d.id, d.sport, d.season, 'same name' AS how FROM se s JOIN di d ON d.short = s.name AND NOT d.longer WHERE len(s.valid) = 0),
       hm AS (SELECT s.name, s.class_year, d.id, d.sport, d.season, 'suffix' AS how FROM se s JOIN di d ON d.short = s.name AND d.longer WHERE len(s.valid) = 0 AND s.name NOT IN (SELECT name FROM hs)),
       hr AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY abs(season - class_year), season, sport) AS rk FROM (SELECT * FROM hs UNION ALL SELECT * FROM hm)),
       hc AS (SELECT name, list_sort(list(DISTINCT id)) AS hits, any_value(sport) AS sport, any_value(season) AS season FROM hr WHERE rk = 1 GROUP BY 1),
       st AS (SELECT s.name, s.class_year, CASE WHEN len(valid) = 1 THEN valid[1] WHEN len(valid) = 0 AND len(hits) = 1 THEN hits[1] END AS id,
         CASE WHEN len(valid) = 1 THEN 'ok' WHEN len(valid) > 1 THEN 'ambiguous:multiple validated (' || array_to_string(valid, ', ') || ')' WHEN len(hits) = 1 THEN 'ok:directory'
           WHEN len(hits) > 1 THEN 'ambiguous:directory duplicate ' || array_to_string(['candidate ' || CAST(i AS VARCHAR) || ' at sport ' || CAST(sport AS VARCHAR) || ' season ' || CAST(season AS VARCHAR) FOR i IN hits], '; ')
           WHEN len(ids) = 0 THEN 'no_exact_match' WHEN len(ids) > 1 THEN 'ambiguous:' || array_to_string(['candidate ' || CAST(i AS VARCHAR) || ' without pro stats' FOR i IN ids], '; ') ELSE 'no_pro_stats' END AS status
         FROM se s LEFT JOIN hc USING (name))"""

BASE_SQL = """bm AS (SELECT a.name, a.class_year, i.id AS item_id, 'u' || CAST(i.id AS VARCHAR) AS url, i.p_type = a.family AS same, row_number() OVER (PARTITION BY a.name ORDER BY 2000 + i.p_size % 20, CASE WHEN i.p_type = a.family THEN 0 ELSE 1 END, i.id) AS rn
         FROM asked a JOIN n i ON i.name = a.name AND 2000 + i.p_size % 20 BETWEEN a.class_year AND a.class_year + 3),
       ba AS (SELECT a.name, a.class_year, item_id, url, CASE WHEN item_id IS NULL THEN 'no_base_card' WHEN same THEN 'same family' ELSE 'other family' END AS decision FROM asked a LEFT JOIN bm ON bm.name = a.name AND bm.rn = 1)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))
    return views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_type", "p_name", brand.cast("int").alias("brand"), F.concat("p_name", F.lit(" b"), brand).alias("name"))


def _players(parts: DataFrame) -> DataFrame:
    found = parts.groupBy("name").agg((2000 + F.min("p_size") % 20).cast("int").alias("class_year"), F.min_by("p_type", "id").alias("family"), F.min("id").alias("__id"))
    return found.select("name", "class_year", "family", F.concat(F.lit("auto-"), F.col("__id").cast("string")).alias("auto_card_url"))


def _resolved(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    people = parts.select(F.when(F.col("p_size") % 2 == 0, F.upper("name")).otherwise(F.concat("name", F.lit(" else"))).alias("full_name"), "id", (F.col("p_size") % 3 == 0).alias("validated"))
    nicknames = parts.where(F.col("brand") % 2 == 0).select("name", F.concat("p_name", F.lit(" B"), (F.col("brand") + 1).cast("string")).alias("search")).distinct()
    suffix = F.when(F.col("p_size") % 5 == 0, " Jr.").when(F.col("p_size") % 5 == 1, " II").otherwise("")
    directory = parts.select(F.concat(F.upper("name"), suffix).alias("full_name"), "id", (11 + F.col("p_size") % 4).alias("sport"), (2000 + F.col("p_size") % 13).alias("season"))
    return identity.resolve_ids(_players(parts).select("name", "class_year"), people, nicknames, directory)


def _base(parts: DataFrame) -> DataFrame:
    items = parts.select(F.col("id").alias("item_id"), F.concat(F.upper("name"), F.lit(" #"), F.col("p_size").cast("string")).alias("title"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), (2000 + F.col("p_size") % 20).alias("year"), F.col("p_type").alias("family"))
    return identity.base_items(_players(parts), items)


@query(f"WITH {NAMES_SQL}, {RESOLVE_SQL} SELECT name, class_year, id, status FROM st")
def j11_j14_resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, nicknames, the directory with suffixes either way: each name's id and status."""
    return _resolved(_parts(spark, sf_dir))[0]


@query(
    f"""WITH {NAMES_SQL}, {RESOLVE_SQL} SELECT name, id, stage, CASE WHEN v THEN 'validated' ELSE 'without pro stats' END AS decision FROM fo
       UNION ALL SELECT name, id, 'search', 'given up for the nickname' FROM f1 WHERE name IN (SELECT name FROM ag)
       UNION ALL SELECT name, id, 'directory', how || CASE WHEN rk = 1 THEN ' nearest cell' ELSE ' farther cell' END || ' sport ' || CAST(sport AS VARCHAR) || ' season ' || CAST(season AS VARCHAR) FROM hr"""
)
def j14_candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every stage with what was decided on it."""
    return _resolved(_parts(spark, sf_dir))[1]


@query(f"WITH {NAMES_SQL}, {BASE_SQL} SELECT name, class_year, item_id, url, decision FROM ba")
def j10_base_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base item from the class year on, by the whole name in the title."""
    return _base(_parts(spark, sf_dir)).select("name", "class_year", "item_id", "url", "decision")


UNIVERSE_SQL = """un AS (SELECT a.name, st.id, a.class_year, a.family, CASE WHEN st.id % 4 = 1 THEN 'pitcher' ELSE 'hitter' END AS role, CASE st.status WHEN 'ok' THEN 'search' WHEN 'ok:directory' THEN 'directory' ELSE '' END AS resolution_source, coalesce(ba.url, '') AS url, a.auto_card_url
         FROM asked a JOIN st USING (name) JOIN ba USING (name) WHERE st.id IS NOT NULL)"""


def _universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = _parts(spark, sf_dir)
    info = parts.select("id", F.when(F.col("id") % 4 == 1, "P").when(F.col("id") % 4 == 2, "SS").alias("position"))
    return identity.universe(_players(parts), _resolved(parts)[0], info, _base(parts))


@query(f"WITH {NAMES_SQL}, {RESOLVE_SQL}, {BASE_SQL}, {UNIVERSE_SQL} SELECT * FROM un")
def j21_resolved_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with an id: role from the position, where the id comes from, the base item's url."""
    return _universe(spark, sf_dir)[0]


@query(f"WITH {NAMES_SQL}, {RESOLVE_SQL}, {BASE_SQL} SELECT name, class_year, status AS reason FROM st WHERE id IS NULL UNION ALL SELECT st.name, st.class_year, 'no_base_card' FROM st JOIN ba USING (name) WHERE st.id IS NOT NULL AND ba.item_id IS NULL")
def j21_universe_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players that lack an id or a base item, and why."""
    return _universe(spark, sf_dir)[1]


PARALLEL_SQL = "regexp_matches(anchor, '(?i)\\b(" + "|".join(f.PARALLEL) + ")\\b')"
LISTINGS_SQL = """ls AS (SELECT p_name AS name, 2006 AS rookie_year, 2000 + p_size % 10 AS year, p_partkey AS pos, CASE p_size % 2 WHEN 0 THEN 'topps-chrome' ELSE 'topps-chrome-update' END AS family, CASE WHEN p_partkey % 3 = 0 THEN 'rookies-only' ELSE 'full' END AS listing,
         CASE WHEN p_size % 7 = 0 THEN 'other ' || reverse(p_name) ELSE upper(p_name) END || CASE p_size % 4 WHEN 0 THEN ' Refractor' WHEN 1 THEN ' 1st' ELSE '' END || ' #' || CAST(p_partkey AS VARCHAR) AS anchor, 'u' || CAST(p_partkey AS VARCHAR) AS url, p_size % 7 > 0 AS named FROM part),
       lk AS (SELECT *, """ + PARALLEL_SQL + """ AS parallel FROM ls)"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    anchor = F.concat(F.when(size % 7 == 0, F.concat(F.lit("other "), F.reverse("p_name"))).otherwise(F.upper("p_name")), F.when(size % 4 == 0, " Refractor").when(size % 4 == 1, " 1st").otherwise(""), F.lit(" #"), key.cast("string"))
    family, listing = F.when(size % 2 == 0, "topps-chrome").otherwise("topps-chrome-update"), F.when(key % 3 == 0, "rookies-only").otherwise("full")
    return views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit(2006).alias("rookie_year"), (2000 + size % 10).alias("year"), key.alias("pos"), family.alias("family"), listing.alias("listing"), anchor.alias("anchor"), F.concat(F.lit("u"), key.cast("string")).alias("url"))


@query(
    f"""WITH {LISTINGS_SQL}, b AS (SELECT name, arg_min(pos, (year, CASE WHEN regexp_matches(anchor, '(?i)\\b1st\\b') THEN 0 ELSE 1 END, pos)) AS best, min(year) AS best_year FROM lk WHERE named AND NOT parallel AND year BETWEEN 2000 AND 2006 GROUP BY 1)
       SELECT lk.name, year, url, CASE WHEN NOT (year BETWEEN 2000 AND 2006 AND (best_year IS NULL OR year <= best_year)) THEN 'not-scanned' WHEN pos = best THEN 'chosen' WHEN NOT named THEN 'skip:name-mismatch' WHEN parallel THEN 'skip:parallel-keyword' ELSE 'candidate' END AS decision FROM lk LEFT JOIN b USING (name)"""
)
def j16_first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first base issue of each name, and a decision on every listing."""
    return identity.first_issues(_listings(spark, sf_dir)).select("name", "year", "url", "decision")


@query(
    f"""WITH {LISTINGS_SQL}, g AS (SELECT DISTINCT name, a.family, a.listing, a.attempt, a.fam FROM lk, (VALUES ('topps-chrome', 'rookies-only', 1, 1), ('topps-chrome', 'full', 2, 1), ('topps-chrome-update', 'rookies-only', 3, 2), ('topps-chrome-update', 'full', 4, 2)) a(family, listing, attempt, fam)),
       h AS (SELECT name, family, listing, arg_min(url, pos) AS url FROM lk WHERE named AND NOT parallel GROUP BY 1, 2, 3),
       m AS (SELECT g.*, h.url, count(h.url) OVER (PARTITION BY g.name, g.fam ORDER BY g.attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done, min(CASE WHEN h.url IS NOT NULL THEN g.attempt END) OVER (PARTITION BY g.name) AS first FROM g LEFT JOIN h USING (name, family, listing))
       SELECT name, CAST(attempt AS BIGINT) AS attempt, family, listing, url, CASE WHEN url IS NULL THEN 'no-match' WHEN attempt = first THEN 'chosen' ELSE 'match' END AS result FROM m WHERE done = 0"""
)
def j17_flagship_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets by two listings in order of preference, an attempt a row."""
    listings = _listings(spark, sf_dir)
    found = identity.flagship_attempts(listings.select("name", "rookie_year").distinct(), listings)
    return found.select("name", F.col("attempt").cast("bigint").alias("attempt"), "family", "listing", "url", "result")


@query("SELECT arg_min(p_name, o) AS player_name, CAST(min(2000 + p_size % 9) AS INTEGER) AS class_year, arg_min(fam, o) AS family, arg_min(url, o) AS card_url FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'chrome' ELSE 'draft' END AS fam, 'u' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS url, (2000 + p_size % 9, p_partkey % 3 > 0, 'u' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS o FROM part) GROUP BY p_name")
def a21_classes_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's earliest class; of that year the preferred family."""
    rows = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (2000 + F.col("p_size") % 9).cast("int").alias("year"), F.when(F.col("p_partkey") % 3 == 0, "chrome").otherwise("draft").alias("family"), F.concat(F.lit("u"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("card_url"))
    return identity.classes_of_names(rows)
