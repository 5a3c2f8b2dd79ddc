"""Queries of the statistical models. SQL gives those that are closed formulas; the others are tested against numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models, quantiles, windows
from tidemark.plans.q_series import rounded
from tidemark.plans.registry import query
from tidemark.sources import views

FEATURES = ["l_quantity", "l_discount", "l_tax", "line", "days"]


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a target that quantity and discount drive."""
    rows = views.read(spark, sf_dir, "lineitem")
    days = F.datediff("l_shipdate", F.lit("1995-01-01")).cast("double")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        "l_suppkey",
        F.year("l_shipdate").alias("year"),
        "l_quantity",
        "l_discount",
        "l_tax",
        F.col("l_linenumber").cast("double").alias("line"),
        days.alias("days"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"),
        "l_returnflag",
    )


@query()
def m01_m03_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.lasso_cv(frame(spark, sf_dir), FEATURES, "y", "row_id")


@query()
def m02_stability_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stability_selection(frame(spark, sf_dir), FEATURES, "y", "row_id")


@query()
def m04_boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.boosted_importance(frame(spark, sf_dir), FEATURES, "y", "row_id")


@query(
    """WITH r AS (SELECT l_quantity AS x, l_extendedprice * (1 - l_discount) AS y FROM lineitem), b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, count(*) AS n FROM r),
       e AS (SELECT sum(pow(y - b0 - b1 * x, 2) * pow(x - mx, 2)) AS m1, sum(pow(y - b0 - b1 * x, 2) * pow(1.0 / n - mx * (x - mx) / sxx, 2)) AS m0 FROM r, b)
       SELECT 'l_quantity' AS term, round(b1, 4) AS coefficient, round(sqrt(m1 / pow(sxx, 2) * n / (n - 2)), 4) AS se FROM b, e UNION ALL SELECT 'intercept', round(b0, 4), round(sqrt(m0 * n / (n - 2)), 4) FROM b, e"""
)
def m05_ols_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.ols_hc1(frame(spark, sf_dir), ["l_quantity"], "y").drop("t", "p_value", "n"), 4)


@query(
    """WITH r AS (SELECT year(l_shipdate) AS year, l_quantity AS x, l_extendedprice * (1 - l_discount) AS y FROM lineitem),
       b AS (SELECT year, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n FROM r GROUP BY 1),
       e AS (SELECT year, sum(pow(y - b0 - b1 * x, 2) * pow(x - mx, 2)) AS m FROM r JOIN b USING (year) GROUP BY 1)
       SELECT year, CASE WHEN n >= 5 THEN round(b1, 4) END AS coefficient, CASE WHEN n >= 5 THEN round(sqrt(m / pow(sxx, 2) * n / (n - 2)), 4) END AS se, n FROM b JOIN e USING (year)"""
)
def m05_season_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of the quantity in each year; p-values are in m05_seasons_with_covariates."""
    return rounded(models.season_consistency(frame(spark, sf_dir), "l_quantity", [], "y", "year").drop("p_value"), 4)


@query()
def m05_seasons_with_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.season_consistency(frame(spark, sf_dir), "l_quantity", ["l_discount", "days"], "y", "year")


@query(
    """WITH g AS (SELECT l_returnflag AS s, avg(l_extendedprice * (1 - l_discount)) AS m, count(*) AS n, var_pop(l_extendedprice * (1 - l_discount)) / count(*) AS v FROM lineitem GROUP BY 1),
       t AS (SELECT sum(n) AS n, CAST(sum(n) AS DOUBLE) / (sum(n) - 3) AS k FROM g), a AS (SELECT m, v FROM g WHERE s = 'A')
       SELECT 'l_returnflag=' || g.s AS term, round(g.m - a.m, 4) AS coefficient, round(sqrt((g.v + a.v) * k), 4) AS se, CAST(t.n AS BIGINT) AS n FROM g, a, t WHERE g.s IN ('N', 'R')
       UNION ALL SELECT 'intercept', round(a.m, 4), round(sqrt(a.v * k), 4), CAST(t.n AS BIGINT) FROM a, t"""
)
def m05_stage_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage adds to the first one."""
    found = models.stage_effects(frame(spark, sf_dir), "y", "l_returnflag", ("A", "N", "R"), [])
    return rounded(found.select("term", "coefficient", "se", "n"), 4)


@query()
def m06_interaction_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the slope differs between two groups, with other features held."""
    return models.interaction_test(frame(spark, sf_dir), "l_quantity", "l_returnflag", ("A", "R"), ["l_discount", "days"], "y")


@query(
    """WITH r AS (SELECT year(l_shipdate) AS year, l_returnflag AS g, l_quantity AS x, l_extendedprice * (1 - l_discount) AS y FROM lineitem WHERE l_returnflag IN ('A', 'R')),
       b AS (SELECT year, g, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n FROM r GROUP BY 1, 2),
       e AS (SELECT year, g, any_value(b1) AS b1, any_value(n) AS n, sum(pow(y - b0 - b1 * x, 2) * pow(x - mx, 2)) / pow(any_value(sxx), 2) AS v FROM r JOIN b USING (year, g) GROUP BY 1, 2),
       p AS (SELECT year, max(b1) FILTER (g = 'A') - max(b1) FILTER (g = 'R') AS d, sum(v) AS v, sum(n) AS n FROM e GROUP BY 1 HAVING count(*) = 2)
       SELECT year, round(d * d / (v * n / (n - 4)), 4) AS f, 1 AS df, CAST(n - 4 AS BIGINT) AS df_residual FROM p"""
)
def m06_interaction_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in each year, of the groups that both have rows."""
    rows, (other,) = models.with_dummies(frame(spark, sf_dir), "l_returnflag", ("R", "A"))
    rows = rows.withColumn("gx", F.col(other) * F.col("l_quantity"))
    both = rows.groupBy("year").agg(F.countDistinct("l_returnflag").alias("k")).where("k = 2").select("year")
    found = models.joint_wald(rows.join(both, "year"), ["l_quantity", other, "gx"], ["gx"], "y", by=["year"])
    return rounded(found.drop("p_value"), 4)


@query()
def m07_random_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances between and within suppliers, by restricted likelihood."""
    return models.random_intercepts(frame(spark, sf_dir), ["l_quantity", "l_discount", "days"], "y", "l_suppkey")


@query(
    """WITH r AS (SELECT l_suppkey AS g, l_extendedprice * (1 - l_discount) AS y FROM lineitem), s AS (SELECT g, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM r GROUP BY 1),
       t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(CAST(n AS DOUBLE) * n) AS nn, sum(n * v) AS ssw, sum(n * m) AS nm, sum(n * m * m) AS nmm FROM s),
       c AS (SELECT ssw / (n - k) AS within, greatest(((nmm - nm * nm / n) / (k - 1) - ssw / (n - k)) / ((n - nn / n) / (k - 1)), 0) AS between_ FROM t)
       SELECT round(between_, 0) AS between, round(within, 0) AS within, round(between_ / (between_ + within), 5) AS icc FROM c"""
)
def m07_variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.variance_components(frame(spark, sf_dir), "l_suppkey", "y")
    return found.select(F.round("between", 0).alias("between"), F.round("within", 0).alias("within"), F.round("icc", 5).alias("icc"))


@query()
def m08_importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods and features in one long table."""
    rows = frame(spark, sf_dir)
    lasso = models.lasso_cv(rows, FEATURES, "y", "row_id").select(F.lit("lasso").alias("method"), "feature", F.abs("coefficient").alias("value"))
    stable = models.stability_selection(rows, FEATURES, "y", "row_id").select(F.lit("stability").alias("method"), "feature", F.col("share").alias("value"))
    return lasso.unionByName(stable)


FOLD_SQL = "CAST('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) % 5"
ROWS_SQL = "r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey AS g, l_extendedprice * (1 - l_discount) AS y FROM lineitem)"


@query(
    f"""WITH {ROWS_SQL}, f AS (SELECT *, {FOLD_SQL} AS fold FROM r),
       m AS (SELECT f.y, coalesce((sum(y) OVER (PARTITION BY g) - sum(y) OVER (PARTITION BY g, fold)) / nullif(count(y) OVER (PARTITION BY g) - count(y) OVER (PARTITION BY g, fold), 0), (sum(y) OVER () - sum(y) OVER (PARTITION BY fold)) / nullif(count(y) OVER () - count(y) OVER (PARTITION BY fold), 0)) AS p FROM f)
       SELECT round(-0.5 * ln(2 * pi() * var_pop(y - p)) - avg(pow(y - p, 2)) / (2 * var_pop(y - p)), 6) AS lpd, round(sqrt(avg(pow(y - p, 2))), 3) AS rmse FROM m"""
)
def m09_group_mean_lpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir).select("row_id", "l_suppkey", "y").withColumn("fold", models.fold_of(F.col("row_id"), 5))
    found = models.gaussian_lpd(models.out_of_fold_means(rows, "l_suppkey", "y"), "y", "oof_mean")
    return found.select(F.round("lpd", 6).alias("lpd"), F.round("rmse", 3).alias("rmse"))


@query(
    """SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer"""
)
def m10_balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.balanced_folds(views.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 5, group=["c_mktsegment"])


def _out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each fold by a model of the others; a tenth of the discounts is missing."""
    rows = frame(spark, sf_dir).withColumn("fold", models.fold_of(F.col("row_id"), 5))
    rows = rows.withColumn("l_discount", F.when(F.col("l_quantity") % 10 > 0, F.col("l_discount")))
    return models.out_of_fold_lasso(rows, FEATURES, "y", "row_id").select("row_id", "fold", "y", "predicted")


@query()
def m10_out_of_fold_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out_of_fold(spark, sf_dir)


@query()
def m09_pooled_lasso_lpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of the pooled predictions, beside that of the groups' means (m09_group_mean_lpd)."""
    return models.gaussian_lpd(_out_of_fold(spark, sf_dir), "y", "predicted")


@query(
    """WITH o AS (SELECT l_suppkey AS g, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM (SELECT l_suppkey, l_quantity AS x, l_extendedprice * (1 - l_discount) AS y FROM lineitem) GROUP BY 1),
       s AS (SELECT *, greatest((syy - sxy * b) / (n - 2), 1e-12) / sxx AS se2 FROM o WHERE n > 2 AND sxx > 0),
       p AS (SELECT sum(b / se2) / sum(1 / se2) AS mean, greatest((sum(b * b / se2) - pow(sum(b / se2), 2) / sum(1 / se2) - (count(*) - 1)) / (sum(1 / se2) - sum(1 / (se2 * se2)) / sum(1 / se2)), 0) AS tau2 FROM s)
       SELECT g AS l_suppkey, round(b, 4) AS slope, round((b / se2 * tau2 + mean) / (tau2 / se2 + 1), 4) AS shrunken FROM s, p"""
)
def m11_shrunken_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.shrunken_slopes(frame(spark, sf_dir), "l_suppkey", "l_quantity", "y"), 4)


@query()
def r06_r07_w14_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year, and by quarter with a longer first training span and fewer picks."""
    rows = frame(spark, sf_dir)
    yearly = models.walk_forward(rows, FEATURES, "y", "year", "row_id").select(F.lit("year").alias("grain"), F.col("year").alias("period"), "row_id", "rank", "predicted", "realized")
    quarters = rows.withColumn("quarter", F.col("year") * 10 + F.ceil((F.col("days") % 365.25 + 1) / 92).cast("int"))
    quarterly = models.walk_forward(quarters, FEATURES, "y", "quarter", "row_id", top_k=2, min_train=6)
    return yearly.unionByName(quarterly.select(F.lit("quarter").alias("grain"), F.col("quarter").alias("period"), "row_id", "rank", "predicted", "realized"))


@query()
def r08_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the walk-forward of each cell, and the mean of each of its years; one cell is registered, the others describe."""
    cells = {"by": ["l_returnflag"]}
    picks = quantiles.stored(models.walk_forward(frame(spark, sf_dir), FEATURES, "y", "year", "row_id", **cells))
    gates, years = models.gate_of_periods(picks, "year", **cells), models.yearly_means(picks, "year", **cells)
    years = years.select("l_returnflag", "year", F.col("mean_excess").alias("year_mean"), F.col("n").alias("n_picks"))
    return gates.join(years, "l_returnflag").withColumn("registered", F.col("l_returnflag") == "A").withColumnRenamed("l_returnflag", "cell")


@query()
def r09_compare_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.compare_feature_sets(frame(spark, sf_dir), ["l_tax", "line"], FEATURES, "y", "year", "row_id", by=["l_returnflag"])


@query()
def r09_feature_set_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.feature_set_gates(frame(spark, sf_dir), ["l_tax", "line"], FEATURES, "y", "year", "row_id", by=["l_returnflag"])


@query(
    """WITH r AS (SELECT year(l_shipdate) AS year, l_quantity AS a, l_extendedprice AS b FROM lineitem),
       k AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY a) + (count(*) OVER (PARTITION BY year, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY year ORDER BY b) + (count(*) OVER (PARTITION BY year, b) - 1) / 2 AS rb FROM r)
       SELECT year, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM k GROUP BY 1"""
)
def r09_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity", "l_extendedprice")
    return rounded(models.spearman_by(rows, "year", "l_quantity", "l_extendedprice"))


@query("SELECT l_orderkey, l_linenumber, year(l_shipdate) AS year, round(l_extendedprice - median(l_extendedprice) OVER (PARTITION BY year(l_shipdate)), 4) AS realized FROM lineitem")
def w13_period_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), "l_extendedprice")
    return rounded(windows.market_excess(rows, ["year"], "l_extendedprice", "realized").select("l_orderkey", "l_linenumber", "year", "realized"), 4)
