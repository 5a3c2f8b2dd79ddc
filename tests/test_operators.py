"""Operators that SQL doesn't express, and rules that no query shows: no look-ahead, edges of cuts, planted signals."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as f
from tidemark.operators import aggregates, asof, events, joins, models, odds, resample, windows
from tidemark.sources import io, parse
from tidemark.streaming import jobs

DAY0 = dt.datetime(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = 2 * x[:, 0] - 1.5 * x[:, 1] + rng.normal(size=3000)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, row_id=range(3000), year=np.repeat(np.arange(2000, 2010), 300))
    return spark.createDataFrame(pdf), pdf


def test_lasso_finds_the_planted_features(planted):
    df, _ = planted
    got = {r["feature"]: r for r in models.lasso_cv(df, list("abcd"), "y", "row_id").collect()}
    assert got["a"]["selected"] and got["b"]["selected"] and abs(got["a"]["coefficient"] - 2) < 0.3
    assert abs(got["c"]["coefficient"]) < 0.1 and abs(got["d"]["coefficient"]) < 0.1
    shares = {r["feature"]: r["share"] for r in models.stability_selection(df, list("abcd"), "y", "row_id", n_boot=12).collect()}
    assert shares["a"] == shares["b"] == 1 and shares["c"] < 1


def test_permutations_hold_a_row_for_each_block_and_none_for_a_draw(spark, monkeypatch):
    import hashlib

    md5 = lambda rep, slot: int(hashlib.md5(f"7:{rep}:{slot}".encode()).hexdigest()[:8], 16)
    assert resample.draws(7, 4999, 99_990, 100_020, 84_001).tolist() == [md5(4999, s) % 84_001 for s in range(99_990, 100_020)]
    assert resample.draws(7, 0, 0, 12, 2**31).tolist() == [md5(0, s) % 2**31 for s in range(12)]
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "SLOTS", 7)
    monkeypatch.setattr(resample, "GROUP_BYTES", 64)
    pool = [(i, float(i * i % 37) - 17) for i in range(90)]
    cars = spark.createDataFrame([(0.5 + i % 3,) for i in range(25)], "car double")
    found = resample.significance(cars, "car", spark.createDataFrame([*pool, (90, None)], "i int, v double"), "v", ["i"], n_perm=40, seed=7)
    assert "__slot" not in found._jdf.queryExecution().optimizedPlan().toString()
    observed = sum(0.5 + i % 3 for i in range(25)) / 25
    means = [sum(pool[md5(rep, s) % 90][1] for s in range(25)) / 25 for rep in range(40)]
    (row,) = found.collect()
    assert (row["n_events"], row["p_value"]) == (25, sum(abs(m) >= abs(observed) for m in means) / 40) and abs(row["observed"] - observed) < 1e-12
    assert resample.significance(cars.limit(0), "car", spark.createDataFrame(pool, "i int, v double"), "v", ["i"], n_perm=4).count() == 0
    assert resample.significance(cars, "car", spark.createDataFrame([], "i int, v double"), "v", ["i"], n_perm=4).count() == 0


def test_totals_by_kind_are_those_of_the_rows_so_far(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.randrange(40), rng.choice([0, 1, 2, 7, None]), rng.choice([None, 1, 2, 3])) for _ in range(200)]
    probes = [(k, t, f"{k}-{t}") for k in range(5) for t in range(0, 45, 6)]
    data = spark.createDataFrame(rows, "k int, at int, kind int, v int")
    asked = spark.createDataFrame(probes, "k int, t int, name string")
    for inclusive in (True, False):
        got = asof.asof_totals(asked, data, ["k"], "t", "at", F.col("kind"), [0, 1, 2], {"s": (F.sum, F.col("v")), "first": (F.min, F.col("at"))}, inclusive).collect()
        assert sorted((r["k"], r["t"], r["name"]) for r in got) == sorted(probes)
        for r in got:
            for kind in (0, 1, 2):
                own = [x for x in rows if x[0] == r["k"] and x[2] == kind and (x[1] <= r["t"] if inclusive else x[1] < r["t"])]
                values = [x[3] for x in own if x[3] is not None]
                assert (tuple(r[f"of_{kind}"]) if r[f"of_{kind}"] else None) == ((sum(values) if values else None, min(x[1] for x in own)) if own else None)


def test_resamples_repeat_no_row(spark):
    import numpy as np

    weights = models.poisson_weights(np.arange(50_000) * 7_919, 20)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02 and np.abs(np.corrcoef(weights.T) - np.eye(20)).max() < 0.03
    rows = [(i, float(i % 7), float(i % 5), 3.0 * (i % 7) + (i % 3)) for i in range(400)] + [(None, 1.0, None, 2.0)]
    got = models.stability_selection(spark.createDataFrame(rows, "k int, a double, b double, y double"), ["a", "b"], "y", "k", n_boot=10)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["feature"]: r["share"] for r in got.collect()}["a"] == 1.0


def test_least_squares_equals_numpy(planted):
    df, pdf = planted
    x = np.column_stack([np.ones(len(pdf)), pdf[list("abc")]])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ pdf["y"].to_numpy()
    e = pdf["y"].to_numpy() - x @ beta
    se = np.sqrt(np.diag(inverse @ (x * (e**2)[:, None]).T @ x @ inverse) * len(x) / (len(x) - 4))
    got = models.ols_hc1(df, list("abc"), "y").toPandas()
    assert np.allclose(got["coefficient"], beta) and np.allclose(got["se"], se)
    f_c = models.joint_wald(df, list("abc"), ["c"], "y").first()["f"]
    assert np.isclose(f_c, (beta[3] / se[3]) ** 2)
    assert models.ols_hc1(df.limit(0), ["a"], "y").where("coefficient IS NOT NULL").count() == 0


def test_walk_forward_doesnt_see_the_future(planted):
    df, _ = planted
    picks = lambda d: {(r["year"], r["rank"]): r["row_id"] for r in models.walk_forward(d, list("abcd"), "y", "year", "row_id").collect()}
    whole, cut = picks(df), picks(df.where("year < 2006"))
    assert cut and all(whole[k] == v for k, v in cut.items())
    changed = df.withColumn("y", F.when(F.col("year") >= 2006, -F.col("y")).otherwise(F.col("y")))
    assert all(picks(changed)[k] == v for k, v in cut.items())


def test_walk_forward_fits_and_reads_the_same_whatever_the_features(planted, spark):
    """Scores equal those of a model fitted in numpy on earlier years alone, medians for what is missing; the plan doesn't grow."""
    df, pdf = planted
    holes = df.withColumn("a", F.when(F.col("row_id") % 7 > 0, F.col("a")))
    got = models.walk_forward(holes, list("abcd"), "y", "year", "row_id", all_scores=True).where("year = 2005").toPandas().set_index("row_id")
    known = pdf.assign(a=pdf["a"].where(pdf["row_id"] % 7 > 0))
    train, test = known[known["year"] < 2005], known[known["year"] == 2005]
    medians = train[list("abcd")].median()
    x, x_test = train[list("abcd")].fillna(medians), test[list("abcd")].fillna(medians)
    slope = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), train["y"], rcond=None)[0]
    plain = np.column_stack([np.ones(len(x_test)), x_test]) @ slope
    assert len(got) == 300 and np.corrcoef(got.loc[test["row_id"], "predicted"], plain)[0, 1] > 0.999
    realized = test.set_index("row_id")["y"] - test["y"].median()
    assert np.allclose(got["realized"].sort_index(), realized.sort_index())
    reads = lambda names: models.walk_forward(df, names, "y", "year", "row_id")._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert reads(list("ab")) == reads(list("abcd")) < 8


def test_gate_cells_and_feature_sets(planted):
    df, _ = planted
    picks = models.walk_forward(df, list("abcd"), "y", "year", "row_id")
    gate = models.gate_of_periods(picks, "year", n_boot=500).first()
    assert gate["n_periods"] == 8 and gate["verdict"] == "PASS" and gate["ci_low"] <= gate["mean_excess"] <= gate["ci_high"] and np.isclose(gate["net_mean"], gate["mean_excess"] - 0.14)
    both = models.compare_feature_sets(df, ["c"], list("abcd"), "y", "year", "row_id").collect()
    assert len(both) == 8 and np.mean([r["delta_top"] for r in both]) > 1 and np.mean([r["extended_spearman"] for r in both]) > 0.8
    flat = models.spearman_by(df.withColumn("flat", F.lit(1.0)), "year", "flat", "y").collect()
    assert all(r["spearman"] is None for r in flat)


def test_boosted_trees_and_folds_find_the_planted_features(planted):
    df, _ = planted
    got = {r["feature"]: r for r in models.boosted_importance(df, list("abcd"), "y", "row_id").collect()}
    assert min(got["a"]["importance"], got["b"]["importance"]) > 5 * max(got["c"]["importance"], got["d"]["importance"]) and got["a"]["oof_r2"] > 0.7


def test_boosted_trees_of_cells_equal_those_of_rows(spark):
    """Rows of the same bins are one weighted row, and the trees are those of all rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (6000, 3))
    pdf = pd.DataFrame(x.astype(float), columns=list("abc")).assign(y=x[:, 0] ** 2 - 3.0 * x[:, 1] + rng.normal(size=6000), row_id=range(6000), wide=rng.normal(size=6000), same=1.0)
    df = spark.createDataFrame(pdf).cache()
    cells = models.binned_cells(df, list("abc"), "y", []).agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("y")).first()
    assert cells["cells"] == len(pdf[list("abc")].drop_duplicates()) <= 729 and cells["n"] == 6000 and np.isclose(cells["y"], pdf["y"].sum())
    got = models.boosted_importance(df, list("abc"), "y", "row_id").toPandas()
    ready = VectorAssembler(inputCols=list("abc"), outputCol="x").transform(df.withColumn("fold", models.fold_of(F.col("row_id"), 3)))
    learner = GBTRegressor(featuresCol="x", labelCol="y", maxIter=10, maxDepth=3, stepSize=0.2, seed=7)
    assert np.allclose(got["importance"], learner.fit(ready).featureImportances.toArray())
    scored = pd.concat([learner.fit(ready.where(F.col("fold") != k)).transform(ready.where(F.col("fold") == k)).select("y", "prediction").toPandas() for k in range(3)])
    assert np.allclose(got["oof_r2"], 1 - ((scored["y"] - scored["prediction"]) ** 2).sum() / ((scored["y"] - scored["y"].mean()) ** 2).sum())
    bins = models.binned_cells(df, ["wide", "same"], "y", []).toPandas()
    assert bins["wide"].nunique() == 32 and bins["same"].nunique() == 1 and bins["n"].between(180, 195).all()


def test_weighted_medians_equal_repeated_values():
    rng = np.random.default_rng(4)
    values, owners, weights = rng.normal(0, 1, 300).round(1), rng.integers(0, 40, 300), rng.poisson(0.7, (40, 60)).astype(np.int32)
    weights[:, 5] = 0
    weights[:, 6] = 0
    weights[owners[0], 6] = 1
    for block in (1, 7, 2048):
        got = events.weighted_medians(values, owners, weights, block)
        want = [np.median(np.repeat(values, weights[owners, k])) if weights[owners, k].any() else np.nan for k in range(60)]
        assert np.allclose(got, want, equal_nan=True)


def test_greedy_rules_of_one_entity_with_a_million_events(spark):
    """What is gathered has a row a day, or two: most events go before."""
    n = 1_000_000
    at = F.timestamp_seconds((F.col("id") * 7919 % (6000 * 86_400)).cast("bigint")).cast("timestamp_ntz")
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("k"), at.alias("d"), (F.sin(F.col("id") * 0.37) + 0.001).alias("delta"), F.when(F.col("id") % 5 == 0, None).otherwise(F.lit(2)).alias("other"))
    rows = df.groupBy(F.datediff("d", F.lit("1970-01-01")).alias("day")).agg(F.min("d").alias("d"), F.max_by("delta", F.struct(F.abs("delta"), -F.unix_micros(F.col("d").cast("timestamp")))).alias("x")).toPandas().sort_values("day")
    want, last = [], None
    for day_number, d in zip(rows["day"], rows["d"], strict=True):
        if last is None or day_number - last > 14:
            want.append(d)
            last = day_number
    kept = windows.drop_overlaps(df, ["k"], "d").toPandas().sort_values("d")
    assert kept["d"].tolist() == want and len(want) == 400
    null_keys = windows.drop_overlaps(df.withColumn("k", F.when(F.col("k") > 5, 1)).limit(1000), ["k"], "d")
    assert null_keys.count() > 0
    picked = windows.pick_spikes(df, "k", "d").toPandas()
    for sign in (1, -1):
        own = picked[np.sign(picked["delta"]) == sign]
        days = np.sort(own["d"].to_numpy().astype("datetime64[D]").astype(int))
        assert len(days) > 300 and np.diff(days).min() > 7
    assert picked["delta"].abs().max() == rows["x"].abs().max()


def test_average_ranks_equal_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"p": rng.integers(0, 3, 500), "v": rng.integers(0, 40, 500).astype(float), "i": range(500)})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(1, None, 900)], "p bigint, v double, i bigint"))
    got = windows.average_ranks(df, "p", "v", "r").toPandas().set_index("i")["r"]
    want = pdf.set_index("i").groupby("p")["v"].rank(method="average")
    assert np.allclose(got.loc[range(500)], want.loc[range(500)]) and np.isnan(got.loc[900])


def test_variance_components_find_planted_groups(spark):
    rng = np.random.default_rng(2)
    g = np.repeat(np.arange(200), 20)
    y = rng.normal(0, 2, 200)[g] + rng.normal(0, 1, len(g))
    got = models.variance_components(spark.createDataFrame(pd.DataFrame({"g": g, "y": y})), "g", "y").first()
    assert abs(got["icc"] - 0.8) < 0.06


def test_asof_cuts(spark):
    rows = spark.createDataFrame([(1, day(1), 10.0), (1, day(5), None), (1, day(9), 30.0), (2, day(3), 7.0), (None, day(1), 1.0)], "k int, t timestamp_ntz, v double")
    probes = spark.createDataFrame([(1, day(1)), (1, day(9)), (1, day(10)), (3, day(9)), (2, None)], "k int, at timestamp_ntz")
    got = {(r["k"], r["at"]): r["x"] for r in asof.last_before(probes, rows, ["k"], "at", "t", "v", "x").collect()}
    assert got == {(1, day(1)): None, (1, day(9)): 10.0, (1, day(10)): 30.0, (3, day(9)): None, (2, None): None}
    sums = {(r["k"], r["at"]): (r["v"], r["n_rows"]) for r in asof.stats_to_date(probes, rows, ["k"], "at", "t", ["v"]).collect()}
    assert sums[(1, day(1))] == (10.0, 1) and sums[(1, day(9))] == (40.0, 3) and sums[(3, day(9))] == (0.0, 0)
    later = rows.union(spark.createDataFrame([(1, day(50), 99.0)], rows.schema))
    again = {(r["k"], r["at"]): r["x"] for r in asof.last_before(probes, later, ["k"], "at", "t", "v", "x").collect()}
    assert again == got


def test_repeated_keys_fail(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats"):
        joins.checked_left(left, right, ["k"]).collect()


def test_greedy_rules_equal_loops(spark):
    rng = random.Random(3)
    rows = sorted({(k, rng.randrange(200)) for k in range(5) for _ in range(40)})
    want = []
    for k in range(5):
        last = None
        for _, d in [r for r in rows if r[0] == k]:
            if last is None or d - last > 14:
                want.append((k, day(d)))
                last = d
    df = spark.createDataFrame([(k, day(d)) for k, d in rows], "k int, d timestamp_ntz")
    assert sorted(map(tuple, windows.drop_overlaps(df, ["k"], "d").collect())) == want
    steps = [(k, d, round(rng.uniform(-1, 1), 3)) for k, d in rows]
    want = []
    for k in range(5):
        kept = []
        for _, d, x in sorted((r for r in steps if r[0] == k), key=lambda r: (-abs(r[2]), r[1])):
            if not any((x > 0) == (y > 0) and abs(d - e) <= 7 for e, y in kept):
                kept.append((d, x))
        want += [(k, day(d), x) for d, x in kept]
    df = spark.createDataFrame([(k, day(d), x) for k, d, x in steps], "k int, d timestamp_ntz, delta double")
    assert sorted(map(tuple, windows.pick_spikes(df, "k", "d").collect())) == sorted(want)


def test_gaps_fill_as_pandas_does(spark):
    rng = random.Random(4)
    values = [rng.random() if rng.random() < 0.4 else None for _ in range(80)]
    values[30:42] = [None] * 12
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, p int, v double")
    got = [r["filled"] for r in windows.fill_gaps(df, ["k"], "p", "v").orderBy("p").collect()]
    want = pd.Series(values, dtype=float).interpolate(limit=3, limit_direction="both").tolist()
    assert np.allclose(np.array(got, float), want, equal_nan=True)
    strict = [r["filled"] for r in windows.fill_gaps(df, ["k"], "p", "v", strict=True).orderBy("p").collect()]
    assert all(x is None for x in strict[30:42])


def test_outliers_need_enough_rows(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 1000)] + [("b", float(x)) for x in (1, 2, 3, 1000)] + [(None, float(x)) for x in (1, 2, 3, 4, 1000)] + [("c", 5.0)] * 5 + [("c", 9.0)]
    df = spark.createDataFrame(rows, "g string, price double")
    got = {(r["g"], r["price"]) for r in aggregates.flag_outliers(df, [F.col("g")]).where("outlier").collect()}
    assert got == {("a", 1000.0), (None, 1000.0)}


def test_nothing_sums_to_nought(spark):
    df = spark.createDataFrame([(1, 0, None, True), (2, 0, 0.5, True), (2, 1, 9.0, False)], "k int, offset int, excess_ret double, horizon_ok boolean")
    assert {r["k"]: r["car"] for r in aggregates.abnormal_sum(df, ["k"], [0, 1]).collect()} == {1: 0.0, 2: 0.5}


def test_breakouts_of_planted_games(spark):
    rng = random.Random(5)
    rows = [(1, "mlb", day(i), i, rng.choice([3, 4, 5]), 4) for i in range(60)]
    rows[40] = (1, "mlb", day(40), 40, 20, 4)
    rows[3] = (1, "mlb", day(3), 3, 20, 4)  # too early for a baseline
    df = spark.createDataFrame(rows, "entity_id int, level string, date timestamp_ntz, game_id int, score_in int, pa int")
    found = windows.breakouts(df.where("game_id <> 3"), F.col("score_in"), F.col("pa") > 0, F.col("pa"), any_row=True, z_min=4)
    assert [r["game_id"] for r in found.collect()] == [40]


def test_half_life_of_a_planted_curve(spark):
    curve = spark.createDataFrame([(t, 1 + 0.5 * (1 - 2 ** (-t / 3))) for t in range(15)], "t_bin int, median double")
    got = events.half_life(curve).first()
    assert got["half_life"] == 3.0 and abs(got["amplitude"] - 0.5) < 1e-9
    assert events.half_life(curve.withColumn("median", F.lit(1.0))).first()["half_life"] is None


def test_odds_before_the_entry(spark):
    snaps = spark.createDataFrame([(1, day(10), 0.2), (1, day(20), 0.4), (1, day(30), 0.9), (2, day(40), 0.5)], "entity_id int, day timestamp_ntz, implied_prob double")
    grid = spark.createDataFrame([(1, day(30), 2020), (1, day(10), 2020), (2, day(30), 2020), (3, day(30), 2020)], "entity_id int, entry_month timestamp_ntz, season int")
    got = {(r["entity_id"], r["entry_month"]): (r["odds_level"], r["odds_delta_7"]) for r in odds.month_features(grid, snaps, (7,)).collect()}
    assert got[(1, day(30))] == (0.4, pytest.approx(0.2)) and got[(1, day(10))] == (None, None) and got[(2, day(30))] == (None, None) and got[(3, day(30))] == (0.0, 0.0)


def test_upsert_keeps_what_an_empty_row_would_hide(spark):
    old = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    new = spark.createDataFrame([(1, None), (2, 7), (3, None), (4, 8)], "k int, v int")
    assert sorted(map(tuple, io.upsert(old, new, ["k"], ["v"]).collect())) == [(1, 5), (2, 7), (3, None), (4, 8)]


def test_snapshot_files(spark, tmp_path):
    for key, name, n in (("a", "2020-01-01", 1), ("a", "2020-02-01", 2), ("b", "2020-01-15", 3)):
        (tmp_path / "set" / key).mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / key / f"{name}.json").write_text(f'{{"n": {n}}}')
    got = io.latest(io.read_snapshots(spark, str(tmp_path), "n int"), ["dataset", "key"], "day", "payload")
    assert sorted((r["dataset"], r["key"], r["day"], r["payload"]["n"]) for r in got.collect()) == [("set", "a", "2020-02-01", 2), ("set", "b", "2020-01-15", 3)]


def test_titles_and_amounts(spark):
    rows = [("2020 Name PSA 10", "psa_10", None), ("sgc 9.5 x", "sgc_9.5", None), ("GEM MINT 10 PSA", "psa_10", None), ("PSA GEM MT 10 $1,234.50", "psa_10", 1234.5), ("plain", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, g string, a double").withColumns({"g2": f.grade_from_title(F.col("t")), "a2": F.when(F.col("t").contains("$"), f.money(F.regexp_extract("t", r"(\$.*)", 1)))})
    assert all(r["g"] == r["g2"] and r["a"] == r["a2"] for r in df.collect())
    outs = spark.createDataFrame([("6.1", 19), ("0.2", 2), ("7", 21), (None, None)], "i string, o int").withColumn("x", f.innings_to_outs(F.col("i")))
    assert all(r["o"] == r["x"] for r in outs.collect())


def test_pages_without_tables(spark):
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, None), (3, "<table><tr><td>2020-01-01<td></table>")], "k int, html string")
    assert parse.sales(parse.table_rows(df, "k"), "k").count() == 0


def alerts_of(rows, silent=30 * 86400):
    """(market, ts) of the rows that no later row can come before, market by market in the order of time."""
    want, end = [], max(ts for _, _, ts, _ in rows) - dt.timedelta(days=1)
    for m in {r[0] for r in rows}:
        last, steps, alerts, before = None, [], [], None
        for _, _, ts, p in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])):
            if ts > end:
                break
            if before is not None and (ts - before).total_seconds() > silent:
                last, steps, alerts = None, [], []
            if last is not None:
                delta = p - last
                steps = [*steps, delta][-30:]
                sd = pd.Series(steps).std() if len(steps) >= 5 else 0.0
                alerts = [a for a in alerts if (ts - a[0]).total_seconds() <= 7 * 86400]
                if abs(delta) >= max(0.1, 3 * sd) and not any((a[1] > 0) == (delta > 0) for a in alerts):
                    alerts.append((ts, delta))
                    want.append((m, ts))
            last, before = p, ts
    return sorted(want)


def test_spike_alerts_equal_a_loop(spark, tmp_path):
    """Rows come in three runs, out of order by less than a day; market 3 is silent for two months in between, and its state goes."""
    rng = random.Random(6)
    gap = lambda m, i: dt.timedelta(days=60) if m == 3 and i >= 30 else dt.timedelta()
    rows = [(m, i, DAY0 + dt.timedelta(hours=9 * i) + gap(m, i), rng.random()) for m in range(4) for i in range(60)]
    rows += [(9, i, DAY0 + dt.timedelta(hours=12 * i), 0.5) for i in range(170)]  # keeps time going
    schema = "market_id bigint, event_id bigint, ts timestamp, raw_price double"
    arriving = sorted(rows, key=lambda r: r[2].timestamp() + rng.uniform(0, 20 * 3600))
    got = []
    for k in range(3):
        part = arriving[len(rows) * k // 3 : len(rows) * (k + 1) // 3]
        for j in range(2):
            spark.createDataFrame(part[len(part) * j // 2 : len(part) * (j + 1) // 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = sorted((r["market_id"], r["ts"]) for r in jobs.run_available(jobs.spike_alerts(stream), f"{tmp_path}/out").collect())
    assert got == alerts_of(rows) and got


def test_spike_alerts_take_few_calls_to_the_store():
    """Each call is a round trip: their number doesn't depend on the rows of a batch."""
    calls = []

    class Store:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendValue", "update"):
                    self.held = [*self.held, args[0]] if name == "appendValue" else [args[0]]
                elif name == "get":
                    return iter(self.held) if self.listed else self.held[0] if self.held else None

            return call

    class Handle:
        def getListState(self, *_):  # noqa: N802 - Spark's name
            store = Store()
            store.listed = True
            return store

        def getValueState(self, *_):  # noqa: N802 - Spark's name
            store = Store()
            store.listed = False
            return store

        def registerTimer(self, _):  # noqa: N802 - Spark's name
            calls.append("registerTimer")

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802 - Spark's name
            return 10**12

    alerts = jobs.SpikeAlerts(0.1, 30, 3.0, 5, 7, 30)
    alerts.init(Handle())
    rows = pd.DataFrame({"at": [i * 10**9 for i in range(400)], "event_id": range(400), "raw_price": [0.5] * 399 + [0.9]})
    assert not [r for r in alerts.handleInputRows((1,), iter([rows[:200], rows[200:]]), None) if len(r)] and len(calls) == 2
    found = pd.concat(alerts.handleExpiredTimer((1,), Now(), None))
    assert found["at"].tolist() == [399 * 10**9] and np.isclose(found["delta"], 0.4).all() and len(calls) <= 7


def test_breakouts_on_the_bound(spark):
    """A last score that lies on 1.5 deviations is in, however its base is rounded; one less isn't."""
    cases = [((6, 6, 5, 5, 4, 3, 3, 0), 7), ((7, 7, 6, 6, 5, 4, 4, 1), 8), ((7, 7, 5, 4, 3, 3, 3, 3, 1), 7), ((3, 3, 2, 2, 0, 0, 0, 0, 0, 0), 3), ((4, 2, 2, 1, 1, 0, 0, 0, 0, 0), 3)]
    rows = [(2 * e + less, "mlb", i, i, x) for e, (base, score) in enumerate(cases) for less in (0, 1) for i, x in enumerate([*base, score - less])]
    df = spark.createDataFrame(rows, "entity_id long, level string, date int, game_id int, x long")
    found = windows.breakouts(df, F.col("x"), F.lit(True), F.lit(1), any_row=True, least_weight=0, z_min=1.5).where("game_id = baseline_n AND baseline_n >= 8")
    assert {(r["entity_id"], r["z"]) for r in found.collect()} == {(2 * e, 1.5) for e in range(len(cases))}


def test_sales_meet_events_without_a_broadcast(spark):
    """The driver gets no events, however small they look: their number has no bound."""
    events = spark.sql("SELECT id AS entity_id, TIMESTAMP_NTZ '2020-01-01' AS event_date FROM range(5)")
    sales = spark.sql("SELECT id AS entity_id, TIMESTAMP_NTZ '2020-01-03' AS sale_date FROM range(5)")
    met = joins.event_sales(events, sales, "entity_id", 5, 5)
    assert met.count() == 5 and "Broadcast" not in met._jdf.queryExecution().sparkPlan().toString()
