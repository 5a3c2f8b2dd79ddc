"""Walk-forward on running sums against models fitted row by row, for cells, holes and every period; gates by cell."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, quantiles

NAMES = list("abcd")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x = rng.normal(size=(n, 4))
    year, cell = 2000 + rng.integers(0, 7, n), np.array(["u", "v"])[rng.integers(0, 2, n)]
    y = 2 * x[:, 0] * (cell == "u") - x[:, 1] + 0.3 * x[:, 2] + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "year": year, "cell": cell, **dict(zip(NAMES, x.T, strict=True)), "y": y})
    pdf.loc[pdf["row_id"] % 7 == 0, "a"] = np.nan
    pdf.loc[(pdf["row_id"] % 5 == 0) & (pdf["year"] > 2003), "b"] = np.nan
    pdf.loc[pdf["year"] < 2004, "d"] = np.nan  # nothing is known of it at first
    df = spark.createDataFrame(pdf)
    df = df.select("row_id", F.col("year").cast("int").alias("year"), "cell", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in NAMES), "y").repartition(4)
    folds = {r["row_id"]: r["f"] for r in df.select("row_id", models.fold_of(F.col("row_id"), 5).alias("f")).collect()}
    return df, pdf.assign(fold=pdf["row_id"].map(folds))


def fitted(known, year):
    """(row_id, predicted, realized) of a year's rows, row by row."""
    train, test = known[known["year"] < year], known[known["year"] == year]
    medians = train[NAMES].median().fillna(0.0)
    z = lambda d: np.column_stack([np.ones(len(d)), d[NAMES].fillna(medians), d["y"]])
    parts = [models.Moments(z(d).T @ z(d)) for _, d in train.groupby("fold")]
    total = models.Moments(sum(p.matrix for p in parts))
    intercept, beta, _ = models.lasso(total, models.select_alpha(parts, one_se=False))
    return pd.DataFrame({"row_id": test["row_id"], "predicted": intercept + test[NAMES].fillna(medians).to_numpy() @ beta, "realized": test["y"] - test["y"].median()})


@pytest.mark.parametrize("fits", [100, None])
def test_every_cell_and_period_equals_a_fit_of_its_rows(rows, monkeypatch, fits):
    df, pdf = rows
    if fits:
        monkeypatch.setattr(quantiles, "FITS", fits)
    got = models.walk_forward(df, NAMES, "y", "year", "row_id", all_scores=True, by=["cell"]).toPandas()
    assert len(got) == (pdf["year"] >= 2002).sum()
    for (cell, year), own in got.groupby(["cell", "year"]):
        want = fitted(pdf[pdf["cell"] == cell], year).set_index("row_id")
        own = own.set_index("row_id")
        assert np.allclose(own.loc[want.index, "predicted"], want["predicted"], atol=1e-7)
        assert np.allclose(own.loc[want.index, "realized"], want["realized"])
        assert (own.sort_values("predicted", ascending=False)["rank"].to_numpy() == np.arange(1, len(own) + 1)).all()


def test_a_cell_alone_and_among_others_is_the_same(rows):
    df, _ = rows
    both = models.walk_forward(df, NAMES, "y", "year", "row_id", by=["cell"]).where("cell = 'u'").drop("cell").orderBy("year", "rank").toPandas()
    alone = models.walk_forward(df.where("cell = 'u'"), NAMES, "y", "year", "row_id").orderBy("year", "rank").toPandas()
    pd.testing.assert_frame_equal(both, alone, check_exact=False)


def test_rows_meet_no_later_period(rows, spark):
    """The rows' number isn't multiplied by that of the periods: sums are taken once by period."""
    df, _ = rows
    months = df.withColumn("month", (F.col("row_id") % 60).cast("int"))
    plan = models.walk_forward(months, ["b", "c"], "y", "month", "row_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert models.walk_forward(df.limit(0), NAMES, "y", "year", "row_id").count() == 0
    assert models.walk_forward(df.withColumn("cell", F.lit(None).cast("string")), NAMES, "y", "year", "row_id", by=["cell"]).count() == 0


def test_gates_of_cells(rows):
    df, _ = rows
    picks = models.walk_forward(df, NAMES, "y", "year", "row_id", by=["cell"])
    gates = models.gate_of_periods(picks, "year", n_boot=400, by=["cell"]).toPandas().set_index("cell")
    for cell in "uv":
        alone = models.gate_of_periods(picks.where(F.col("cell") == cell), "year", n_boot=400).first()
        assert all(gates.loc[cell, c] == pytest.approx(alone[c]) for c in ("mean_excess", "ci_low", "ci_high", "net_ci_low")) and gates.loc[cell, "verdict"] == alone["verdict"]
    yearly = models.yearly_means(picks, "year", by=["cell"]).toPandas()
    assert len(yearly) == 10 and (yearly["n"] == 5).all()
    assert yearly[yearly["cell"] == "u"]["mean_excess"].mean() == pytest.approx(gates.loc["u", "mean_excess"])


def test_gates_of_both_feature_sets(rows):
    df, pdf = rows
    got = models.feature_set_gates(df, ["c"], NAMES, "y", "year", "row_id", by=["cell"], n_boot=200).toPandas().set_index("cell")
    periods = models.compare_feature_sets(df, ["c"], NAMES, "y", "year", "row_id", by=["cell"]).toPandas()
    for cell in "uv":
        own = periods[periods["cell"] == cell]
        assert got.loc[cell, "delta_mean_excess"] == pytest.approx(own["delta_top"].mean()) and got.loc[cell, "delta_mean_excess"] > 0.5
        assert got.loc[cell, "delta_spearman"] == pytest.approx(own["delta_spearman"].dropna().mean())
        assert len(own) == 5 and own["delta_spearman"].notna().all()
    assert got.loc["u", "extended_verdict"] == "PASS" and got.loc["u", "extended_n_periods"] == 5


def test_a_constant_prediction_has_no_rank_correlation(rows):
    df, _ = rows
    found = models.compare_feature_sets(df.where("year < 2004"), ["d"], NAMES, "y", "year", "row_id").collect()
    assert len(found) == 2 and all(r["baseline_spearman"] is None and r["delta_spearman"] is None and r["extended_spearman"] > 0.5 for r in found)


def test_out_of_fold_predictions_equal_fits_of_the_other_folds(rows):
    df, pdf = rows
    got = models.out_of_fold_lasso(df.withColumn("fold", (F.col("row_id") % 3).cast("int")), NAMES, "y", "row_id").toPandas().set_index("row_id")
    inner = {r["row_id"]: r["f"] for r in df.select("row_id", models.fold_of(F.col("row_id"), 5, seed=43).alias("f")).collect()}
    known = pdf.assign(inner=pdf["row_id"].map(inner))
    assert len(got) == len(pdf) and got["predicted"].notna().all()
    for fold in range(3):
        train, test = known[known["row_id"] % 3 != fold], known[known["row_id"] % 3 == fold]
        medians = train[NAMES].median()
        parts = [np.column_stack([np.ones(len(d)), d[NAMES].fillna(medians), d["y"]]) for _, d in train.groupby("inner")]
        parts = [models.Moments(z.T @ z) for z in parts]
        intercept, beta, _ = models.lasso(models.Moments(sum(p.matrix for p in parts)), models.select_alpha(parts, one_se=False))
        assert np.allclose(got.loc[test["row_id"], "predicted"], intercept + test[NAMES].fillna(medians).to_numpy() @ beta, atol=1e-7)
    errors = got["y"] - got["predicted"]
    lpd = models.gaussian_lpd(df.sparkSession.createDataFrame(got.reset_index()[["y", "predicted"]]), "y", "predicted").first()
    assert lpd["lpd"] == pytest.approx(np.mean(-0.5 * np.log(2 * np.pi * errors.var(ddof=0)) - errors**2 / (2 * errors.var(ddof=0)))) and lpd["rmse"] == pytest.approx(np.sqrt((errors**2).mean()))
    assert models.out_of_fold_lasso(df.limit(0).withColumn("fold", F.lit(0)), NAMES, "y", "row_id").count() == 0


def test_no_task_gathers_a_period_of_scores(spark, monkeypatch):
    rows = spark.range(600).select(F.col("id").alias("k"), (2000 + F.col("id") % 4).alias("year"), (F.col("id") % 23).cast("double").alias("x"), (F.col("id") % 23 + F.col("id") % 3).cast("double").alias("y"))
    monkeypatch.setattr(quantiles, "FITS", 50)  # as for large tables
    for everything in (True, False):
        found = models.walk_forward(rows, ["x"], "y", "year", "k", all_scores=everything)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and ("__part" if everything else "WindowGroupLimit") in plan
        picks = found.toPandas()
        for _, own in picks.groupby("year"):
            own = own.sort_values(["predicted", "k"], ascending=[False, True])
            assert own["rank"].tolist() == list(range(1, (150 if everything else 5) + 1))
