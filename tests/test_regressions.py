"""Robust regressions by group, tests with p-values, and random intercepts, against dense numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models


def dense(x, y):
    """(coefficients, HC1 covariance, residual degrees of freedom)."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e, df = y - x @ beta, len(y) - np.linalg.matrix_rank(x)
    return beta, inverse @ (x * (e**2)[:, None]).T @ x @ inverse * len(y) / df, df


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"season": 2000 + rng.integers(0, 3, n), "stat": rng.normal(0, 1, n), "games": rng.integers(1, 160, n).astype(float), "age": rng.normal(27, 4, n), "position_group": np.array(["IF", "OF", "P"])[rng.integers(0, 3, n)]})
    pdf["y"] = 0.4 * pdf["stat"] * (pdf["season"] - 2000) + 0.01 * pdf["games"] - 0.05 * pdf["age"] + rng.normal(0, 1, n) * (1 + np.abs(pdf["stat"]))
    pdf.loc[pdf["position_group"] == "IF", "y"] += 0.5 * pdf["stat"]
    few = pdf.iloc[:4].assign(season=1990)
    five = pdf.iloc[4:9].assign(season=1991, age=30.0)  # a covariate that doesn't vary
    pdf = pd.concat([pdf, few, five], ignore_index=True)
    return spark.createDataFrame(pdf).repartition(4), pdf


def test_seasons_with_p_values_and_too_few_rows(rows):
    df, pdf = rows
    got = {r["season"]: r for r in models.season_consistency(df, "stat", ["games", "age"], "y", "season").collect()}
    assert got.keys() == set(pdf["season"])
    for season, own in pdf.groupby("season"):
        r = got[season]
        assert r["n"] == len(own)
        if len(own) < 5:
            assert r["coefficient"] is None and r["se"] is None and r["p_value"] is None
            continue
        beta, cov, _ = dense(np.column_stack([np.ones(len(own)), own[["stat", "games", "age"]]]), own["y"].to_numpy())
        se = math.sqrt(cov[1, 1])
        assert r["coefficient"] == pytest.approx(beta[1], rel=1e-6) and r["se"] == pytest.approx(se, rel=1e-6)
        assert r["p_value"] == pytest.approx(math.erfc(abs(beta[1] / se) / math.sqrt(2)), rel=1e-5, abs=1e-12)


def test_nulls_drop_out_and_null_groups_stay(spark):
    df = spark.createDataFrame([(None, float(i), 2.0 * i + i % 3) for i in range(9)] + [(None, None, 1.0), (1, 1.0, 2.0), (2, None, 1.0)], "g int, x double, y double")
    got = {(r["g"], r["term"]): r for r in models.ols_hc1(df, ["x"], "y", ["g"], 5).collect()}
    assert len(got) == 6 and got[None, "x"]["n"] == 9 and got[None, "x"]["coefficient"] is not None
    assert got[1, "x"]["n"] == 1 and got[2, "x"]["n"] == 0 and got[1, "x"]["p_value"] is None and got[2, "x"]["se"] is None


def test_stage_effects_against_the_first_stage(spark):
    rng = np.random.default_rng(5)
    stages = np.array(["rookie_year", "sophomore", "established", "prospect"])[rng.integers(0, 4, 600)]
    pdf = pd.DataFrame({"career_stage": stages, "age": rng.normal(25, 3, 600), "y": rng.normal(0, 1, 600) + 2.0 * (stages == "sophomore") - 1.0 * (stages == "established")})
    got = {r["term"]: r for r in models.stage_effects(spark.createDataFrame(pdf), "y", covariates=["age"]).collect()}
    own = pdf[pdf["career_stage"] != "prospect"]
    x = np.column_stack([np.ones(len(own)), own["career_stage"] == "sophomore", own["career_stage"] == "established", own["age"]]).astype(float)
    beta, cov, _ = dense(x, own["y"].to_numpy())
    for i, term in enumerate(["intercept", "career_stage=sophomore", "career_stage=established", "age"]):
        assert got[term]["coefficient"] == pytest.approx(beta[i], rel=1e-6, abs=1e-9) and got[term]["se"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-6) and got[term]["n"] == len(own)


def test_interaction_of_two_groups(rows):
    df, pdf = rows
    got = models.interaction_test(df, "stat", "position_group", ("IF", "OF"), ["games", "age"], "y").first()
    own = pdf[pdf["position_group"] != "P"]
    other = (own["position_group"] == "OF").astype(float)
    beta, cov, df_residual = dense(np.column_stack([np.ones(len(own)), own["stat"], other, other * own["stat"], own["games"], own["age"]]), own["y"].to_numpy())
    f = beta[3] ** 2 / cov[3, 3]
    assert got["f"] == pytest.approx(f, rel=1e-6) and (got["df"], got["df_residual"]) == (1, df_residual)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(f / 2)), rel=0.05)  # many rows: near the normal
    one = models.interaction_test(df.where("position_group = 'IF'"), "stat", "position_group", ("IF", "OF"), ["games"], "y").first()
    assert one["f"] is None and one["p_value"] is None
    assert models.joint_wald(df.limit(0), ["stat"], ["stat"], "y").first()["f"] is None


def reml(pdf, features, ratio_of):
    """(restricted likelihood, variance within) at a ratio of the variances, by dense matrices."""
    x, y = np.column_stack([np.ones(len(pdf)), pdf[features]]), pdf["y"].to_numpy()
    same = (pdf["id"].to_numpy()[:, None] == pdf["id"].to_numpy()[None, :]).astype(float)

    def at(r):
        v = np.eye(len(y)) + r * same
        inner = x.T @ np.linalg.solve(v, x)
        beta = np.linalg.solve(inner, x.T @ np.linalg.solve(v, y))
        e = y - x @ beta
        rss, df = e @ np.linalg.solve(v, e), len(y) - x.shape[1]
        return -0.5 * (df * np.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(inner)[1]), rss / df, beta

    low, high = np.log(ratio_of / 50), np.log(ratio_of * 50)
    for _ in range(60):  # golden section
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (a, high) if at(np.exp(a))[0] < at(np.exp(b))[0] else (low, b)
    return np.exp((low + high) / 2), at(np.exp((low + high) / 2))


def test_random_intercepts_equal_a_dense_solve(spark):
    rng = np.random.default_rng(6)
    ids = np.repeat(np.arange(40), rng.integers(1, 12, 40))
    n = len(ids)
    pdf = pd.DataFrame({"id": ids, "stat": rng.normal(0, 1, n), "games": rng.normal(80, 30, n), "flat": 7.0})
    pdf["y"] = 1 + 0.5 * pdf["stat"] + 0.02 * pdf["games"] + rng.normal(0, 1.5, 40)[ids] + rng.normal(0, 1, n)
    got = models.random_intercepts(spark.createDataFrame(pdf).repartition(3), ["stat", "games", "flat"], "y", "id").first()
    ratio, (_, within, beta) = reml(pdf, ["stat", "games"], 2.0)
    assert got["within"] == pytest.approx(within, rel=1e-4) and got["between"] == pytest.approx(ratio * within, rel=1e-4) and got["icc"] == pytest.approx(ratio / (1 + ratio), rel=1e-4)
    assert np.allclose(got["beta"][:3], beta, rtol=1e-4) and got["beta"][3] is None and (got["n"], got["n_groups"]) == (n, 40)


def test_random_intercepts_without_spread_between_groups(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(300) % 30, "x": rng.normal(0, 1, 300)})
    pdf["y"] = pdf["x"] + rng.normal(0, 1, 300)
    pdf["y"] -= pdf.groupby("id")["y"].transform("mean") - pdf["y"].mean()  # groups differ less than by chance
    got = models.random_intercepts(spark.createDataFrame(pdf), ["x"], "y", "id").first()
    assert got["between"] < 1e-6 and got["icc"] < 1e-6
    assert models.random_intercepts(spark.createDataFrame(pdf).limit(0), ["x"], "y", "id").count() == 0
