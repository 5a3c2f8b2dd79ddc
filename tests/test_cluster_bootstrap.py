"""The cluster bootstrap of the lag curve against brute force, and the rows that it takes."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import events, resample

DAYS, REPS = (-1, 0, 1), 40


@pytest.fixture(scope="module")
def sold():
    """(event, day, value): few sales with ties, an event that has most sales of day 1, and one without a value."""
    rng = np.random.default_rng(3)
    rows = [(int(e), int(d), float(v)) for e, d, v in zip(rng.integers(0, 400, 3000), rng.integers(-1, 1, 3000), rng.normal(1, 0.3, 3000).round(2), strict=True)]
    return rows + [(7, 1, float(v)) for v in rng.normal(5, 1, 300).round(3)] + [(e, 1, 1.0) for e in range(30)] + [(401, 0, None)]


def frame(spark, sold):
    at = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(e, at, float(d), v) for e, d, v in sold], "entity_id int, event_date timestamp_ntz, t_days double, v double")


def brute(sold, n_reps, seed=42):
    known = [(e, d, v) for e, d, v in sold if v is not None]
    pool = {e: i for i, e in enumerate(sorted({e for e, _, _ in known}))}
    owner, day, value = np.array([pool[e] for e, _, _ in known]), np.array([d for _, d, _ in known]), np.array([v for *_, v in known])
    out = {}
    for d in DAYS:
        medians = []
        for rep in range(n_reps):
            times = np.bincount(resample.draws(seed, rep, 0, len(pool), len(pool)), minlength=len(pool))
            drawn = np.repeat(value[day == d], times[owner[day == d]])
            medians += [np.median(drawn)] if len(drawn) else []
        out[d] = np.quantile(medians, [0.025, 0.975])
    return out


@pytest.mark.parametrize("spread", [8.0, 0.0])
def test_bounds_equal_brute_force_whatever_the_brackets(spark, sold, monkeypatch, spread):
    """Without a spread most medians lie outside the brackets, and the days are done again."""
    monkeypatch.setattr(resample, "BLOCK", 64)
    monkeypatch.setattr(resample, "SLOTS", 150)
    got = {r["t_bin"]: (r["ci_lo"], r["ci_hi"]) for r in events.lag_bounds(frame(spark, sold), "v", REPS, spread=spread).collect()}
    want = brute(sold, REPS)
    assert set(got) == set(DAYS)
    for d in DAYS:
        assert np.allclose(got[d], want[d])


def test_no_value_gives_no_bounds(spark):
    assert events.lag_bounds(frame(spark, [(1, 0, None)]), "v", REPS).count() == 0


def test_weights_of_blocks_are_the_draws(spark, monkeypatch):
    """A place that is drawn more than 255 times takes several rows."""
    monkeypatch.setattr(resample, "BLOCK", 4)
    for n in (1, 10):
        got = np.zeros((5, n), int)
        for r in resample.block_weights(spark, n, 5, 42, 2).collect():
            assert r["part"] == r["rep"] // 2
            got[r["rep"], r["block"] * 4 :][: len(r["times"])] += np.frombuffer(r["times"], np.uint8)
        assert (got == [np.bincount(resample.draws(42, k, 0, n, n), minlength=n) for k in range(5)]).all()


def test_no_draw_is_a_row(spark, sold):
    """No step of any plan gives as many rows as a fifth of the draws."""
    store, number = spark._jsparkSession.sharedState().statusStore(), lambda text: int(text.replace(",", ""))
    before, reps = store.executionsCount(), 500
    events.lag_bounds(frame(spark, sold), "v", reps).collect()
    ran, rows = store.executionsList(), [0]
    for execution in (ran.apply(i) for i in range(before, ran.size())):
        values, metrics = store.executionMetrics(execution.executionId()), execution.metrics()
        for metric in (metrics.apply(i) for i in range(metrics.size())):
            value = values.get(metric.accumulatorId())
            if metric.name() == "number of output rows" and value.isDefined():
                rows.append(number(value.get()))
    assert 3000 <= max(rows) < 400 * reps / 5
