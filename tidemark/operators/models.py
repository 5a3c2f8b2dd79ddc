"""Statistical models from sums that Spark gathers: Gram matrices by fold, solved where they are k x k.

The data stay distributed; what reaches the driver is a matrix of as many rows as there are features, for each fold or
resample. Scores are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import distributions
from tidemark.operators import quantiles, resample, windows


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """A fold by hash, alike on every machine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % folds


def balanced_folds(frame: DataFrame, key: str, folds: int, seed: int = 42, group: list[str] | None = None) -> DataFrame:
    """frame with `fold`: numbers over the hash's order in each group, so that folds differ by one row at most. Rows are numbered by
    ranges that are written first and counted, so no task holds a group, or all rows."""
    spark = frame.sparkSession
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rows = frame.withColumns({"__g": F.struct(*(F.col(c) for c in group or []), F.lit(0).alias("__all")), "__h": digest})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = quantiles.stored(rows.repartitionByRange(parts, "__g", "__h", key).withColumn("__p", F.spark_partition_id()))
    earlier = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = ranged.groupBy("__g", "__p").agg(F.count("*").alias("__c")).select("__g", "__p", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__g", "__p").orderBy("__h", key)) - 1
    numbered = ranged.withColumn("__own", own).join(sizes, ["__g", "__p"])
    return numbered.select(*frame.columns, ((F.col("__own") + F.col("__before")) % folds).cast("int").alias("fold"))


def grams(frame: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Per group the sums of products of (1, features, target), as one array in the order of the upper triangle: one pass with
    partial sums, whatever the rows."""
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in features), F.col(target).cast("double")]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = frame.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*features, target))))
    sums = [F.sum(columns[i] * columns[j] * w) for i in range(len(columns)) for j in range(i, len(columns))]
    return rows.groupBy(*by).agg(F.array(*sums).alias("gram"))


def as_matrix(values: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values
    return out + np.triu(out, 1).T


class Moments:
    """Sums of products of (1, x, y); adding and taking away sums gives those of unions and rests."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.matrix + other.matrix)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.matrix - other.matrix)

    @property
    def n(self) -> float:
        return self.matrix[0, 0]

    def standardized(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(correlation-scale x'x / n, x'y / n, means, population deviations) after centring; flat columns have deviation 1."""
        m = self.matrix / self.n
        mean = m[0, 1:]
        cov = m[1:, 1:] - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        flat = sd <= 1e-12
        sd[flat] = 1.0
        xx, xy = cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd
        xx[flat], xx[:, flat], xy[flat] = 0.0, 0.0, 0.0
        return xx, xy, mean, sd

    def squared_error(self, intercept: float, beta: np.ndarray) -> float:
        c = np.concatenate([[-intercept], -beta, [1.0]])
        return float(c @ self.matrix @ c) / self.n


def lasso(moments: Moments, alpha: float, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, coefficients, coefficients of the standardised features) by coordinate descent on the sums."""
    xx, xy, mean, sd = moments.standardized()
    beta = np.zeros(len(xy))
    for _ in range(rounds):
        was = beta.copy()
        for j in range(len(beta)):
            if xx[j, j] > 0:
                rho = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
                beta[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / xx[j, j]
        if np.abs(beta - was).max(initial=0) < 1e-10:
            break
    raw = beta / sd
    return float(mean[-1] - raw @ mean[:-1]), raw, beta


def alphas_of(moments: Moments, count: int = 60, span: float = 1e-3) -> np.ndarray:
    top = np.abs(moments.standardized()[1]).max(initial=0)
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * span, count)


def select_alpha(folds: list[Moments], one_se: bool = True) -> float:
    """The alpha of least mean error over held-out folds, or the largest within one standard error of it."""
    total = reduce(lambda a, b: a + b, folds)
    alphas = alphas_of(total)
    errors = np.array([[held.squared_error(*lasso(total - held, alpha)[:2]) for alpha in alphas] for held in folds if held.n])
    mean = errors.mean(axis=0)
    best = int(mean.argmin())
    if not one_se or len(errors) < 2:
        return float(alphas[best])
    limit = mean[best] + errors[:, best].std(ddof=1) / np.sqrt(len(errors))
    return float(alphas[np.flatnonzero(mean <= limit)[0]])


def moments_by(frame: DataFrame, features: Sequence[str], target: str, by: Sequence[str], weight: Column | None = None) -> dict[tuple, Moments]:
    """Moments of each group; groups are folds, periods or resamples, so they are few."""
    k = len(features) + 2
    return {tuple(r[c] for c in by): Moments(as_matrix(r["gram"], k)) for r in grams(frame, features, target, by, weight).collect() if r["gram"][0] is not None}


def lasso_cv(frame: DataFrame, features: Sequence[str], target: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(feature, coefficient, selected) of an L1 regression whose penalty cross-validation picks by the one-error rule;
    coefficients are those of the standardised features."""
    rows = frame.withColumn("__fold", fold_of(F.col(key), folds, seed))
    parts = [m for _, m in sorted(moments_by(rows, features, target, ["__fold"]).items())]
    spark = frame.sparkSession
    schema = "feature string, coefficient double, selected boolean"
    if not parts:
        return spark.createDataFrame([], schema)
    _, _, beta = lasso(reduce(lambda a, b: a + b, parts), select_alpha(parts))
    return spark.createDataFrame([(f, float(b), bool(abs(b) > 1e-9)) for f, b in zip(features, beta, strict=True)], schema).orderBy(F.abs("coefficient").desc(), "feature")


#: The Poisson distribution of mean 1: chances of at most 0, 1, ... 5.
POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)


def poisson_weights(hashes: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): Poisson draws of mean 1, from 32 bits of each row's hash mixed with the draw's number (splitmix64)."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(u.shape)
    for cut in POISSON:
        out += u > np.uint32(int(cut * 2.0**32))
    return out


def stability_selection(frame: DataFrame, features: Sequence[str], target: str, key: str, n_boot: int = 200, folds: int = 5, seed: int = 42) -> DataFrame:
    """(feature, share): how many of the resamples select each feature. A row's weight in a resample is a Poisson draw from its key's
    hash and the resample's number. Each task adds its rows' products, weighted for all resamples at a time, as products of
    matrices: no row is repeated, and a task sends on a row for each resample and fold. The small problems are solved in the grouped step."""
    k, names = len(features) + 2, list(features)
    products = [f"g{i}" for i in range(k * (k + 1) // 2)]
    upper = np.triu_indices(k)

    def add(batches):
        import pandas as pd

        total = np.zeros((folds, n_boot, len(products)))
        for batch in batches:
            for start in range(0, len(batch), 2_000):
                part = batch.iloc[start : start + 2_000]
                x = np.column_stack([np.ones(len(part)), part[["x%d" % i for i in range(k - 1)]].to_numpy(dtype=float)])
                weights = poisson_weights(part["h"].to_numpy(dtype=np.int64), n_boot)
                own, fold = x[:, upper[0]] * x[:, upper[1]], part["fold"].to_numpy()
                for f in np.unique(fold):
                    total[f] += weights[fold == f].T @ own[fold == f]
        out = pd.DataFrame(total.reshape(folds * n_boot, -1), columns=products)
        out.insert(0, "fold", np.repeat(np.arange(folds), n_boot))
        out.insert(0, "rep", np.tile(np.arange(n_boot), folds))
        yield out

    some = frame.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*names, target))))
    rows = some.select(fold_of(F.col(key), folds, seed).cast("int").alias("fold"), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("h"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate((*names, target))))
    parts = rows.mapInPandas(add, ", ".join(["rep int", "fold int", *(f"{g} double" for g in products)]))
    sums = parts.groupBy(F.col("rep").alias("__rep"), F.col("fold").alias("__fold")).agg(F.array(*(F.sum(g) for g in products)).alias("gram"))

    def solve(part):
        import pandas as pd

        moments = [Moments(as_matrix(g, k)) for g in part.sort_values("__fold")["gram"]]
        moments = [m for m in moments if m.n > 0]
        if not moments:
            return pd.DataFrame({"feature": names, "chosen": 0.0})
        beta = lasso(reduce(lambda a, b: a + b, moments), select_alpha(moments))[2]
        return pd.DataFrame({"feature": names, "chosen": (np.abs(beta) > 1e-9).astype(float)})

    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for stays: small rows, long work
    return sums.repartition(parts, "__rep").groupBy("__rep").applyInPandas(solve, "feature string, chosen double").groupBy("feature").agg(F.avg("chosen").alias("share"))


def linear_score(features: Sequence[str], intercept: float, beta: Sequence[float]) -> Column:
    return reduce(lambda acc, fb: acc + F.col(fb[0]) * F.lit(float(fb[1])), zip(features, beta, strict=True), F.lit(float(intercept)))


def _sums_by_period(rows: DataFrame, names: list[str], holes: list[str], periods: dict[tuple, list]) -> dict[tuple, list[Moments]]:
    """For each cell and period, the moments of the fold's rows of all earlier periods, in (1, features with 0 for null, flags of
    what is null, target); rows are summed once, by cell, period and fold."""
    zeroed = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in names}
    flags = {f"__n_{c}": F.col(c).isNull().cast("double") for c in holes}
    moments = moments_by(rows.withColumns(flags).withColumns(zeroed), [*names, *flags], "__y", ["__b", "__p", "__fold"])
    folds = sorted({f for _, _, f in moments})
    out: dict[tuple, list[Moments]] = {}
    for cell, own in periods.items():
        running: dict[int, Moments] = {}
        for period in own:
            out[cell, period] = [running[f] for f in folds if f in running]
            for f in folds:
                if (m := moments.get((cell, period, f))) is not None:
                    running[f] = running[f] + m if f in running else m
    return out


def _imputed(moments: Moments, names: list[str], holes: list[str], medians: dict[str, float]) -> Moments:
    """Moments of the features with medians in place of nulls: each is its zeroed value and the median times its flag."""
    k, h = len(names), len(holes)
    turn = np.zeros((k + 2, 1 + k + h + 1))
    turn[: k + 1, : k + 1] = np.eye(k + 1)
    turn[-1, -1] = 1
    for j, c in enumerate(holes):
        turn[1 + names.index(c), 1 + k + j] = medians.get(c, 0.0)
    return Moments(turn @ moments.matrix @ turn.T)


def _earlier_medians(rows: DataFrame, holes: list[str], counts: dict[tuple, dict[str, int]], periods: dict[tuple, list], tests: list[tuple]) -> dict[tuple, dict[str, float]]:
    """For each cell and tested period, medians of all earlier periods' values, by ranks among the rows of earlier places."""
    spark = rows.sparkSession
    wanted, where = [], {}
    for cell, period in tests:
        place = periods[cell].index(period)
        for i, c in enumerate(holes):
            n = sum(counts[cell, p][c] for p in periods[cell][:place])
            if n:
                where[cell, period, c] = (i, place, (n - 1) // 2, n // 2)
                wanted += [(cell, i, place, k) for k in {(n - 1) // 2, n // 2}]
    if not wanted:
        return {}
    kind = rows.select("__b", "__p").schema
    group = F.struct(F.col("__b").alias("b"), F.col("c").alias("c")).alias("g")
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(holes)))).alias("x")
    places = spark.createDataFrame([(cell, p, i) for cell, own in periods.items() for i, p in enumerate(own)], T.StructType([*kind.fields, T.StructField("p", T.IntegerType())]))
    long = rows.join(places, ["__b", "__p"]).select("__b", "p", values).where("x.v IS NOT NULL").select("__b", "x.c", "p", "x.v").select(group, "p", "v", F.lit(1).cast("bigint").alias("w"))
    told = spark.createDataFrame(wanted, T.StructType([kind["__b"], *(T.StructField(n, t) for n, t in (("c", T.IntegerType()), ("t", T.IntegerType()), ("k", T.LongType())))]))
    found = quantiles.order_statistics(long, told.select(group, "t", "k")).select("g.*", "t", "k", "v").collect()
    at = {(tuple(r["b"]), r["c"], r["t"], r["k"]): r["v"] for r in found}
    medians: dict[tuple, dict[str, float]] = {}
    for (cell, period, c), (i, t, low, high) in where.items():
        medians.setdefault((cell, period), {})[c] = (at[cell, i, t, low] + at[cell, i, t, high]) / 2
    return medians


def walk_forward(frame: DataFrame, features: Sequence[str], target: str, period: str, key: str, top_k: int = 5, min_train: int = 2, folds: int = 5, all_scores: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Per cell (`by`) and period a model of the cell's earlier periods alone, and its top_k rows (all of them with all_scores):
    (by, period, key, rank, predicted, realized), realised over the period's median.

    Medians for missing values, scaling, and the penalty (the one of least error over folds of the training rows) know the earlier
    periods alone. Rows are summed once, by cell, period and fold, whatever the number of periods: sums of earlier periods are
    running sums, and since imputing is linear in the flags of what is missing, the medians go in afterwards. What reaches the driver
    is a row of counts, medians and sums of products for each cell, period and fold. Rows without a target or period, and with a null
    in `by`, take no part.
    """
    names, cells, types = list(features), list(by), dict(frame.dtypes)
    spark = frame.sparkSession
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (target, period, *cells)))
    cell = F.struct(*(F.col(c) for c in cells)) if cells else F.struct(F.lit(0).alias("all"))
    rows = quantiles.stored(frame.where(present).select(cell.alias("__b"), F.col(period).alias("__p"), F.col(key).alias("__k"), *(F.col(c).cast("double").alias(c) for c in names), F.col(target).cast("double").alias("__y")))
    seen = rows.groupBy("__b", "__p").agg(F.count("*").alias("__rows"), *(F.count(c).alias(c) for c in names)).collect()  # as few as cells have periods
    periods: dict[tuple, list] = {}
    for b, p in sorted((tuple(r["__b"]), r["__p"]) for r in seen):
        periods.setdefault(b, []).append(p)
    tests = [(b, p) for b, own in periods.items() for p in own[min_train:]]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cells), f"`{period}` {types[period]}, `{key}` {types[key]}, rank int, predicted double, realized double"])
    if not tests:
        return spark.createDataFrame([], schema)
    holes = [c for c in names if any(r[c] < r["__rows"] for r in seen)]
    medians = _earlier_medians(rows, holes, {(tuple(r["__b"]), r["__p"]): r.asDict() for r in seen}, periods, tests)
    sums = _sums_by_period(rows.withColumn("__fold", fold_of(F.col("__k"), folds)), names, holes, periods)
    fitted = []
    for b, p in tests:
        own = medians.get((b, p), {})
        parts = [_imputed(m, names, holes, own) for m in sums[b, p]]
        if parts:
            intercept, beta, _ = lasso(reduce(lambda x, y: x + y, parts), select_alpha(parts, one_se=False))
            fitted.append((b, p, float(intercept), [float(x) for x in beta], [float(own.get(c, 0.0)) for c in names]))
    kind = rows.select("__b", "__p").schema
    doubles = T.ArrayType(T.DoubleType())
    models_of = spark.createDataFrame(fitted, T.StructType([*kind.fields, T.StructField("__a", T.DoubleType()), T.StructField("__beta", doubles), T.StructField("__m", doubles)]))
    predicted = reduce(lambda acc, ic: acc + F.coalesce(F.col(ic[1]), F.col("__m")[ic[0]]) * F.col("__beta")[ic[0]], enumerate(names), F.col("__a"))
    scored = rows.join(models_of, ["__b", "__p"]).select("__b", "__p", "__k", "__y", predicted.alias("predicted"))
    # A median for each cell and period: sent to the rows, as a merge would gather a period in one task.
    scored = scored.join(F.broadcast(quantiles.median_of(rows, ["__b", "__p"], "__y", "__med")), ["__b", "__p"])
    order = [F.col("predicted").desc(), F.col("__k")]
    if all_scores:
        kept = windows.numbered_within(scored, ["__b", "__p"], order, "rank")
    else:
        kept = scored.withColumn("rank", F.row_number().over(Window.partitionBy("__b", "__p").orderBy(*order))).where(F.col("rank") <= top_k)
    return kept.select(*(F.col(f"__b.{c}").alias(c) for c in cells), F.col("__p").alias(period), F.col("__k").alias(key), "rank", "predicted", (F.col("__y") - F.col("__med")).alias("realized"))


def yearly_means(picks: DataFrame, period: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, period, mean_excess, n): mean realised return of each period's picks."""
    return picks.groupBy(*by, period).agg(F.avg("realized").alias("mean_excess"), F.count("*").alias("n"))


def gate_of_periods(picks: DataFrame, period: str, fee: float = 0.14, n_boot: int = 10_000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """A row for each cell (`by`; one without): mean of the periods' mean returns, its bounds over resampled periods, both less the
    fee, how many periods there are, and PASS if the lower bound stays above 0 after the fee."""
    yearly = picks.groupBy(*by, period).agg(F.avg("realized").alias("m"))
    found = resample.mean_interval(yearly, "m", [period], n_boot, seed, by).drop("p").withColumnRenamed("mean", "mean_excess")
    sizes = yearly.groupBy(*by).agg(F.count("*").alias("n_periods"))
    found = found.join(sizes, list(by)) if by else found.crossJoin(sizes)
    net = F.col("ci_low") - fee
    return found.withColumns({"net_mean": F.col("mean_excess") - fee, "net_ci_low": net, "verdict": F.when(net > 0, "PASS").otherwise("FAIL")})


def compare_feature_sets(frame: DataFrame, baseline: Sequence[str], extended: Sequence[str], target: str, period: str, key: str, top_k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Per cell and period: mean realised return of the top_k of either feature set, the rank correlation of all their predictions
    with what came (null where one doesn't vary), and what the larger set adds to both."""
    return _compared(_both_sets(frame, baseline, extended, target, period, key, by), period, top_k, by)


def _both_sets(frame: DataFrame, baseline: Sequence[str], extended: Sequence[str], target: str, period: str, key: str, by: Sequence[str]) -> dict[str, DataFrame]:
    return {name: quantiles.stored(walk_forward(frame, features, target, period, key, all_scores=True, by=by)) for name, features in (("baseline", baseline), ("extended", extended))}


def _compared(scores: dict[str, DataFrame], period: str, top_k: int, by: Sequence[str]) -> DataFrame:
    keys, parts = [*by, period], []
    for name, found in scores.items():
        top = found.where(F.col("rank") <= top_k).groupBy(*keys).agg(F.avg("realized").alias(f"{name}_top"))
        cell = F.struct(*keys).alias("__cell")
        ranks = spearman_by(found.select(cell, "predicted", "realized"), "__cell", "predicted", "realized").select("__cell.*", F.col("spearman").alias(f"{name}_spearman"))
        parts.append(top.join(ranks, keys, "left"))
    both = parts[0].join(parts[1], keys)
    return both.withColumns({f"delta_{what}": F.col(f"extended_{what}") - F.col(f"baseline_{what}") for what in ("top", "spearman")})


def feature_set_gates(frame: DataFrame, baseline: Sequence[str], extended: Sequence[str], target: str, period: str, key: str, top_k: int = 5, by: Sequence[str] = (), n_boot: int = 10_000) -> DataFrame:
    """A row for each cell: the gate of either feature set's picks (baseline_*, extended_*), what the larger set adds to the mean
    (delta_mean_excess), and the mean over periods of what it adds to the rank correlation, where both have one (delta_spearman)."""
    scores = _both_sets(frame, baseline, extended, target, period, key, by)
    keys = list(by)
    gates = []
    for name, found in scores.items():
        gate = gate_of_periods(found.where(F.col("rank") <= top_k), period, n_boot=n_boot, by=by)
        gates.append(gate.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in gate.columns if c not in keys)))
    delta = _compared(scores, period, top_k, by).groupBy(*keys).agg(F.avg("delta_spearman").alias("delta_spearman"))
    out = gates[0].join(gates[1], keys).join(delta, keys) if keys else gates[0].crossJoin(gates[1]).crossJoin(delta)
    return out.withColumn("delta_mean_excess", F.col("extended_mean_excess") - F.col("baseline_mean_excess"))


def _solved(gram: Sequence[float], k: int) -> tuple[float, int, np.ndarray, np.ndarray]:
    """(rows, rank, coefficients, inverse of x'x) of a fit of k terms; the inverse is the general one where terms are dependent."""
    m = as_matrix(gram, k + 1)
    size = np.sqrt(np.maximum(np.diag(m)[:k], 1e-300))  # unit columns, so that the rank doesn't depend on units
    values, vectors = np.linalg.eigh(m[:k, :k] / np.outer(size, size))
    fine = values > 1e-11 * max(values.max(initial=0), 1e-300)
    inverse = (vectors[:, fine] / values[fine]) @ vectors[:, fine].T / np.outer(size, size)
    return m[0, 0], int(fine.sum()), inverse @ m[:k, -1], inverse


def robust_fits(frame: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, df, beta, cov) of least squares of each group, cov the heteroscedasticity-robust (HC1) one as an array by rows, df the
    rows less the rank; null where a group has no more rows than that. Terms are 1 and the features.

    One pass sums x'x and x'y of all groups, each group is solved where its sums are, and a second pass sums the squared residuals
    times x x'. Rows with a null in a feature or the target take no part.
    """
    k, keys, types = len(features) + 1, list(by), dict(frame.dtypes)
    rows = frame.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*features, target))))
    rows = rows.select(F.struct(*(F.col(c) for c in keys), F.lit(0).alias("__all")).alias("__g"), *(F.col(c).cast("double").alias(c) for c in features), F.col(target).cast("double").alias("__y"))
    kind = f"struct<{', '.join([*(f'`{c}`: {types[c]}' for c in keys), '`__all`: int'])}>"

    def solve(parts):
        for part in parts:
            found = [_solved(g, k) for g in part["gram"]]
            part["__b"] = [beta.tolist() for _, _, beta, _ in found]
            yield part

    def spread(parts):
        for part in parts:
            out = []
            for gram, meat in zip(part["gram"], part["meat"], strict=True):
                n, rank, beta, inverse = _solved(gram, k)
                df = n - rank
                cov = inverse @ as_matrix(meat, k + 1)[:k, :k] @ inverse * (n / df) if df > 0 else None
                out.append((int(n), int(df), beta.tolist(), None if cov is None else cov.ravel().tolist()))
            part["n"], part["df"], part["beta"], part["cov"] = zip(*out, strict=True) if out else ([], [], [], [])
            yield part[["__g", "n", "df", "beta", "cov"]]

    sums = quantiles.stored(grams(rows, features, "__y", ["__g"]))
    fits = sums.mapInPandas(solve, f"__g {kind}, gram array<double>, __b array<double>")
    line = reduce(lambda acc, ic: acc + F.col(ic[1]) * F.col("__b")[ic[0]], enumerate(features, 1), F.col("__b")[0])
    errors = rows.join(fits.select("__g", "__b"), "__g").withColumn("__e2", F.pow(F.col("__y") - line, 2))
    meat = grams(errors, features, "__y", ["__g"], F.col("__e2")).withColumnRenamed("gram", "meat")
    done = sums.join(meat, "__g").select("__g", "gram", "meat").mapInPandas(spread, f"__g {kind}, n bigint, df bigint, beta array<double>, cov array<double>")
    return done.select(*(F.col(f"__g.{c}").alias(c) for c in keys), "n", "df", "beta", "cov")


def ols_hc1(frame: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), least: int = 0) -> DataFrame:
    """(by, term, coefficient, se, t, p_value, n) of least squares of each group with heteroscedasticity-robust errors; p_value is
    two-sided by the normal distribution. A group of fewer than `least` rows has null values, and so has one with no more rows than
    terms; one without rows has a null row for each term, too."""
    names, keys = ["intercept", *features], list(by)
    fits = robust_fits(frame, features, target, by)
    groups = frame.select(*keys).distinct() if keys else frame.sparkSession.range(1).select()
    if keys:
        match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys))
        fits = groups.join(fits.select(*(F.col(c).alias(f"__{c}") for c in keys), "n", "df", "beta", "cov"), match, "left")
    else:
        fits = groups.join(fits, F.lit(True), "left")  # one row
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    fine = (n >= least) & F.col("cov").isNotNull()
    terms = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col("beta")[i].alias("coefficient"), F.sqrt(F.greatest(F.col("cov")[i * len(names) + i], F.lit(0.0))).alias("se")) for i, t in enumerate(names)))).alias("x")
    rows = fits.select(*keys, n.alias("n"), fine.alias("fine"), terms)
    rows = rows.select(*keys, "x.term", *(F.when(F.col("fine"), F.col(f"x.{c}")).alias(c) for c in ("coefficient", "se")), "n")
    rows = rows.withColumn("t", F.col("coefficient") / F.nullif("se", F.lit(0.0)))
    return rows.select(*keys, "term", "coefficient", "se", "t", distributions.two_sided_normal(F.col("t")).alias("p_value"), "n")


def season_consistency(frame: DataFrame, stat: str, covariates: Sequence[str], target: str, season: str, least: int = 5) -> DataFrame:
    """(season, coefficient, se, p_value, n): the effect of `stat` on the target in each season, covariates held; a season of fewer than
    `least` whole rows has null values."""
    found = ols_hc1(frame, [stat, *covariates], target, [season], least)
    return found.where(F.col("term") == stat).select(season, "coefficient", "se", "p_value", "n")


def with_dummies(frame: DataFrame, column: str, categories: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(rows whose category is one of them, with a 0/1 column for each but the first; their names)."""
    names = {f"{column}={c}": c for c in categories[1:]}
    rows = frame.where(F.col(column).isin(*categories))
    return rows.withColumns({n: (F.col(column) == c).cast("double") for n, c in names.items()}), list(names)


def stage_effects(frame: DataFrame, target: str, stage: str = "career_stage", stages: Sequence[str] = ("rookie_year", "sophomore", "established"), covariates: Sequence[str] = ("age", "price_level", "market_ret_3m"), by: Sequence[str] = ()) -> DataFrame:
    """(by, term, coefficient, se, t, p_value, n): the stages' effects against the first of them, covariates held."""
    rows, dummies = with_dummies(frame, stage, stages)
    return ols_hc1(rows, [*dummies, *covariates], target, by)


def joint_wald(frame: DataFrame, features: Sequence[str], tested: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, f, df, df_residual, p_value): robust joint test that the coefficients of `tested` are nought, by the F distribution; one row
    without groups, null where it can't be made."""
    k, keys = len(features) + 1, list(by)
    at, types = [1 + list(features).index(c) for c in tested], dict(frame.dtypes)
    fits = robust_fits(frame, features, target, by)
    if not keys:
        fits = frame.sparkSession.range(1).select().join(fits, F.lit(True), "left")  # one row

    def test(parts):
        for part in parts:
            out = []
            for beta, cov in zip(part["beta"], part["cov"], strict=True):
                if beta is None or cov is None:
                    out.append((None, len(at)))
                    continue
                b, v = np.asarray(beta)[at], np.asarray(cov).reshape(k, k)[np.ix_(at, at)]
                rank = int(np.linalg.matrix_rank(v, hermitian=True))
                out.append((float(b @ np.linalg.pinv(v, hermitian=True) @ b) / rank if rank else None, rank))
            part["f"], part["rank"] = zip(*out, strict=True) if out else ([], [])
            yield part[[*keys, "f", "rank", "df"]]

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "f double, rank int, df bigint"])
    found = fits.select(*keys, "df", "beta", "cov").mapInPandas(test, schema)
    told = found.withColumn("p_value", distributions.f_upper(F.col("f"), F.col("rank"), F.col("df")))
    return told.select(*keys, "f", F.col("rank").alias("df"), F.col("df").alias("df_residual"), "p_value")


def interaction_test(frame: DataFrame, stat: str, group: str, levels: tuple[str, str], covariates: Sequence[str], target: str) -> DataFrame:
    """(f, df, df_residual, p_value): whether the slope of `stat` differs between two groups, covariates held; null if one has no rows."""
    rows, (other,) = with_dummies(frame, group, levels)
    rows = rows.withColumn("__slope", F.col(other) * F.col(stat))
    return joint_wald(rows, [stat, other, "__slope", *covariates], ["__slope"], target)


def random_intercepts(frame: DataFrame, features: Sequence[str], target: str, group: str, rounds: int = 5, points: int = 25) -> DataFrame:
    """One row (between, within, icc, n, n_groups, beta): a normal intercept for each group beside fixed effects, by restricted maximum
    likelihood. Features that don't vary are left out; beta holds the intercept and a coefficient for each feature, null for those.

    A group gives its size and sums alone: by Woodbury's identity its part of the likelihood at a ratio r of the variances is that of
    the plain sums less r / (1 + n r) of the products of its sums. The likelihood is profiled in r; each round sums, in one pass over
    the groups' sums and for a grid of ratios at once, what the likelihood needs, and the next grid lies around the best ratio.
    """
    spark, k = frame.sparkSession, len(features) + 2
    rows = frame.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*features, target, group))))
    columns = [*(F.col(c).cast("double") for c in features), F.col(target).cast("double")]
    names = [f"__s{i}" for i in range(len(columns))]
    sums = quantiles.stored(rows.groupBy(group).agg(F.count("*").cast("double").alias("__n"), *(F.sum(c).alias(n) for c, n in zip(columns, names, strict=True))))
    schema = "between double, within double, icc double, n bigint, n_groups bigint, beta array<double>"
    total = moments_by(rows, features, target, []).get(())
    if total is None or not total.n:
        return spark.createDataFrame([], schema)
    varies = [0, *(1 + i for i in range(len(features)) if total.standardized()[0][i, i] > 0), k - 1]
    whole, p = total.matrix[np.ix_(varies, varies)], len(varies) - 1
    if total.n <= p:
        return spark.createDataFrame([], schema)

    def needed(ratios: list[float]):
        """For each ratio, the groups' weighed products of sums, the sum of ln(1 + n r), and the number of groups."""

        def run(parts):
            import pandas as pd

            for part in parts:
                z = part[["__n", *names]].to_numpy(float)[:, varies]
                n = part["__n"].to_numpy(float)
                made = [[*((z * (r / (1 + n * r))[:, None]).T @ z).ravel(), np.log1p(n * r).sum(), len(n)] for r in ratios]
                yield pd.DataFrame({"i": range(len(ratios)), "part": [np.asarray(m).tolist() for m in made]})

        parts = sums.select("__n", *names).mapInPandas(run, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        out = np.zeros((len(ratios), (p + 1) ** 2 + 2))
        for r in parts.collect():  # a few numbers for each ratio
            out[r["i"], r["j"]] = r["v"]
        return out

    def likelihood(ratio: float, part: np.ndarray) -> tuple[float, float, np.ndarray, int]:
        m = whole - part[:-2].reshape(p + 1, p + 1)
        beta = np.linalg.lstsq(m[:p, :p], m[:p, -1], rcond=None)[0]
        rss = max(float(m[-1, -1] - beta @ m[:p, -1]), 1e-300)
        df = total.n - p
        return -0.5 * (df * np.log(rss) + part[-2] + np.linalg.slogdet(m[:p, :p])[1]), rss / df, beta, int(part[-1])

    low, high, best = np.log(1e-8), np.log(1e6), None
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        ratios = [0.0, *np.exp(grid).tolist()]
        found = [(*likelihood(r, part), r) for r, part in zip(ratios, needed(ratios), strict=True)]
        at = max(range(len(found)), key=lambda i: found[i][0])
        best = found[at]
        i = max(at - 1, 0)
        low, high = grid[max(i - 1, 0)], grid[min(i + 1, points - 1)]
    _, within, beta, n_groups, ratio = best
    full: list[float | None] = [None] * (k - 1)
    for at, b in zip(varies[:-1], beta, strict=True):
        full[at] = float(b)
    return spark.createDataFrame([(float(ratio * within), float(within), float(ratio / (1 + ratio)), int(total.n), n_groups, full)], schema)


def variance_components(frame: DataFrame, group: str, value: str) -> DataFrame:
    """(between, within, icc): random intercepts by the moments of a one-way layout, not by likelihood."""
    groups = frame.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    sums = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm")
    )
    within = F.col("ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    ssb = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    size = (F.col("n") - F.col("nn") / F.col("n")) / F.nullif(F.col("k") - 1, F.lit(0))
    between = F.greatest((ssb / F.nullif(F.col("k") - 1, F.lit(0)) - within) / size, F.lit(0.0))
    return sums.select(between.alias("between"), within.alias("within")).withColumn("icc", F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0)))


def out_of_fold_means(frame: DataFrame, group: str, value: str) -> DataFrame:
    """frame (with `fold`) and `oof_mean`: the group's mean over the other folds, the other folds' overall mean if it has none."""
    totals = frame.groupBy(group).agg(F.sum(value).alias("__gs"), F.count(value).alias("__gn"))
    parts = frame.groupBy(group, "fold").agg(F.sum(value).alias("__ps"), F.count(value).alias("__pn"))
    folds = frame.groupBy("fold").agg(F.sum(value).alias("__fs"), F.count(value).alias("__fn"))
    overall = frame.agg(F.sum(value).alias("__as"), F.count(value).alias("__an"))
    joined = frame.join(totals, group).join(parts, [group, "fold"]).join(folds, "fold").crossJoin(F.broadcast(overall))
    own = (F.col("__gs") - F.coalesce("__ps", F.lit(0))) / F.nullif(F.col("__gn") - F.col("__pn"), F.lit(0))
    rest = (F.col("__as") - F.col("__fs")) / F.nullif(F.col("__an") - F.col("__fn"), F.lit(0))
    return joined.withColumn("oof_mean", F.coalesce(own, rest)).select(*frame.columns, "oof_mean")


def gaussian_lpd(frame: DataFrame, value: str, predicted: str) -> DataFrame:
    """(lpd, rmse): mean log density of the values under a normal around the predictions, whose deviation is that of the residuals
    around their own mean."""
    error = F.col(value) - F.col(predicted)
    sums = frame.agg(F.var_pop(error).alias("__v"), F.avg(error * error).alias("__e"))
    return sums.select((-0.5 * F.log(2 * np.pi * F.col("__v")) - F.col("__e") / (2 * F.col("__v"))).alias("lpd"), F.sqrt("__e").alias("rmse"))


def out_of_fold_lasso(frame: DataFrame, features: Sequence[str], target: str, key: str, fold: str = "fold", inner: int = 5) -> DataFrame:
    """frame with `predicted`: each row's prediction by a model of the other folds' rows, whose medians stand in for what is missing,
    and whose means and deviations scale; the penalty is the one of least error over `inner` folds of these rows.

    Rows are summed once, by fold and inner fold, and the other folds' sums are sums of these. Every row gets a prediction; those
    without a target teach nothing.
    """
    names, spark = list(features), frame.sparkSession
    rows = quantiles.stored(frame.where(F.col(target).isNotNull() & F.col(fold).isNotNull()).select(F.col(fold).alias("__p"), F.col(key).alias("__k"), *(F.col(c).cast("double").alias(c) for c in names), F.col(target).cast("double").alias("__y")))
    seen = {r["__p"]: r for r in rows.groupBy("__p").agg(F.count("*").alias("__rows"), *(F.count(c).alias(c) for c in names)).collect()}
    holes = [c for c in names if any(r[c] < r["__rows"] for r in seen.values())]
    medians: dict = {f: {} for f in seen}
    if holes and len(seen) > 1:
        others = F.explode(F.filter(F.array(*map(F.lit, sorted(seen))), lambda f: f != F.col("__p"))).alias("__f")  # a few copies
        for r in quantiles.quantiles(quantiles.stored(rows.select(others, *holes)), ["__f"], holes).collect():
            medians[r["__f"]] = {c: r[c][0] for c in holes if r[c]}
    zeroed = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in names}
    flags = {f"__n_{c}": F.col(c).isNull().cast("double") for c in holes}
    parted = rows.withColumn("__fold", fold_of(F.col("__k"), inner, seed=43))
    sums = moments_by(parted.withColumns(flags).withColumns(zeroed), [*names, *flags], "__y", ["__p", "__fold"])
    fitted = []
    for f in sorted(seen):
        by_inner: dict[int, Moments] = {}
        for (g, j), m in sums.items():
            if g != f:
                by_inner[j] = by_inner[j] + m if j in by_inner else m
        if by_inner:
            parts = [_imputed(m, names, holes, medians[f]) for _, m in sorted(by_inner.items())]
            intercept, beta, _ = lasso(reduce(lambda x, y: x + y, parts), select_alpha(parts, one_se=False))
            fitted.append((f, float(intercept), [float(b) for b in beta], [float(medians[f].get(c, 0.0)) for c in names]))
    models_of = spark.createDataFrame(fitted, f"__f {dict(frame.dtypes)[fold]}, __a double, __beta array<double>, __m array<double>")
    line = reduce(lambda acc, ic: acc + F.coalesce(F.col(ic[1]).cast("double"), F.col("__m")[ic[0]]) * F.col("__beta")[ic[0]], enumerate(names), F.col("__a"))
    return frame.join(models_of, F.col(fold) == F.col("__f"), "left").select(*frame.columns, line.alias("predicted"))


def shrunken_slopes(frame: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, slope, shrunken): group slopes drawn to the precision-weighted mean by the estimated spread between groups."""
    own = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")
    )
    error = (F.col("syy") - F.col("sxy") * F.col("slope")) / F.nullif(F.col("n") - 2, F.lit(0))
    rows = own.where("n > 2 AND sxx > 0").withColumn("se2", F.greatest(error, F.lit(1e-12)) / F.col("sxx"))
    w = 1 / F.col("se2")
    sums = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col("slope")).alias("ws"), F.sum(w * w).alias("ww"), F.sum(w * F.col("slope") * F.col("slope")).alias("wss"), F.count("*").alias("k"))
    mean = F.col("ws") / F.col("w")
    tau2 = F.greatest((F.col("wss") - mean * F.col("ws") - (F.col("k") - 1)) / F.nullif(F.col("w") - F.col("ww") / F.col("w"), F.lit(0.0)), F.lit(0.0))
    pooled = sums.select(mean.alias("__mean"), F.coalesce(tau2, F.lit(0.0)).alias("__tau2"))
    return rows.crossJoin(F.broadcast(pooled)).select(group, "slope", ((F.col("slope") / F.col("se2") * F.col("__tau2") + F.col("__mean")) / (F.col("__tau2") / F.col("se2") + 1)).alias("shrunken"))


def spearman_by(frame: DataFrame, period: str, a: str, b: str) -> DataFrame:
    """Rank correlation per period, ties at their average; null where one side doesn't vary."""
    rows = windows.average_ranks(windows.average_ranks(frame.where(F.col(a).isNotNull() & F.col(b).isNotNull()), period, a, "__ra"), period, b, "__rb")
    return rows.groupBy(period).agg((F.covar_pop("__ra", "__rb") / F.nullif(F.stddev_pop("__ra") * F.stddev_pop("__rb"), F.lit(0.0))).alias("spearman"), F.count("*").alias("n"))


def _bins(rows: DataFrame, features: Sequence[str], most: int) -> dict[str, list[float]]:
    """The lower bounds of each feature's bins but the first: a bin for each value where there are at most `most`, else quantiles."""
    at = [i / most for i in range(1, most)]
    found = rows.agg(*(F.struct(F.approx_count_distinct(c).alias("n"), F.min(c).alias("low"), F.percentile_approx(c, F.array(*map(F.lit, at))).alias("cuts")).alias(c) for c in features)).first()
    if found[0]["n"] == 0:
        return {c: [] for c in features}
    few = [c for c in features if found[c]["n"] <= 2 * most]  # the number is not exact, but a set of so many values is small
    sets = rows.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in few)).first() if few else {}
    cuts = {c: sets[c][1:] if c in few and len(sets[c]) <= most else [v for v in sorted(set(found[c]["cuts"])) if v > found[c]["low"]] for c in features}
    return {c: v or [found[c]["low"]] for c, v in cuts.items()}


def binned_cells(rows: DataFrame, features: Sequence[str], target: str, by: Sequence[str], most: int = 32) -> DataFrame:
    """(by, a bin's number for each feature, n, mean, ss): rows of the same bins as one, with their number and the target's mean and sum
    of squares about it. Trees of at most `most` bins a feature see no more of a row than this."""
    from pyspark.ml.feature import Bucketizer

    doubles = rows.select(*by, *(F.col(c).cast("double").alias(c) for c in (*features, target)))
    cuts = _bins(doubles, features, most)
    names = [f"__b{i}" for i in range(len(features))]
    splits = [[-float("inf"), *(cuts[c] or [0.0]), float("inf")] for c in features]
    binned = Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=names).transform(doubles)
    binned = binned.withColumns({b: F.col(b).cast("int") for b in names})  # without the mark of a category: a tree's splits keep the order
    cells = binned.groupBy(*by, *names).agg(F.count("*").cast("double").alias("n"), F.avg(target).alias("mean"), (F.var_pop(target) * F.count("*")).alias("ss"))
    return cells.select(*by, *(F.col(b).alias(c) for b, c in zip(names, features, strict=True)), "n", "mean", "ss")


def boosted_importance(frame: DataFrame, features: Sequence[str], target: str, key: str, folds: int = 3, iterations: int = 10, depth: int = 3) -> DataFrame:
    """(feature, importance, oof_r2) of gradient-boosted trees; the R2 is that of predictions out of fold.

    Trees see rows by bins alone, and their means and gains of squares need a cell's number and mean: the passes of all fits read cells,
    not rows. What squares lie within a cell is added to the R2's sums."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = frame.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*features, target)))).withColumn("fold", fold_of(F.col(key), folds))
    cells = quantiles.stored(binned_cells(rows.select("fold", *features, F.col(target).alias("__y")), features, "__y", ["fold"]))
    ready = VectorAssembler(inputCols=list(features), outputCol="__x").transform(cells)
    learner = GBTRegressor(featuresCol="__x", labelCol="mean", weightCol="n", maxIter=iterations, maxDepth=depth, stepSize=0.2, seed=7)
    scored = [learner.fit(ready.where(F.col("fold") != k)).transform(ready.where(F.col("fold") == k)) for k in range(folds)]
    out = reduce(lambda a, b: a.unionByName(b), scored)
    middle = cells.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).first()[0]
    about = lambda c: F.sum(F.col("ss") + F.col("n") * F.pow(F.col("mean") - c, 2))
    r2 = out.agg((1 - about(F.col("prediction")) / F.nullif(about(F.lit(middle)), F.lit(0.0))).alias("r2")).first()["r2"]
    weights = learner.fit(ready).featureImportances.toArray()
    return frame.sparkSession.createDataFrame([(f, float(w), None if r2 is None else float(r2)) for f, w in zip(features, weights, strict=True)], "feature string, importance double, oof_r2 double")
