"""Scores against n-gram counts in Python, of more distinct n-grams than would fit a fixed table apart."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def _ratios(rows):
    """A function of a word, from (text, toxic)."""
    top, lower = (Counter(), Counter()), {}
    for text, toxic in rows:
        for w in text.split():
            line = "\0\0\0\0\0 " + w + " "
            top[toxic].update(line[i - 5 : i + 1] for i in range(6, len(line)))
    longer = {*top[0], *top[1]}
    for order in (5, 4, 3, 2):
        lower[order] = Counter(g[1:] for g in longer)
        longer = set(lower[order])

    def histories(counts):
        total, kinds = defaultdict(float), defaultdict(int)
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return counts, total, kinds

    tables = [histories(lower[2]), histories(lower[3]), histories(lower[4]), histories(lower[5])]
    tops = [histories(c) for c in top]

    def step(table, g, p):
        counts, total, kinds = table
        n = total.get(g[:-1], 0)
        return (max(counts.get(g, 0) - 0.75, 0) + 0.75 * kinds[g[:-1]] * p) / n if n else p

    def ratio(w):
        line, logs = "\0\0\0\0\0 " + w + " ", []
        for i in range(6, len(line)):
            g, p = line[i - 5 : i + 1], 1 / 256
            for order in (2, 3, 4, 5):
                p = step(tables[order - 2], g[-order:], p)
            logs.append(math.log(step(tops[1], g, p)) - math.log(step(tops[0], g, p)))
        return sum(logs) / len(logs)

    return ratio


@pytest.mark.parametrize("most", [10**9, 0])
def test_scores_come_from_exact_counts(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "MOST_SENT_GRAMS", most, raising=False)
    rng = random.Random(12)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)), int(i % 4 == 0)) for i in range(400)]
    rows = [(i, t + " " + t[:19] if i % 3 else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1]), (9000, None)], "doc_id bigint, text string")
    model = toxicity.fit(docs.where("doc_id < 9000").dropDuplicates(["doc_id"]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"), F.col("id") % 5)
    ratio, checked = _ratios([(t, y) for _, t, y in rows]), rows[:60]
    got = toxicity.predict(docs, model, keep=["doc_id"]).collect()
    assert len(got) == 402
    by = {r["doc_id"]: r["score"] for r in got}
    for i, t, _ in checked:
        r = np.array([ratio(w) for w in t.split()])
        size = np.array([len(w) + 1 for w in t.split()])
        f = (r * size).sum() / size.sum(), r.max(), np.sort(r)[-3:].mean()
        z = np.array([1, 10 * f[0], f[1], f[2], max(f[1], 0) ** 2]) @ model.weights
        assert math.isclose(by[i], 1 / (1 + math.exp(-max(min(z, 30), -30))), rel_tol=1e-6)
