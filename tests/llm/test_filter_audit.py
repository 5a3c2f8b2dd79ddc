"""The filter audit against each order applied one filter after another, and its merge against sets."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tidemark.llm import filter_audit, queries

SCHEMA = "doc_id bigint, text string, source string, part string, A string, good string"
LABELS = "doc_id bigint, quality int, toxic int, row string"


def brute(docs, labels):
    least, marks = {}, {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        old = marks.get(i, (False, False))
        marks[i] = (old[0] or q == 1, old[1] or x == 1)
    rows = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        rows.append((source or "", {f for f, x in fails.items() if x}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    shares = Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for k, f in enumerate(order):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                alone = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, order, k + 1] = [len(left), len(here), sum(f in r[1] for r in gone), alone, sum(r[2] for r in here), sum(r[3] for r in here)]
                gone += here
                shares[part, f] += len(here)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_orders_against_one_filter_after_another(spark):
    rng = random.Random(2)
    words = ["tide", "Mark", "x", "y\x0bz", "50%", "é", "#"]
    pool = [" ".join(rng.choices(words[: rng.randint(3, 7)], k=rng.randint(0, 90))) for _ in range(60)] + [" ".join(f"w{i}" for i in range(70)), "", None, "A\tB  C\n", "word " * 20_000]
    docs = [(i, rng.choice(pool), rng.choice(["s", "t", None])) for i in range(400)]
    docs += [(7, pool[0], "s"), (7, pool[0], "s"), (None, pool[1], "t"), (None, None, None)] + [(5, "same", "hot")] * 50
    labels = [(rng.randint(0, 400), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, "p", "a", "g") for d in docs], SCHEMA).repartition(5)
    assert found(filter_audit.filter_audit(df, spark.createDataFrame([(*x, "r") for x in labels], LABELS))) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, "p", "a", "g")], SCHEMA), labels)
    assert one.count() == 600 and {r["part"] for r in one.collect()} == {""}


@pytest.mark.parametrize("seed", range(5))
def test_merge_against_sets(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(500), rng.choice([0, 1, 30, 400]))) for _ in range(6)] + [list(range(100, 300))]
    want = Counter(mask for p in range(500) if (mask := sum(1 << i for i, x in enumerate(lists) if p in x)))
    assert filter_audit.merged(lists) == want


def test_gallop():
    places = list(range(0, 1000, 3))
    assert all(filter_audit.gallop(places, a, t) == next((i for i in range(a, len(places)) if places[i] >= t), len(places)) for a in (0, 5, 333) for t in (0, 15, 16, 500, 2000))


def test_query_against_sql(spark):
    table = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{table}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op13_filter_audit"]).df()
    got = queries.op13_filter_audit(spark, table).toPandas()
    key = ["part", "filter_order", "step"]
    assert got.sort_values(key, ignore_index=True)[sorted(got)].equals(want.astype(got.dtypes.to_dict()).sort_values(key, ignore_index=True)[sorted(got)])
