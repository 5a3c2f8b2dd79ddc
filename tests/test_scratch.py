"""What stored frames leave on disk, and league means that no longer send a row for each later month."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, quantiles


def test_shuffles_behind_a_stored_frame_go(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: files.getAllFiles().size()
    was, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None), held()
    frame = quantiles.stored(spark.range(0, 50_000, 1, 4).groupBy((F.col("id") % 7000).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before
    assert frame.agg(F.sum("n")).first()[0] == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == was


def test_league_means_of_players_who_miss_months(spark):
    """Months that a player misses take the sums so far; a month without a rate, and rows of no role, don't count."""
    rng, rows = random.Random(5), []
    names = ["hits", "at_bats", "walks", "hit_by_pitch", "sac_flies", "total_bases", "plate_appearances", "earned_runs", "outs", "batters_faced"]
    for player in range(12):
        role = ("hitting", "pitching", "other")[player % 3 if player < 9 else player % 2]
        for month in rng.sample(range(1, 13), rng.randint(1, 6)):
            counts = [0] * 10 if rng.random() < 0.2 else [rng.randint(1, 9) for _ in names]
            rows.append((player, 2020, role, dt.datetime(2020, month, rng.randint(1, 28)), *counts))
    frame = spark.createDataFrame(rows, "entity_id int, season bigint, role string, date timestamp_ntz, " + ", ".join(f"{c} bigint" for c in names))
    got = {(r["role"], r["month"].month): r["league_mean"] for r in aggregates.league_means_to_date(frame).collect()}
    want = {}
    for role in ("hitting", "pitching"):
        for to in range(2, 13):
            sums = {}
            for r in rows:
                if r[2] == role and r[3].month < to:
                    own = sums.setdefault(r[0], dict.fromkeys(names, 0))
                    for c, v in zip(names, r[4:], strict=True):
                        own[c] += v
            lines = []
            for s in sums.values():
                if role == "pitching":
                    lines += [(s["earned_runs"] * 27 / s["outs"], s["batters_faced"])] if s["batters_faced"] else []
                elif s["plate_appearances"]:
                    free = s["hits"] + s["walks"] + s["hit_by_pitch"]
                    lines.append((free / (s["at_bats"] + s["walks"] + s["hit_by_pitch"] + s["sac_flies"]) + s["total_bases"] / s["at_bats"], s["plate_appearances"]))
            if lines:
                want[role, to] = sum(r * w for r, w in lines) / sum(w for _, w in lines)
    assert got == pytest.approx(want)
