"""Seeded resampling that any engine can repeat: draw `slot` of replicate `rep` is the first 32 bits of an md5."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch


def draw(seed: int, rep: Column, slot: Column, n: Column) -> Column:
    """A place from 0 to n - 1, with replacement."""
    text = F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def draw_sql(seed: int, rep: str, slot: str, n: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({rep} AS VARCHAR) || ':' || CAST({slot} AS VARCHAR)), 1, 8) AS BIGINT) % ({n}))"


def draws_sql(seed: int, n_reps: int, pool: str, slots: str = "z") -> str:
    """(rep, i): as many draws from the pool as it has rows, or as `slots` gives."""
    return f"SELECT rep, {draw_sql(seed, 'rep', 'slot', 'z')} AS i FROM range({n_reps}) r(rep), (SELECT z, unnest(range({slots})) AS slot FROM (SELECT count(*) AS z FROM {pool}))"


def numbered(pool: DataFrame, order: list[str]) -> DataFrame:
    """pool with its place `__i` in the order, and its size `__n`; draws name rows by these places. Ranges of the order are
    written and counted, so no task sorts the whole pool, and a range that is read again is the same."""
    spark = pool.sparkSession
    path = scratch(spark, "numbered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pool.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__n"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__own", own).join(F.broadcast(sizes), "__p").withColumn("__i", F.col("__own") + F.col("__before")).drop("__own", "__before", "__p")


def replicates(pool: DataFrame, n_reps: int, seed: int, order: list[str]) -> DataFrame:
    """(rep, row of pool), a row for each draw, for replicates of as many draws as the pool has rows."""
    times = drawn(pool, n_reps, seed, order)
    return times.withColumn("__t", F.explode(F.sequence(F.lit(1), "times"))).drop("__t", "times")


def places(pool: DataFrame, n_reps: int, seed: int) -> DataFrame:
    """(rep, __i): the places in a numbered pool that each replicate draws, a row for each draw.

    Each slot of a replicate is a row of its own, made where the pool's rows are: slots are as many as rows, so every numbered row
    brings the slot of its number.
    """
    slots = pool.select(F.col("__i").alias("__slot"), "__n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))))
    return slots.select("rep", draw(seed, F.col("rep"), F.col("__slot"), F.col("__n")).alias("__i"))


def drawn(pool: DataFrame, n_reps: int, seed: int, order: list[str]) -> DataFrame:
    """(rep, row of pool, times): how often each replicate draws the row, if it does. Draws meet the pool by number, in a merge: the
    pool's size has no bound, and its file's size doesn't say what it takes on the driver."""
    pool = numbered(pool, order)
    draws = places(pool, n_reps, seed).groupBy("rep", "__i").agg(F.count("*").alias("times"))
    return draws.join(pool.drop("__n").hint("merge"), "__i").drop("__i")


def mean_interval(pool: DataFrame, value: str, order: list[str], n_reps: int = 10_000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean, ci_low, ci_high, p): mean, bounds of the bootstrapped mean, and the share of it at or below 0.

    The pool holds a value for each period, so a group's values are a short array in order; each replicate is a row that draws its
    own places from the array, and no draw is a row.
    """
    spark, keys = pool.sparkSession, list(by)
    of_pool = pool.groupBy(*keys).agg(F.avg(value).alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))), lambda r: r["__v"]).alias("__values"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reps = spark.range(0, n_reps, 1, parts).withColumnRenamed("id", "rep").crossJoin(of_pool.where(F.size("__values") > 0).select(*keys, "__values"))  # a row for each cell
    n = F.size("__values").cast("bigint")
    drawn_values = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda slot: F.get("__values", draw(seed, F.col("rep"), slot, n).cast("int")))
    some = F.array_compact(drawn_values)
    boot = reps.select(*keys, some.alias("__s")).withColumn("m", F.aggregate("__s", F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size("__s"), F.lit(0)))
    bounds = boot.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"), F.avg((F.col("m") <= 0).cast("int")).alias("p"))
    means = of_pool.drop("__values")
    return means.join(bounds, keys, "left") if keys else means.crossJoin(bounds)


def spread_summary(spreads: DataFrame, period: str, n_reps: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: mean of the yearly means and its bounds over resampled years, months, and the share of months above 0."""
    rows = spreads.where(F.col("spread").isNotNull())
    yearly = rows.groupBy(F.year(period).alias("year")).agg(F.avg("spread").alias("m"))
    months = rows.agg(F.count("*").alias("n_months"), F.avg((F.col("spread") > 0).cast("double")).alias("share_positive"))
    return mean_interval(yearly, "m", ["year"], n_reps, seed).drop("p").withColumnRenamed("mean", "mean_spread").crossJoin(months)


#: Rows of a pool that meet their draws at a time: a place within them takes two bytes.
BLOCK = 65_536
#: Slots that are drawn at a time, and the bytes of places that one group meets at most (but for a single row of draws).
SLOTS, GROUP_BYTES = 1 << 20, 32 << 20
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]


def _heads(prefix: bytes, slots: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of prefix + slot in decimals, for slots of equally many digits: the rounds over whole arrays."""
    digits = len(str(int(slots[0])))
    length = len(prefix) + digits
    if length > 55:
        raise ValueError("draws are named by at most 55 characters")
    text = np.zeros((len(slots), length // 4 * 4 + 4), np.uint8)
    text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    rest = slots.astype(np.uint32)
    for k in range(length - 1, len(prefix) - 1, -1):
        tens = rest // 10
        text[:, k] = rest - tens * 10 + 48
        rest = tens
    text[:, length] = 0x80
    words = dict(enumerate(np.ascontiguousarray(text.view("<u4").T)))
    first = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(len(slots), x, np.uint32) for x in first)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            g = 7 * i % 16
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        if g in words:
            np.add(t, words[g], out=t)
        np.add(t, np.uint32((_SINES[i] + (8 * length if g == 14 else 0)) & 0xFFFFFFFF), out=t)
        np.left_shift(t, np.uint32(_SHIFTS[i]), out=u), np.right_shift(t, np.uint32(32 - _SHIFTS[i]), out=t), np.bitwise_or(t, u, out=t)
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + np.uint32(first[0])).byteswap()


def draws(seed: int, rep: int, start: int, end: int, n: int, batch: int = 32_768) -> np.ndarray:
    """What draw() gives for the slots from start to end - 1 of a replicate."""
    prefix, out, at = f"{seed}:{rep}:".encode(), np.empty(end - start, np.int64), start
    while at < end:
        to = min(end, at + batch, 10 ** len(str(at)))  # slots of one number of digits
        out[at - start : to - start] = _heads(prefix, np.arange(at, to))
        at = to
    return out % n


def block_weights(spark: SparkSession, n: int, n_reps: int, seed: int, part: int) -> DataFrame:
    """(block, part, rep, times): how often each replicate, of as many draws as a pool has rows (n), draws the places of a block of the
    pool, a byte a place; the rows of a replicate and block add up. part is the replicate's number over the given one.

    A task draws a replicate's slots a chunk at a time, so it holds a chunk, and the counts of the pool's places in it.
    """
    parts, chunks = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLOTS)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for work in batch["id"].tolist():
                rep, chunk = divmod(work, chunks)
                times = np.bincount(draws(seed, rep, chunk * SLOTS, min(n, (chunk + 1) * SLOTS), n), minlength=n)
                while times.any():
                    own = np.minimum(times, 255).astype(np.uint8)
                    times -= own
                    yield pd.DataFrame({"block": range(-(-n // BLOCK)), "part": rep // part, "rep": rep, "times": [own[at : at + BLOCK].tobytes() for at in range(0, n, BLOCK)]})

    # A work item is a replicate and a chunk of its slots.
    work = spark.range(0, n_reps * chunks, 1, max(parts, min(n_reps * chunks, n_reps * n // 50_000_000)))
    return work.mapInPandas(counted, "block bigint, part bigint, rep bigint, times binary")


def significance(observed: DataFrame, value: str, pool: DataFrame, pool_value: str, order: list[str], n_perm: int = 5000, seed: int = 42) -> DataFrame:
    """(observed, n_events, p_value): two-sided share of permutations, means of as many draws from the pool as there are observed
    rows, that lie as far out as the observed mean.

    A permutation's draws from a block of the pool are one row of two bytes a draw, which meets the block's values by its number. A
    block comes once for each share of the permutations, so what meets it stays small however many draws there are for each row.
    """
    spark = pool.sparkSession
    mean, n_events = observed.agg(F.avg(value), F.count("*")).first()
    of_pool = numbered(pool.where(F.col(pool_value).isNotNull()).select(*order, pool_value), order)
    n = of_pool.agg(F.max("__n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, chunks = max(-(-n // BLOCK), 1), -(-n_events // SLOTS)
    shares = max(-(-2 * n_perm * n_events // (blocks * GROUP_BYTES)), -(-4 * parts // blocks))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for work in batch["id"].tolist():
                rep, chunk = divmod(work, chunks)
                found = np.sort(draws(seed, rep, chunk * SLOTS, min(n_events, (chunk + 1) * SLOTS), n))
                held, starts = np.unique(found // BLOCK, return_index=True)
                own = [x.tobytes() for x in np.split((found % BLOCK).astype("<u2"), starts[1:])]
                yield pd.DataFrame({"block": held, "share": work % shares, "rep": rep, "places": own})

    def sums(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        block = np.asarray(values["values"].iloc[0] if len(values) else [], np.float64)
        drawn = [block[np.frombuffer(p, "<u2")] for p in rows["places"]]
        return pd.DataFrame({"rep": rows["rep"], "s": [float(d.sum()) for d in drawn], "n": [len(d) for d in drawn]})

    # A work item is a replicate and a chunk of its slots.
    work = spark.range(0, n_perm * chunks if n else 0, 1, max(parts, min(n_perm * chunks, n_perm * n_events // 50_000_000)))
    rows = work.mapInPandas(placed, "block bigint, share bigint, rep bigint, places binary")
    item = F.struct((F.col("__i") % BLOCK).alias("i"), F.col(pool_value).cast("double").alias("v"))
    packed = of_pool.groupBy(F.floor(F.col("__i") / BLOCK).cast("bigint").alias("block")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("values"))
    copies = packed.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))))
    met = rows.groupBy("block", "share").cogroup(copies.groupBy("block", "share")).applyInPandas(sums, "rep bigint, s double, n bigint")
    means = met.groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("__m"))
    share = F.avg((F.abs("__m") >= F.abs(F.lit(mean))).cast("double"))
    return means.agg(F.lit(mean).cast("double").alias("observed"), F.lit(n_events).cast("bigint").alias("n_events"), share.alias("p_value"), F.count("*").alias("__reps")).where("__reps > 0").drop("__reps")
