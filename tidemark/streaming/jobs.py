"""Streaming forms of the batch operators: windowed bars, daily odds, spike alerts with state, de-duplicated snapshots."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds.
_DAY = 86_400_000_000
#: A row that waits.
_WAITING = np.dtype([("at", "i8"), ("event_id", "i8"), ("price", "f8")])


def _packed(at: pd.Series, number: pd.Series, price: pd.Series) -> np.ndarray:
    out = np.empty(len(at), _WAITING)
    out["at"], out["event_id"], out["price"] = at, number, price
    return out


def weekly_bars(sales: DataFrame, ts: str = "sale_date", late: str = "14 days") -> DataFrame:
    """Median price and sales of each item and week (Mondays), once no row of it can still come. The epoch is a Thursday."""
    windowed = sales.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    grade = F.coalesce("grade", F.lit("ungraded")).alias("grade")
    out = windowed.groupBy("card_slug", grade, F.window("__ts", "7 days", "7 days", "4 days")).agg(F.percentile("price", F.lit(0.5)).alias("median_price"), F.count("*").alias("n_sales"))
    return out.select("card_slug", "grade", F.col("window.start").cast("timestamp_ntz").alias("week"), "median_price", "n_sales")


def daily_odds(odds: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The last price of each event, market and day."""
    windowed = odds.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = windowed.groupBy("event", "market_id", F.window("__ts", "1 day")).agg(F.max_by("raw_price", F.struct("__ts", "event_id")).alias("raw_price"))
    return out.select("event", "market_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "raw_price")


def distinct_snapshots(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    return rows.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark(keys)


class SpikeAlerts(StatefulProcessor):
    """A market's alerts in the order of time, whatever the order in which its rows come.

    State: rows that wait (a list, an element for each batch that brought some), and in one value the last price and its time, the last
    steps, and the alerts that may still matter: each call to the store is a round trip to the JVM, so a market takes few. Rows wait until the watermark has passed them, as an event-time timer tells; then they are taken in order. A market that stays silent
    for `silent_days` loses its state by a timer, too.
    """

    def __init__(self, least: float, rows: int, times: float, least_rows: int, days: int, silent_days: int):
        self.least, self.rows, self.times, self.least_rows = least, rows, times, least_rows
        self.near, self.silent = days * _DAY, silent_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        parts = []
        for new in rows:
            new = new[new["raw_price"].notna()]
            parts.append(_packed(new["at"].astype("int64"), new["event_id"].astype("int64"), new["raw_price"]))
        held = np.concatenate(parts)
        if len(held):
            self.waiting.appendValue((held.tobytes(),))
            self._wake(int(held["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        parts = [np.frombuffer(r[0], _WAITING) for r in self.waiting.get()]
        held = np.sort(np.concatenate(parts), order=["at", "event_id", "price"]) if parts else np.empty(0, _WAITING)
        n = int(np.searchsorted(held["at"], now, side="right"))
        if n:
            out, last = self._taken(held[:n].tolist())
            if n < len(held):
                self.waiting.put([(held[n:].tobytes(),)])
                self._wake(int(held["at"][n]))
            else:
                self.waiting.clear()
            self._wake(last + self.silent)
        elif not len(held):
            kept = self.kept.get()
            if kept is not None and pickle.loads(kept[0])[0] + self.silent <= now:
                self.kept.clear()
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["market_id", "at", "delta"]).astype({"market_id": "int64", "at": "int64", "delta": "float64"})

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def _taken(self, due: list[tuple]) -> tuple[list[tuple[int, float]], int]:
        """The alerts of rows in order, and the last row's time; the state follows."""
        kept = self.kept.get()
        before, last, steps, alerts = (None, None, [], []) if kept is None else pickle.loads(kept[0])
        out = []
        for at, _, price in due:
            if before is not None and at - before > self.silent:  # a timer may come late, so it only frees the state
                last, steps, alerts = None, [], []
            if last is not None:
                delta = price - last
                steps = [*steps, delta][-self.rows :]
                alerts = [a for a in alerts if at - a[0] <= self.near]
                if abs(delta) >= self.least and not any((a[1] > 0) == (delta > 0) for a in alerts):
                    sd = float(np.std(steps, ddof=1)) if len(steps) >= self.least_rows else 0.0
                    if abs(delta) >= self.times * sd:
                        alerts.append((at, delta))
                        out.append((at, delta))
            before, last = at, price
        self.kept.update((pickle.dumps((before, last, steps, alerts)),))
        return out, before

    def close(self) -> None:
        pass


def spike_alerts(odds: DataFrame, least: float = 0.10, rows: int = 30, times: float = 3.0, least_rows: int = 5, days: int = 7, late: str = "1 day", silent_days: int = 30) -> DataFrame:
    """(market_id, ts, delta): large steps of a market. A stream can't wait for the largest of a week, so the first one is kept
    and later ones of its sign within `days` are not. Rows may come out of order by `late`, and a row is judged when no earlier one can
    come any more; a market that is silent for `silent_days` starts anew. Its state needs the RocksDB store."""
    spark = odds.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = odds.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.select("market_id", "event_id", "ts", F.unix_micros("ts").alias("at"), F.col("raw_price").cast("double").alias("raw_price")).groupBy("market_id")
    made = grouped.transformWithStateInPandas(SpikeAlerts(least, rows, times, least_rows, days, silent_days), "market_id bigint, at bigint, delta double", "Append", "eventTime")
    return made.select("market_id", F.timestamp_micros("at").alias("ts"), "delta")


def run_available(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to `out` and read again; a later run goes on from its checkpoint."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/_checkpoint")
    query = writer.format("parquet").option("path", f"{out}/rows").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def run_batches(stream: DataFrame, change: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """run_available() with a batch transformation of what each micro-batch emits. A batch has a folder of its own, which a repeat
    of it replaces, so each counts once."""

    def put(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/_checkpoint").start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/rows").drop("batch")
