"""Sources and sinks: tables, dated snapshots that are only ever added to, and merges that a repeat doesn't change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed columns, empty cells as null; nothing is inferred, so the file is read once."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", emptyValue="", mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, `<dataset>/<key>/<day>.json` below path: (dataset, key, day, payload)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parts = F.split("file", "/")
    return files.select(F.get(parts, F.size(parts) - 3).alias("dataset"), F.get(parts, F.size(parts) - 2).alias("key"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("day"), F.from_json("value", schema).alias("payload"))


def latest(snapshots: DataFrame, keys: list[str], day: str, payload: str) -> DataFrame:
    """The newest payload of each key; partial sums keep one row a key before the shuffle."""
    return snapshots.groupBy(*keys).agg(F.max_by(payload, day).alias(payload), F.max(day).alias(day))


def new_snapshots(incoming: DataFrame, stored: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Incoming rows whose key, day and content aren't stored: what an append-only store takes, however often it is sent."""
    marked = incoming.withColumn("__h", F.sha2(F.col(payload).cast("binary"), 256)).dropDuplicates([*keys, "__h"])
    held = stored.select(*keys, F.sha2(F.col(payload).cast("binary"), 256).alias("__h"))
    return marked.join(held, [*keys, "__h"], "left_anti").drop("__h")


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done, keys, "left_anti")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All part files below a folder, with the columns of all of them."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)


def replace_source(old: DataFrame, new: DataFrame, source: Column, value: str) -> DataFrame:
    """Rows of one source are replaced, those of the others stay (a null source too)."""
    return old.where(~source.eqNullSafe(value)).unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New rows replace old ones of their keys, but a new row without any value never replaces one that is there."""
    some = F.coalesce(*values).isNotNull()
    good = new.where(some)
    empty = new.where(~some).join(old, keys, "left_anti").join(good, keys, "left_anti")
    taken = good.unionByName(empty)
    return old.join(taken, keys, "left_anti").unionByName(taken)


def chunks(ranges: DataFrame, start: str, end: str, days: int = 14) -> DataFrame:
    """Half-open windows of `days` that cover [start, end); the last may be shorter."""
    step = F.make_dt_interval(F.lit(days))
    starts = F.sequence(F.col(start), F.col(end) - F.expr("INTERVAL 1 SECOND"), step)
    return ranges.where(F.col(start) < F.col(end)).withColumn("chunk_start", F.explode(starts)).withColumn("chunk_end", F.least(F.col("chunk_start") + step, F.col(end)))


def stacked(frame: DataFrame, cells: list[dict]) -> DataFrame:
    """frame once for each cell of a short list, tagged with the cell's values."""
    tags = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in cell.items())) for cell in cells))
    return frame.withColumn("__cell", F.explode(tags)).select("*", *(F.col(f"__cell.{k}").alias(k) for k in cells[0])).drop("__cell")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
