"""What a session needs before the jobs of this package run in it."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once in a context, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    import tempfile

    folder = Path(tempfile.mkdtemp(prefix="ship-"))  # the driver's own copy; Spark serves it to the executors
    (folder / "tidemark_package.zip").write_bytes(held.getvalue())
    context.addPyFile(str(folder / "tidemark_package.zip"))
    context._tidemark_shipped = True
    return spark


#: With this setting Spark removes the shuffle files of a query when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written to a folder and read from it; the shuffle files behind them are let go, as nothing reads them again."""
    spark = rows.sparkSession
    was = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        rows.select("*").write.parquet(path)  # a frame made under the setting
    finally:
        if was is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, was)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that the session names (spark.checkpoint.dir). Where it names none, a local
    session gets a folder of its machine; on a cluster that would lose data, so there it is an error.

    All of an application's folders lie in one, which goes when the application ends: results are read from them until then.
    """
    import uuid

    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    import tempfile

    context = spark.sparkContext
    if (root := getattr(context, "_tidemark_scratch", None)) is not None:
        return root
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        shared = tempfile.mkdtemp(prefix="scratch-")
    root = f"{shared.rstrip('/')}/scratch-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    context._tidemark_scratch = root
    return root
