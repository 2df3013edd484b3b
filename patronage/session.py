"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "patronage", **conf: str) -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
    folder = tempfile.mkdtemp(prefix="patronage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_stored_paths: list[str] = []


def new_table_path(spark: SparkSession) -> str:
    """Where the next stored table goes; :func:`release_tables` removes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/patronage-{uuid.uuid4().hex}"
    _stored_paths.append(path)
    return path


def release_tables(spark: SparkSession) -> int:
    """Remove all tables that this process has stored; DataFrames that read them can no longer be used."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _stored_paths:
        path = jvm.org.apache.hadoop.fs.Path(_stored_paths.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed


def materialize(df: DataFrame) -> DataFrame:
    """Store ``df`` once as Parquet in the shared folder and return a scan of it.

    Iterative steps read the stored table, so a lost executor costs a re-read instead of a
    recomputation from the raw transactions, and later plans know the real size of the data.
    """
    if _stored(df):
        return df
    spark = df.sparkSession
    path = new_table_path(spark)
    df.write.parquet(path)
    return as_stored(spark.read.schema(df.schema).parquet(path))


def as_stored(df: DataFrame) -> DataFrame:
    """Mark a scan of a stored table, or a cheap projection of one: storing it again gains nothing."""
    df.__dict__["_stored"] = True
    return df


def _stored(df: DataFrame) -> bool:
    return df.__dict__.get("_stored", False)


def small_lookup(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``max_rows`` rows, else ``df`` unchanged.

    The size is measured, not assumed; beyond the bound the planner picks the join itself.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
