"""Session settings the operators are tuned for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive execution carries the size decisions: it broadcasts a join side only
# after measuring it, splits skewed join partitions and merges small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


#: How many tasks a single-machine session deals a table's rows over; unset elsewhere.
SPREAD = "tessitura.spread"


def local_session(cpus: int | str = 8, memory: str = "12g", name: str = "tessitura") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config(SPREAD, str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A fresh folder below the one the cluster names in spark.checkpoint.dir.

    Only a single-machine session that names none, as in tests, gets a private one, removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix=f"tessitura-{prefix}-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def dimension(df: DataFrame) -> DataFrame:
    """A table of one row per configured thing, such as a source or a language, read once into the plan.

    The planner then knows its size and broadcasts it, or not, by its own threshold.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with further columns that are evaluated once per row, however often later steps read them.

    Plain columns are expressions that the planner may copy into every filter, function and argument that reads them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def reliable_checkpoint(df, eager: bool = True):
    """Cut the lineage of `df` through the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=eager)


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once below the shared folder, as a table of compressed columns.

    For large tables that several later steps read: a checkpoint keeps whole rows, uncompressed, and reads all columns.
    """
    folder = shared_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
