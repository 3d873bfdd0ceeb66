"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracehound")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on: UTC timestamps and adaptive execution."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate data on storage that driver and executors share.

    It lies below ``spark.checkpoint.dir``. Without that setting a local session uses its warehouse folder, and any other
    is told to set it: a folder of one machine is not there for the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tracehound"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table on shared storage: a lost executor re-reads it, and later reads prune columns."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def intermediate_mark() -> int:
    """How many intermediate paths there are so far, for ``clear_intermediate``."""
    return len(_written)


def clear_intermediate(spark: SparkSession, since: int = 0) -> int:
    """Delete what this driver wrote through ``shared_path`` (after a mark), once nothing reads it any more; gives the number of paths."""
    jvm, n = spark.sparkContext._jvm, 0
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def keep_last(spark: SparkSession, since: int) -> None:
    """Delete what was written after a mark but for the last path, the result that all else led to."""
    last = _written.pop()
    clear_intermediate(spark, since)
    _written.append(last)
