"""SparkSession factory and the shared-folder helpers that operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlstone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; on a local master, where none is set, a temporary one."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, parts: int = 16) -> DataFrame:
    """`df` dealt to `parts` times as many tasks as its scan has: a file's split of short rows is too long a task for work on each row."""
    return df.repartition(parts * df.rdd.getNumPartitions())


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint for the small frames of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
