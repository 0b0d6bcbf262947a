"""Tables in hash buckets with numbered versions: a change writes the buckets that it touches, then a version file that names all.

`root/data/<name>/__bucket=<k>` has rows, `root/versions/<n>` a line `<k> <name>` for each bucket and the number of the batch
that made it. A version appears by one rename, last of all, so a crash at any step leaves the version before it whole; two
writers of one number don't both succeed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.select import last_wins
from marlstone.sources.files import exists

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    if not exists(spark, f"{root}/versions"):
        return []
    fs, at = _fs(spark, f"{root}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())


def _version(spark: SparkSession, root: str, n: int) -> tuple[dict[int, str], int]:
    """(bucket to folder, batch): bounded by the number of buckets."""
    lines = [r.value for r in spark.read.text(f"{root}/versions/{n}").collect()]
    held = [x.split(" ") for x in lines if not x.startswith("batch")]
    return {int(k): name for k, name in held}, int(next(x for x in lines if x.startswith("batch")).split(" ")[1])


def _publish(spark: SparkSession, root: str, n: int, held: dict[int, str], batch: int) -> None:
    fs, new = _fs(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray("\n".join([f"batch {batch}", *[f"{k} {name}" for k, name in sorted(held.items())]]).encode()))
    out.close()
    at = _fs(spark, f"{root}/versions/{n}")[1]
    if fs.exists(at) or not fs.rename(new, at):
        fs.delete(new, False)
        raise OSError(f"version {n} of {root} is there already")


def _write(df: DataFrame, root: str, keys: list[str], buckets: int) -> str:
    name = uuid.uuid4().hex
    split = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    split.write.partitionBy("__bucket").parquet(f"{root}/data/{name}")
    return name


def _written(spark: SparkSession, root: str, name: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/data/{name}")
    return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]


def read(spark: SparkSession, root: str, schema, version: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The rows of a version, by default the last; no rows where there is none. `only`: these buckets."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], schema)
    held, _ = _version(spark, root, known[-1] if version is None else version)
    paths = [f"{root}/data/{name}/__bucket={k}" for k, name in held.items() if only is None or k in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace(df: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS, batch: int = -1) -> int:
    """`df` as the next version; its number."""
    spark = df.sparkSession
    known = versions(spark, root)
    name = _write(df, root, keys, buckets)
    n = known[-1] + 1 if known else 1
    _publish(spark, root, n, dict.fromkeys(_written(spark, root, name), name), batch)
    return n


def upsert(df: DataFrame, root: str, keys: list[str], sequence: str, batch: int = -1, buckets: int = BUCKETS) -> int:
    """Rows of `df` into the table: for each key the row of the greatest `sequence` stays. The number of the version that holds them.

    Only buckets that hold keys of `df` are read and written. A batch of a number that is in already (0 or more) changes
    nothing, so a stream's repeated batch is harmless; so is one of equal rows.
    """
    spark = df.sparkSession
    known = versions(spark, root)
    held, last = _version(spark, root, known[-1]) if known else ({}, -1)
    if 0 <= batch <= last:
        return known[-1]
    touched = {r[0] for r in df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).distinct().collect()}
    old = read(spark, root, df.schema, only=touched)
    name = _write(last_wins(old.unionByName(df), keys, sequence).select(*df.columns), root, keys, buckets)
    n = known[-1] + 1 if known else 1
    _publish(spark, root, n, {**held, **dict.fromkeys(_written(spark, root, name), name)}, max(batch, last))
    return n


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Versions before the last `keep` go, then folders that no version names, those of failed writes too; no writer may be at work."""
    known = versions(spark, root)
    for n in known[: max(0, len(known) - keep)]:
        fs, at = _fs(spark, f"{root}/versions/{n}")
        fs.delete(at, False)
    named = {name for n in known[-keep:] for name in _version(spark, root, n)[0].values()}
    fs, at = _fs(spark, f"{root}/data")
    gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in named]
    for path in gone:
        fs.delete(path, True)
    return sorted(p.getName() for p in gone)
