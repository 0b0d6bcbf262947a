"""Cross-table checks: key sets, full matrices, partitions, unknown ids; each returns the rows that break the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from marlstone.session import cut


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, with the side that has them."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").filter("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("only_in"))


def complete(df: DataFrame, item: str, by: str) -> DataFrame:
    """Items that occur with every value of `by`."""
    n = df.select(F.count_distinct(by).alias("__n"))
    return df.groupBy(item).agg(F.count_distinct(by).alias("__k")).crossJoin(F.broadcast(n)).filter("__k = __n").select(item)


def missing_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """Cells of the full matrix of rows and columns that don't occur; both axes are distinct values."""
    cells = df.select(row).distinct().crossJoin(F.broadcast(df.select(column).distinct()))
    return cells.join(df.select(row, column).distinct(), [row, column], "left_anti")


def private_fields(df: DataFrame, words: tuple[str, ...]) -> list[str]:
    """Dotted paths of fields at any depth whose name holds one of the caller's `words`; the schema alone is read, so keys of maps are `private_keys`'."""
    out: list[str] = []

    def walk(kind: DataType, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                at = f"{path}.{f.name}" if path else f.name
                if any(w in f.name.casefold() for w in words):
                    out.append(at)
                walk(f.dataType, at)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, MapType):
            walk(kind.valueType, path)

    walk(df.schema, "")
    return out


def private_keys(df: DataFrame, column: str, words: tuple[str, ...]) -> DataFrame:
    """(path, n): keys of a VARIANT column's objects, at any depth and in arrays, that hold one of `words`, and in how many rows.

    A level is a job: values are opened by `variant_explode` until none is an object or an array.
    """
    spark, out = df.sparkSession, None
    level = df.select(F.monotonically_increasing_id().alias("row"), F.lit("$").alias("path"), F.col(column).alias("v"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("key"), F.lit(w))
    while True:
        inner = spark.sql("SELECT row, path, e.key AS key, e.value AS v FROM {level}, LATERAL variant_explode(v) e WHERE schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)'", level=level)
        inner = cut(inner.withColumn("path", F.concat("path", F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), "key")))))
        found = inner.filter(F.col("key").isNotNull() & hit).select("row", "path").distinct()
        out = found if out is None else out.unionByName(found)
        level = inner.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select("row", "path", "v")
        if not level.take(1):
            return out.distinct().groupBy("path").agg(F.count("*").alias("n"))
