"""Running sums over a hot key without one task for the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    n = least
    while n * per_bucket < rows:
        n *= 2
    return n


def running(df: DataFrame, key: str, amount: str, order: list[str], buckets: int, out: str) -> DataFrame:
    """`out`: the sum of `amount` over the rows of `key` before this one, in an order by hash, then by `order`.

    Each key is split into buckets by the hash of its order columns: sums within a bucket, plus the total of the
    key's buckets before it. Rows equal in all of `order` are interchangeable. A null key is a key.
    """
    split = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    within = Window.partitionBy(key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = split.groupBy(F.col(key).alias("__k"), F.col("__b").alias("__c")).agg(F.sum(amount).alias("__n"))
    base = base.withColumnRenamed("__k", key).withColumnRenamed("__c", "__b").select(F.col(key).alias("__k"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = split.withColumn("__in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = inner.join(base, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__c")))
    return joined.withColumn(out, F.col("__base") + F.col("__in")).select(*df.columns, out)
