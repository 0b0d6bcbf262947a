"""Ordered computations: usage ledgers, error attribution, last values of typed events, prefix offsets, places in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written


def ledger(df: DataFrame, thread: str, order: str, counter: str, cumulative: str) -> DataFrame:
    """`increment`: a cumulative report less the thread's previous cumulative report; other reports as they are.

    `missing`: a resumed cumulative report without predecessor. `decreased`: a counter that fell; strict callers raise on it.
    """
    w = Window.partitionBy(thread).orderBy(order)
    before = F.last(F.when(F.col(cumulative), F.col(counter)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    out = df.withColumn("previous", before).withColumn("__first", first)
    gain = F.when(F.col(cumulative) & F.col("previous").isNotNull(), F.col(counter) - F.col("previous")).when(F.col(cumulative) & ~F.col("__first"), F.lit(None)).otherwise(F.col(counter))
    return out.withColumns({"increment": gain, "missing": F.col(cumulative) & F.col("previous").isNull() & ~F.col("__first"), "decreased": F.coalesce(gain < 0, F.lit(False))}).drop("__first")


def attributed(df: DataFrame, log: str, order: str, kind: str, error: str, ends: dict[str, str]) -> DataFrame:
    """Each `error` event takes the verdict of the next event that ends a turn (`ends`: kind to verdict); at the log's end it is an error."""
    verdict = F.create_map(*[x for k, v in ends.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy(log).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = df.withColumn("__v", F.first(verdict[F.col(kind)], ignorenulls=True).over(w))
    return out.filter(F.col(kind) == error).withColumn("verdict", F.coalesce("__v", F.lit("error"))).drop("__v")


def last_values(df: DataFrame, keys: list[str], order: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """Per key: the last non-null value of each kind of event, by partial aggregation."""
    hit = lambda k: (F.col(kind) == k) & F.col(value).isNotNull()
    return df.groupBy(*keys).agg(*[F.max_by(F.when(hit(k), F.col(value)), F.when(hit(k), F.col(order))).alias(f"last_{k}") for k in kinds])


def prefix_offsets(df: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """`sequence` from 0 and `offset`, the lengths before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"sequence": (F.row_number().over(w) - 1).cast("long"), "offset": F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})


def placed(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "place") -> DataFrame:
    """`out`: a row's place from 1 within its keys, without a task for a key: rows are cut into ranges of (keys, order).

    A range numbers its own rows; what a key's earlier ranges hold is added. Only keys that begin in an earlier range
    have such a sum, at most one key for each range, so these sums are broadcast. Null keys are a key; ties take any order.
    """
    ranges = written(df.repartitionByRange(*keys, *order).withColumn("__r", F.spark_partition_id()))
    w = Window.partitionBy(*keys, "__r").orderBy(*order)
    sums = ranges.groupBy(*keys, "__r").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.withColumn("__before", before).filter("__before > 0").select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__r").alias("__q"), "__before")
    same = F.col("__r") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    numbered = ranges.withColumn("__place", F.row_number().over(w)).join(F.broadcast(carried), same, "left")
    return numbered.withColumn(out, (F.col("__place") + F.coalesce("__before", F.lit(0))).cast("long")).select(*df.columns, out)
