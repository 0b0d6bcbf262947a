"""Approximate aggregates as mergeable states: distinct items and quantiles kept per key and merged later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registers as a power of two: a standard error of 1.3 % for distinct items. Size of quantile sketches: a rank error of 1.3 % with 99 % confidence.
LG, SIZE = 12, 200


def states(df: DataFrame, keys: list[str | Column], item: str, value: str) -> DataFrame:
    """Per key: rows, a sketch of distinct items and one of the values; each is built from partial sketches of tasks. Nulls count in neither."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, F.lit(LG)).alias("items"), F.call_function("kll_sketch_agg_double", F.col(value).cast("double"), F.lit(SIZE)).alias("values"))


def merged(kept: DataFrame, keys: list[str | Column]) -> DataFrame:
    """States of several keys, days or batches as one; any order and grouping keeps the error bounds."""
    return kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.call_function("kll_merge_agg_double", F.col("values")).alias("values"))


def distinct(items: Column) -> Column:
    return F.hll_sketch_estimate(items)


def quantile(values: Column, rank: float) -> Column:
    """Null where no value was seen."""
    n = F.call_function("kll_sketch_get_n_double", values)
    return F.when(n > 0, F.call_function("kll_sketch_get_quantile_double", values, F.lit(rank).cast("double")))


def register(spark: SparkSession) -> None:
    """`distinct_of(state)`, `median_of(state)`, `low_of(state)` and `high_of(state)` (.025 and .975) for SQL texts over kept states."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION distinct_of(items BINARY) RETURNS BIGINT RETURN hll_sketch_estimate(items)")
    for name, rank in (("median_of", 0.5), ("low_of", 0.025), ("high_of", 0.975)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(state BINARY) RETURNS DOUBLE RETURN CASE WHEN kll_sketch_get_n_double(state) > 0 THEN kll_sketch_get_quantile_double(state, {rank}D) END")
