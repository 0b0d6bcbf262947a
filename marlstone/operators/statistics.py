"""Bootstrap ranking stability: draws, interval quantiles, rank flips, Kendall's tau."""

from __future__ import annotations

import ast

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numpy_draws(spark: SparkSession, tasks: int, sizes: list[int], iterations: int, seed: int) -> DataFrame:
    """(sample_size, iteration, draw, position): one generator runs through all sizes in order, with replacement.

    The driver only advances the generator from resample to resample and keeps its state; executors draw again from there.
    """
    rng, states = np.random.default_rng(seed), []
    for size in sizes:
        for i in range(iterations):
            states.append((size, i, str(rng.bit_generator.state)))
            rng.integers(0, tasks, size=size)

    def draw(batches):
        import pyarrow as pa

        own = np.random.default_rng()
        for b in batches:
            for size, i, state in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own.bit_generator.state = ast.literal_eval(state)
                at = own.integers(0, tasks, size=size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(at)], ["sample_size", "iteration", "draw", "position"])

    given = spark.createDataFrame(states, "sample_size int, iteration int, state string")
    return given.mapInArrow(draw, "sample_size int, iteration int, draw int, position int")


def hashed_draws(spark: SparkSession, tasks: int, sizes: tuple[int, ...], iterations: int) -> DataFrame:
    """(sample_size, iteration, position, n): resamples with replacement by a hash, that any engine can repeat; n draws of a position."""
    rows = spark.range(iterations).select(F.col("id").alias("iteration"), F.explode(F.array(*[F.lit(z).cast("long") for z in sizes])).alias("sample_size"))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sample_size") - 1)))
    mark = F.md5(F.concat_ws("/", "sample_size", "iteration", "draw").cast("binary"))
    position = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % tasks
    return rows.groupBy("sample_size", "iteration", position.alias("position")).agg(F.count("*").alias("n"))


def subsample(spark: SparkSession, items: list, size: int, seed: int) -> list:
    """`size` of the items without replacement, in their own order."""
    at = np.random.default_rng(seed).choice(len(items), size=size, replace=False)
    return [items[i] for i in sorted(at.tolist())]


def bootstrap_means(draws: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score of each model over each resample, repeats counted; draws have sample_size, iteration, position, n; scores position, model, score."""
    total = F.sum(F.col("n") * F.col("score").cast("decimal(18,6)")).cast("double")
    return draws.join(scores, "position").groupBy("sample_size", "iteration", "model").agg((total / F.col("sample_size")).alias("mean"))


#: Cut, not rounded, at four places: sums of few places often lie on the edge of rounding.
def cut(c: Column) -> Column:
    return F.floor(c * 10000 + 0.001) / 10000


def intervals(means: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Mean, 95 and 90 per cent intervals by exact percentiles with linear interpolation."""
    q = F.percentile(value, F.array(*map(F.lit, (0.025, 0.975, 0.05, 0.95))))
    out = means.groupBy(*keys).agg(F.avg(F.col(value).cast("decimal(20,8)")).cast("double").alias("center"), q.alias("__q"))
    names = ("ci_low", "ci_high", "low_90", "high_90")
    return out.select(*keys, cut(F.col("center")).alias("center"), *[cut(F.col("__q")[i]).alias(n) for i, n in enumerate(names)])


def adjacent_differences(means: DataFrame, board: DataFrame) -> DataFrame:
    """Per sample size and pair of models next to each other on the board (rank, model, mean): the difference's interval, significance, flips."""
    upper = board.select(F.col("rank").alias("k"), F.col("model").alias("upper_model"), F.col("mean").alias("m"))
    lower = board.select((F.col("rank") - 1).alias("k"), F.col("model").alias("lower_model"), F.col("mean").alias("l"))
    pairs = upper.join(lower, "k").select("upper_model", "lower_model", F.round(F.col("m") - F.col("l"), 6).alias("full_gap"))
    at = ["sample_size", "iteration"]
    a = means.select(*at, F.col("model").alias("upper_model"), F.col("mean").alias("x")).join(pairs, "upper_model")
    both = a.join(means.select(*at, F.col("model").alias("lower_model"), F.col("mean").alias("y")), [*at, "lower_model"]).withColumn("d", F.col("x") - F.col("y"))
    out = both.groupBy("sample_size", "upper_model", "lower_model", "full_gap").agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.round(F.avg((F.round("d", 6) < 0).cast("double")), 6).alias("rank_flip_probability"))
    low, high = cut(F.col("q")[0]), cut(F.col("q")[1])
    return out.select("sample_size", "upper_model", "lower_model", "full_gap", low.alias("difference_ci_low"), high.alias("difference_ci_high"), ((low > 0) | (high < 0)).alias("significant_95pct"), "rank_flip_probability")


def ranked(means: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("mean"), "model")
    return means.withColumn("rank", F.row_number().over(w).cast("long"))


def kendall_tau(df: DataFrame, by: list[str], item: str, a: str, b: str) -> DataFrame:
    """(concordant - discordant) / max(1, both) over pairs of items within each of `by`."""
    left = df.select(*by, F.col(item).alias("i"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    right = df.select(*by, F.col(item).alias("j"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    sign = F.signum((F.col("a1") - F.col("a2")).cast("double")) * F.signum((F.col("b1") - F.col("b2")).cast("double"))
    pairs = left.join(right, by).filter("i < j").withColumn("s", sign)
    out = pairs.groupBy(*by).agg(F.count_if(F.col("s") > 0).alias("concordant"), F.count_if(F.col("s") < 0).alias("discordant"))
    return out.withColumn("tau", F.round((F.col("concordant") - F.col("discordant")) / F.greatest(F.lit(1), F.col("concordant") + F.col("discordant")), 6))
