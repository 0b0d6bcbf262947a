"""Joins by time: the last row at or before a time, and points in intervals. No key and no time range meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import written

#: Distinct times of a key in a bucket of its own, on average; points of a bin before it is split, and least share of all.
BUCKET, HOT, SHARE = 4096, 10_000, 1000


def buckets(times: DataFrame, at: str, rows: int) -> Column:
    """The number of the bucket of a time, among about equal ones; later times never have smaller numbers."""
    parts = min(max(1, rows // BUCKET), 10_000)
    if parts == 1:
        return F.lit(0)
    cuts = times.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    cuts = times.sparkSession.range(1).select(F.array_sort(F.array_distinct(F.array(*map(F.lit, cuts))))).first()[0]
    return _rank(F.col(at), cuts)


def _rank(at: Column, cuts: list) -> Column:
    """How many of the sorted `cuts` are below `at`, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(at > F.lit(cuts[mid]), F.lit(mid + 1) + _rank(at, cuts[mid + 1 :])).otherwise(_rank(at, cuts[:mid]))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], tie: str | None = None, forward: bool = False) -> DataFrame:
    """`left` with `values` of the last row of `right` with its keys at or before its time, or, `forward`, of the first at or after.

    Of right rows with equal keys and times the one with the greatest `tie` counts. Rows of `left` without one, or with a
    null key or time, get nulls; repeated rows stay. Only distinct (keys, time) meet in windows, and these are cut into
    time buckets: each bucket passes its last value on to the next ones, so that a key's rows never meet in one task.
    """
    whole = [c for c in left.columns if c in values]
    if whole:
        raise ValueError(f"columns on both sides: {whole}")
    named = [*keys, at]
    known = F.lit(True)
    for c in named:
        known = known & F.col(c).isNotNull()
    row = F.struct(*[F.col(v).alias(v) for v in values])
    pick = F.max_by(row, F.col(tie)) if tie else F.max(row)
    given = right.filter(known).groupBy(*named).agg(pick.alias("__v"))
    asked = left.filter(known).select(*named).distinct().withColumn("__v", F.lit(None).cast(given.schema["__v"].dataType))
    # written, as the cuts, the ends and the windows each read the points, and `left` and `right` may be costly
    points = written(asked.unionByName(given).groupBy(*named).agg(F.max("__v").alias("__v")))
    points = written(points.withColumn("__b", buckets(points, at, points.count())))
    # within a bucket: the window's own last value; before it: the last of the key's buckets that has one
    ends = points.filter("__v IS NOT NULL").groupBy(*keys, "__b").agg((F.min_by if forward else F.max_by)("__v", at).alias("__end"))
    every = points.select(*keys, "__b").distinct().join(ends, [*keys, "__b"], "left")
    order = F.desc("__b") if forward else F.asc("__b")
    carry = every.withColumn("__carry", F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy(*keys, "__b").orderBy(F.desc(at) if forward else F.asc(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.withColumn("__in", F.last("__v", ignorenulls=True).over(inner)).join(carry.select(*keys, "__b", "__carry"), [*keys, "__b"])
    found = found.select(*named, F.coalesce("__in", "__carry").alias("__v")).filter("__v IS NOT NULL")
    return left.join(found, named, "left").select(*[left[c] if c not in named else F.col(c) for c in left.columns], *[F.col(f"__v.{v}").alias(v) for v in values])


def in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval with start <= at <= end; the columns are whole numbers and differ between the sides.

    An interval's level is the width of bins, a power of two, of which it meets two at most; points go to their bin of
    each level that intervals have. Bins with many points are split by the points' hashes, which a
    lost task's second run gives again, and their intervals copied to each part. Nulls and
    intervals that end before they start meet nothing.
    """
    spans = intervals.filter(F.col(start) <= F.col(end)).withColumn("__level", F.ceil(F.log2(F.col(end) - F.col(start) + 1)).cast("int"))
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())  # 64 at most
    if not levels:
        levels = [0]
    spans = spans.withColumn("__bin", F.explode(F.expr(f"array_distinct(array(shiftright({start}, __level), shiftright({end}, __level)))")))
    dealt = points.filter(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__bin", F.expr(f"shiftright({at}, __level)"))
    counts = dealt.groupBy("__level", "__bin").agg(F.count("*").alias("n"))
    total = points.count()
    # bins over a SHARE-th of all points: at most SHARE for each level, so they are broadcast
    limit = max(HOT, total // SHARE)
    hot = counts.filter(F.col("n") > limit).select("__level", "__bin", F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    spread = dealt.join(F.broadcast(hot), ["__level", "__bin"], "left").withColumn("__part", F.pmod(F.xxhash64(*points.columns), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copied = spans.join(F.broadcast(hot), ["__level", "__bin"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    met = spread.join(copied, ["__level", "__bin", "__part"]).filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    return met.select(*points.columns, *intervals.columns)
