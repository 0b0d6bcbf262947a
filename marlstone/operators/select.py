"""Selection: reasons, caps, first-wins and last-wins rules, interleaving, running stops, greedy near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ordered import placed
from marlstone.session import cut


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def additive_score(terms: list[tuple[str, float, Column]]) -> tuple[Column, Column]:
    """(sum of the weights of the terms that hold, the names of these terms in order)."""
    score = sum((F.when(c, F.lit(w)).otherwise(0.0) for _, w, c in terms), F.lit(0.0))
    return score, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in terms]))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first `n` rows of each key; Catalyst limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def last_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """An append log's newest row for each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(position).alias(position))


def interleave(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Round robin over groups, first of each key wins: each key's least (position within its group, group); no group is one task."""
    return placed(df, [group], [order], "position").groupBy(key).agg(F.min(F.struct("position", group)).alias("__p")).select(key, F.col("__p.position").cast("long").alias("position"), F.col(f"__p.{group}").alias(group))


def running_stop(df: DataFrame, partition: list[str], order: list[str], amount: str, target: float) -> DataFrame:
    """Rows of each partition until the sum of `amount` reaches `target`; the row that reaches it is the last."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__s", F.coalesce(F.sum(amount).over(w), F.lit(0))).filter(F.col("__s") < target).drop("__s")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """(a, b, distance) with a < b of 64-bit hashes at most `most` apart: of most + 1 chunks one must be equal, so an equi-join on chunks finds all."""
    size = max(1, 64 // (most + 1))
    chunks = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col(bits), i * size).bitwiseAND(F.lit((1 << size) - 1)).alias("c")) for i in range(-(-64 // size))]
    keyed = df.select(F.col(key).alias("k"), F.col(bits).alias("h"), F.explode(F.array(*chunks)).alias("x")).select("k", "h", "x.i", "x.c")
    left, right = (keyed.select(F.col("k").alias(f"{s}"), F.col("h").alias(f"h{s}"), "i", "c") for s in "ab")
    pairs = left.join(right, ["i", "c"]).filter(F.col("a") < F.col("b")).withColumn("distance", hamming(F.col("ha"), F.col("hb")).cast("long"))
    return pairs.filter(F.col("distance") <= most).select("a", "b", "distance").distinct()


def greedy_keep(nodes: DataFrame, pairs: DataFrame, key: str, order: list[Column | str] | str, rounds: int = 10_000) -> DataFrame:
    """Rows that a pass in priority order keeps if it drops what is near to a kept row.

    The lexicographically first maximal independent set: each round keeps rows without an undecided neighbour before
    them and drops the neighbours of kept rows, so the sequential answer comes in a few distributed rounds. Rounds go on
    until no row is open; more than `rounds` of them are an error. The name of one ascending column as `order` is taken
    as it is, other orders are numbered by ranges.
    """
    ranked = nodes.select(key, F.col(order).alias("__p")) if isinstance(order, str) else placed(nodes, [], order, "__p").select(key, "__p")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    p = ranked.withColumnRenamed(key, "a").withColumnRenamed("__p", "pa")
    q = ranked.withColumnRenamed(key, "b").withColumnRenamed("__p", "pb")
    edges = cut(both.join(p, "a").join(q, "b"))
    state = cut(ranked.select(F.col(key).alias("a"), F.lit(0).alias("s")))  # 0 undecided, 1 kept, 2 dropped
    for _ in range(rounds):
        open_ = state.filter("s = 0").select("a")
        live = edges.join(open_, "a", "left_semi").join(open_.withColumnRenamed("a", "b"), "b", "left_semi")
        blocked = live.filter("pb < pa").select("a").distinct()
        kept = open_.join(blocked, "a", "left_anti")
        dropped = edges.join(kept.withColumnRenamed("a", "b"), "b", "left_semi").select("a").distinct().join(open_, "a", "left_semi")
        news = kept.withColumn("n", F.lit(1)).unionByName(dropped.withColumn("n", F.lit(2)))
        state = cut(state.join(news, "a", "left").select("a", F.coalesce("n", "s").alias("s")))
        if not state.filter("s = 0").take(1):
            break
    else:
        raise RuntimeError(f"rows are still open after {rounds} rounds")
    return nodes.join(state.filter("s = 1").select(F.col("a").alias(key)), key, "left_semi")
