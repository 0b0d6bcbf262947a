"""Findings to scores: severity and stair points, consensus of rounds, capped scores, leaderboard and issue summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inclusive upper bounds of the affected ratio and their multipliers; points by severity; most points by dimension.
STAIRS = ((0.02, 1.0), (0.10, 1.25), (0.25, 1.5), (0.50, 2.0))
TOP_STAIR = 2.5
POINTS = {"diagnostic": 0.0, "low": 0.5, "medium": 1.5, "high": 3.0}
MAXIMA = {"layout": 30.0, "text": 40.0, "graphics": 30.0}
KEYS = ["task_id", "candidate_id"]
ISSUE = ["dimension", "category", "issue_type"]


def stair(ratio: Column) -> Column:
    out = F.lit(TOP_STAIR)
    for bound, multiplier in reversed(STAIRS):
        out = F.when(ratio <= bound, F.lit(multiplier)).otherwise(out)
    return out


def points(base: Column, ratio: Column) -> Column:
    """base times the stair multiplier, rounded half to even at two places."""
    return F.bround(base * stair(ratio), 2)


def severity(findings: DataFrame, types: DataFrame, defaults: DataFrame) -> DataFrame:
    """The type's own severity, else its category's; an unknown category is an error when the row is read."""
    joined = findings.join(types, "issue_type", "left").join(defaults, "category", "left")
    known = F.coalesce("type_severity", "category_severity", F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(F.col("category").cast("string"), F.lit("null")))))
    base = F.create_map(*[x for k, v in POINTS.items() for x in (F.lit(k), F.lit(v))])
    return joined.withColumn("severity", known).withColumn("base_points", base[F.col("severity")]).drop("type_severity", "category_severity")


def merge_rounds(findings: DataFrame, rounds: DataFrame, expected: int | None = 3) -> DataFrame:
    """One row per case and issue: greatest ratio, greatest base points with their severity, the rounds that support it.

    Findings of gated rounds count for nothing. A case with other than `expected` rounds is an error when it is read; None
    takes any number. `observations` are the distinct ones of a finding (round, ratio).
    """
    if expected is not None:
        n = rounds.groupBy(*KEYS).agg(F.count("*").alias("__n"))
        said = F.concat(F.lit(f"not {expected} rounds: "), F.concat_ws("/", *[F.col(k).cast("string") for k in KEYS]))
        rounds = rounds.join(n, KEYS).filter(F.when(F.col("__n") == expected, True).otherwise(F.raise_error(said).cast("boolean"))).drop("__n")
    open_rounds = rounds.filter(~F.coalesce("gated", F.lit(False))).select(*KEYS, "round")
    live = findings.join(open_rounds, [*KEYS, "round"], "left_semi")
    merged = live.groupBy(*KEYS, *ISSUE).agg(
        F.max("affected_ratio").alias("affected_ratio"), F.max("base_points").alias("base_points"),
        F.max_by("severity", "base_points").alias("severity"), F.sort_array(F.collect_set("round")).alias("round_ids"),
        F.sort_array(F.collect_set(F.struct("round", "affected_ratio"))).alias("observations"),
    )
    return merged.withColumn("round_support", F.size("round_ids").cast("long")).withColumn("points_lost", points(F.col("base_points"), F.col("affected_ratio")))


def gates(rounds: DataFrame) -> DataFrame:
    """Per case: rounds, gated rounds, and whether a majority (n // 2 + 1) is gated."""
    out = rounds.groupBy(*KEYS).agg(F.count("*").alias("round_count"), F.count_if(F.coalesce("gated", F.lit(False))).alias("gate_count"))
    return out.withColumn("majority_gate", F.col("gate_count") >= F.floor(F.col("round_count") / 2) + 1)


def wrong_round_counts(rounds: DataFrame, expected: int = 3) -> DataFrame:
    return rounds.groupBy(*KEYS).agg(F.count("*").alias("round_count")).filter(F.col("round_count") != expected)


def scores(issues: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per case: a score for each dimension (most points less the capped sum lost), their total, issue counts; gated cases get 0."""
    lost = lambda d: F.coalesce(F.sum(F.when(F.col("dimension") == d, F.col("points_lost").cast("decimal(18,2)"))), F.lit(0).cast("decimal(18,2)")).cast("double").alias(f"lost_{d}")
    summed = issues.groupBy(*KEYS).agg(*[lost(d) for d in MAXIMA], F.count("*").alias("issues"), F.count_if(F.col("round_support") == 1).alias("singles"))
    out = gates(rounds).join(summed, KEYS, "left")
    score = {d: F.when(F.col("majority_gate"), 0.0).otherwise(F.lit(m) - F.least(F.coalesce(F.col(f"lost_{d}"), F.lit(0.0)), F.lit(m))) for d, m in MAXIMA.items()}
    out = out.select(*KEYS, "majority_gate", "gate_count", *[c.alias(f"{d}_score") for d, c in score.items()], F.when(F.col("majority_gate"), 0).otherwise(F.coalesce("issues", F.lit(0))).cast("long").alias("issue_count"), F.when(F.col("majority_gate"), 0).otherwise(F.coalesce("singles", F.lit(0))).cast("long").alias("single_round_issue_count"))
    return out.withColumn("total_score", F.round(sum((F.col(f"{d}_score") for d in MAXIMA), F.lit(0.0)), 6))


def leaderboard(cases: DataFrame) -> DataFrame:
    """Per candidate: counts, gate rate, mean scores, mean issues, single-round share of all issues; rank by mean, then id."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")).cast("double"), 6)
    out = cases.groupBy("candidate_id").agg(
        F.count("*").alias("task_count"), F.count_if("majority_gate").alias("majority_gate_count"),
        F.round(F.avg(F.col("majority_gate").cast("double")), 6).alias("majority_gate_rate"), *[mean(f"{d}_score").alias(f"mean_{d}_score") for d in MAXIMA],
        mean("total_score").alias("mean_final_score"), F.round(F.avg("issue_count"), 6).alias("mean_issue_count"),
        F.round(F.coalesce(F.try_divide(F.sum("single_round_issue_count"), F.sum("issue_count")), F.lit(0.0)), 6).alias("single_round_issue_rate"),
    )
    # the ranked rows are one for each candidate, already aggregated
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_final_score"), "candidate_id")).cast("long"))


def issue_summary(issues: DataFrame, cases: DataFrame) -> DataFrame:
    """Over cases that no majority gates: per issue, cases, mean ratio, points lost, share supported by one round; worst first."""
    live = issues.join(cases.filter("NOT majority_gate").select(*KEYS), KEYS, "left_semi")
    out = live.groupBy(*ISSUE).agg(
        F.count("*").alias("case_count"), F.round(F.avg(F.col("affected_ratio").cast("decimal(18,6)")).cast("double"), 6).alias("mean_affected_ratio"),
        F.sum(F.col("points_lost").cast("decimal(18,2)")).cast("double").alias("total_points_lost"),
        F.round(F.avg((F.col("round_support") == 1).cast("double")), 6).alias("single_round_rate"), F.min("severity").alias("severity"),
    )
    return out.orderBy(F.desc("total_points_lost"), "issue_type", "dimension", "category")
