"""From line items as findings to ranked rounds, consensus, leaderboard and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import consensus as C
from marlstone.operators import statistics as S
from marlstone.plans.base import Tables, query

TYPES = [(0, "diagnostic"), (1, "high"), (2, "high"), (3, "medium"), (4, "medium")]
DEFAULTS = [("F", "low"), ("O", "medium")]

FINDINGS = """findings AS (
  SELECT CAST(l_orderkey % 100 AS BIGINT) AS task_id, CAST(l_suppkey % 12 AS BIGINT) AS candidate_id, l_linenumber % 3 AS round,
    CASE l_returnflag WHEN 'A' THEN 'layout' WHEN 'N' THEN 'text' ELSE 'graphics' END AS dimension, l_linestatus AS category, l_partkey % 7 AS issue_type,
    CAST(round(l_discount * 100) AS INT) / 20.0 AS affected_ratio FROM lineitem),
rounds AS (SELECT task_id, candidate_id, round, CAST(count(*) AS BIGINT) % 4 = 0 AS gated FROM findings GROUP BY ALL),
rated AS (SELECT *, CASE WHEN issue_type = 0 THEN 'diagnostic' WHEN issue_type IN (1, 2) THEN 'high' WHEN issue_type IN (3, 4) THEN 'medium' WHEN category = 'F' THEN 'low' ELSE 'medium' END AS severity FROM findings),
based AS (SELECT *, CASE severity WHEN 'diagnostic' THEN 0.0 WHEN 'low' THEN 0.5 WHEN 'medium' THEN 1.5 ELSE 3.0 END AS base_points FROM rated)"""
STAIR = "CASE WHEN {r} <= 0.02 THEN 1.0 WHEN {r} <= 0.1 THEN 1.25 WHEN {r} <= 0.25 THEN 1.5 WHEN {r} <= 0.5 THEN 2.0 ELSE 2.5 END"
ISSUES = f"""{FINDINGS},
merged AS (SELECT b.task_id, b.candidate_id, dimension, category, issue_type, max(affected_ratio) AS affected_ratio, max(base_points) AS base_points,
    arg_max(severity, base_points) AS severity, count(DISTINCT b.round) AS round_support, list_sort(list(DISTINCT b.round)) AS round_ids
  FROM based b JOIN rounds r ON b.task_id = r.task_id AND b.candidate_id = r.candidate_id AND b.round = r.round WHERE NOT gated GROUP BY ALL),
issues AS (SELECT *, round_even(CAST(base_points * ({STAIR.format(r='affected_ratio')}) AS DOUBLE), 2) AS points_lost FROM merged)"""
CASES = f"""{ISSUES},
gate AS (SELECT task_id, candidate_id, count(*) AS round_count, count(*) FILTER (gated) AS gate_count FROM rounds GROUP BY ALL),
lost AS (SELECT task_id, candidate_id, coalesce(sum(CAST(points_lost AS DECIMAL(18,2))) FILTER (dimension = 'layout'), 0) AS l1, coalesce(sum(CAST(points_lost AS DECIMAL(18,2))) FILTER (dimension = 'text'), 0) AS l2,
    coalesce(sum(CAST(points_lost AS DECIMAL(18,2))) FILTER (dimension = 'graphics'), 0) AS l3, count(*) AS issues, count(*) FILTER (round_support = 1) AS singles FROM issues GROUP BY ALL),
cases AS (SELECT g.task_id, g.candidate_id, gate_count >= round_count // 2 + 1 AS majority_gate, gate_count,
    CASE WHEN gate_count >= round_count // 2 + 1 THEN 0 ELSE CAST(30 - least(coalesce(l1, 0), 30) AS DOUBLE) END AS layout_score, CASE WHEN gate_count >= round_count // 2 + 1 THEN 0 ELSE CAST(40 - least(coalesce(l2, 0), 40) AS DOUBLE) END AS text_score,
    CASE WHEN gate_count >= round_count // 2 + 1 THEN 0 ELSE CAST(30 - least(coalesce(l3, 0), 30) AS DOUBLE) END AS graphics_score,
    CASE WHEN gate_count >= round_count // 2 + 1 THEN 0 ELSE coalesce(issues, 0) END AS issue_count, CASE WHEN gate_count >= round_count // 2 + 1 THEN 0 ELSE coalesce(singles, 0) END AS single_round_issue_count
  FROM gate g LEFT JOIN lost USING (task_id, candidate_id)),
scored AS (SELECT *, round(layout_score + text_score + graphics_score, 6) AS total_score FROM cases)"""
BOARD = f"""{CASES},
board AS (SELECT candidate_id, count(*) AS task_count, count(*) FILTER (majority_gate) AS majority_gate_count, round(avg(CAST(majority_gate AS INT)), 6) AS majority_gate_rate,
    round(avg(layout_score), 6) AS mean_layout_score, round(avg(text_score), 6) AS mean_text_score, round(avg(graphics_score), 6) AS mean_graphics_score, round(avg(total_score), 6) AS mean_final_score,
    round(avg(issue_count), 6) AS mean_issue_count, round(CASE WHEN sum(issue_count) > 0 THEN sum(single_round_issue_count) / sum(issue_count) ELSE 0 END, 6) AS single_round_issue_rate FROM scored GROUP BY 1)"""


def findings(t: Tables) -> DataFrame:
    k = F.round(F.col("l_discount") * 100).cast("int")
    dimension = F.when(F.col("l_returnflag") == "A", "layout").when(F.col("l_returnflag") == "N", "text").otherwise("graphics")
    return t.lineitem.select(
        (F.col("l_orderkey") % 100).alias("task_id"), (F.col("l_suppkey") % 12).alias("candidate_id"), (F.col("l_linenumber") % 3).alias("round"),
        dimension.alias("dimension"), F.col("l_linestatus").alias("category"), (F.col("l_partkey") % 7).alias("issue_type"), (k / F.lit(20.0)).alias("affected_ratio"),
    )


def rounds(found: DataFrame) -> DataFrame:
    return found.groupBy("task_id", "candidate_id", "round").agg((F.count("*") % 4 == 0).alias("gated"))


def rated(found: DataFrame) -> DataFrame:
    spark = found.sparkSession
    return C.severity(found, spark.createDataFrame(TYPES, "issue_type long, type_severity string"), spark.createDataFrame(DEFAULTS, "category string, category_severity string"))


def issues_and_cases(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = findings(t)
    per_round = rounds(found)
    issues = C.merge_rounds(rated(found), per_round, None)
    return issues, C.scores(issues, per_round)


@query(f"WITH {FINDINGS} SELECT task_id, candidate_id, round, dimension, category, issue_type, severity, base_points::DOUBLE AS base_points, affected_ratio::DOUBLE AS affected_ratio, round_even(CAST(base_points * ({STAIR.format(r='affected_ratio')}) AS DOUBLE), 2) AS points_lost FROM based")
def findings_rank_rounds(t: Tables) -> DataFrame:
    """Every finding with its severity, base points and points lost."""
    return rated(findings(t)).withColumn("points_lost", C.points(F.col("base_points"), F.col("affected_ratio"))).select("task_id", "candidate_id", "round", "dimension", "category", "issue_type", "severity", "base_points", "affected_ratio", "points_lost")


@query(f"WITH {ISSUES} SELECT task_id, candidate_id, dimension, category, issue_type, affected_ratio::DOUBLE AS affected_ratio, base_points::DOUBLE AS base_points, severity, array_to_string(round_ids, ',') AS rounds, round_support, points_lost FROM issues")
def consensus_cases(t: Tables) -> DataFrame:
    issues, _ = issues_and_cases(t)
    return issues.withColumn("rounds", F.array_join(F.transform("round_ids", lambda x: x.cast("string")), ",")).drop("round_ids", "observations")


@query(f"WITH {CASES} SELECT * FROM scored")
def case_scores(t: Tables) -> DataFrame:
    return issues_and_cases(t)[1]


@query(f"WITH {BOARD} SELECT *, row_number() OVER (ORDER BY mean_final_score DESC, candidate_id) AS rank FROM board")
def leaderboard(t: Tables) -> DataFrame:
    return C.leaderboard(issues_and_cases(t)[1])


@query(f"""WITH {CASES} SELECT dimension, category, issue_type, count(*) AS case_count, round(avg(i.affected_ratio), 6) AS mean_affected_ratio, CAST(sum(CAST(points_lost AS DECIMAL(18,2))) AS DOUBLE) AS total_points_lost,
  round(avg(CAST(round_support = 1 AS INT)), 6) AS single_round_rate, min(severity) AS severity FROM issues i JOIN scored USING (task_id, candidate_id) WHERE NOT majority_gate GROUP BY ALL""")
def issue_summary(t: Tables) -> DataFrame:
    return C.issue_summary(*issues_and_cases(t))


@query(f"WITH {FINDINGS} SELECT task_id, candidate_id, count(*) AS round_count FROM rounds GROUP BY ALL HAVING count(*) <> 3")
def round_count_violations(t: Tables) -> DataFrame:
    return C.wrong_round_counts(rounds(findings(t)))


@query(f"WITH {FINDINGS} SELECT b.task_id, b.candidate_id, dimension, category, issue_type, count(*) AS n, len(list(DISTINCT (b.round, affected_ratio))) AS observations FROM based b JOIN rounds r ON b.task_id = r.task_id AND b.candidate_id = r.candidate_id AND b.round = r.round WHERE NOT gated GROUP BY ALL")
def observations(t: Tables) -> DataFrame:
    found = findings(t)
    live = found.join(rounds(found).filter("NOT gated"), ["task_id", "candidate_id", "round"], "left_semi")
    return live.groupBy("task_id", "candidate_id", "dimension", "category", "issue_type").agg(F.count("*").alias("n"), F.size(F.collect_set(F.struct("round", "affected_ratio"))).cast("long").alias("observations"))


@query(f"WITH {BOARD}, r AS (SELECT *, row_number() OVER (ORDER BY mean_final_score DESC, candidate_id) AS rank FROM board) SELECT rank, candidate_id AS upper_model, lead(candidate_id) OVER (ORDER BY rank) AS lower_model, round(mean_final_score - lead(mean_final_score) OVER (ORDER BY rank), 6) AS full_gap FROM r QUALIFY lower_model IS NOT NULL")
def adjacent_pairs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy("rank")  # one row for each candidate
    out = C.leaderboard(issues_and_cases(t)[1]).select("rank", F.col("candidate_id").alias("upper_model"), F.lead("candidate_id").over(w).alias("lower_model"), F.round(F.col("mean_final_score") - F.lead("mean_final_score").over(w), 6).alias("full_gap"))
    return out.filter("lower_model IS NOT NULL")


#: Sizes of a resample and resamples of each size.
SIZES, RESAMPLES = (50, 100, 200, 300, 400, 500), 2000
DRAWS = f"""draws AS (SELECT z, i, ('0x' || substr(md5(z || '/' || i || '/' || d), 1, 8))::BIGINT % 100 AS position, count(*) AS n
  FROM unnest([{", ".join(map(str, SIZES))}]) s(z), range({RESAMPLES}) a(i), range({max(SIZES)}) b(d) WHERE d < z GROUP BY ALL)"""
MEANS = f"""{CASES}, {DRAWS}, means AS (SELECT z, i, candidate_id AS model, sum(n * CAST(total_score AS DECIMAL(18,6)))::DOUBLE / z AS mean FROM draws JOIN scored ON task_id = position GROUP BY z, i, candidate_id),
r AS (SELECT *, row_number() OVER (PARTITION BY z, i ORDER BY round(mean, 6) DESC, model) AS rank FROM means)"""
CUT = lambda x: f"floor({x} * 10000 + 0.001) / 10000"


def drawn(t: Tables) -> DataFrame:
    """Mean score of each model over each resample; positions are drawn with replacement, by a hash of size, resample and draw."""
    draws = S.hashed_draws(t.region.sparkSession, 100, SIZES, RESAMPLES)
    scores = issues_and_cases(t)[1].select(F.col("task_id").alias("position"), F.col("candidate_id").alias("model"), F.col("total_score").alias("score"))
    return S.bootstrap_means(draws, scores)


@query(f"""WITH {MEANS} SELECT z AS sample_size, model, {CUT("avg(mean)")} AS center, {CUT("quantile_cont(mean, 0.025)")} AS ci_low, {CUT("quantile_cont(mean, 0.975)")} AS ci_high,
 {CUT("quantile_cont(mean, 0.05)")} AS low_90, {CUT("quantile_cont(mean, 0.95)")} AS high_90 FROM means GROUP BY ALL""")
def bootstrap_ci(t: Tables) -> DataFrame:
    return S.intervals(drawn(t), ["sample_size", "model"])


@query(f"WITH {MEANS} SELECT z AS sample_size, model, round(avg(CAST(rank <= 3 AS INT)), 6) AS top3_probability FROM r GROUP BY ALL")
def top3_probability(t: Tables) -> DataFrame:
    ranked = S.ranked(drawn(t).withColumn("mean", F.round("mean", 6)), ["sample_size", "iteration"])
    return ranked.groupBy("sample_size", "model").agg(F.round(F.avg((F.col("rank") <= 3).cast("double")), 6).alias("top3_probability"))


@query(f"""WITH {MEANS}, f AS (SELECT candidate_id AS model, round(avg(total_score), 6) AS mean FROM scored GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY mean DESC, model) AS k FROM f),
top AS (SELECT z, i, list_sort(list(model)) AS s FROM r WHERE rank <= 3 GROUP BY ALL)
SELECT z AS sample_size, round(avg(CAST(s = (SELECT list_sort(list(model)) FROM o WHERE k <= 3) AS INT)), 6) AS same_top3 FROM top GROUP BY 1""")
def top3_set_stability(t: Tables) -> DataFrame:
    """How often a resample's three best models are the full data's."""
    means = S.ranked(drawn(t).withColumn("mean", F.round("mean", 6)), ["sample_size", "iteration"])
    full = C.leaderboard(issues_and_cases(t)[1]).filter("rank <= 3").agg(F.sort_array(F.collect_list("candidate_id")).alias("best"))
    sets = means.filter("rank <= 3").groupBy("sample_size", "iteration").agg(F.sort_array(F.collect_list("model")).alias("s"))
    return sets.crossJoin(F.broadcast(full)).groupBy("sample_size").agg(F.round(F.avg((F.col("s") == F.col("best")).cast("double")), 6).alias("same_top3"))


@query(f"""WITH {MEANS}, f AS (SELECT candidate_id AS model, round(avg(total_score), 6) AS mean FROM scored GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY mean DESC, model) AS k FROM f),
d AS (SELECT u.z, u.i, a.model AS upper_model, b.model AS lower_model, a.mean - b.mean AS gap, u.mean - l.mean AS diff FROM o a JOIN o b ON b.k = a.k + 1 JOIN means u ON u.model = a.model JOIN means l ON l.model = b.model AND l.z = u.z AND l.i = u.i)
SELECT z AS sample_size, upper_model, lower_model, round(any_value(gap), 6) AS full_gap, {CUT("quantile_cont(diff, 0.025)")} AS difference_ci_low, {CUT("quantile_cont(diff, 0.975)")} AS difference_ci_high,
 {CUT("quantile_cont(diff, 0.025)")} > 0 OR {CUT("quantile_cont(diff, 0.975)")} < 0 AS significant_95pct, round(avg(CAST(round(diff, 6) < 0 AS INT)), 6) AS rank_flip_probability FROM d GROUP BY z, upper_model, lower_model""")
def pair_differences(t: Tables) -> DataFrame:
    """Models next to each other in the full ranking: interval of the difference, its significance, how often they change places."""
    board = C.leaderboard(issues_and_cases(t)[1]).select("rank", F.col("candidate_id").alias("model"), F.col("mean_final_score").alias("mean"))
    return S.adjacent_differences(drawn(t), board)


@query("""WITH s AS (SELECT CAST(l_suppkey % 12 AS BIGINT) AS m, l_linenumber AS g, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS e FROM lineitem GROUP BY ALL)
SELECT a.g AS g, count(*) FILTER (sign(a.q - b.q) * sign(a.e - b.e) > 0) AS concordant, count(*) FILTER (sign(a.q - b.q) * sign(a.e - b.e) < 0) AS discordant,
 round((concordant - discordant) / greatest(1, concordant + discordant), 6) AS tau FROM s a JOIN s b ON a.g = b.g AND a.m < b.m GROUP BY a.g""")
def kendall_tau(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy((F.col("l_suppkey") % 12).alias("m"), F.col("l_linenumber").alias("g")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("e"))
    return S.kendall_tau(s, ["g"], "m", "q", "e")
