"""Quality rules: base rules on word statistics, and robust multivariate outliers per language and source.

DataFrame functions only: statistics are array expressions over one row's text, and the minimum covariance
determinant comes from concentration steps whose every estimate is an aggregate of sums that partial aggregation
reduces before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table, written

#: Least words; share of words in repeated windows (per cent) above which a text fails; words in a window.
LEAST_WORDS, MOST_REPEAT, WINDOW = 50, 50, 3
#: Share of rows that a concentration step keeps; most steps, and the fall of the log determinant below which they end;
#: fewest rows of a group with an estimate of its own and of any estimate; squared distance beyond which a text goes, which
#: one in a thousand of normal vectors exceeds (chi-square, 4 degrees); least deviations of the four transformed statistics;
#: groups that are broadcast at most.
KEEP, STEPS, EPS, OWN, ANY, CUTOFF, SMALL = 0.75, 8, 1e-3, 60, 8, 18.47, 100_000
FLOORS = (0.08, 0.05, 0.15, 0.15)
STATS = ("x1", "x2", "x3", "x4")
#: The median of the squared distance of four normal variables.
MEDIAN_4 = 3.3567
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; `hashes` has one for each window, in order."""

    def covered(s: Column) -> Column:
        twice = F.transform(s, lambda e, k: F.when((F.get(s, k - 1)["v"] == e["v"]) | (F.get(s, k + 1)["v"] == e["v"]), e["i"]))
        return let(F.sort_array(F.filter(twice, lambda i: i.isNotNull())), spread)

    def spread(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    pairs = F.transform(hashes, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), covered))


def statistics(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text counts as an empty one."""
    raw = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    names = raw.columns[:-1]
    spaced = F.translate("__t", SPACES, " " * len(SPACES))
    step = raw.select(
        *names,
        F.array_remove(F.split(spaced, " "), "").alias("__w"),
        (F.length("__t") - F.length(F.translate("__t", SPACES, ""))).alias("__s"),
        F.length("__t").alias("__n"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    windows = F.when(
        F.size("__w") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *names, F.size("__w").cast("long").alias("n_words"), (F.col("__n") - F.col("__s")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.size("__l").alias("__lines"), windows.alias("__h"),
    )
    return step.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("__h")).cast("long").alias("n_repeat_words"), "__lines")


def transformed() -> list[Column]:
    """Log mean word length, log symbols per word, roots of the shares of repeated lines and words."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log1p(F.col("word_chars") / n).alias("x1"), F.log1p(F.col("n_symbols") / n).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("__lines", F.lit(1))).alias("x3"), F.sqrt(F.col("n_repeat_words") / n).alias("x4"),
    ]


def distance(p: int = 4) -> Column:
    """Squared Mahalanobis distance from centre m and lower Cholesky factor l, by forward substitution."""

    def solve(i: int, ys: list[Column]) -> Column:
        if i == p:
            return sum((y * y for y in ys[1:]), ys[0] * ys[0])
        y = (F.col(STATS[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * ys[j] for j in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}")
        return let(y, lambda v: solve(i + 1, [*ys, v]))

    return solve(0, [])


def factored(moments: DataFrame, keep: list[str], p: int = 4) -> DataFrame:
    """Centre and Cholesky factor from n, sums s and sums of products q; the diagonal gets the least variances."""
    cov = {(i, j): F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i in range(p) for j in range(i + 1)}
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(p)})
    out = out.withColumns({f"c{i}{j}": F.greatest(c, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else c for (i, j), c in cov.items()})
    for j in range(p):
        rest = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2 / 4))))
        for i in range(j + 1, p):
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    return out.select(*keep, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def small(df: DataFrame) -> DataFrame:
    """A written table with a row for each group, broadcast once counted, so that no group's rows meet in one task."""
    return F.broadcast(df) if df.count() <= SMALL else df


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(STATS)]
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i in range(4) for j in range(i + 1)]
    return factored(rows.groupBy(*by).agg(F.count("*").alias("n"), *sums, *products), by)


def volume() -> Column:
    """The log of the determinant, from the factor's diagonal."""
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, 4)), 2 * F.log("l00"))


def estimates(rows: DataFrame) -> DataFrame:
    """Per `g`: centre, Cholesky factor and scale of the minimum covariance determinant; rows have g, x1 to x4.

    Three starts: medians and absolute deviations; means and covariances of all rows; those of the rows of one half by
    hash. From each, concentration steps go on until no determinant falls any more, but STEPS times at most: the share KEEP of
    a group's rows with the smallest distances gives the next estimate, which takes the last one's place. The least determinant counts. Quantiles are sketches of bounded size.
    """
    near = lambda c, q: F.percentile_approx(c, q, 2000)
    middle = written(rows.groupBy("g").agg(*[near(x, 0.5).alias(f"m{i}") for i, x in enumerate(STATS)]))
    spread = rows.join(small(middle), "g").groupBy("g").agg(*[near(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(STATS)])
    first = middle.join(spread, "g").select(
        "g", F.lit(0).alias("start"), *[f"m{i}" for i in range(4)],
        *[(F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(4) for j in range(i + 1)],
    )
    half = F.explode(F.when(F.pmod(F.xxhash64(*STATS), F.lit(2)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    now = first.unionByName(moments(rows.withColumn("start", half), ["g", "start"])).withColumn("volume", F.lit(None).cast("double"))
    for _ in range(STEPS):
        now = written(now)
        known = now.withColumnRenamed("volume", "before")
        far = rows.join(small(known), "g").select("g", "start", *STATS, distance().alias("d"))
        bound = written(far.groupBy("g", "start").agg(near("d", KEEP).alias("most")))
        core = far.join(small(bound), ["g", "start"]).filter("d <= most")
        after = moments(core, ["g", "start"]).withColumn("volume", volume())
        after = after.join(known.select("g", "start", "before"), ["g", "start"])
        now = written(after)
        moved = now.filter(F.col("before").isNull() | (F.col("volume") < F.col("before") - EPS)).limit(1).count()
        now = now.drop("before")
        if not moved:
            break
    best = now.groupBy("g").agg(F.min_by(F.struct(*[c for c in now.columns if c not in ("g", "start")]), F.struct("volume", "start")).alias("e")).select("g", "e.*").drop("volume")
    best = written(best)
    scale = rows.join(small(best), "g").groupBy("g").agg(F.greatest(near(distance(), 0.5) / MEDIAN_4, F.lit(1.0)).alias("scale"), F.count("*").alias("n"))
    return best.join(scale, "g")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: key, statistics, base_failed, distance, kept.

    A null text has no words and fails the base rules. Null languages and sources are values of their own. Groups of
    fewer than OWN rows share an estimate per language, then one for all; fewer than ANY rows give none, and the base
    rules alone decide. Repeated rows get equal verdicts; an empty table gives an empty one.
    """
    stats = written(statistics(docs, text, [F.col(key).alias("__key"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("__lang"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("__source")]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed).select("*", *transformed())
    sound = rows.filter(~F.col("base_failed"))
    sizes = written(sound.groupBy("__lang", "__source").count())
    rest = sizes.filter(F.col("count") < OWN).groupBy("__lang").agg(F.sum("count").alias("of_lang"))
    named = sizes.join(rest, "__lang", "left").select(
        F.col("__lang").alias("__a"), F.col("__source").alias("__b"),
        F.when(F.col("count") >= OWN, F.concat_ws("\0", F.lit("1"), "__lang", "__source")).when(F.col("of_lang") >= OWN, F.concat_ws("\0", F.lit("2"), "__lang")).otherwise("3").alias("g"),
    )
    named = written(named)
    same = (F.col("__lang") == F.col("__a")) & (F.col("__source") == F.col("__b"))
    grouped = sound.join(small(named), same).select("g", *STATS)
    found = written(estimates(grouped))
    known = written(named.join(found.filter(F.col("n") >= ANY), "g", "left"))
    far = rows.join(small(known), same, "left").withColumn("distance", distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return far.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: statistics and verdict of every document; the distance follows."""
    return judge(table(spark, sf_dir, "documents"))


def brute_force(text: str | None) -> tuple:
    """The contract's statistics by plain Python; for tests."""
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict[tuple, int] = {}
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])] = seen.get(tuple(words[i : i + 3]), 0) + 1
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)
