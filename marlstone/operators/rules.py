"""Row rules: filters with reasons, veto ladders, validation with lists of violations, counters, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ordered import placed
from marlstone.operators.select import first_reason
from marlstone.session import written

#: Texts of a side of a page that meet in one task.
SIDE = 64


def hard_filter(width: Column, height: Column, kept: Column, side: int = 400, area: int = 250_000, aspect: tuple[float, float] = (0.4, 4.0)) -> Column:
    """The first rule that a figure breaks: its source, then its short side, its area, its aspect; null if none."""
    return first_reason([("source", ~kept), ("side", F.least(width, height) < side), ("area", width * height < area), ("aspect", ~(width / height).between(*aspect))])


def keyword_score(text: Column, liked: tuple[str, ...], disliked: tuple[str, ...], length: Column, area: Column, aspect: Column, vector: Column, single: Column) -> tuple[Column, Column]:
    """(score, reasons): +3 and -3 for each keyword that the text holds, then length, area, aspect, vector source, single graphic."""
    low = F.lower(text)
    held = lambda words: F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(low, k))
    plus, minus = held(liked), held(disliked)
    terms = [("length80", 1.0, length >= 80), ("length180", 0.5, length >= 180), ("area1m", 1.0, area >= 1e6), ("area2.5m", 0.5, area >= 2.5e6), ("aspect", 1.0, aspect.between(1.2, 3.2)), ("vector", 1.0, vector), ("single", 0.5, single)]
    score = 3.0 * F.size(plus) - 3.0 * F.size(minus) + sum((F.when(c, w).otherwise(0.0) for _, w, c in terms), F.lit(0.0))
    marks = [F.transform(plus, lambda k: F.concat(F.lit("+"), k)), F.transform(minus, lambda k: F.concat(F.lit("-"), k))]
    return score, F.concat(*marks, F.array_compact(F.array(*[F.when(c, n) for n, _, c in terms])))


def structured_score(raster: Column, nodes: Column, edges: Column, plot: Column, hits: Column, captioned: Column, drawn: Column) -> Column:
    """-100 for what can't be a diagram, else points for hits, nodes and edges, each capped, 2 for a caption and 2 for a drawn source; three places, half to even."""
    veto = raster | (nodes < 3) | (edges < 2) | (edges > F.greatest(F.lit(100), 8 * nodes)) | plot | (hits < 1)
    capped = F.least(F.lit(20.0), 4 + 1.5 * hits) + F.least(F.lit(8.0), nodes * 0.35) + F.least(F.lit(8.0), edges * 0.35)
    return F.when(veto, -100.0).otherwise(F.bround(capped + F.when(captioned, 2.0).otherwise(0.0) + F.when(drawn, 2.0).otherwise(0.0), 3))


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules]))


def ratio_rules(ratio: Column, cases: Column) -> list[tuple[str, Column]]:
    """A ratio is finite, in [0, 1], of two places at most, and 0 without cases."""
    return [
        ("not finite", F.isnan(ratio) | (F.abs(ratio) == float("inf"))), ("range", ~ratio.between(0, 1)),
        ("places", F.abs(ratio * 100 - F.round(ratio * 100)) > 1e-9), ("no cases", (cases == 0) & (ratio != 0)), ("cases", cases < 0),
    ]


def symmetric_difference(a: Column, b: Column) -> Column:
    """Elements of one array alone, sorted."""
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def contiguous(numbers: Column) -> Column:
    """Whether an array is 1, 2, ... in some order, each once."""
    return F.array_sort(numbers) == F.sequence(F.lit(1), F.size(numbers)).cast("array<bigint>")


def safe_name(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"), F.lit(False))


def usage(given: Column, cached: Column, output: Column, reasoning: Column) -> dict[str, Column]:
    """Counters: uncached input and total are derived, reasoning is part of the output; what can't be is named in `error`."""
    whole = lambda c: (c >= 0) & (c == F.floor(c))
    wrong = violations([("input", ~whole(given)), ("cached", ~whole(cached)), ("output", ~whole(output)), ("reasoning", ~whole(reasoning)), ("cached > input", cached > given)])
    fine = F.size(wrong) == 0
    keep = lambda c: F.when(fine, c.cast("long"))
    return {"input_tokens": keep(given), "cached_input_tokens": keep(cached), "uncached_input_tokens": keep(given - cached), "output_tokens": keep(output), "reasoning_output_tokens": keep(reasoning), "total_tokens": keep(given + output), "error": F.array_join(wrong, ",")}


def succeeded(code: Column, timed_out: Column, events: Column, errors: Column) -> Column:
    return F.coalesce((code == 0) & ~timed_out & (F.size(events) == 0) & (F.size(errors) == 0), F.lit(False))


def bounded(offset: Column, extent: Column, limit: Column) -> tuple[Column, Column]:
    """Offset and extent moved inside [0, limit]."""
    at = F.least(F.greatest(offset, F.lit(0)), limit)
    return at, F.least(F.greatest(extent, F.lit(0)), limit - at)


def outside(offset: Column, extent: Column, limit: Column, slack: int = 1) -> Column:
    return (offset < -slack) | (extent < 0) | (offset + extent > limit + slack)


def stage_and_role(path: Column, stage: Column, role: Column) -> tuple[Column, Column]:
    """What is given, else the number behind /g or /stage of the path as G<n>, and the folder below it."""
    number = F.regexp_extract(F.lower(path), r"/(?:g|stage)[-_]?(\d+)(?:/|$)", 1)
    folder = F.regexp_extract(F.lower(path), r"/(?:g|stage)[-_]?\d+/([a-z]+)(?:/|$)", 1)
    return F.coalesce(F.upper(stage), F.when(number != "", F.concat(F.lit("G"), number))), F.coalesce(role, F.when(folder != "", folder))


def box_units(box: Column, width: Column, height: Column) -> Column:
    """Units of a box by its greatest number: shares up to 1.5, else the canvas's up to 100000, else EMU."""
    top = F.array_max(F.transform(box, F.abs))
    return F.when(top <= 1.5, "share").when(top > 1e5, "emu").otherwise("canvas")


def letterbox(width: Column, height: Column, to: tuple[int, int] = (1600, 900)) -> dict[str, Column]:
    """Scale and offsets that fit a page into a canvas, centred."""
    scale = F.least(to[0] / width, to[1] / height)
    return {"scale": scale, "left": (to[0] - width * scale) / 2, "top": (to[1] - height * scale) / 2}


def count_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(F.exp(-F.abs(F.log1p(a) - F.log1p(b))))


def harmonic(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def integral(x: Column) -> Column:
    """A whole number written in any decimal spelling; null for others, infinite and none."""
    d = x.try_cast("decimal(38,10)")
    return F.when(d == F.floor(d), d.cast("bigint"))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def by_priority(df: DataFrame, buckets: list[Column], then: str) -> DataFrame:
    """`bucket`: the first of the conditions that holds, else their number; ordered by it, then by `then`."""
    bucket = F.lit(len(buckets))
    for i, c in reversed(list(enumerate(buckets))):
        bucket = F.when(c, F.lit(i)).otherwise(bucket)
    return df.withColumn("bucket", bucket).orderBy("bucket", then)


def ordinals(df: DataFrame, keys: list[str], order: str, given: str) -> DataFrame:
    """`ordinal`: the given one, else the place in order; no key is one task."""
    return placed(df, keys, [order], "__n").withColumn("ordinal", F.coalesce(F.col(given).cast("long"), F.col("__n"))).drop("__n")


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each left row with the first right row of its keys, by partial aggregation before the join."""
    rest = [c for c in right.columns if c not in keys]
    return left.join(right.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")), keys, "left").select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in rest])


def differing_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows whose fields differ between two tables, with the names of these; rows that one side lacks are `missing`."""
    r = right.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = left.join(r, F.col(key) == F.col("__k"), "left")
    named = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields]))
    wrong = F.when(F.col("__k").isNull(), F.array(F.lit("missing"))).otherwise(named)
    return both.select(key, F.array_join(wrong, ",").alias("differs")).filter("differs <> ''")


def later_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two manifests as one; the second's rows win."""
    rest = [c for c in first.columns if c not in keys]
    both = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__o").alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def pool_size(target: int, factor: float, up: bool = False) -> int:
    """Rows to gather for a target: half to even, or rounded up."""
    import math

    return math.ceil(target * factor) if up else round(target * factor)


def matched_texts(docs: DataFrame, key: str, canvas: tuple[int, int] = (1600, 900)) -> DataFrame:
    """Per key: mean similarity of reference texts to candidates that are placed alike.

    Rows: key, side ('reference' or 'candidate'), position, text, x, y (centres, as shares of the page). Texts are compared
    as their words, in lower case. References go by falling number of words; each takes the free candidate of the greatest
    0.72 x text ratio + 0.28 x nearness among those whose text ratio is 0.25 or more, the earlier one among equals.
    Nearness falls to 0 at 0.35 of the canvas's diagonal. Without references the mean is 1 if there are no candidates
    either, else 0. Texts meet in blocks of SIDE of each side, so a long page's ratios are computed by many tasks; the one
    that gives a page's candidates away has numbers alone.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, "position", "x", "y")}

    def worded(batches):
        import re

        for t in batches:
            words = [re.findall(r"\w+", x.casefold()) for x in t["text"]]
            yield t.assign(n=[len(w) for w in words], text=[" ".join(w) for w in words])

    def compare(t):
        from difflib import SequenceMatcher

        import pandas as pd

        given, wanted, out = t[~t["ref"]], t[t["ref"]], {}
        for c in given["text"].unique():
            of = SequenceMatcher(None, "", c)  # keeps what it learns of its second text
            for r in wanted["text"].unique():
                of.set_seq1(r)
                # two bounds from above, the second with all its counts, then the ratio
                out[r, c] = of.ratio() if of.real_quick_ratio() >= 0.25 and of.quick_ratio() >= 0.25 else 0.0
        found = [(a, b, out[r, c]) for a, r in zip(wanted["i"], wanted["text"], strict=True) for b, c in zip(given["i"], given["text"], strict=True) if out[r, c] >= 0.25]
        return pd.DataFrame({key: [t[key].iloc[0]] * len(found), "a": [f[0] for f in found], "b": [f[1] for f in found], "ratio": [f[2] for f in found]})

    def match(t, ratios):
        import math

        import pandas as pd

        t = t.sort_values(["position", "i"])
        given, wanted = t[~t["ref"]], t[t["ref"]].sort_values("n", ascending=False, kind="stable")
        at = {i: (k, x * canvas[0], y * canvas[1]) for k, (i, x, y) in enumerate(zip(given["i"], given["x"], given["y"], strict=True))}
        fits, reach, taken, total = {a: (own["b"], own["ratio"]) for a, own in ratios.groupby("a")}, 0.35 * math.hypot(*canvas), set(), 0.0
        for a, x, y in zip(wanted["i"], wanted["x"] * canvas[0], wanted["y"] * canvas[1], strict=True):
            free = [(0.72 * r + 0.28 * max(0.0, 1 - math.dist((x, y), at[b][1:]) / reach), -at[b][0]) for b, r in zip(*fits.get(a, ((), ())), strict=True) if at[b][0] not in taken]
            if free:
                best, place = max(free)
                taken.add(-place)
                total += best
        score = total / len(wanted) if len(wanted) else float(not len(given))
        return pd.DataFrame({key: [t[key].iloc[0]], "score": [round(score, 6)], "references": [len(wanted)], "candidates": [len(given)]})

    numbers = f"{key} {kinds[key]}, ref boolean, i long, position {kinds['position']}, x {kinds['x']}, y {kinds['y']}, n long"
    rows = docs.select(key, (F.col("side") == "reference").alias("ref"), F.monotonically_increasing_id().alias("i"), "position", "x", "y", F.lit(0).cast("bigint").alias("n"), "text")
    parts = 4 * docs.rdd.getNumPartitions()  # by number: texts are few bytes for the work that they give
    rows = written(rows.repartition(parts).mapInPandas(worded, f"{numbers}, text string"))
    sizes = rows.groupBy(F.col(key).alias("__k")).agg(*[F.ceil(F.count_if(c) / SIDE).cast("int").alias(n) for c, n in ((F.col("ref"), "__rs"), (~F.col("ref"), "__cs"))])
    dealt = rows.join(F.broadcast(sizes.filter("__rs > 1 OR __cs > 1")), F.col(key).eqNullSafe(F.col("__k")), "left")
    mine, other = ((F.greatest(F.when(F.col("ref"), F.col(a)).otherwise(F.col(b)), F.lit(1))) for a, b in (("__rs", "__cs"), ("__cs", "__rs")))
    dealt = dealt.select(key, "ref", "i", "text", F.pmod(F.xxhash64("i"), mine).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("met"))
    block = lambda a, b, n: F.when(F.col("ref"), F.col(a)).otherwise(F.col(b)).alias(n)
    ratios = dealt.select(key, "ref", "i", "text", block("own", "met", "r"), block("met", "own", "c")).repartition(parts, key, "r", "c").groupBy(key, "r", "c").applyInPandas(compare, f"{key} {kinds[key]}, a long, b long, ratio double")
    pages = rows.drop("text").repartition(parts, key).groupBy(key).cogroup(ratios.repartition(parts, key).groupBy(key))
    return pages.applyInPandas(match, f"{key} {kinds[key]}, score double, references long, candidates long")
