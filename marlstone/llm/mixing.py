"""Mixing sources to target weights by blocks of fixed length."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import map_batches, table, written
from marlstone.llm.ranks import buckets_for, running

#: Words in a block, blocks in an output shard, most passes over a source, share of all words in the mix.
BLOCK, SHARD, PASSES, SHARE, SEED = 256, 4096, 2, 1.5, 17
#: Slots that a task makes.
PER_TASK = 1 << 15
WEIGHTS = (3, 1, 2)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = PASSES) -> dict[str | None, float]:
    """Words for each source: `share` of all by weight; none above `most` times its size, the excess reshared by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def draws(quotas: list[int], shard: int = SHARD, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source in each output shard: multinomial draws against what is left of the quotas.

    A draw beyond what a source has left goes to the sources that have most left, so the shards use up every quota.
    """
    left, out, k = np.array(quotas, dtype=np.int64), [], 0
    while (total := int(left.sum())) > 0:
        size = min(shard, total)
        got = np.minimum(np.random.default_rng([seed, k]).multinomial(size, left / total), left)
        while (lack := size - int(got.sum())) > 0:
            i = int(np.argmax(left - got))
            got[i] += min(lack, int(left[i] - got[i]))
        left -= got
        out.append(got.tolist())
        k += 1
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at `index`: a Feistel network over the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    while todo.any():
        x = out[todo]
        high, low = x >> np.uint64(half), x & mask
        for r in range(4):
            mixed = (low + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            high, low = low, high ^ ((mixed * np.uint64(0x94D049BB133111EB) >> np.uint64(32)) & mask)
        out[todo] = (high << np.uint64(half)) | low
        todo &= out >= n
    return out.astype(np.int64)


def word_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and `size`: the words of the whole text; a null text has 0."""

    def make():
        return lambda x: {**{k: x[k] for k in keep}, "size": [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in x["__text"]]}

    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep], "size bigint"])
    return map_batches(docs.select(*keep, F.col(text).alias("__text")), make, schema)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, shard: int = SHARD, seed: int = SEED, uid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, places). Documents: key, source, size, source_size, target, __uid. Places: where blocks go.

    Every source's words form a stream in an order by hash, cut into blocks. A place is (shard, slot, __uid,
    first, length): `length` words of a document from word `first`, in a slot of an output shard. A null text has
    no words and no places; a null source is a source, the last one; repeated rows are documents of their own; an
    empty table gives no places. `uid` names a column that tells rows apart, if there is one. The driver holds one number for each source and shard, never one for a document.
    """
    spark = docs.sparkSession
    own = [F.col(uid).alias("__uid")] if uid else []
    sized = word_counts(docs.select(F.col(key).alias("__key"), F.col(source).alias("__source"), *own, F.col(text).alias("__words")), ["__key", "__source", *["__uid"] * bool(uid)], "__words")
    sized = written(sized if uid else sized.withColumn("__uid", F.monotonically_increasing_id()))
    totals = {r[0]: (r[1], r[2]) for r in sized.groupBy("__source").agg(F.sum("size"), F.count("*")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    want = targets({s: totals[s][0] for s in names})
    about = spark.createDataFrame(
        [(i, s, totals[s][0], want[s]) for i, s in enumerate(names)], "__i int, __name string, source_size bigint, target double"
    )
    ordered = running(sized, "__source", "size", ["__key", "size", "__uid"], buckets_for(sum(n for _, n in totals.values())), "__at")
    placed = ordered.join(about, F.col("__source").eqNullSafe(F.col("__name")))
    # whole blocks of each source; the last may be short
    blocks = [-(-totals[s][0] // block) for s in names]
    quotas = [min(PASSES * b, round(want[s] * b / totals[s][0])) if b else 0 for s, b in zip(names, blocks, strict=True)]
    rows, used = [], [0] * len(names)
    for k, counts in enumerate(draws(quotas, shard, seed)):
        slot = 0
        for i, n in enumerate(counts):
            if n:
                rows.append((k, i, slot, used[i], n, blocks[i]))
                used[i] += n
                slot += n
    drawn = spark.createDataFrame(rows, "shard long, __i int, slot long, first long, n long, blocks long")

    def make():
        def step(x: dict) -> dict:
            out = {c: [] for c in ("shard", "slot", "__i", "__block")}
            for sh, i, slot, first, n, of in zip(*[x[c] for c in ("shard", "__i", "slot", "first", "n", "blocks")], strict=True):
                at = np.arange(first, first + n)
                index = np.empty(n, dtype=np.int64)
                for e in range(first // of, (first + n - 1) // of + 1):
                    inside = at // of == e
                    index[inside] = permuted(at[inside] % of, of, seed + 1000 * i + e)
                out["shard"] += [sh] * n
                out["slot"] += range(slot, slot + n)
                out["__i"] += [i] * n
                out["__block"] += index.tolist()
            return out

        return step

    slots = map_batches(drawn.repartition(max(1, min(len(rows), -(-sum(used) // PER_TASK)))) if rows else drawn, make, "shard bigint, slot bigint, __i int, __block bigint")
    first, last = F.floor(F.col("__at") / block), F.floor((F.col("__at") + F.col("size") - 1) / block)
    pieces = placed.filter("size > 0").withColumn("__block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("__block") * block, F.col("__at"))
    end = F.least((F.col("__block") + 1) * block, F.col("__at") + F.col("size"))
    pieces = pieces.select("__i", "__block", "__uid", (start - F.col("__at")).alias("first"), (end - start).alias("length"), (start - F.col("__block") * block).alias("offset"))
    # the planner sees only the few rows that slots are made from, so it is told not to broadcast them
    places = slots.hint("merge").join(pieces, ["__i", "__block"]).select("shard", "slot", "offset", "__uid", "first", "length")
    return placed.select(F.col("__key").alias(key), F.col("__source").alias(source), "size", "source_size", "target", "__uid"), places


def taken(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Documents with `taken`, the words that the mix takes of each, repeats counted."""
    used = places.groupBy(F.col("__uid").alias("__of")).agg(F.sum("length").alias("taken"))
    return documents.join(used, F.col("__uid") == F.col("__of"), "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("__of")


def assembled(text: str, parts: list[tuple[int, int]], size: int) -> list[str]:
    """The text's words as often as `parts` (first, length) take them: a text for each time, in page order, gaps as new lines."""
    times: dict[int, tuple[int, int]] = {}
    for first, length in parts:
        times[first] = (length, times.get(first, (0, 0))[1] + 1)
    out, spans = [], None
    for copy in range(1, max((n for _, n in times.values()), default=0) + 1):
        runs: list[list[int]] = []
        for first, (length, n) in sorted(times.items()):
            if n >= copy:
                if runs and runs[-1][1] == first:
                    runs[-1][1] += length
                else:
                    runs.append([first, first + length])
        if runs == [[0, size]]:
            out.append(text)
            continue
        if spans is None:
            data = text.encode("utf-8", "surrogatepass")
            spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        out.append("\n".join(data[spans[a][0] : spans[z - 1][1]].decode("utf-8", "surrogatepass") for a, z in runs))
    return out


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """The mix as rows with the columns of `docs`: a document once for each time that the mix takes words of it, with those words.

    Documents that the mix doesn't take, those without words among them, don't occur. `length` is made anew.
    """
    names = docs.columns
    # written once, so that a row keeps its number whatever its splits are when it is read again
    marked = written(docs.withColumn("__uid", F.monotonically_increasing_id()))
    documents, places = mix(marked, key, source, text, uid="__uid", **options)
    use = places.groupBy("__uid").agg(F.collect_list(F.struct("first", "length")).alias("__parts"), F.sum("length").alias("__taken"))
    use = use.join(documents.select(F.col("__uid").alias("__of"), F.col("size").alias("__size")), F.col("__uid") == F.col("__of")).drop("__of", "__taken")
    rows = marked.join(use, "__uid").select(*names, "__parts", "__size")

    def make():
        def step(x: dict) -> dict:
            out = {n: [] for n in names}
            for k, t in enumerate(x[text]):
                for made in assembled(t, [(p["first"], p["length"]) for p in x["__parts"][k]], x["__size"][k]):
                    for n in names:
                        out[n].append(made if n == text else len(made) if n == length else x[n][k])
            return out

        return step

    return map_batches(rows, make, docs.schema)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest over every document: the words that the mix takes of it."""
    documents, places = mix(table(spark, sf_dir, "documents"))
    return taken(documents, places).select("doc_id", "size", "source_size", "target", "taken")
