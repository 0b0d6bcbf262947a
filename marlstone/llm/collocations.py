"""Phrase collocations by pivot partitioning.

Words are counted first. Each phrase belongs to its pivot, its rarest word: every occurrence of a word sends a fragment of
its piece, rewritten to what phrases with this pivot can use: up to three words before it that are more frequent, and up to
three after it that are no rarer, so that a phrase which holds its pivot twice belongs to the first of the two. Fragments meet by pivot;
a bucket of pivots is mined on its own and gives only phrases that hold their fragment's pivot. A pivot of very many
occurrences is dealt to several buckets, whose counts are added.

Words travel as 64-bit hashes. A table of at most 2^TABLE bytes, one for each slot of hashes, says how frequent a slot's
words are at most (0: none has LEAST occurrences), so what tasks hold doesn't grow with the number of words. Its steps,
then hashes, order words by rarity; any one order gives the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import give_back, table, written

#: Least occurrences and most words of a phrase; phrases of a language; steps of frequency in a factor of two; bits of the
#: table; words of a task's memo and count; tokens cut into fragments at once; occurrences of a bucket; fragments of a row.
LEAST, LONGEST, TOP, STEPS, TABLE, MEMO, TOKENS, BUCKET, ROW = 30, 4, 2000, 6, 24, 400_000, 2_000_000, 1 << 19, 512
#: Bytes that end a piece become a full stop, which stands alone between the words of two pieces.
STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
WORDS = ["w1", "w2", "w3", "w4"]
SEED, FAR = 42, np.iinfo(np.int32).max


def tokens(text: bytes) -> list[bytes]:
    """Words in order, and a full stop for each end of a piece. Lower-casing bytes changes A to Z alone."""
    return text.lower().translate(STOPS).replace(b".", b" . ").split()


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task's texts; the row with a null word counts all words."""
    seen: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            total = words.total()
            yield pa.record_batch({"lang": pa.array([lang] * (len(words) + 1), pa.string()), "word": pa.array([*words, None], pa.binary()).cast(pa.string()), "n": pa.array([*words.values(), total], pa.int64())})
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = seen.setdefault(lang, Counter())
            words.update(tokens(text))
            del words[b"."]
            if len(words) > MEMO:
                yield from out()
    yield from out()
    give_back()


def hashed(lang: Column, word: Column) -> Column:
    """The hash that a task's memo has for a word."""
    return F.xxhash64(F.concat(lang, F.lit("\0"), word))


def step_of(n: Column) -> Column:
    return (1 + F.least(F.lit(254), F.floor(F.lit(STEPS) * F.log2(n / LEAST)))).cast("int")


def steps_of(words: DataFrame, bits: int) -> np.ndarray:
    """The table: for each slot of hashes the greatest step of its words."""
    slots = words.groupBy(F.col("id").bitwiseAND((1 << bits) - 1).alias("slot")).agg(F.max(step_of(F.col("n"))).alias("step"))
    part = min(bits, 12)

    def filled(group: pa.Table) -> pa.Table:
        block = np.zeros(1 << part, np.uint8)
        slot = group.column("slot").to_numpy()
        block[slot & ((1 << part) - 1)] = group.column("step").to_numpy()
        return pa.table({"block": pa.array([int(slot[0]) >> part], pa.int64()), "bytes": pa.array([block.tobytes()], pa.binary())})

    out = np.zeros(1 << bits, np.uint8).reshape(-1, 1 << part)
    for r in slots.groupBy(F.shiftright("slot", part).alias("block")).applyInArrow(filled, "block long, bytes binary").collect():
        out[r.block] = np.frombuffer(r.bytes, np.uint8)
    return out.ravel()


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Memo(dict):
    """Word to number; number 0 is a word of too few occurrences or the end of a piece. `ids` and `steps` are by number."""

    def __init__(self, steps: np.ndarray, lang: str):
        super().__init__({b".": 0})
        self.table, self.lead, self.ids, self.steps = steps, lang.encode() + b"\0", [0], [0]

    def __missing__(self, word: bytes) -> int:
        at = xxhash.xxh64_intdigest(self.lead + word, SEED)
        step = int(self.table[at & (len(self.table) - 1)])
        self[word] = n = len(self.ids) if step else 0
        if step:
            self.ids.append(at)
            self.steps.append(step)
        return n


def fragments(numbers: np.ndarray, memo: Memo) -> tuple[np.ndarray, ...]:
    """(position, words before, words after) of every occurrence that has a phrase of its own."""
    ids, steps = np.array(memo.ids, np.uint64), np.array(memo.steps, np.uint8)
    rarity = np.empty(len(ids), np.int32)
    rarity[np.lexsort((ids, -steps.astype(np.int16)))] = np.arange(len(ids), dtype=np.int32)
    rarity[0] = FAR
    reach = LONGEST - 1
    r = np.full(len(numbers) + 2 * reach, FAR, np.int32)
    r[reach:-reach] = rarity[numbers]
    here = r[reach:-reach]
    before, after = np.zeros(len(here), np.uint8), np.zeros(len(here), np.uint8)
    left, right = here < FAR, here < FAR
    for k in range(1, reach + 1):
        left = left & (r[reach - k : len(r) - reach - k] < here)
        right = right & (r[reach + k : len(r) - reach + k] <= here)
        before += left
        after += right
    at = np.flatnonzero(before + after)
    return at, before[at], after[at]


def routed(batches: Iterator[pa.RecordBatch], steps: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, shape, words): fragments of pivots. A shape has the words before and after, and 16 where a pivot is dealt to several buckets."""
    memos: dict[str, Memo] = {}

    def out(lang: str, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        memo = memos[lang]
        at, before, after = fragments(numbers, memo)
        ids, pivots = np.array(memo.ids, np.uint64), numbers[at]
        parts = np.ceil(LEAST * 2.0 ** (np.array(memo.steps) / STEPS) / BUCKET).astype(np.uint64)[pivots]
        salt = np.arange(len(at), dtype=np.uint64) % np.maximum(parts, np.uint64(1))
        mixed = (ids[pivots] + salt * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, before, after, bucket = at[order], before[order], after[order], bucket[order]
        shape = before | after << 2 | (parts[order] > 1).astype(np.uint8) << 4
        lengths = before.astype(np.int64) + after + 1
        words = ids[numbers[flat(at - before, lengths)]]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        cuts = np.concatenate([np.arange(a, b, ROW) for a, b in zip(edges, [*edges[1:], len(at)], strict=True)]) if len(at) else edges
        stops = [*cuts[1:], len(at)]
        for k in range(0, len(cuts), 4096):
            some = list(zip(cuts[k : k + 4096], stops[k : k + 4096], strict=True))
            yield pa.record_batch({"bucket": pa.array(bucket[cuts[k : k + 4096]]), "shape": pa.array([shape[a:b].tobytes() for a, b in some], pa.binary()), "words": pa.array([words[ends[a] : ends[b]].tobytes() for a, b in some], pa.binary())})
        if len(memo) > MEMO:
            del memos[lang]

    held: dict[str, list] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if lang not in memos:
                memos[lang] = Memo(steps, lang)
            memo = memos[lang]
            words = tokens(text)
            held.setdefault(lang, []).append(np.fromiter(map(memo.__getitem__, words), np.int32, len(words)))
            held[lang].append(np.zeros(1, np.int32))
            sizes[lang] += len(words) + 1
            if sizes[lang] > TOKENS or len(memo) > MEMO:
                yield from out(lang, np.concatenate(held.pop(lang)))
                del sizes[lang]
    for lang, numbers in held.items():
        yield from out(lang, np.concatenate(numbers))
    give_back()


def counted(local: np.ndarray, size: int, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of its phrase for each start, a start for each phrase, its count): phrases of k words of `local`, which are below `size`."""
    code = local[starts]
    for j in range(1, k):
        code = np.unique(code, return_inverse=True)[1] if j > 1 else code
        code = code * size + local[starts + j]
    _, first, which, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    return which, starts[first], n


def phrases(shape: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, words, count) of the phrases that a bucket's fragments own.

    A pivot that is here alone has all its occurrences here, so its phrases below LEAST go, and what could only
    lengthen them goes before longer ones are counted.
    """
    before, after, shared = (shape & 3).astype(np.int64), (shape >> 2 & 3).astype(np.int64), shape >> 4 > 0
    pivot = np.cumsum(before + after + 1) - after - 1
    names, local = np.unique(words, return_inverse=True)
    for k in range(2, LONGEST + 1):
        lead = [np.flatnonzero((before >= a) & (after >= k - 1 - a)) for a in range(k)]
        rows, offset = np.concatenate(lead), np.repeat(np.arange(k), [len(x) for x in lead])
        if not len(rows):
            return
        which, start, n = counted(local, len(names), pivot[rows] - offset, k)
        part = np.zeros(len(n), bool)
        part[which[shared[rows]]] = True
        stay = part | (n >= LEAST)
        yield k, names[local[start[stay][:, None] + np.arange(k)]], n[stay]
        if k == 2:
            low = ~stay[which]
            before[rows[low & (offset == 1)]] = 0
            after[rows[low & (offset == 0)]] = 0


def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, w3, w4, a) of sorted buckets, one at a time; 0 stands for no word."""
    now, shapes, words = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        for k, ids, n in phrases(np.frombuffer(b"".join(shapes), np.uint8), np.frombuffer(b"".join(words), np.uint64)):
            columns = [pa.array(ids[:, j].view(np.int64) if j < k else np.zeros(len(n), np.int64)) for j in range(LONGEST)]
            if len(n):
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], names=[*WORDS, "a"])

    for batch in batches:
        for bucket, shape, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if bucket != now and shapes:
                yield from out()
                shapes, words = [], []
            now = bucket
            shapes.append(shape)
            words.append(some)
    if shapes:
        yield from out()
    give_back()


def inside(grams: DataFrame) -> DataFrame:
    """(s1, s2, s3, s4, longer): phrases within longer ones, and the count of the most frequent of these."""
    w, none = [F.col(c) for c in WORDS], F.lit(0).cast("long")
    sub = lambda *c: F.struct(*[x.alias(f"s{i + 1}") for i, x in enumerate([*c, *[none] * (LONGEST - len(c))])])
    three = F.array(sub(w[0], w[1]), sub(w[1], w[2]))
    four = F.array(sub(w[0], w[1]), sub(w[1], w[2]), sub(w[2], w[3]), sub(w[0], w[1], w[2]), sub(w[1], w[2], w[3]))
    parts = grams.filter("w3 != 0").select("a", F.explode(F.when(w[3] == 0, three).otherwise(four)).alias("s"))
    return parts.select("a", "s.*").groupBy("s1", "s2", "s3", "s4").agg(F.max("a").alias("longer"))


def kept_phrases(grams: DataFrame) -> DataFrame:
    """Phrases that aren't mostly part of a longer one. Products are decimals of 38 digits."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    joined = grams.join(inside(grams), [F.col(c) == F.col(f"s{i + 1}") for i, c in enumerate(WORDS)], "left")
    return joined.filter(F.col("longer").isNull() | (100 * big("longer") < 80 * big("a"))).select(*WORDS, "a")


def scored(grams: DataFrame, known: DataFrame) -> DataFrame:
    """Each phrase with l, r and score of its lowest-scoring cut; `known` has the counts of all words and phrases."""
    w, none = [F.col(c) for c in WORDS], F.lit(0).cast("long")
    whole = lambda lead, *c: [x.alias(f"{lead}{i + 1}") for i, x in enumerate([*c, *[none] * (LONGEST - len(c))])]
    cut = lambda k, *c: F.struct(F.lit(k).alias("k"), *whole("l", *w[:k]), *whole("r", *w[k:]))
    cuts = F.array(cut(1), F.when(w[2] != 0, cut(2)), F.when(w[3] != 0, cut(3)))
    rows = grams.select(*WORDS, "a", F.explode(F.array_compact(cuts)).alias("c")).select(*WORDS, "a", "c.*")
    for lead in ("l", "r"):
        part = known.select(*[F.col(c).alias(f"{lead}{i + 1}") for i, c in enumerate(WORDS)], F.col("a").alias(lead))
        rows = rows.join(part, [f"{lead}{i + 1}" for i in range(LONGEST)])
    score = F.expr("(2000000 * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    return rows.groupBy(*WORDS, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select(*WORDS, "a", "c.l", "c.r", "c.score")


def named(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The language and text of each phrase."""
    each = rows.select("*", F.posexplode(F.array(*WORDS)).alias("pos", "id")).filter("id != 0")
    back = each.join(words.select("id", "lang", "word"), "id").groupBy(*rows.columns)
    back = back.agg(F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return back.withColumn("phrase", F.array_join(F.col("w.word"), " ")).drop("w", *WORDS)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words.

    A null text has no words, a null language counts as `und`. Repeated rows count as often as they stand. Ties go by
    count, then by phrase in byte order. An empty table, or one without a phrase of LEAST occurrences, gives no rows.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    every = texts.mapInArrow(counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(f"word IS NULL OR n >= {LEAST}")
    every = written(every.withColumn("id", hashed(F.col("lang"), F.col("word"))))
    words, totals = every.filter("word IS NOT NULL"), every.filter("word IS NULL").select("lang", "n")
    size = words.agg(F.count("*").alias("words"), F.count_distinct("id").alias("ids")).first()
    if size.words != size.ids:
        raise RuntimeError("two words have one hash")
    total = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(TABLE, max(12, (8 * size.words).bit_length()))
    steps = spark.sparkContext.broadcast(steps_of(words, bits))
    buckets = 64 + total // BUCKET

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return routed(batches, steps.value, buckets)

    dealt = texts.mapInArrow(route, "bucket long, shape binary, words binary").repartition("bucket").sortWithinPartitions("bucket")
    grams = dealt.mapInArrow(mined, "w1 long, w2 long, w3 long, w4 long, a long").groupBy(*WORDS).agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)
    grams = written(grams)
    none = F.lit(0).cast("long")
    known = grams.unionByName(words.select(F.col("id").alias("w1"), none.alias("w2"), none.alias("w3"), none.alias("w4"), F.col("n").alias("a")))
    best = named(scored(kept_phrases(grams), known), words)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: each language's first 2,000 phrases."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, [w FOR w IN string_split_regex(p, '[\x20\x09]+') IF w <> ''] AS ws
    FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), grams AS (
    SELECT lang, k, list_slice(ws, i, i + k - 1) AS g
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)
), f AS (
    SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= {LEAST}
), n AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
), longer AS (
    SELECT lang, s AS g, max(a) AS longer FROM (
        SELECT lang, a, list_slice(g, i, i + m - 1) AS s
        FROM (SELECT lang, g, a, k, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m)
    ) GROUP BY lang, s
), kept AS (
    SELECT f.lang, f.k, f.g, f.a FROM f LEFT JOIN longer USING (lang, g) WHERE f.k > 1 AND (longer.longer IS NULL OR 100 * longer.longer < 80 * f.a)
), cuts AS (
    SELECT c.lang, c.g, c.a, c.cut, x.a AS l, y.a AS r, 2000000 * c.a // (x.a + y.a) AS score
    FROM (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM kept) c
    JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.cut) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.cut + 1, c.k)
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""


def brute_force(rows: list[tuple], least: int = LEAST, top: int = TOP) -> list[tuple]:
    """Rows of the result from (lang, text), by plain Python; for tests."""
    import re

    f: dict[str, Counter] = {}
    n: Counter = Counter()
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for lang, text in rows:
        of = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, LONGEST + 1):
                of.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        often = {g: a for g, a in of.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in often.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in often.items()):
                continue
            score, k = min((2000000 * a // (of[g[:k]] + of[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), of[g[:k]], of[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out
