"""Best-fit packing by a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import bisect
import math
import os
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import map_batches, table, written
from marlstone.llm.ranks import buckets_for, running

#: Tokens in a sequence, the id that ends a document, and the tokenizer's file.
CAPACITY, END, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Rounds of weights; step of a round; rate of the weights; times that the program runs over what rounding left; parts of
#: words in a generation that a worker remembers.
ROUNDS, STEP, RATE, TURNS, REMEMBERED = 24, 0.5, 0.5, 4, 150_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters of the Latin blocks that are composed already and have one small letter each.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c))
SMALL = "a-z" + "".join(sorted({c.lower() for c in LATIN}))
#: Texts of these characters alone are split here, as the tokenizer splits them once they are in small letters.
PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{LATIN}]*")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{SMALL}]+|[0-9]|[^\\t\\n\\r\\x20{SMALL}0-9]+")


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit numbers, equal to the tokenizer's own.

    The tokenizer cuts a text into parts (letters, one digit, other marks) and merges inside a part alone, so a
    text's ids are those of its parts; a part met before needs no second run. Two generations of parts are
    remembered. Texts with other characters, or with what may be a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.of, self.parts, self.before = Tokenizer.from_file(path), {}, {}
        # the same merges for parts between spaces, which are in small letters and need no further cutting
        self.merge = Tokenizer(self.of.model)
        self.merge.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.of.get_vocab_size(), dtype=bool)
        for token, i in self.of.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def raw(self, text: str) -> bytes:
        return np.array(self.of.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, met: set[str]) -> None:
        new = met - self.parts.keys()
        if len(self.parts) + len(new) > REMEMBERED:
            self.before, self.parts, new = self.parts, {}, met
        parts, before = self.parts, self.before
        known = new & before.keys()
        parts.update(zip(known, map(before.__getitem__, known), strict=True))
        new = list(new - known)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.array(self.merge.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(some):
                data = ids.tobytes()
                parts.update(zip(some, map(data.__getitem__, map(slice, [0, *stops[:-1].tolist()], stops.tolist())), strict=True))
            else:
                parts.update((c, self.raw(c)) for c in some)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        out, some, n = [b""] * len(texts), {}, 0
        for i, text in enumerate(texts):
            if text and PLAIN.fullmatch(text) and "<|" not in text:
                some[i] = PARTS.findall(text.lower())
                n += len(some[i])
            elif text:
                out[i] = self.raw(text)
            if n and (n > REMEMBERED // 2 or i + 1 == len(texts)):  # so many texts at once that their parts fit
                self.learn(set().union(*some.values()))
                get = self.parts.__getitem__
                for k, cut in some.items():
                    out[k] = b"".join(map(get, cut))
                some, n = {}, 0
        return out

    def __call__(self, text: str | None) -> bytes:
        return self.batch([text])[0]


@lru_cache(maxsize=2)
def ids_for(path: str) -> Ids:
    """One a worker process; Spark reuses its workers."""
    return Ids(path)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of at most `capacity` ids: key, piece, start, length, ids_crc32 (and `ids`, little-endian bytes).

    A null text is an empty one: its piece holds `end` alone. Only documents of more ids than that are cut.
    """
    path, stop = tokenizer, np.array([end], dtype="<u4").tobytes()

    def make():
        of = ids_for(path or tokenizer_path())

        def step(x: dict) -> dict:
            out = {c: [] for c in (key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
            for k, data in zip(x[key], of.batch(x["__text"]), strict=True):
                data += stop
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for c, v in ((key, k), ("piece", i), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part)), *[("ids", part)] * with_ids):
                        out[c].append(v)
            return out

        return step

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return map_batches(docs.select(key, F.col(text).alias("__text")), make, schema)


def priced(values: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: for each capacity up to `room`, the best value and the class taken last.

    values[c]: what a piece of class c (of c units) is worth; 0: none is left.
    """
    worth, last = np.where(values > 0, values, -np.inf), np.zeros(room + 1, dtype=np.int64)
    rest = np.zeros(room + 1)  # the best values from the largest capacity down, so that a capacity's candidates lie side by side
    for c in range(1, room + 1):
        at = room - c
        rest[at] = rest[at + 1]
        got = rest[at + 1 :] + worth[1 : c + 1]
        i = int(got.argmax())
        if got[i] > rest[at]:
            rest[at], last[c] = got[i], i + 1
    return rest[::-1], last


def filled(last: np.ndarray, room: int) -> Counter:
    out = Counter()
    while room > 0:
        if last[room]:
            out[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return out


def fractional(counts: np.ndarray, units: int) -> tuple[dict[tuple, float], float]:
    """The covering program min sum x_p, sum x_p a_pc >= n_c, by multiplicative weights with knapsack pricing; and a lower bound of it.

    Each round prices once; every class still short then gets the best configuration that holds it, in a share of what it
    lacks. A class's weight is multiplied by the more the less of it is covered, against the mean. Weights over the worth
    of the best configuration are a solution of the dual, so each round bounds the program from below.
    """
    n = counts.astype(float)
    have = np.flatnonzero(n)
    short, x = n.copy(), Counter()
    weights = (have / units) ** 1.15
    bound = float((n[have] * have).sum() / units)
    for r in range(ROUNDS):
        worth = np.zeros(units + 1)
        worth[have] = weights
        value, last = priced(worth, units)
        bound = max(bound, float((n[have] * weights).sum() / value[units]))
        open_ = short[have] > 1e-9
        if not open_.any():
            break
        if not open_.all():
            worth[have] = np.where(open_, weights, 0)
            _, last = priced(worth, units)
        share = 1.0 if r == ROUNDS - 1 else STEP
        for c in have[::-1]:
            if short[c] < 1e-9:
                continue
            pattern = filled(last, units - int(c))
            pattern[int(c)] += 1
            most = min(short[k] / a for k, a in pattern.items())
            amount = min(most, share * short[c] / pattern[int(c)])
            if amount > 1e-9:
                x[tuple(sorted(pattern.items(), reverse=True))] += amount
                for k, a in pattern.items():
                    short[k] -= amount * a
        lack = short[have] / n[have]
        weights = weights * np.exp(RATE * (lack - lack.mean()))
    return x, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, low, high, first sequence, sequences, copy0 offset, copies): where pieces number low to high of a length go."""
    return bounded_plan(histogram, capacity)[0]


def bounded_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """The plan, and a number of sequences that no plan can do without.

    Every length is a class of its own, so no room is lost to coarser ones. The program's solution is rounded down to whole sequences, again and again over what is left; best fit places
    what rounding leaves. Its size follows the lengths that occur, not the number of pieces.
    """
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v > 0}
    used, out, sequence = Counter(), [], 0

    def place(items: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, a in items:
            low = used[length]
            used[length] += a * times
            out.append((length, low, low + a * times, sequence, times, offset, a))
            offset += a * length
            left[length] -= a * times
            if not left[length]:
                del left[length]
        sequence += times

    if left.get(capacity):
        place([(capacity, 1)], left[capacity])
    full, least = sequence, 0.0
    for turn in range(TURNS):
        if not left:
            break
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for length, k in left.items():
            counts[length] = k
        before = sequence
        found, bound = fractional(counts, capacity)
        least = least if turn else bound
        for pattern, amount in sorted(found.items(), key=lambda p: -p[1]):
            times = min(int(amount), *[left.get(length, 0) // a for length, a in pattern])
            if times > 0:
                place(list(pattern), times)
        if sequence == before:
            break
    # best fit for the rest, longest first
    bins: dict[int, list[Counter]] = {}
    rooms: list[int] = []
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                one = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            else:
                room, one = capacity, Counter()
            one[length] += 1
            if room - length not in bins:
                bins[room - length] = []
                bisect.insort(rooms, room - length)
            bins[room - length].append(one)
    for same in list(bins.values()):
        for one in same:
            place(sorted(one.items(), reverse=True), 1)
    return out, full + math.ceil(least - 1e-6)


def pack(parts: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Rows with `length` (1 to capacity) get `sequence_id` and a gapless `offset`; other columns stay.

    The driver holds the histogram of lengths (at most `capacity` numbers) and the plan made from it; pieces are
    numbered within their length without one task for a length. Equal rows are interchangeable.
    """
    spark = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    rows = [tuple(map(int, r)) for r in plan(histogram, capacity)]
    places = spark.createDataFrame(rows, "__length long, __low long, __high long, __first long, __n long, __offset long, __copies long")
    counted = running(parts.withColumn("__one", F.lit(1)), "length", "__one", order, buckets_for(sum(histogram.values())), "__rank").drop("__one")
    # bounded: intervals follow the lengths that occur (at most `capacity`) and the fixed rounds
    hit = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high"))
    joined = counted.join(F.broadcast(places) if len(rows) < 200_000 else places, hit)
    nth = F.col("__rank") - F.col("__low")
    return joined.select(
        *parts.columns,
        (F.col("__first") + nth % F.col("__n")).alias("sequence_id"),
        (F.col("__offset") + F.floor(nth / F.col("__n")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences: null and empty texts too, repeated rows each, none of an empty table."""
    parts = written(pieces(docs, key, text, capacity, end, tokenizer))
    return pack(parts, [key, "piece", "ids_crc32"], capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every piece of every document, with its sequence and offset."""
    return pack_documents(table(spark, sf_dir, "documents"))
