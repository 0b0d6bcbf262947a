"""N-gram Jaccard join by signature trees.

A set's prefix, its rarest quarter of shingles and one more, meets that of every set similar enough. Each shingle that
prefixes of different sets share is the root of a tree of those sets: nodes hold the OR of their sets' bitmaps and the
range of their sizes. Two nodes are traversed together, and the pair goes when the greatest overlap that these allow is
below the least one asked for. Pairs of sets that the leaves leave group sets, and each group's own tree is traversed again with
its sets compared shingle by shingle, unless they are connected already; so a task returns fewer links than it has sets, however many pairs a group of copies has. No link
that connects anything is lost: prefixes and bounds are exact.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import give_back, map_batches, table, written
from marlstone.llm.components import components

#: Words in a shingle; similarity as a fraction; sets in a leaf; shingles of a block of a large root's sets and of the
#: small roots that share a task; 64-bit numbers that mark shingles; ids that are broadcast at most; bytes of input for a
#: bucket of prefixes; slices of rows from which a shingle is frequent; bins of sizes in a factor of BELOW / ABOVE.
WORDS, ABOVE, BELOW, LEAF, BLOCK, TOGETHER, WORDS_OF, SMALL, BUCKET, OFTEN, BINS = 5, 3, 4, 64, 1 << 21, 1 << 23, 1 << 21, 1_000_000, 16 << 20, 64, 4
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of a text: A-Z lowered, words between the six ASCII spaces.

    A word's hash is a difference of running sums of random numbers for bytes times powers of an odd number, divided
    by the power at which it starts; so no word is looked at by itself.
    """

    def __init__(self):
        rng = np.random.default_rng(20)
        self.byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.byte[ord("A") : ord("Z") + 1] = self.byte[ord("a") : ord("z") + 1]
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.power, self.back = self.powers(1 << 16)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(int(PRIME), -1, 1 << 64)
        out = np.full((2, n), 1, dtype=np.uint64)
        out[0, 1:], out[1, 1:] = PRIME, inverse
        return tuple(np.multiply.accumulate(out, axis=1))

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) if text else np.empty(0, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(self.space[data].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        if not len(edge):
            return np.empty(0, dtype=np.uint64)
        while len(data) > len(self.power):
            self.power, self.back = self.powers(2 * len(self.power))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=sums[1:])
        start, end = edge[::2], edge[1::2]
        ids = mixed((sums[end] - sums[start]) * self.back[start])
        n = min(WORDS, len(ids))
        out = np.full(len(ids) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = out * PRIME + ids[k : len(ids) - n + 1 + k]
        return np.unique(mixed(out))


def set_id(s: np.ndarray) -> int:
    """A set's fingerprint, signed; equal sets only share it."""
    total = s.sum(dtype=np.uint64, keepdims=True) * PRIME + np.uint64(len(s))
    return int(mixed(total).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """The set's size, its least shingle, then a bit for each hash modulo a power of two of four bits a shingle, so a longer map folds onto a shorter one."""
    width = width_of(len(s))
    out = np.zeros(width, dtype=np.uint8)
    out[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return len(s).to_bytes(8, "little") + s[:1].tobytes() + np.packbits(out, bitorder="little").tobytes()


def width_of(n: int) -> int:
    return 1 << max(6, (4 * n - 1).bit_length())


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps (the last axis) of a power of two of 64-bit numbers as narrower ones."""
    return np.bitwise_or.reduce(words.reshape(*words.shape[:-1], -1, to), axis=-2) if words.shape[-1] > to else words


def alike(n, m):
    """Whether sizes allow the similarity."""
    return BELOW * np.minimum(n, m) >= ABOVE * np.maximum(n, m)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if not alike(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return BELOW * both >= ABOVE * (len(a) + len(b) - both)


def bits_at(marks: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether a map of WORDS_OF 64-bit numbers has the bit of each hash."""
    return (marks[s & np.uint64(WORDS_OF - 1)] >> ((s >> np.uint64(21)) & np.uint64(63))) & np.uint64(1) == 1


def shared_shingles(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Two maps with a bit for each shingle, by its hash: those that prefixes of different sets share, and frequent ones.

    A slice of rows sends each shingle of its prefixes once, with 32 bits of its set's fingerprint (0: several sets), so a
    shingle that every set has costs one number a slice. A frequent shingle occurs in OFTEN slices or more. The maps have
    a fixed size however many shingles there are; any order and any split is exact, so a bit that two shingles share does
    no harm.
    """
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def make():
        of = Shingles()

        def step(x: dict) -> dict:
            sets = [s for s in map(of, x["__t"]) if len(s)]
            out = {c: [] for c in ("bucket", "shingles", "marks")}
            if sets:
                tokens = np.concatenate([s[: reach(len(s))] for s in sets])
                mark = np.repeat(np.array([set_id(s) & 0xFFFFFFFF | 1 for s in sets], dtype=np.uint32), [reach(len(s)) for s in sets])
                tokens, mark = merged(tokens, mark)[:2]
                bucket = (tokens >> shift).astype(np.int64)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for a, z in zip(starts, [*starts[1:], len(bucket)], strict=True):
                    for c, v in (("bucket", int(bucket[a])), ("shingles", tokens[a:z].tobytes()), ("marks", mark[a:z].tobytes())):
                        out[c].append(v)
            return out

        return step

    def find(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=kind)
        tokens, mark, slices = merged(read("shingles", np.uint64), read("marks", np.uint32))
        at, bit = tokens & np.uint64(WORDS_OF - 1), np.uint64(1) << ((tokens >> np.uint64(21)) & np.uint64(63))
        words = {}
        for name, some in (("shared", mark == 0), ("often", slices >= OFTEN)):
            words[name] = np.zeros(WORDS_OF, dtype=np.uint64)
            np.bitwise_or.at(words[name], at[some], bit[some])
        w = np.flatnonzero(words["shared"] | words["often"])
        return pa.table({"w": w, **{k: v[w].view(np.int64) for k, v in words.items()}})

    packed = map_batches(docs.select("__t"), make, "bucket bigint, shingles binary, marks binary")
    found = packed.groupBy("bucket").applyInArrow(find, "w bigint, shared bigint, often bigint")
    table_ = found.groupBy("w").agg(F.bit_or("shared").alias("shared"), F.bit_or("often").alias("often")).toArrow()
    out = np.zeros((2, WORDS_OF), dtype=np.uint64)
    for i, c in enumerate(("shared", "often")):
        out[i, table_.column("w").to_numpy()] = table_.column(c).to_numpy().view(np.uint64)
    del table_
    give_back()
    return out[0], out[1]


def merged(tokens: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, sorted; the mark that all of a token's rows have, 0 if they differ; a token's rows."""
    order = np.argsort(tokens, kind="stable")
    tokens, mark = tokens[order], mark[order]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, dtype=np.int64)
    if not len(start):
        return tokens, mark, start
    low, high = np.minimum.reduceat(mark, start), np.maximum.reduceat(mark, start)
    return tokens[start], np.where(low == high, low, np.uint32(0)), np.diff(np.append(start, len(tokens)))


def reach(n: int) -> int:
    """Shingles of the prefix of a set of n: any two similar sets' prefixes share one."""
    return n - -(-ABOVE * n // BELOW) + 1


def prefix(s: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """The first quarter of a set and one more, in an order that puts common shingles last."""
    if common is not None:
        often = bits_at(common, s)
        return np.concatenate([s[~often], s[often]])[: reach(len(s))]
    return s[: reach(len(s))]


def postings(docs: DataFrame, common: np.ndarray | None, often: np.ndarray | None, buckets: int) -> DataFrame:
    """Prefixes of all sets, packed by bucket: (bucket, shingles, counts, sids, sizes).

    A bucket is the shingle's top bits. Frequent shingles are dealt by their sets instead, over as many buckets more, so
    no bucket holds a hot shingle whole.
    """
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def make():
        of = Shingles()

        def step(x: dict) -> dict:
            seen, parts = set(), []
            for t in x["__t"]:
                s = of(t)
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    parts.append((i, len(s), np.sort(prefix(s, common))))
            out = {c: [] for c in ("bucket", "shingles", "counts", "sids", "sizes")}
            if parts:
                which = np.concatenate([np.full(len(p), k) for k, (_, _, p) in enumerate(parts)])
                tokens = np.concatenate([p for _, _, p in parts])
                sids, sizes = np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.int32)
                bucket = (tokens >> shift).astype(np.int64)
                if often is not None:
                    bucket = np.where(bits_at(often, tokens), buckets + (sids[which].view(np.uint64) % np.uint64(buckets)).astype(np.int64), bucket)
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for a, z in zip(starts, [*starts[1:], len(order)], strict=True):
                    mine = order[a:z]
                    docs_, counts = np.unique(which[mine], return_counts=True)
                    for c, v in (("bucket", int(bucket[mine[0]])), ("shingles", tokens[mine].tobytes()), ("counts", counts.astype(np.int32).tobytes()), ("sids", sids[docs_].tobytes()), ("sizes", sizes[docs_].tobytes())):
                        out[c].append(v)
            return out

        return step

    return map_batches(docs.select("__t"), make, "bucket bigint, shingles binary, counts binary, sids binary, sizes binary")


def roots(packed: DataFrame, buckets: int) -> DataFrame:
    """(g, sid, n): the sets under each shingle that two or more different sets share.

    Roots of a bucket that hold the same sets are one. A frequent shingle's sets come from many buckets, so each gives what it has.
    """

    def find(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=kind)
        split = t.column("bucket")[0].as_py() >= buckets
        tokens, counts = read("shingles", np.uint64), read("counts", np.int32)
        sid, n = np.repeat(read("sids", np.int64), counts), np.repeat(read("sizes", np.int32), counts)
        order = np.lexsort((sid, tokens))
        tokens, sid, n = tokens[order], sid[order], n[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sid[1:] != sid[:-1])
        tokens, sid, n = tokens[new], sid[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        size = np.diff(np.append(start, len(tokens)))
        keep = np.full(len(start), split)
        if not split:
            mark = np.add.reduceat(mixed(sid.view(np.uint64)), start) + size.astype(np.uint64) * PRIME
            keep[np.unique(mark, return_index=True)[1]] = True
            keep &= size > 1
        rows = np.repeat(keep, size)
        return pa.table({"g": tokens.view(np.int64)[rows], "sid": sid[rows], "n": n[rows]})

    return packed.groupBy("bucket").applyInArrow(find, "g bigint, sid bigint, n int")


class Tree:
    """A signature tree of a root's sets, ordered by size and then by least shingle so that copies lie together.

    A node is (parts, positions, bitmaps, OR bitmap, least size, greatest size, slack); leaves hold LEAF sets and their
    bitmaps, all of one width, as a long set folded to a short one's width would seem similar to anything. A node's width
    is that of its smallest set: four bits a shingle. Slack is the most shingles of a set beyond its bits; an overlap is
    at most the common bits and the slack of the narrower side.
    """

    def __init__(self, maps: list[bytes]):
        maps = [np.frombuffer(m, dtype=np.uint64) for m in maps]
        self.n = np.array([m[0] for m in maps], dtype=np.int64)
        width = np.array([len(m) for m in maps])
        order = np.lexsort((np.array([m[1] for m in maps]), np.floor(np.log(self.n) * 8), width))
        of_one = np.split(order, np.flatnonzero(np.diff(width[order])) + 1)
        leaves = [self.leaf(own[a : a + LEAF], maps) for own in of_one for a in range(0, len(own), LEAF)]
        while len(leaves) > 1:
            leaves = [self.over(leaves[a : a + 2]) for a in range(0, len(leaves), 2)]
        self.top = leaves[0]

    def leaf(self, at: np.ndarray, maps: list[np.ndarray]) -> tuple:
        n = self.n[at]
        width = width_of(int(n.min())) // 64
        bits = np.array([folded(maps[i][2:], width) for i in at])
        return (), at, bits, np.bitwise_or.reduce(bits, axis=0), int(n.min()), int(n.max()), int((n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)).max())

    def over(self, parts: list[tuple]) -> tuple:
        if len(parts) == 1:
            return parts[0]
        width = min(len(p[3]) for p in parts)
        slack = max(p[6] if len(p[3]) == width else self.slack(p, width) for p in parts)
        return tuple(parts), None, None, np.bitwise_or.reduce([folded(p[3], width) for p in parts], axis=0), min(p[4] for p in parts), max(p[5] for p in parts), slack


    def slack(self, node: tuple, width: int) -> int:
        if node[0]:
            return max(self.slack(p, width) for p in node[0])
        return int((self.n[node[1]] - np.bitwise_count(folded(node[2], width)).sum(axis=1, dtype=np.int64)).max())


def apart(x: tuple, y: tuple) -> bool:
    """No set of node x can be similar to one of node y: by their sizes, or by the greatest overlap that their bitmaps allow."""
    if BELOW * x[5] < ABOVE * y[4] or BELOW * y[5] < ABOVE * x[4]:
        return True
    if len(x[3]) > len(y[3]):
        x, y = y, x
    common = int(np.bitwise_count(x[3] & folded(y[3], len(x[3]))).sum())
    return (ABOVE + BELOW) * min(x[5], y[5], common + x[6]) < ABOVE * (x[4] + y[4])


def possible(x: tuple, y: tuple, left: Tree, right: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Of two leaves: which pairs of sets may be similar by their bitmaps, and the greatest overlaps that these allow."""
    width = min(x[2].shape[1], y[2].shape[1])
    a, b = folded(x[2], width), folded(y[2], width)
    n, m = left.n[x[1]], right.n[y[1]]
    most = np.zeros((len(n), len(m)), dtype=np.int64)
    for at in range(0, width, 64):  # bounded memory, however long the sets are
        most += np.bitwise_count(a[:, None, at : at + 64] & b[None, :, at : at + 64]).sum(axis=2, dtype=np.int64)
    most += np.minimum((n - np.bitwise_count(a).sum(axis=1, dtype=np.int64))[:, None], (m - np.bitwise_count(b).sum(axis=1, dtype=np.int64))[None, :])
    np.minimum(most, np.minimum(n[:, None], m[None, :]), out=most)
    may = (ABOVE + BELOW) * most >= ABOVE * (n[:, None] + m[None, :])
    if left is right and x is y:
        may &= np.tri(len(n), k=-1, dtype=bool)
    return may, most


class Groups:
    """Union-find over fingerprints."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.find(x)] = self.find(y)


def traversed(left: Tree, right: Tree):
    """Dual traversal: the pairs of leaves that are left; pairs of nodes that are apart go whole."""
    same, todo = left is right, [(left.top, right.top)]
    while todo:
        x, y = todo.pop()
        if apart(x, y):
            continue
        if not x[0] and not y[0]:
            yield x, y
        elif same and x is y:
            todo += [(p, q) for k, p in enumerate(x[0]) for q in x[0][: k + 1]]
        elif x[0] and (not y[0] or x[5] - x[4] >= y[5] - y[4]):
            todo += [(p, y) for p in x[0]]
        else:
            todo += [(x, q) for q in y[0]]


def linked(left: Tree, right: Tree, sids: tuple, groups: Groups, sets: tuple | None = None) -> list[tuple[int, int]]:
    """Pairs (fingerprints) of similar sets of two trees, enough of them to connect what `groups` hasn't connected yet.

    Pairs that the leaves' bitmaps leave are compared by their shingles (`sets`), those likeliest to be similar first,
    unless they are connected already; without `sets`, they count as they are.
    """
    out = []
    for x, y in traversed(left, right):
        mine, other = (np.array([groups.find(of[i]) for i in node[1]]) for of, node in zip(sids, (x, y), strict=True))
        apart_ = mine[:, None] != other[None, :]
        if not apart_.any():
            continue
        may, most = possible(x, y, left, right)
        at = np.nonzero(may & apart_)
        first = np.argsort(-(most[at] / (left.n[x[1][at[0]]] + right.n[y[1][at[1]]])), kind="stable")
        for i, j in zip(x[1][at[0][first]].tolist(), y[1][at[1][first]].tolist(), strict=True):
            u, v = sids[0][i], sids[1][j]
            if groups.find(u) != groups.find(v) and (sets is None or links(sets[0][i], sets[1][j])):
                groups.join(u, v)
                out.append((min(u, v), max(u, v)))
    return out


def little(df: DataFrame) -> DataFrame:
    """`df`, written; broadcast if it was counted to have SMALL rows at most, so that what it joins needs no shuffle of its own."""
    df = written(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def one_row_each(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, __of): the least key of each set of `members`."""
    return rows.select("sid", "__id").join(members.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("__id").alias("__of"))


def held_texts(docs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, s): a compressed text of each set of `members`, from one document of each.

    A text takes a fraction of the bytes of its shingles' hashes, which don't compress; who gets it makes its set again.
    """
    ids = little(one_row_each(rows, members).select("__of").distinct())

    def make():
        of, pack = Shingles(), zstandard.ZstdCompressor()

        def step(x: dict) -> dict:
            sets = [of(t) for t in x["__t"]]
            return {"sid": [set_id(s) if len(s) else None for s in sets], "s": [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in x["__t"]]}

        return step

    return map_batches(docs.join(ids, F.col("__id").eqNullSafe(F.col("__of")), "left_semi").select("__t"), make, "sid bigint, s binary")


def size_bin() -> Column:
    """Sets of similar sizes lie in bins at most BINS + 1 apart."""
    return F.floor(BINS * F.log("n") / F.log(F.lit(BELOW / ABOVE))).cast("int")


def dealt(members: DataFrame, per: DataFrame) -> DataFrame:
    """(k, p, q, g, sid, part): the sets of each group g that tasks (k, p, q) traverse; `members` have g, sid, n, `per` g, w (its shingles) and lo.

    Groups with the same `lo` share a task. A group of more than BLOCK shingles is cut by size into bins, and these into
    blocks by hash; here a block meets itself alone.
    """
    zero = F.lit(0).cast("bigint")
    per = written(per.join(per.groupBy("lo").agg(F.sum("w").alias("lo_w")), "lo"))
    sums = per.agg(F.sum(F.when(F.col("w") <= BLOCK, F.col("w")))).first()[0] or 0
    groups = 1 << max(4, (sums // TOGETHER).bit_length())
    small = per.filter(F.col("w") <= BLOCK).select("g", F.pmod(F.xxhash64(F.when(F.col("lo_w") <= TOGETHER, F.col("lo")).otherwise(F.col("g"))), F.lit(groups)).alias("k"))
    under = members.join(small, "g").select("k", zero.alias("p"), zero.alias("q"), "g", "sid", zero.alias("part"))
    large = members.join(per.filter(F.col("w") > BLOCK).select("g"), "g").withColumn("out", F.lit(True))
    return written(under.unionByName(blocks_met(large, alone=True)))


def blocks_met(large: DataFrame, alone: bool = False) -> DataFrame:
    """The same rows for large groups (g, sid, n, out): blocks of near bins meet, but for two of sets that aren't `out`; `alone`: each meets itself."""
    zero = F.lit(0).cast("bigint")
    large = large.withColumn("bin", size_bin())
    # a block's number: its bin, whether its sets are out, then its place in the bin
    sizes = large.groupBy("g", "bin", "out").agg(F.ceil(F.sum("n") / (BLOCK // 2)).alias("n_of"))
    block = lambda b, out, i: (b.cast("bigint") * 2 + out.cast("int")) * (1 << 32) + i
    placed = large.join(sizes, ["g", "bin", "out"]).withColumn("part", block(F.col("bin"), F.col("out"), F.pmod(F.xxhash64("sid"), F.col("n_of"))))
    if alone:
        return placed.select(F.col("g").alias("k"), F.col("part").alias("p"), F.col("part").alias("q"), "g", "sid", "part")
    other = sizes.select("g", F.col("bin").alias("other"), F.col("out").alias("other_out"), F.col("n_of").alias("of"))
    meets = sizes.join(other, "g").filter((F.abs(F.col("bin") - F.col("other")) <= BINS + 1) & (F.col("out") | F.col("other_out")))
    meets = meets.groupBy("g", "bin", "out").agg(F.collect_list(F.struct("other", "other_out", "of")).alias("others"))
    big = placed.join(meets, ["g", "bin", "out"]).withColumn("o", F.explode("others"))
    big = big.withColumn("o", F.explode(F.transform(F.sequence(zero, F.col("o.of") - 1), lambda i: block(F.col("o.other"), F.col("o.other_out"), i))))
    return big.select(F.col("g").alias("k"), F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "g", "sid", "part")


def classed(large: DataFrame, links: DataFrame) -> DataFrame:
    """`large` (g, sid, n) with `c`, the class of each set by the links between such sets."""
    ids = little(large.select("sid").distinct())
    among = links.join(ids.withColumnRenamed("sid", "a"), "a", "left_semi").join(ids.withColumnRenamed("sid", "b"), "b", "left_semi")
    found = little(components(among.select("a", "b")).withColumnRenamed("c", "of"))
    return written(large.join(found, F.col("sid") == F.col("v"), "left").select("g", "sid", "n", F.coalesce("of", "sid").alias("c")))


def meetings(members: DataFrame, per: DataFrame, what: DataFrame, name: str) -> DataFrame:
    """Links that connect the sets of all groups.

    A large group's blocks are traversed alone first. One set for each class then found meets those of the group's other
    classes, if they fit a block. What is still apart from the group's heaviest class meets all blocks; sets that are
    connected already never meet again. So a set of a group of copies is sent about twice, however many blocks the group has.
    """
    links = written(traversals(dealt(members, per), what, name))
    large = written(members.join(per.filter(F.col("w") > BLOCK).select("g"), "g").select("g", "sid", "n"))
    if not large.take(1):
        return links
    own = classed(large, links)
    heads = written(own.groupBy("g", "c").agg(F.min_by(F.struct("sid", "n"), "sid").alias("h")).select("g", "h.sid", "h.n"))
    fit = heads.groupBy("g").agg(F.sum("n").alias("w"), F.count("*").alias("f")).filter((F.col("w") <= BLOCK) & (F.col("f") > 1)).select("g", "w", F.col("g").alias("lo"))
    links = written(links.unionByName(traversals(dealt(heads.join(fit.select("g"), "g"), fit), what, name)))
    own = classed(large, links)
    main = own.groupBy("g", "c").agg(F.sum("n").alias("w")).groupBy("g").agg(F.max_by("c", F.struct("w", "c")).alias("main"), F.count("*").alias("classes"))
    apart = own.join(main.filter("classes > 1"), "g").select("g", "sid", "n", (F.col("c") != F.col("main")).alias("out"))
    return links.unionByName(traversals(written(blocks_met(apart)), what, name)).distinct()


def met_under(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: g, sid, n; per: g, lo, w): the sets of the roots that have anything to compare.

    Copies have many roots in common, so a root goes with others of the same least set, `lo`.
    """
    per = found.groupBy("g").agg(F.count("*").alias("f"), F.min("sid").alias("lo"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"))
    # roots of different buckets that hold the same sets are one
    per = written(per.filter("f > 1").groupBy("x", "y", "f").agg(F.min("g").alias("g"), F.first("lo").alias("lo"), F.first("w").alias("w")).select("g", "lo", "w"))
    # a set without another in the bins around its own has no partner under this root
    all_ = written(found.join(per.select("g"), "g").withColumn("bin", size_bin()))
    around = all_.groupBy("g", "bin").agg(F.count("*").alias("f")).withColumn("bin", F.explode(F.sequence(F.col("bin") - BINS - 1, F.col("bin") + BINS + 1)))
    around = around.groupBy("g", "bin").agg(F.sum("f").alias("f")).filter("f > 1").select("g", "bin")
    # Sets that share this root and the one before it meet there; bounded windows: a set has no more roots than its
    # prefix has shingles. A root whose sets all share the one before it has nothing to compare.
    before = F.lag("g").over(Window.partitionBy("sid").orderBy("g"))
    members = written(all_.join(around, ["g", "bin"]).select("g", "sid", "n", before.alias("before")))
    fresh = members.groupBy("g").agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.count("before").alias("k"), F.count("*").alias("f"))
    per = written(per.join(fresh.filter("f > 1 AND (k < f OR lo < hi)").select("g"), "g", "left_semi"))
    return members.select("g", "sid", "n"), per


def traversals(met: DataFrame, what: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) that connect the sets of each task's groups: by bitmaps (`bits` of `what`) or by whole sets (made of the texts `s`).

    A set's data is sent once a task. A task returns fewer pairs than it has sets.
    """
    sent = what.join(little(met.select("k", "p", "q", "sid").distinct()), "sid")
    full = met.withColumn(name, F.lit(None).cast("binary")).unionByName(sent, allowMissingColumns=True)

    def traverse(t: pa.Table) -> pa.Table:
        own = t.filter(pa.compute.is_valid(t.column(name)))
        of = dict(zip(own.column("sid").to_pylist(), own.column(name).to_pylist(), strict=True))
        if name == "s":
            make, unpack = Shingles(), zstandard.ZstdDecompressor()
            of = {i: make(unpack.decompress(x).decode("utf-8", "surrogatepass")) for i, x in of.items()}
        rest = t.filter(pa.compute.is_null(t.column(name))).select(["g", "sid", "part"]).sort_by("g")
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        g, sid, part = (rest.column(c).to_numpy() for c in ("g", "sid", "part"))
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, dtype=np.int64)
        groups, out = Groups(), []
        for a, z in zip(start, [*start[1:], len(g)], strict=True):
            both = []
            for k in [p] if p == q else [p, q]:
                sids = sid[a:z][part[a:z] == k].tolist()
                sets = [of[x] for x in sids] if name == "s" else None
                both.append((Tree([of[x] for x in sids] if sets is None else [bitmap(x) for x in sets]) if sids else None, sids, sets))
            (x, xs, xv), (y, ys, yv) = both[0], both[-1]
            if x and y:
                out += linked(x, y, (xs, ys), groups, (xv, yv) if name == "s" else None)
        del own, of
        give_back()
        return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64())})

    return full.groupBy("k", "p", "q").applyInArrow(traverse, "a bigint, b bigint").distinct()


def connected(found: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between sets, enough of them to connect all that links connect.

    A first traversal, of the roots' trees by bitmaps alone, groups the sets that may be similar; similar ones are in one
    group. A second one, of a tree for each group, compares whole sets. So a set is sent whole once, unless its group is large.
    """
    members, per = met_under(found)
    one = little(one_row_each(rows, members).withColumnRenamed("sid", "__sid"))
    maps = rows.join(one, (F.col("sid") == F.col("__sid")) & F.col("__id").eqNullSafe(F.col("__of")), "left_semi").select("sid", "bits")
    groups = written(components(written(meetings(members, per, maps, "bits"))))
    sizes = rows.filter("sid IS NOT NULL").groupBy(F.col("sid").alias("v")).agg(F.min("n").alias("n"))
    members = written(groups.join(sizes, "v").select(F.col("c").alias("g"), F.col("v").alias("sid"), "n"))
    per = members.groupBy("g").agg(F.sum("n").alias("w")).withColumn("lo", F.col("g"))
    return meetings(members, per, held_texts(docs, rows, members), "s")


def buckets_of(docs: DataFrame) -> int:
    """Buckets of prefixes in proportion to the input's bytes."""
    spark = docs.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get("spark.sql.files.maxPartitionBytes")).removesuffix("B").removesuffix("b") or "128m")
    return 1 << max(5, (docs.rdd.getNumPartitions() * size // BUCKET).bit_length())


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(__id, th, n, c, m) of every row: key, hash of its text, shingles, class and the class's least key; c is null without shingles."""
    docs = docs.select(F.col(key).alias("__id"), F.col(text).alias("__t"), F.xxhash64(text).alias("th"))
    kind = docs.schema["__id"].dataType.simpleString()

    def make():
        of = Shingles()

        def step(x: dict) -> dict:
            sets = [of(t) for t in x["__t"]]
            return {"__id": x["__id"], "th": x["th"], "sid": [set_id(s) if len(s) else None for s in sets], "n": [len(s) for s in sets], "bits": [bitmap(s) if len(s) else None for s in sets]}

        return step

    rows = written(map_batches(docs, make, f"__id {kind}, th bigint, sid bigint, n bigint, bits binary"))
    docs = docs.drop("th")
    # shingles that prefixes share in plain order are common; with these last, few prefixes but those of copies meet
    buckets = buckets_of(docs)
    common, often = shared_shingles(docs, buckets)
    found = written(roots(postings(docs, common, often, buckets), buckets))
    # the driver needs the maps no more, and functions that hold them are in cycles
    del common, often
    gc.collect()
    give_back()
    comps = written(components(written(connected(found, docs, rows))))
    whole = rows.join(comps, F.col("sid") == F.col("v"), "left").select("__id", "th", "n", F.coalesce("c", "sid").alias("c"))
    least = whole.filter("c IS NOT NULL").groupBy("c").agg(F.min("__id").alias("m")).withColumnRenamed("c", "d")
    joined = whole.filter("c IS NOT NULL").join(least, F.col("c") == F.col("d")).select("__id", "th", "n", "c", "m")
    alone = whole.filter("c IS NULL").select("__id", "th", "n", "c", F.col("__id").alias("m"))
    return joined.unionByName(alone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component (the least key that it reaches by links, its own included).

    A null or empty text, or one of white space, has no shingles and is linked with nothing. Equal texts are one set;
    repeated rows are copies. An empty table gives an empty one. Other columns aren't read.
    """
    return classes(docs, key, text).select(F.col("__id").alias(key), F.col("n").alias("n_shingles"), F.col("m").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, one of each class: that of the least key, and of its rows that of the least text hash.

    Rows go, not keys: a row of another text stays though its key has a row that goes. Repeated rows of a key and text are
    one. A null key comes after all others. Rows without shingles stay. An empty table gives an empty one.
    """
    found = written(classes(docs, key, text))
    rows = found.groupBy("__id", "th", "c", "m").agg(F.count("*").alias("k"))
    first = rows.filter("c IS NOT NULL AND __id <=> m").groupBy(F.col("c").alias("d")).agg(F.min("th").alias("kept"), F.count("*").alias("of"))
    other = rows.filter("c IS NOT NULL AND NOT __id <=> m").select("__id", "th")
    several = rows.filter("c IS NOT NULL AND __id <=> m").join(first.filter("of > 1"), F.col("c") == F.col("d")).filter("th != kept").select("__id", "th")
    gone = little(other.unionByName(several).select(F.col("__id").alias("__gone"), F.col("th").alias("__th")))
    twice = little(rows.filter("k > 1").select(F.col("__id").alias("__twice"), F.col("th").alias("__th")))
    same = lambda ids: docs[key].eqNullSafe(F.col(ids)) & (F.xxhash64(docs[text]) == F.col("__th"))
    left = docs.join(gone, same("__gone"), "left_anti")
    if not twice.take(1):
        return left
    again = left.join(twice, same("__twice"), "left_semi").dropDuplicates([key, text])
    return left.join(twice, same("__twice"), "left_anti").unionByName(again)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: shingles and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(texts: dict) -> dict:
    """key -> (n_shingles, component) by comparing all pairs of true shingle sets; for tests."""
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset(tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))) if w else frozenset()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by: dict = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}
