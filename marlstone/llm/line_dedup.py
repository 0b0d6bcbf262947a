"""Line dedup by levelled sorted runs.

Batches of documents come in falling order of their ids. A batch gives one record for each line hash: in how many of its
documents, and the largest of them. Its records merge-anti-join the runs' settled hashes (those of LEAST documents or
more: all that is still to know of them is known) and the rest becomes a run of level 0. Two runs of a level are merged
into one of the next. Runs are tables bucketed and sorted by hash, so that neither a merge nor an anti-join shuffles
them. After the last batch the merged runs say which lines go, and documents drop them by position.

DataFrame functions only. Hashes have 128 bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table
from marlstone.session import shared_dir

#: Code points of a key, documents from which it is dropped, batches of a table, keys that are joined by broadcast at most.
CHARS, LEAST, BATCHES, HOT = 20, 3, 4, 2000
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NONE = -(2**63)
KEY = ["h1", "h2"]


def key_of(line: Column) -> Column:
    """A stripped line's key: A to Z in lower case. Text of one byte a character takes the quick way."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def stripped(line: Column) -> Column:
    """White space goes at both ends; lines without any there, most of them, aren't searched for it."""
    codes = [ord(c) for c in SPACES]
    ends = F.ascii(line).isin(codes) | F.ascii(F.substring(line, -1, 1)).isin(codes)
    return F.when(ends, F.btrim(line, F.lit(SPACES))).otherwise(line)


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that part a table into about equal batches."""
    at = docs.agg(F.percentile_approx("doc", [k / parts for k in range(1, parts)], 1000)).first()[0]
    return sorted(set(at or []))


def lines_of(docs: DataFrame, parts: int) -> DataFrame:
    """(doc, t, pos, h1, h2, batch) of every line with a key of CHARS or more, written by batch; batch 0 has the largest ids."""
    rows = docs.select("doc", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a key has as many code points as its stripped line, so the filter needs no key
    rows = rows.filter(F.length(stripped(F.col("line"))) >= CHARS).select("doc", "t", "pos", key_of(stripped(F.col("line"))).alias("key"))
    cuts = bounds(docs, parts)
    batch = sum((-(F.col("doc") > cut).cast("int") for cut in cuts), F.lit(len(cuts)))
    path = f"{shared_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    out = rows.select("doc", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch.alias("batch"))
    out.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


class Runs:
    """Levels of sorted runs of (h1, h2, n, top): in how many documents a line is, and the largest of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def saved(self, run: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        sink = run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        sink.option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in sorted(self.levels) for name in self.levels[level]]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One record for each hash of several runs: a merge join of sorted buckets after another."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select(*KEY, F.col("n").alias("n_b"), F.col("top").alias("top_b"))
            out = out.join(other.hint("merge"), KEY, "full").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.greatest("top", "top_b").alias("top"))
        return out

    def add(self, lines: DataFrame) -> None:
        """A batch whose ids are all below those of the batches before."""
        held = lines.groupBy("doc", *KEY).agg(F.lit(1).alias("one"))
        fresh = held.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("top"))
        for run in self.runs():
            fresh = fresh.join(run.filter(F.col("n") >= LEAST).select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels.setdefault(0, []).append(self.saved(fresh))
        level = 0
        while len(self.levels[level]) == 2:
            pair = self.levels.pop(level)
            self.levels.setdefault(level, [])
            self.levels.setdefault(level + 1, []).append(self.saved(self.merged([self.spark.table(x) for x in pair])))
            self.dropped(pair)
            level += 1

    def frequent(self) -> DataFrame:
        return self.merged(self.runs()).filter(F.col("n") >= LEAST)

    def dropped(self, names: list[str]) -> None:
        """Runs that are merged go, files too: what was made of them has been written."""
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc, t, gone): the positions that a text loses.

    A hash that a 2000th of all lines have is one of 2,000 at most, so these are broadcast; the rest is joined by hash.
    """
    share = lines.count() // HOT
    hot = frequent.filter(F.col("n") > share).select(*KEY, F.col("top").alias("hot_top"))
    tagged = lines.join(F.broadcast(hot), KEY, "left")
    often = tagged.filter(F.col("doc") < F.col("hot_top")).select("doc", "t", "pos")
    rare = tagged.filter("hot_top IS NULL").join(frequent.filter(F.col("n") <= share).select(*KEY, "top"), KEY)
    rare = rare.filter(F.col("doc") < F.col("top")).select("doc", "t", "pos")
    return often.unionByName(rare).groupBy("doc", "t").agg(F.collect_set("pos").alias("gone"))


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """Per row: key, n_lines, n_dropped, kept (its text without the lines that go).

    A key of CHARS code points or more found in LEAST documents or more loses all its lines except those of the largest id
    that holds it. A null text is an empty one, of one empty line. Rows of the same id are one document: what it keeps, all
    its rows keep. A null id is an id below all others. Empty tables give empty ones; other columns aren't read.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines, runs = lines_of(rows, batches), Runs(docs.sparkSession)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k).select("doc", *KEY))
    gone = dropped_lines(lines, runs.frequent())
    joined = rows.withColumn("t", F.xxhash64("text")).join(gone, ["doc", "t"], "left")
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1

    def without(whole: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(whole, i)), "\n")

    # the text is split once, as an element of an array that the lambda binds
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n")), without), F.lit(0)))
    return joined.select(F.col("id").alias(key), count.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: lines before, lines dropped, and the digest of what stays, of every document."""
    out = dedupe_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= {CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST}
), marked AS (
    SELECT doc_id, pos, line, coalesce(doc_id < top, false) AS gone FROM keyed LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(id, n_lines, n_dropped, kept) by plain Python; for tests."""
    table = str.maketrans(UPPER, LOWER)
    key = lambda line: line.strip(SPACES).translate(table)
    holders: dict[str, set] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= CHARS:
                holders.setdefault(key(line), set()).add(NONE if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held := holders.get(key(x), ())) < LEAST or (NONE if doc is None else doc) == max(held)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
