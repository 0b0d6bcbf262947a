"""The paged source, SQL functions and texts, the early stop, mergeable sketches, streamed attribution."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import consensus as C
from marlstone.operators import ordered as O
from marlstone.operators import select as D
from marlstone.operators import sketches as K
from marlstone.operators import table_functions as Q
from marlstone.sources import paged
from marlstone.streaming import attribution as A

SF = "/root/testdata/sf0.001"


def page(root, query, n, ids):
    at = root / f"query={query}" / f"page={n}"
    at.mkdir(parents=True)
    (at / "part-0.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))


def rows(df):
    return sorted((r.query, r.position, json.loads(r.value)["id"]) for r in df.collect())


def test_pages_until_a_short_one(spark, tmp_path):
    paged.register(spark)
    page(tmp_path, "a", 0, [1, 2, 3])
    page(tmp_path, "a", 1, [4])
    page(tmp_path, "a", 2, [5, 6, 7])  # behind the end: never read
    page(tmp_path, "b%2Fc", 0, [8, 9, 10])
    page(tmp_path, "b%2Fc", 2, [11])  # page 1 is missing
    page(tmp_path, "e", 0, [])
    read = spark.read.format("paged").option("path", str(tmp_path)).option("size", 3)
    assert rows(read.load()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("b/c", 1, 8), ("b/c", 2, 9), ("b/c", 3, 10)]
    assert rows(read.option("limit", 2).load()) == [("a", 1, 1), ("a", 2, 2), ("b/c", 1, 8), ("b/c", 2, 9)]
    assert rows(read.option("limit", 3).option("queries", "b/c").load()) == [("b/c", i, i + 7) for i in (1, 2, 3)]
    assert rows(read.option("path", f"{tmp_path}/none").load()) == []


def test_bad_pages(spark, tmp_path):
    paged.register(spark)
    page(tmp_path, "a", 0, [1, 2])
    with pytest.raises(Exception, match="at most 1"):
        spark.read.format("paged").option("path", str(tmp_path)).option("size", 1).load().collect()
    page(tmp_path, "b", 0, [])
    (tmp_path / "query=b" / "page=0" / "part-0.json").write_text("{}\n[1]\n")
    with pytest.raises(Exception, match="page=0:2 is not a JSON object"):
        spark.read.format("paged").option("path", str(tmp_path)).option("queries", "b").load().collect()


def test_streamed_pages_resume(spark, tmp_path):
    paged.register(spark)
    pages, out = tmp_path / "pages", tmp_path / "out"
    fail = tmp_path / "fail"

    def run():
        def save(batch, n):
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
            if fail.exists():
                raise RuntimeError("stopped")

        df = spark.readStream.format("paged").option("path", str(pages)).option("size", 2).option("limit", 5).load()
        q = df.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    page(pages, "a", 0, [1, 2])
    run()
    page(pages, "a", 1, [3, 4])
    page(pages, "b", 0, [9])
    fail.touch()
    with pytest.raises(Exception, match="stopped"):
        run()
    fail.unlink()
    page(pages, "b", 1, [10])  # b has ended
    page(pages, "a", 2, [5, 6])  # cut by the limit
    run()
    page(pages, "a", 3, [7])
    run()
    got = rows(spark.read.parquet(str(out)))
    assert got == [("a", i, i) for i in range(1, 6)] + [("b", 1, 9)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_sql_texts_equal_dataframes(spark):
    t = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("orders", "events", "documents", "embeddings", "customer", "lineitem")}
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    Q.register(spark)
    K.register(spark)
    o, e, d = t["orders"], t["events"], t["documents"]
    at = F.concat(F.lit("https://x/abs/"), F.col("doc_id").cast("string"), F.lit("v12"))
    state = K.states(e, ["event_type"], "user_id", "value")
    state.createOrReplaceTempView("states")
    pairs = [
        ("SELECT canonical_id('https://x/abs/' || doc_id || 'v12') FROM documents", d.select(X.canonical_id(at))),
        ("SELECT safe_id(source || '/' || doc_id || '.x') FROM documents", d.select(X.safe_id(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".x"))))),
        ("SELECT caption_of(text) FROM documents", d.select(X.caption(F.col("text")))),
        ("SELECT license_url(' HTTPS://A/' || source || '//') FROM documents", d.select(X.license_url(F.concat(F.lit(" HTTPS://A/"), "source", F.lit("//"))))),
        ("SELECT stair(l_discount) FROM lineitem", t["lineitem"].select(C.stair(F.col("l_discount")))),
        ("SELECT points_lost(l_quantity, l_discount) FROM lineitem", t["lineitem"].select(C.points(F.col("l_quantity"), F.col("l_discount")))),
        ("SELECT hamming(doc_id, n_chars) FROM documents", d.select(D.hamming(F.col("doc_id"), F.col("n_chars").cast("long")))),
        ("SELECT o_custkey, o_orderkey FROM top_orders(2)", D.top_per_key(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")),
        ("SELECT o_orderkey FROM until_sums(TABLE(SELECT o_custkey, o_orderkey, o_totalprice FROM orders) PARTITION BY (o_custkey) ORDER BY (o_orderkey), 'o_totalprice', '300000')", D.running_stop(o, ["o_custkey"], ["o_orderkey"], "o_totalprice", 300000).select("o_orderkey")),
        ("SELECT user_id, n FROM usage_by('click')", e.filter("event_type = 'click'").groupBy("user_id").count()),
        ("SELECT o_orderkey, place FROM orders_of(7)", O.placed(o.filter("o_custkey = 7"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "place")),
        ("SELECT event_type, distinct_of(items), median_of(values) FROM states", state.select("event_type", K.distinct(F.col("items")), K.quantile(F.col("values"), 0.5))),
    ]
    for text, df in pairs:
        got, want = (sorted((tuple(r) for r in x.collect()), key=repr) for x in (spark.sql(text), df))
        assert got == want and want, text


def test_until_sums(spark):
    Q.register(spark, tables=False)
    data = [("a", i, 2, 1.0) for i in range(9)] + [("b", 0, None, None), (None, 0, 9, 9.0), (None, 1, 9, 9.0)]
    spark.createDataFrame(data, "k string, o int, x int, y double").createOrReplaceTempView("amounts")
    call = "SELECT * FROM until_sums(TABLE(amounts) PARTITION BY (k) ORDER BY (o), {}, {})"
    got = sorted((str(r.k), r.o, r.sum_x, r.sum_y) for r in spark.sql(call.format("'x, y'", "'5, 4'")).collect())
    assert got == [("None", 0, 9, 9.0)] + [("a", i, 2 * i + 2, i + 1.0) for i in range(4)] + [("b", 0, 0, 0.0)]
    with pytest.raises(AnalysisException, match="no column z"):
        spark.sql(call.format("'z'", "'1'"))
    with pytest.raises(AnalysisException, match="differ in number"):
        spark.sql(call.format("'x'", "'1, 2'"))
    spark.createDataFrame([], "k string, o int, x int, y double").createOrReplaceTempView("amounts")
    assert spark.sql(call.format("'x'", "'5'")).collect() == []


def test_sketches_merge_in_any_order(spark):
    df = spark.range(60_000).select((F.col("id") % 40_000).alias("item"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"), (F.col("id") % 12).alias("day"))
    daily = K.states(df, ["day"], "item", "v").cache()
    for part in (F.lit(0), F.col("day") % 5, F.hash("day") % 3):
        out = K.merged(K.merged(daily, [part.alias("p")]), [F.lit(1).alias("one")]).select("n", K.distinct(F.col("items")).alias("d"), *[K.quantile(F.col("values"), q).alias(f"q{i}") for i, q in enumerate((0.05, 0.5, 0.95))]).first()
        assert out.n == 60_000 and abs(out.d - 40_000) < 0.05 * 40_000
        assert all(abs(out[f"q{i}"] / 60_000 - q) < 0.03 for i, q in enumerate((0.05, 0.5, 0.95)))
    empty = K.states(spark.createDataFrame([(1, None, None)], "day int, item long, v double"), ["day"], "item", "v").select("n", K.distinct(F.col("items")).alias("d"), K.quantile(F.col("values"), 0.5).alias("q")).first()
    assert (empty.n, empty.d, empty.q) == (1, 0, None)


ENDS = {"good": "warning", "bad": "error"}
LINES = [(log, i, kind) for log, kinds in {"a": ["error", "error", "good", "error", "x", "bad"], "b": ["error", "x", "stop", "error", "good"], "c": ["good", "error", "error", "stop"]}.items() for i, kind in enumerate(kinds)]


def verdicts(df, at, n):
    """Sorted rows of the stream, stopped when there are `n` or after a minute."""
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{at}/c").start(f"{at}/out")
    got, until = [], time.time() + 60
    try:
        while len(got) < n and time.time() < until and q.exception() is None:
            time.sleep(1)
            if os.path.isdir(f"{at}/out/_spark_metadata"):
                got = df.sparkSession.read.schema(A.OUT).parquet(f"{at}/out").collect()
    finally:
        q.stop()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("cut", [100, 4])
def test_streamed_attribution_equals_batch(spark, tmp_path, cut):
    ordered = sorted(LINES, key=lambda r: (r[1], r[0]))
    for n in range(0, len(ordered), cut):
        spark.createDataFrame(ordered[n : n + cut], "log string, line long, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("log string, line long, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # processing-time timeouts keep a query running without data, so it is stopped once all lines have a verdict
    got = verdicts(A.attributed(stream, "error", ENDS, closing="stop"), tmp_path, 7)
    batch = O.attributed(spark.createDataFrame(LINES, "log string, line long, kind string"), "log", "line", "kind", "error", {**ENDS, "stop": "error"})
    assert got == sorted((r.log, r.line, r.verdict) for r in batch.collect())


def test_a_silent_log_ends(spark, tmp_path):
    schema = "log string, line long, kind string"
    spark.createDataFrame([("a", 1, "error"), ("a", 2, "x")], schema).write.parquet(f"{tmp_path}/in")
    got = verdicts(A.attributed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "error", ENDS, idle_ms=1), tmp_path, 1)
    assert got == [("a", 1, "error")]
