"""Plans at the limits that round 3's review named: what is parsed once, what is dealt to tasks, what a task holds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone.operators import files, rules
from marlstone.operators import typed as V
from marlstone.plans import base, logs, relations
from marlstone.sources import agent_logs as A


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def events(spark, path, n=400):
    e = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("signup", "purchase", "click", "view", "error"))), (F.col("id") % 5 + 1).cast("int")).alias("event_type"), F.lit('{"k": 3}').alias("props"),
    )
    e.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_diagnostics_parse_each_line_once(spark, tmp_path):
    t = base.Tables(spark, events(spark, tmp_path))
    rows = A.events(logs.log_lines(t))
    found = A.diagnostics(rows)
    assert "parseJson" in plan(rows) and "parseJson" not in plan(found)
    assert found.agg(F.sum("event_count")).first()[0] == 400


def test_one_split_of_events_is_dealt_to_tasks(spark, tmp_path):
    t = base.Tables(spark, events(spark, tmp_path))
    assert logs.typed_scores(t).rdd.getNumPartitions() > t.events.rdd.getNumPartitions() == 1


def test_objects_and_arrays_are_known_without_their_schemas(spark):
    spec = V.Obj({"a": V.Arr(V.Int()), "b": V.Obj({})}, [("no", lambda v: V.get(v, "$.b", "variant").isNotNull())])
    texts = ['{"a":[1],"b":{}}', '{"a":{},"b":[]}', '{"a":null,"b":"{}"}', "[]", "null", '"x"', "3", None, '{"a":[],"b":null}', '{"a":[null,1.5,[2]],"b":{"c":1}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.check(F.parse_json("t"), spec).alias("x"))
    other, none = "$: not an object", "$.b: not an object"
    assert [r.x for r in df.orderBy("i").collect()] == [
        [], ["$.a: not an array", none], ["$.a: not an array", none], *[[other]] * 5, [none], [*["$.a[]: not an integer"] * 3, "$.b.c: unknown"],
    ]
    nested = V.check(F.parse_json(F.col("id").cast("string")), V.Obj({"a": V.Arr(V.Obj({}))}))
    assert "schemaOfVariant" not in plan(spark.range(1).select(nested))


def test_set_operations_join_distinct_keys(spark, tmp_path):
    """No join of the intersection or the difference sees a key twice from its right side."""
    o = spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), F.format_string("%s", F.col("id") % 3).alias("o_orderpriority"), F.when(F.col("id") % 2 == 0, "P").otherwise("O").alias("o_orderstatus"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(60).select((F.col("id") % 20).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(30).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    found = relations.set_operations(base.Tables(spark, str(tmp_path)))
    assert sorted(map(tuple, found.collect())) == [("0", 1), ("1", 1), ("2", 1), ("except", 10), ("except all", 40), ("intersect all", 20)]
    assert "RepartitionByExpression" in plan(found)


def test_only_documents_of_a_pair_give_all_their_words(spark, tmp_path):
    long = "abcdefghijk bcdefghijkl cdefghijklm"
    spark.createDataFrame([(1, f"x {long} x"), (2, "short words alone"), (3, None), (4, f"{long[:22]}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, f"{long} x y"), (8, "short words alone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = relations.token_f1(base.Tables(spark, str(tmp_path)))
    assert [tuple(r) for r in found.collect()] == [(1, 7, 4, 0.8)]
    assert "LeftSemi" in plan(found)


def test_a_long_chain_of_files_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(files, "cut", lambda df: rounds.append(1) or df.localCheckpoint())
    edges = spark.createDataFrame([("p", f"f{i:02}", f"f{i + 1:02}") for i in range(20)] + [("p", "f00", "f07")], "paper string, file string, target string")
    got = {(r.root, r.file): r.depth for r in files.closure(edges).collect()}
    want = {(f"f{i:02}", f"f{j:02}"): j - i - (6 if i == 0 and j >= 7 else 0) for i in range(21) for j in range(i + 1, 21)}
    assert got == want and len(rounds) <= 7
    with pytest.raises(ValueError, match="in 5 steps"):
        files.closure(spark.createDataFrame([("p", f"f{i}", f"f{(i + 1) % 5}") for i in range(5)], "paper string, file string, target string"))


def test_a_long_page_meets_in_blocks(spark, monkeypatch):
    """The same scores however a page's sides are cut, with repeated texts, a page of one side and a null key."""
    rows = [(k, side, p, f"{'same words' if p % 3 else 'other'} {k} {p % 4} Straße", p % 5 / 5, p % 3 / 3) for k in (1, 2, None) for side in ("reference", "candidate") for p in range(9)]
    rows += [(3, "candidate", 0, "x", 0.0, 0.0), (4, "reference", 0, "", 0.0, 0.0)]
    docs = spark.createDataFrame(rows, "pair long, side string, position int, text string, x double, y double")
    monkeypatch.setattr(rules, "SIDE", 2)
    found = rules.matched_texts(docs, "pair")
    assert "FlatMapCoGroupsInPandas" in plan(found)
    got = sorted(map(tuple, found.collect()), key=repr)
    monkeypatch.setattr(rules, "SIDE", 64)
    assert got == sorted(map(tuple, rules.matched_texts(docs, "pair").collect()), key=repr)
    assert got == [(1, 1.0, 9, 9), (2, 1.0, 9, 9), (3, 0.0, 0, 1), (4, 0.0, 1, 0), (None, 1.0, 9, 9)]
