"""Readers, writers, archives and streams: round trips on temporary folders."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.sources import archives, files, sinks, versions
from marlstone.streaming import streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_json_lines(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"task_id": "x", "n": 1}\n\n{"task_id": "ü", "n": 2}\n')
    bad = put(tmp_path / "b.jsonl", '{"task_id": "x", "n": 1}\nnot json\n[1]\n{"task_id": "y"\n')
    schema = "task_id string, n long"
    assert sorted(map(tuple, files.jsonl(spark, good, schema).collect())) == [("x", 1), ("ü", 2)]
    with pytest.raises(PySparkException, match="not a JSON object"):
        files.jsonl(spark, bad, schema).collect()
    assert [tuple(r) for r in files.jsonl(spark, bad, schema, "lenient").collect()] == [("x", 1)]
    assert files.jsonl(spark, str(tmp_path / "none"), schema, missing_ok=True).count() == 0
    assert [(r.line, r.value) for r in files.numbered_lines(spark, good).collect()][1][0] == 3


def test_trees_and_ids(spark, tmp_path):
    for k in (1, 2):
        put(tmp_path / f"t/task_000{k}/metadata.json", json.dumps({"task_id": f"task_000{k}", "n": k}, indent=1))
    assert sorted(r.task_id for r in files.task_tree(spark, str(tmp_path / "t"), "task_id string, n int").collect()) == ["task_0001", "task_0002"]
    put(tmp_path / "t/task_0009/metadata.json", '{"task_id": "other"}')
    with pytest.raises(PySparkException, match="folder and id differ"):
        files.task_tree(spark, str(tmp_path / "t"), "task_id string, n int").collect()
    with pytest.raises(ValueError, match="no tasks"):
        files.task_tree(spark, str(tmp_path / "none"), "task_id string")
    got = files.task_ids(spark, put(tmp_path / "ids.txt", "3 # first\n\n task_0001\n3\n#no\n")).orderBy("position").collect()
    assert [r.task_id for r in got] == ["task_0003", "task_0001"]
    with pytest.raises(PySparkException, match="no task id"):
        files.task_ids(spark, put(tmp_path / "bad.txt", "../x\n")).collect()
    assert files.ids_with_fallback(spark, str(tmp_path / "t"), 2).count() == 2 and files.ids_with_fallback(spark, str(tmp_path / "none")).count() == 500
    docs = files.documents(spark, put(tmp_path / "x.json", "[]"), "n int", empty_ok=True).collect()
    assert docs[0].n is None
    got = files.path_keys(files.documents(spark, str(tmp_path / "t/*/metadata.json"), "n int"), ["task", "name"]).collect()
    assert {(r.task, r.name) for r in got} == {(f"task_000{k}", "metadata") for k in (1, 2, 9)}


def test_csv_pairs_settings(spark, tmp_path):
    rows = files.csv(spark, put(tmp_path / "b.csv", "\ufeffrank,id\n1,x\n"))
    assert rows.columns == ["rank", "id"]
    pairs = files.pairs(spark, put(tmp_path / "p.json", json.dumps([{"image": "a.png", "text": "t"}, {"image": "/b.png", "text": "u"}]))).collect()
    assert pairs[0].image.endswith(f"{tmp_path.name}/a.png") and pairs[1].image == "/b.png"
    assert files.settings("n = 3\nz = 1\nr = 2", {"n": 1, "r": 0.5, "s": "x"}) == {"n": 3, "r": 2, "s": "x"}
    with pytest.raises(TypeError):
        files.settings("n = 'a'", {"n": 1})
    b = files.binary(spark, put(tmp_path / "d.pdf", b"%PDF-1.4")).select(files.signature(F.col("content")).alias("y")).first()
    assert b.y


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("j", "a", 1, None), ("j", "b", 2, "x")], "judge string, candidate string, n long, s string")
    sinks.write_jsonl(df, str(tmp_path / "j"), one_file=True)
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert list(lines[1]) == ["candidate", "judge", "n", "s"]
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"), ["n", "s", "absent"], bom=True)
    text = next((tmp_path / "c").glob("part-*")).read_text()
    assert text.splitlines() == ["\ufeffn,s,absent", "1,,", "2,x,"]
    sinks.write_per_key(df, str(tmp_path / "k"), ["judge", "candidate"])
    sinks.write_per_key(df.filter("n = 2").withColumn("n", F.lit(9)), str(tmp_path / "k"), ["judge", "candidate"])
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "k")).collect()) == [1, 9]
    for n in (3, 5):
        sinks.replace(spark.range(n), str(tmp_path / "r"))
        assert spark.read.parquet(str(tmp_path / "r")).count() == n
    assert [p.name for p in tmp_path.glob("r*")] == ["r"]
    nested = spark.sql("SELECT 1 AS a, struct(2 AS b, array(struct(3 AS c, 4 AS secret)) AS l) AS s, 5 AS secret")
    assert sinks.public(nested, {"secret"}).schema.simpleString() == "struct<a:int,s:struct<b:int,l:array<struct<c:int>>>>"
    sinks.write_results(str(tmp_path / "res"), nested, df, df, df, {"secret"})
    assert spark.read.option("header", True).csv(str(tmp_path / "res/scores")).count() == 2
    rows = [r.row for r in sinks.gallery(df, "t", ["candidate", "s"]).collect()]
    assert "<td>x</td>" in sinks.page(rows, "t", ["candidate", "s"]) and "| j | b | 2 | x |" in sinks.markdown(spark, df, "t")
    with pytest.raises(ValueError):
        sinks.markdown(spark, df, "t", most=1)


def tar(**named):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in named.items():
            info = tarfile.TarInfo(name.replace("__", "/").replace("UP", ".."))
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    deck = io.BytesIO()
    with zipfile.ZipFile(deck, "w") as z:
        for n in ("ppt/media/b.png", "ppt/media/a.png", "ppt/x.xml"):
            z.writestr(n, b"same" if "media" in n else b"<x/>")
    given = {"t": tar(a__fig=b"1", UP__evil=b"2"), "z": deck.getvalue(), "g": gzip.compress(b"raw"), "r": b"plain", "n": None, "broken": b"\x1f\x8bzz"}
    df = spark.createDataFrame(list(given.items()), "path string, content binary")
    got = {(r.path, r.member): (bytes(r.data) if r.data is not None else None) for r in archives.extract(df).collect()}
    assert got[("t", "a/fig")] == b"1" and ("t", "../evil") not in got and got[("g", "main")] == b"raw" and got[("r", "main")] == b"plain" and got[("broken", None)] is None
    assert [(r.member, r.path) for r in archives.media(df).collect()] == [("ppt/media/a.png", "z")]
    tex = spark.createDataFrame([("p", tar(**{"a.tex": b"\\begin{tikzpicture}", "b.svg": b"<svg >", "c.txt": b"<svg>"}))], "path string, content binary")
    r = archives.probe(tex).first()
    assert (r.files, r.tikz_files, r.svg_files, r.error) == (3, 1, 1, None)
    pdf = b"%PDF-1.7 x"
    two = spark.createDataFrame([("p", tar(**{"x__a.pdf": pdf, "b.pdf": pdf}))], "path string, content binary")
    h = spark.sql(f"SELECT sha2(X'{pdf.hex()}', 256) AS h").first().h
    want = spark.createDataFrame([("p", "b.pdf", h), ("p", "gone.pdf", h)], "path string, source_filename string, sha256 string")
    assert {(r.source_filename, r.member) for r in archives.find_source(two, want).collect()} == {("b.pdf", "b.pdf"), ("gone.pdf", "b.pdf")}
    with pytest.raises(PySparkException, match="no such source"):
        archives.find_source(two, want.withColumn("sha256", F.lit("0"))).collect()


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_streams(spark, tmp_path):
    at = str(tmp_path / "in")
    first = events(spark, [(1, 1, "2024-01-01 00:00:00", "a", 1.0), (2, 1, "2024-01-01 00:10:00", "a", 2.0), (2, 1, "2024-01-01 00:10:00", "a", 2.0), (3, 2, "2024-01-01 05:00:00", "b", 4.0)])
    first.coalesce(1).write.parquet(at)
    open_ = lambda: streams.files(spark, at, first.schema, 1)
    out = lambda name: (str(tmp_path / name), str(tmp_path / f"{name}-c"))
    streams.drained(streams.without_replays(open_()), *out("d")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    streams.drained(streams.windowed(open_()), *out("w"), mode="complete").awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [("a", 3), ("b", 1)]
    # a row far behind the watermark comes too late, a resumed stream takes new files alone
    streams.drained(streams.windowed(open_()), *out("late")).awaitTermination()
    events(spark, [(9, 1, "2023-12-31 00:00:00", "a", 1.0), (10, 3, "2024-01-02 00:00:00", "c", 1.0)]).coalesce(1).write.mode("append").parquet(at)
    streams.drained(streams.windowed(open_()), *out("late")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "late")).collect()
    assert "2023" not in str([r.start for r in closed]) and sum(r.n for r in closed if r.event_type == "a") == 3
    streams.drained(streams.sessions(open_()), *out("s"), mode="complete").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).filter("user_id = 1").count() >= 1
    streams.drained(streams.followed(open_().filter("event_id = 1"), open_().filter("event_id = 2")), *out("f")).awaitTermination()
    assert {(r.first_id, r.second_id) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {(1, 2)}
    streams.drained(streams.idle_users(open_()), *out("i"), mode="update").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "i")).filter("user_id = 2 AND events = 1").count() >= 1
    table = str(tmp_path / "t")
    streams.upsert(spark, open_(), table, ["user_id"], "event_id", str(tmp_path / "t-c")).awaitTermination()
    assert {(r.user_id, r.event_id) for r in versions.read(spark, table, open_().schema).collect()} == {(1, 9), (2, 3), (3, 10)}


def test_versions_write_what_a_batch_touches_and_survive_crashes(spark, tmp_path, monkeypatch):
    root, kind = str(tmp_path / "v"), "k long, seq long, x string"
    rows = lambda *r: spark.createDataFrame(r, kind)
    now = lambda **at: {r.k: r.x for r in versions.read(spark, root, kind, **at).collect()}
    assert now() == {}
    assert versions.upsert(spark.range(200).selectExpr("id AS k", "1L AS seq", "'a' AS x"), root, ["k"], "seq", batch=0) == 1
    before = {k: v for k, v in versions._version(spark, root, 1)[0].items()}
    assert versions.upsert(rows((7, 2, "b"), (7, 0, "old")), root, ["k"], "seq", batch=1) == 2
    after, _ = versions._version(spark, root, 2)
    assert sum(before[k] != after[k] for k in before) == 1 and now()[7] == "b" and now(version=1)[7] == "a" and len(now()) == 200
    assert versions.upsert(rows((7, 9, "again")), root, ["k"], "seq", batch=1) == 2 and now()[7] == "b"
    real = {n: getattr(versions, n) for n in ("_write", "_publish")}
    for name, do in (("_write", False), ("_write", True), ("_publish", False)):
        def fails(*a, name=name, do=do):
            if do:
                real[name](*a)
            raise OSError("lost")

        monkeypatch.setattr(versions, name, fails)
        with pytest.raises(OSError, match="lost"):
            versions.upsert(rows((7, 3, "c")), root, ["k"], "seq", batch=2)
        monkeypatch.setattr(versions, name, real[name])
        assert now()[7] == "b" and len(now()) == 200
    assert versions.upsert(rows((7, 3, "c")), root, ["k"], "seq", batch=2) == 3 and now()[7] == "c"
    with pytest.raises(OSError, match="there already"):
        versions._publish(spark, root, 3, {}, 5)
    assert len(versions.vacuum(spark, root)) >= 3 and now()[7] == "c" and len(now()) == 200
    assert versions.replace(rows((1, 1, "z")), root, ["k"]) == 4 and now() == {1: "z"}


def test_streamed_ledger(spark, tmp_path):
    at = str(tmp_path / "in")
    schema = "thread_id string, seq long, reported long, cumulative boolean, resumed boolean"
    rows = [[("a", 1, 5, True, False), ("a", 2, 9, True, True), ("b", 1, 3, False, False), ("", 1, 4, True, True)], [("a", 3, None, True, True), ("a", 4, 8, True, True), ("a", 5, 10, True, True), ("b", 2, 7, True, True)]]
    got = {}
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(schema).parquet(at)
        streams.drained(streams.ledger(stream), str(tmp_path / "o"), str(tmp_path / "c"), "update").awaitTermination()
    got = {(r.thread_id, r.seq): (r.increment, r.status) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {("a", 1): (5, "ok"), ("a", 2): (4, "ok"), ("b", 1): (3, "ok"), ("", 1): (None, "missing"), ("a", 3): (None, "none"), ("a", 4): (None, "decreased"), ("a", 5): (2, "ok"), ("b", 2): (None, "missing")}
