"""Agents' logs and typed documents with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import typed as V
from marlstone.sources import agent_logs as A
from marlstone.sources.files import numbered_lines

LOGS = {
    "turns": ['{"type":"thread.started","thread_id":7}', '{"type":"error","message":"x"}', "not json", "[1]", '{"type":"turn.completed","usage":{"input_tokens":5,"output_tokens":true}}', '{"type":"turn.completed","usage":3}', '{"type":"item.completed","item":{"type":"agent_message","text":"hi"}}', '{"type":"item.completed","item":"x"}', '{"type":"error"}'],
    "result": ['{"type":"system","subtype":"init","session_id":"s1","model":"m"}', '{"type":"error"}', '{"type":"result","subtype":"success","is_error":false,"session_id":"","usage":{"input_tokens":2,"cache_creation_input_tokens":3,"cache_read_input_tokens":4,"output_tokens":-5},"result":"done","num_turns":9,"total_cost_usd":1,"terminal_reason":null,"modelUsage":{"m":{"in":1.5,"name":"x"}}}'],
    "limit": ['{"type":"result","subtype":"error_max_turns","session_id":"s2"}'],
    "steps": ['{"sessionID":"a"}', '{"type":"step_finish","part":{"tokens":{"input":3,"cache":{"read":1}},"cost":0.5,"reason":"r1"}}', '{"type":"step_finish","part":{"cost":-1}}', '{"type":"text","part":{"text":""}}', '{"type":"text","part":{"text":"t"},"sessionID":"b"}', '{"type":"step_finish"}'],
    "empty": ["", "null"],
}


def rows(spark):
    agent = {"limit": "result", "empty": "nobody"}
    lines = [(log, agent.get(log, log), i + 1, x) for log, own in LOGS.items() for i, x in enumerate(own)]
    return A.events(spark.createDataFrame(lines, "log string, agent string, line long, value string"))


def test_metadata_of_each_kind(spark):
    got = {r.log: r for r in A.metadata(rows(spark)).collect()}
    usage = lambda r: (r.input_tokens, r.cached_input_tokens, r.output_tokens, r.reasoning_output_tokens)
    assert usage(got["turns"]) == (5, 0, 0, 0) and got["turns"].thread_id == "7" and got["turns"].final_message == "hi" and got["turns"].total_cost_usd is None
    assert usage(got["result"]) == (9, 4, 0, 0) and got["result"].thread_id == "s1" and got["result"].final_message == "done"
    assert (got["result"].total_cost_usd, got["result"].num_turns, got["result"].model, got["result"].terminal_reason) == (1.0, 9, "m", None)
    assert usage(got["limit"]) == (None,) * 4 and got["limit"].thread_id == "s2"
    assert usage(got["steps"]) == (3, 1, 0, 0) and got["steps"].thread_id == "b" and got["steps"].final_message == "t"
    assert (got["steps"].total_cost_usd, got["steps"].num_turns, got["steps"].terminal_reason) == (0.5, 2, None)
    assert got["empty"].thread_id == "" and got["empty"].num_turns is None


def test_diagnostics(spark):
    got = {r.log: tuple(r)[1:] for r in A.diagnostics(rows(spark)).collect()}
    assert got == {"turns": (9, 1, 1, 1, False), "result": (3, 0, 0, 1, False), "limit": (1, 0, 1, 0, True), "steps": (6, 0, 0, 0, False), "empty": (2, 1, 0, 0, False)}
    assert [tuple(r)[2:] for r in A.model_usage(rows(spark)).collect()] == [("m", "in", 1.5)]


def test_logs_from_files(spark, tmp_path):
    for log in ("turns", "steps"):
        (tmp_path / f"{log}.jsonl").write_text("\n".join(LOGS[log]))
    lines = numbered_lines(spark, str(tmp_path)).select(F.regexp_extract("file", r"([a-z]+)\.jsonl", 1).alias("log"), F.regexp_extract("file", r"([a-z]+)\.jsonl", 1).alias("agent"), "line", "value")
    assert {r.log: r.thread_id for r in A.metadata(A.events(lines)).collect()} == {"turns": "7", "steps": "b"}


def found(spark, spec, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    return [r.x for r in df.select("i", V.check(F.col("v"), spec).alias("x")).orderBy("i").collect()]


def test_each_type_has_its_own_violation(spark):
    spec = V.Obj({"n": V.Int(1), "r": V.Num(), "b": V.Bool(), "t": V.Text(True), "a": V.Arr(V.OneOf(("x", "y")))})
    good = '{"n":1,"r":0.25,"b":false,"t":"s","a":["x","y"]}'
    got = found(
        spark, spec, good, good.replace('"n":1', '"n":true'), good.replace('"n":1', '"n":1.5'), good.replace('"n":1,', ""), good.replace('"n":1', '"n":null'), good.replace('"n":1', '"n":0'), good.replace("0.25", "true"),
        good.replace("0.25", "1.255"), good.replace("false", "0"), good.replace('"s"', '" "'), good.replace('"y"', "1"), good.replace('"t"', '"u"'), "[]", None,
    )
    assert got == [
        [], ["$.n: not an integer"], ["$.n: not an integer"], ["$.n: missing"], ["$.n: not an integer"], ["$.n: below 1"], ["$.r: not a number"], ["$.r: not in [0, 1]", "$.r: more than 2 places"],
        ["$.b: not a boolean"], ["$.t: blank"], ["$.a[]: not a known value"], ["$.t: missing", "$.u: unknown"], ["$: not an object"], ["$: not an object"],
    ]
    assert found(spark, V.GATE, '{"gate_keeper":{"triggered":true,"reason":" "}}', '{"gate_keeper":{"triggered":1,"reason":""}}') == [["$.gate_keeper: triggered without a reason"], ["$.gate_keeper.triggered: not a boolean"]]


def test_usage_of_odd_reports(spark):
    texts = ['{"input_tokens":5.0,"cached_input_tokens":2,"output_tokens":1,"reasoning_output_tokens":9}', "{}", '{"input_tokens":"5"}', '{"input_tokens":1,"cached_input_tokens":2}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    got = df.select("i", *[c.alias(n) for n, c in V.usage(F.col("v")).items()]).orderBy("i").collect()
    assert [(r.input_tokens, r.uncached_input_tokens, r.total_tokens, r.error) for r in got] == [(5, 3, 6, ""), (0, 0, 0, ""), (None, None, None, "input_tokens: not an integer"), (None, None, None, "cached_input_tokens: above input_tokens"), (0, 0, 0, "")]
