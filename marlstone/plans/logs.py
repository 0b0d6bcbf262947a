"""Agents' logs made of events: a log for each user, whose kind of agent goes by the user's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import typed as V
from marlstone.plans.base import Tables, query
from marlstone.session import spread
from marlstone.sources import agent_logs as A

MADE = """m AS (SELECT event_id AS line, user_id AS log, user_id % 3 AS a, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 100 AS o FROM events)"""


def log_lines(t: Tables) -> DataFrame:
    """(log, agent, line, value): five kinds of event are five kinds of line for each agent."""
    e = spread(t.events.select("event_id", "user_id", "event_type", "props")).select(F.col("event_id").alias("line"), F.col("user_id").alias("log"), F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"), (F.col("event_id") % 100).cast("string").alias("o"))
    i = F.col("line").cast("string")
    say = lambda pattern, *c: F.format_string(pattern, *c)
    k, o = F.col("k"), F.col("o")
    made = {
        "turns": {"signup": say('{"type":"thread.started","thread_id":"t%s"}', i), "purchase": say('{"type":"turn.completed","usage":{"input_tokens":%s,"cached_input_tokens":true,"output_tokens":%s}}', k, o), "click": F.lit('{"type":"turn.failed"}'), "view": say('{"type":"item.completed","item":{"type":"agent_message","text":"é%s"}}', i)},
        "result": {"signup": say('{"type":"system","subtype":"init","session_id":"t%s","model":"m%s"}', i, o), "purchase": say('{"type":"result","subtype":"success","usage":{"input_tokens":%s,"cache_read_input_tokens":%s,"output_tokens":%s},"result":"é%s","total_cost_usd":0.5,"num_turns":%s,"modelUsage":{"a":{"in":%s},"b":{"in":%s,"name":"x"}}}', k, o, o, i, o, k, o), "click": F.lit('{"type":"result","subtype":"error_max_turns","usage":[]}'), "view": F.lit('{"type": ')},
        "steps": {"signup": say('{"sessionID":"t%s","type":"step_start"}', i), "purchase": say('{"type":"step_finish","part":{"tokens":{"input":%s,"cache":{"read":1.5},"output":%s,"reasoning":-1},"cost":0.25,"reason":"r%s"}}', k, o, o), "click": F.lit('{"type":"turn.failed"}'), "view": say('{"type":"text","part":{"text":"é%s"}}', i)},
    }
    agent = F.element_at(F.array(*map(F.lit, made)), (F.col("log") % 3 + 1).cast("int"))
    value = F.lit('{"type":"error","message":"m"}')
    for name, lines in made.items():
        for of, text in lines.items():
            value = F.when((agent == name) & (F.col("t") == of), text).otherwise(value)
    return e.select("log", agent.alias("agent"), "line", value.alias("value"))


@query(f"""WITH {MADE} SELECT log, CASE a WHEN 0 THEN 'turns' WHEN 1 THEN 'result' ELSE 'steps' END AS agent,
  coalesce('t' || max(line) FILTER (t = 'signup'), '') AS thread_id,
  CASE a WHEN 0 THEN arg_max(k, line) FILTER (t = 'purchase') WHEN 1 THEN CASE WHEN arg_max(t, line) FILTER (t IN ('purchase', 'click')) = 'purchase' THEN arg_max(k + o, line) FILTER (t = 'purchase') END ELSE sum(k) FILTER (t = 'purchase') END::BIGINT AS input_tokens,
  CASE a WHEN 1 THEN CASE WHEN arg_max(t, line) FILTER (t IN ('purchase', 'click')) = 'purchase' THEN arg_max(o, line) FILTER (t = 'purchase') END ELSE CASE WHEN count(*) FILTER (t = 'purchase') > 0 THEN 0 END END::BIGINT AS cached_input_tokens,
  CASE a WHEN 0 THEN arg_max(o, line) FILTER (t = 'purchase') WHEN 1 THEN CASE WHEN arg_max(t, line) FILTER (t IN ('purchase', 'click')) = 'purchase' THEN arg_max(o, line) FILTER (t = 'purchase') END ELSE sum(o) FILTER (t = 'purchase') END::BIGINT AS output_tokens,
  CASE WHEN a = 1 AND arg_max(t, line) FILTER (t IN ('purchase', 'click')) = 'click' THEN NULL WHEN count(*) FILTER (t = 'purchase') > 0 THEN 0 END::BIGINT AS reasoning_output_tokens,
  CASE a WHEN 1 THEN CASE WHEN arg_max(t, line) FILTER (t IN ('purchase', 'click')) = 'purchase' THEN 'é' || max(line) FILTER (t = 'purchase') ELSE '' END ELSE coalesce('é' || max(line) FILTER (t = 'view'), '') END AS final_message,
  CASE a WHEN 1 THEN CASE WHEN arg_max(t, line) FILTER (t IN ('purchase', 'click')) = 'purchase' THEN 0.5 END WHEN 2 THEN CASE WHEN count(*) FILTER (t = 'purchase') > 0 THEN 0.25 * count(*) FILTER (t = 'purchase') END END::DOUBLE AS total_cost_usd,
  CASE a WHEN 1 THEN CASE WHEN arg_max(t, line) FILTER (t IN ('purchase', 'click')) = 'purchase' THEN arg_max(o, line) FILTER (t = 'purchase') END WHEN 2 THEN nullif(count(*) FILTER (t = 'purchase'), 0) END::BIGINT AS num_turns,
  CASE WHEN a = 1 THEN coalesce('m' || arg_max(o, line) FILTER (t = 'signup'), '') ELSE '' END AS model,
  CASE WHEN a = 2 THEN 'r' || arg_max(o, line) FILTER (t = 'purchase') END AS terminal_reason FROM m GROUP BY log, a""")
def agent_log_metadata(t: Tables) -> DataFrame:
    return A.metadata(A.events(log_lines(t)))


@query(f"""WITH {MADE}, v AS (SELECT *, first_value(CASE WHEN t = 'click' THEN 'bad' WHEN t = 'purchase' AND a < 2 THEN 'good' END IGNORE NULLS) OVER (PARTITION BY log ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM m)
SELECT log, count(*) AS event_count, count(*) FILTER (a = 1 AND t = 'view') AS parse_errors, count(*) FILTER (t = 'click' OR t = 'error' AND coalesce(e, 'bad') = 'bad') AS errors, count(*) FILTER (t = 'error' AND e = 'good') AS warnings,
  count(*) FILTER (t = 'click' OR t = 'error' AND coalesce(e, 'bad') = 'bad') > 0 AND count(*) FILTER (t = 'error' AND coalesce(e, 'bad') = 'bad') = 0 AND a = 1 AS only_turn_limit FROM v GROUP BY log, a""")
def agent_log_diagnostics(t: Tables) -> DataFrame:
    return A.diagnostics(A.events(log_lines(t)))


@query(f"WITH {MADE} SELECT log, 'a' AS model, 'in' AS field, sum(k)::DOUBLE AS total FROM m WHERE a = 1 AND t = 'purchase' GROUP BY log UNION ALL SELECT log, 'b', 'in', sum(o)::DOUBLE FROM m WHERE a = 1 AND t = 'purchase' GROUP BY log")
def agent_model_usage(t: Tables) -> DataFrame:
    return A.model_usage(A.events(log_lines(t))).groupBy("log", "model", "field").agg(F.sum("value").alias("total"))


@query(f"""WITH {MADE}, u AS (SELECT *, CASE t WHEN 'purchase' THEN 'input_tokens: not an integer' WHEN 'click' THEN 'input_tokens: not an integer, output_tokens: not an integer' WHEN 'error' THEN 'output_tokens: negative'
  WHEN 'signup' THEN CASE WHEN o > k THEN 'cached_input_tokens: above input_tokens' ELSE '' END ELSE '' END AS error FROM m)
SELECT line AS event_id, error, CASE WHEN error = '' THEN k END AS input_tokens, CASE WHEN error = '' THEN CASE t WHEN 'signup' THEN o ELSE 0 END END AS cached_input_tokens, CASE WHEN error = '' THEN CASE t WHEN 'signup' THEN 3 ELSE 2 END END AS output_tokens,
  CASE WHEN error = '' THEN CASE t WHEN 'signup' THEN k - o ELSE k END END AS uncached_input_tokens, CASE WHEN error = '' THEN CASE t WHEN 'signup' THEN k + 3 ELSE k + 2 END END AS total_tokens FROM u""")
def typed_usage(t: Tables) -> DataFrame:
    """Usage reports of five spellings: whole numbers, `true`, 1.5 and null, 2.0, negative."""
    k, o = F.get_json_object("props", "$.k"), (F.col("event_id") % 100).cast("string")
    report = (
        F.when(F.col("event_type") == "signup", F.format_string('{"input_tokens":%s,"cached_input_tokens":%s,"output_tokens":3}', k, o))
        .when(F.col("event_type") == "purchase", F.lit('{"input_tokens":true}')).when(F.col("event_type") == "click", F.lit('{"input_tokens":1.5,"output_tokens":null}'))
        .when(F.col("event_type") == "view", F.format_string('{"input_tokens":%s,"output_tokens":2.0}', k)).otherwise(F.lit('{"output_tokens":-1}'))
    )
    found = V.usage(F.parse_json(report))
    return t.events.select("event_id", *[c.alias(n) for n, c in found.items() if n != "reasoning_output_tokens"])


SCORING = V.score({"layout": {"overlap": ("covers", "touches")}, "text": {"wording": ("typo",)}})


def answers(t: Tables, types: dict[str, str]) -> DataFrame:
    """(event_id, event_type, doc): an answer for each event, by its type; `%s` is the event's number."""
    doc = F.lit(None).cast("string")
    for of, text in types.items():
        doc = F.when(F.col("event_type") == of, F.format_string(text, *[F.col("event_id").cast("string")] * text.count("%s"))).otherwise(doc)
    return spread(t.events.select("event_id", "event_type")).select("event_id", "event_type", F.parse_json(doc).alias("doc"))


def answer(cases: str = "", ratio: str = "0", other: str = '"cases":[],"ratio":0', more: str = "") -> str:
    return f'{{"deductions":{{"layout":{{"overlap":{{"cases":[{cases}],"ratio":{ratio}}}}},"text":{{"wording":{{{other}}}}}}},"summary_feedback":"no. %s"{more}}}'


CASE = '{"issue_type":"covers","location":"left","candidate":"a","reference":"b","affected_count":%s}'


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN '$.deductions.text.wording.ratio: missing, $.deductions.text.wording.rate: unknown'
  WHEN 'purchase' THEN '$.deductions.layout.overlap.ratio: not a number' WHEN 'error' THEN '$.deductions.layout.overlap.cases[].affected_count: not an integer, $.deductions.layout.overlap.ratio: more than 2 places'
  ELSE '$.x: unknown, $.deductions.layout.overlap: a ratio without cases' END || CASE WHEN event_type = 'view' AND event_id = 0 THEN '$.deductions.layout.overlap.cases[].affected_count: below 1' ELSE '' END AS violations FROM events""")
def typed_scores(t: Tables) -> DataFrame:
    """Scoring answers: right, without a key, with `true` and 1.5 for numbers, with a key too many."""
    docs = answers(t, {
        "view": answer(CASE, "0.25"), "click": answer(other='"cases":[],"rate":0'), "purchase": answer(CASE % 3, "true"),
        "error": answer(CASE % "1.5", "0.255"), "signup": answer("", "0.5", more=',"x":1'),
    })
    return docs.select("event_id", F.array_join(V.check(F.col("doc"), SCORING), ", ").alias("violations"))


@query("SELECT event_id, event_type IN ('view', 'click', 'purchase') AND event_id > 0 OR event_type = 'signup' AS complete FROM events")
def complete_results(t: Tables) -> DataFrame:
    """Results of each final status: scored, gated by meaning, gated by rendering, no artifact, and one whose gate isn't triggered."""
    gate = lambda on: f'{{"status":"complete","output":{{"gate_keeper":{{"triggered":{on},"reason":"r"}}}}}}'
    whole = lambda final, stages, more="": f'{{"schema":"s/1","protocol_id":"p","status":"complete","final_status":"{final}"{more},"stages":{{{stages}}}}}'
    scored = f'"semantic_gate":{gate("false")},"render_gate":{gate("false")},"scoring":{{"status":"complete","output":{answer(CASE, "0.25")}}}'
    docs = answers(t, {
        "view": whole("scored", scored), "click": whole("semantic_gate", f'"semantic_gate":{gate("true")}'), "purchase": whole("render_gate", f'"semantic_gate":{gate("false")},"render_gate":{gate("true")}'),
        "signup": whole("artifact_gate", '"scoring":{"status":"skipped"}', ',"artifact_gate":true'), "error": whole("render_gate", f'"semantic_gate":{gate("true")},"render_gate":{gate("true")}'),
    })
    first = F.col("event_id") > 0
    return docs.select("event_id", (V.complete(F.col("doc"), "s/1", "p", SCORING) & (first | (F.col("event_type") == "signup"))).alias("complete"))
