"""Agents' event logs as VARIANT: no fixed struct, one mapping for each kind of agent, one schema of events for all.

Kinds of agents by the shape of their logs: `turns` (a thread, turns, items), `result` (an init and one result, with
disjoint cache counters) and `steps` (a session and steps, each with its own tokens and cost).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.timed import asof
from marlstone.session import written

COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
NONE = {
    "role": "string", "thread_id": "string", "message": "string", **dict.fromkeys(COUNTERS, "bigint"), "reported": "boolean",
    "cost_usd": "double", "turns": "bigint", "model": "string", "reason": "string", "models": "variant",
}


def text(e: Column, path: str) -> Column:
    return F.try_variant_get(e, f"$.{path}", "string")


def part(e: Column, path: str) -> Column:
    return F.try_variant_get(e, f"$.{path}", "variant")


def kind(e: Column) -> Column:
    """The type of a value without its inside: OBJECT, ARRAY, BIGINT, BOOLEAN, DECIMAL, ...; null for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(e), "^[A-Z]+", 0)


def is_object(e: Column, path: str) -> Column:
    return F.try_variant_get(e, f"$.{path}", "map<string,variant>").isNotNull()


def counter(e: Column, path: str) -> Column:
    """A whole number of 0 or more; what is missing, true or 1.5 counts as 0."""
    n = F.when(kind(part(e, path)) == "BIGINT", F.try_variant_get(e, f"$.{path}", "bigint"))
    return F.when(n >= 0, n).otherwise(F.lit(0).cast("bigint"))


def number(e: Column, path: str) -> Column:
    return F.when(kind(part(e, path)).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(e, f"$.{path}", "double"))


def turns(e: Column, of: Column) -> dict[str, Column]:
    started, ended = of == "thread.started", (of == "turn.completed") & is_object(e, "usage")
    said = (of == "item.completed") & F.coalesce(text(e, "item.type") == "agent_message", F.lit(False))
    return {
        "role": F.when(started, "session").when(ended, "usage").when(said, "message"), "thread_id": F.when(started, F.coalesce(text(e, "thread_id"), F.lit(""))),
        "message": F.when(said, F.coalesce(text(e, "item.text"), F.lit(""))), **{c: F.when(ended, counter(e, f"usage.{c}")) for c in COUNTERS}, "reported": F.when(ended, True),
    }


def result(e: Column, of: Column) -> dict[str, Column]:
    init, ended = (of == "system") & F.coalesce(text(e, "subtype") == "init", F.lit(False)), of == "result"
    direct, write, read = (counter(e, f"usage.{c}") for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"))
    given = [part(e, f"usage.{c}").isNotNull() for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")]
    sums = dict(zip(COUNTERS, (direct + write + read, read, counter(e, "usage.output_tokens"), F.lit(0).cast("bigint")), strict=True))
    return {
        "role": F.when(init, "session").when(ended, "usage"), "thread_id": F.when(init | ended, F.coalesce(text(e, "session_id"), F.lit(""))),
        "message": F.when(ended, F.coalesce(text(e, "result"), F.lit(""))), **{c: F.when(ended, v) for c, v in sums.items()},
        "reported": F.when(ended, given[0] | given[1] | given[2] | given[3]), "cost_usd": F.when(ended, number(e, "total_cost_usd")),
        "turns": F.when(ended, F.try_variant_get(e, "$.num_turns", "bigint")), "model": F.when(init, F.coalesce(text(e, "model"), F.lit(""))),
        "reason": F.when(ended, text(e, "terminal_reason")), "models": F.when(ended & is_object(e, "modelUsage"), part(e, "modelUsage")),
    }


def steps(e: Column, of: Column) -> dict[str, Column]:
    inside = is_object(e, "part")
    step, said = (of == "step_finish") & inside, (of == "text") & inside & (F.coalesce(text(e, "part.text"), F.lit("")) != "")
    paths = ("part.tokens.input", "part.tokens.cache.read", "part.tokens.output", "part.tokens.reasoning")
    cost = number(e, "part.cost")
    return {
        "role": F.when(step, "usage").when(said, "message"), "thread_id": F.nullif(text(e, "sessionID"), F.lit("")), "message": F.when(said, text(e, "part.text")),
        **{c: F.when(step, counter(e, p)) for c, p in zip(COUNTERS, paths, strict=True)}, "reported": F.when(step, True),
        "cost_usd": F.when(step & (cost >= 0), cost), "reason": F.when(step, text(e, "part.reason")),
    }


AGENTS: dict[str, Callable[[Column, Column], dict[str, Column]]] = {"turns": turns, "result": result, "steps": steps}


def events(lines: DataFrame) -> DataFrame:
    """Rows of one schema from (log, agent, line, value): a row for each line, in any order.

    A line that isn't JSON has `parse_error`; JSON that isn't an object, or an agent of no known kind, gives a row without
    a role. `outcome` is that of W6's events: error, good or bad. Counters that aren't whole numbers of 0 or more are 0.
    """
    parsed = lines.select("log", "agent", "line", F.try_parse_json("value").alias("e"))
    whole = F.try_variant_get(F.col("e"), "$", "map<string,variant>").isNotNull()
    e, of = F.col("o"), F.coalesce(text(F.col("o"), "type"), F.lit(""))
    # an explode of one element keeps what is above it from repeating what is below: a line is parsed once, and plans stay small
    shaped = parsed.select("log", "agent", "line", F.explode(F.array(F.struct(F.col("e").isNull().alias("parse_error"), F.when(whole, F.col("e")).alias("o")))).alias("x")).select("log", "agent", "line", "x.*")
    wrong = F.coalesce(F.try_variant_get(e, "$.is_error", "boolean"), F.lit(False)) | F.coalesce(text(e, "subtype") != "success", F.lit(True))
    outcome = F.when(of == "error", "error").when(of == "turn.completed", "good").when(of == "turn.failed", "bad").when(of == "result", F.when(wrong, "bad").otherwise("good"))
    limit = (of == "result") & F.coalesce((text(e, "terminal_reason") == "max_turns") | (text(e, "subtype") == "error_max_turns"), F.lit(False))
    made = {name: make(e, of) for name, make in AGENTS.items()}
    columns = []
    for c, form in NONE.items():
        value = F.lit(None).cast(form)
        for name, given in made.items():
            if c in given:
                value = F.when(F.col("agent") == name, given[c]).otherwise(value)
        columns.append(value.alias(c))
    told = F.struct("parse_error", F.nullif(of, F.lit("")).alias("type"), outcome.alias("outcome"), limit.alias("turn_limit"), *columns)
    return shaped.select("log", "agent", "line", F.explode(F.array(told)).alias("x")).select("log", "agent", "line", "x.*")


def last(value: str | Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("line")))


def metadata(rows: DataFrame) -> DataFrame:
    """A row for each log: thread, usage, last message, cost, turns, model, reason; by partial aggregation, so a long log is no one task.

    Usage is that of the last report, or the sum of `steps`; null without any. An empty log has no row.
    """
    used, by_steps = F.col("role") == "usage", F.col("agent") == "steps"
    usage = F.struct(*[F.when(F.col("reported"), F.col(c)).alias(c) for c in COUNTERS])
    found = rows.groupBy("log", "agent").agg(
        last("thread_id", (F.col("thread_id") != "") & used).alias("of_usage"),
        last("thread_id", F.col("thread_id").isNotNull() & (by_steps | (F.col("role") == "session"))).alias("of_session"),
        last(usage, used).alias("last"), *[F.sum(F.when(used, F.col(c))).alias(f"sum_{c}") for c in COUNTERS],
        last("message", F.col("message").isNotNull()).alias("message"), last("cost_usd", used).alias("cost"), F.sum("cost_usd").alias("costs"),
        last("turns", used).alias("turns"), F.count_if(used).alias("steps"), last("model", F.col("model").isNotNull()).alias("model"), last("reason", used).alias("reason"),
    )
    of_last = F.when(F.col("agent") == "result", F.coalesce("of_usage", "of_session")).otherwise(F.col("of_session"))
    both = lambda a, b: F.when(by_steps, a).otherwise(b)
    return found.select(
        "log", "agent", F.coalesce(of_last, F.lit("")).alias("thread_id"), *[both(F.col(f"sum_{c}"), F.col(f"last.{c}")).alias(c) for c in COUNTERS],
        F.coalesce("message", F.lit("")).alias("final_message"), both(F.when(F.col("steps") > 0, F.coalesce("costs", F.lit(0.0))), F.col("cost")).alias("total_cost_usd"),
        both(F.nullif(F.col("steps"), F.lit(0)), F.col("turns")).alias("num_turns"), F.coalesce("model", F.lit("")).alias("model"), F.col("reason").alias("terminal_reason"),
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """(log, line, verdict) of each error and each bad end: an error is a warning if the log's next end is good; at the log's end it stays an error."""
    ends = rows.filter(F.col("outcome").isin("good", "bad")).select("log", "line", F.col("outcome").alias("end"))
    errors = asof(rows.filter("outcome = 'error'").select("log", "line"), ends, ["log"], "line", ["end"], forward=True)
    pending = errors.select("log", "line", F.when(F.col("end") == "good", "warning").otherwise("error").alias("verdict"))
    return pending.unionByName(ends.filter("end = 'bad'").select("log", "line", F.lit("error").alias("verdict")))


def diagnostics(rows: DataFrame) -> DataFrame:
    """A row for each log: lines, lines that aren't JSON, errors, warnings, and whether all errors are ends at the limit of turns.

    The few columns that verdicts and counts need are written once, so each line is parsed once.
    """
    rows = written(rows.select("log", "line", "parse_error", "outcome", "turn_limit"))
    told = rows.join(verdicts(rows), ["log", "line"], "left")
    errors = F.count_if(F.col("verdict") == "error")
    return told.groupBy("log").agg(
        F.count("*").alias("event_count"), F.count_if("parse_error").alias("parse_errors"), errors.alias("errors"), F.count_if(F.col("verdict") == "warning").alias("warnings"),
        ((errors > 0) & (errors == F.count_if((F.col("verdict") == "error") & F.col("turn_limit")))).alias("only_turn_limit"),
    )


def model_usage(rows: DataFrame) -> DataFrame:
    """(log, line, model, field, value): numbers that results give for each model, whatever their names."""
    given = rows.filter("models IS NOT NULL").select("log", "line", "models")
    each = given.sparkSession.sql("SELECT log, line, m.key AS model, m.value AS fields FROM {given}, LATERAL variant_explode(models) m", given=given)
    return each.sparkSession.sql(
        "SELECT log, line, model, f.key AS field, try_variant_get(f.value, '$', 'double') AS value FROM {each}, LATERAL variant_explode_outer(fields) f WHERE try_variant_get(f.value, '$', 'double') IS NOT NULL", each=each
    )
