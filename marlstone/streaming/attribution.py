"""Error attribution over a growing log: state holds the errors whose turn hasn't ended."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "log string, line long, verdict string"


def attributed(lines: DataFrame, error: str, ends: dict[str, str], closing: str | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """(log, line, verdict) of a stream of (log string, line long, kind string).

    Each `error` line takes the verdict of its log's next line whose kind is in `ends`. It is an error if a line of the
    kind `closing` comes first, or if its log says nothing for `idle_ms`. Verdicts don't depend on how lines fall into
    triggers, as long as a log's lines come in order from trigger to trigger; within one they are sorted. State is the
    numbers of a log's open errors; an end, a close or the timeout clears it. Lines without a log give nothing.
    """
    verdicts = dict(ends) if closing is None else {closing: "error", **ends}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, out = (json.loads(state.get[0]) if state.exists else []), []
        if state.hasTimedOut:
            out, open_ = [(x, "error") for x in open_], []
        else:
            for line, kind in pd.concat(list(batches)).sort_values("line", kind="stable")[["line", "kind"]].itertuples(index=False):
                if kind == error:
                    open_.append(int(line))
                elif kind in verdicts:
                    out += [(x, verdicts[kind]) for x in open_]
                    open_ = []
        if open_:
            state.update((json.dumps(open_),))
            state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"log": [key[0]] * len(out), "line": [x for x, _ in out], "verdict": [v for _, v in out]})

    known = lines.select("log", "line", "kind").filter("log IS NOT NULL")
    return known.groupBy("log").applyInPandasWithState(fold, OUT, "open string", "append", GroupStateTimeout.ProcessingTimeTimeout)
