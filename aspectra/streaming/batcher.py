"""Count-or-timeout batches per key on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key string, batch long, reason string, ids array<string>"
STATE = "number long, waiting array<string>, since long"


def batches(stream: DataFrame, size: int = 32, timeout_ms: int = 15_000) -> DataFrame:
    """Groups of ``size`` ids of ``stream(key, id)``; what waits longer than the timeout is flushed as it is.

    The time runs from the first id that waits, however many follow it.  The
    state of a key is its next batch number, less than one batch of ids, and that
    time; (key, batch) never repeats.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, waiting, since = (state.get[0], list(state.get[1]), state.get[2]) if state.exists else (0, [], 0)
        now, out = state.getCurrentProcessingTimeMs(), []
        if not state.hasTimedOut:
            for part in parts:
                since = since if waiting else now
                waiting += part["id"].tolist()
                while len(waiting) >= size:
                    out.append((key[0], number, "count", waiting[:size]))
                    waiting, number, since = waiting[size:], number + 1, now
        if waiting and now - since >= timeout_ms:
            out.append((key[0], number, "timeout", waiting))
            waiting, number = [], number + 1
        state.update((number, waiting, since))
        if waiting:
            state.setTimeoutDuration(max(1, since + timeout_ms - now))
        yield pd.DataFrame(out, columns=["key", "batch", "reason", "ids"])

    return stream.groupBy("key").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
