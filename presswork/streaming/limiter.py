"""The anchored request limiter on a stream, with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import Window


def limited(requests: DataFrame, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """requests (consumer string, ts timestamp, request_id long) with allowed and retry_after.

    Rows of a micro-batch are taken in order of time and id; a key's rows of one
    micro-batch are held together, so the batch size bounds memory. The state of a key is its
    window's start and count. It goes by event time, once the watermark (``late``
    behind the newest request) has passed the window's end, so a slow stream loses no
    count. Requests behind the watermark are dropped by Spark.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        w = Window(limit, seconds)
        if state.exists:
            w.start, w.count = state.get
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        got = [w.check(int(t.value // 1000)) for t in rows["ts"]]
        state.update((w.start, w.count))
        state.setTimeoutTimestamp(max(w.start // 1000 + int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"consumer": key[0], "request_id": rows["request_id"].to_numpy(), "allowed": [a for a, _ in got], "retry_after": [r for _, r in got]})

    return requests.withWatermark("ts", late).groupBy("consumer").applyInPandasWithState(
        step, "consumer string, request_id long, allowed boolean, retry_after long", "start long, count int", "append", GroupStateTimeout.EventTimeTimeout
    )
