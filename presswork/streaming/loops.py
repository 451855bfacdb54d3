"""Background loops: a clock stream drives a step with retries in the next tick."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LOG = logging.getLogger(__name__)
DRAIN_SECONDS, SWEEP_SECONDS = 1, 300


def guarded(step: Callable[[], object]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that logs a failing step and lets the loop go on."""

    def run(_: DataFrame, tick: int) -> None:
        try:
            step()
        except Exception:
            LOG.exception("step failed at tick %d; it runs again at the next", tick)

    return run


def every(spark: SparkSession, seconds: float, step: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Runs step every ``seconds`` (drain: 1, sweep: 300) until the query is stopped."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(guarded(step)).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").option("checkpointLocation", checkpoint).start()


def drain(claim: Callable[[], bool]) -> Callable[[], int]:
    """A step that claims and runs jobs until none is left; gives how many ran."""

    def step() -> int:
        n = 0
        while claim():
            n += 1
        return n

    return step
