"""Session settings and helpers for running streams."""

import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Per-file state lives in RocksDB, which spills to disk and writes changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def is_idle(query: StreamingQuery) -> bool:
    """Two batches in a row found no new input and left no state.

    Two, since a query that is started again first repeats its last, cut-off batch.
    """
    last = query.recentProgress[-2:]
    return len(last) == 2 and not any(
        p["numInputRows"] or any(op["numRowsTotal"] for op in p["stateOperators"]) for p in last
    )


def run_until_idle(query: StreamingQuery, seconds: float | None = None) -> None:
    """Let the query take all input and its timers clear all state, then stop it.

    A query with timers runs a batch at every trigger, so waiting for it to have
    nothing to do would not end. With ``seconds``, raises if it is not idle after these.
    """
    deadline = time.monotonic() + seconds if seconds else None
    try:
        while not is_idle(query):
            if not query.isActive:
                raise query.exception() or RuntimeError("the stream has stopped")
            if deadline and time.monotonic() > deadline:
                raise TimeoutError(f"not idle: {query.lastProgress}")
            time.sleep(0.2)
        # Stop between two batches where possible, not in the middle of one.
        for _ in range(100):
            if not query.status["isTriggerActive"]:
                break
            time.sleep(0.02)
    finally:
        query.stop()
