"""The gate on a stream: a file's rows leave when complete, or when it goes idle."""

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from subflow.operators.ranks import ranked
from subflow.operators.spread import attach_per_key
from subflow.schemas import PACKET_COLUMNS, RELEASE, RELEASE_CUT
from subflow.streaming.session import with_state_store
from subflow.streaming.together import per_file

# Workers get the processor with the query and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDLE_MS = 10_000


class HoldFile(StatefulProcessor):
    """Counts the good rows a file holds and knows the arrivals they came in.

    A file's arrivals come in rising order; one that isn't beyond the last has been
    counted. What is rewritten at a line are a few numbers; its arrival is added to a list
    that is read only when the rows leave, so a line costs the same however many arrivals
    the file has.

    A release covers whole arrivals, unless ``by_row``: then rows leave as soon as their
    number is the expected one, in the middle of an arrival too, and its other rows wait
    for the next status or the timer.
    """

    def __init__(self, idle_ms: int = IDLE_MS, by_row: bool = False) -> None:
        self.idle_ms, self.by_row = idle_ms, by_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState(
            "file", "expected bigint, held bigint, skip bigint, last bigint, last_active bigint"
        )
        self.arrivals = handle.getListState("arrivals", "arrival bigint, good bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each call on the state is a round trip, so none is made without need.
        before = self.file.get()
        expected, held, skip, last, active = before or (None, 0, 0, -1, 0)
        if before:
            self.handle.deleteTimer(active + self.idle_ms)
        new, is_kept = [], bool(held)
        # A status first: then a release is at the very arrival that makes it complete.
        for row in sorted(rows, key=lambda r: (r.expected is None, r.arrival or 0)):
            if row.expected is not None:
                expected = row.expected
            earlier = held
            if row.held and row.arrival > last:
                held, last = held + row.held, row.arrival
                new.append((row.arrival, row.held))
            is_met = expected is not None and held == expected
            is_cut = self.by_row and expected is not None and earlier < expected < held
            if is_met or is_cut:
                arrivals = [*(self.arrivals.get() if is_kept else ()), *new]
                if held:
                    upto = arrivals[-1][1] - (held - expected) if is_cut else None
                    yield self._release(key, arrivals, expected, True, skip, upto)
                if is_kept:
                    self.arrivals.clear()
                new, is_kept = arrivals[-1:] if is_cut else [], False
                # Of the last arrival, so many rows have left.
                skip = upto if is_cut else 0
                held, expected = held - expected, None
        if expected is None and held == 0:
            if before:
                self.file.clear()
            return
        if new:
            self.arrivals.appendList(new)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.file.update((expected, held, skip, last, now))
        self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.file.get()
        if not before:
            return
        _, held, skip, _, active = before
        idle_at = active + self.idle_ms
        if timerValues.getCurrentProcessingTimeInMs() < idle_at:
            self.handle.registerTimer(idle_at)
            return
        if held:
            yield self._release(key, list(self.arrivals.get()), held, False, skip, None)
            self.arrivals.clear()
        self.file.clear()

    def _release(self, key, arrivals, held, complete, skip, upto) -> Row:
        whole = Row(file_name=key[0], arrivals=[a for a, _ in arrivals], held=held, is_complete=complete)
        return Row(**whole.asDict(), skip=skip, upto=upto) if self.by_row else whole

    def close(self) -> None:
        pass


def gate_stream(
    statuses: DataFrame, progress: DataFrame, idle_ms: int = IDLE_MS, by_row: bool = False
) -> DataFrame:
    """Releases: file, its arrivals, number of rows, complete or by timeout; ``by_row``, where they are cut.

    ``statuses`` are the reconciled counts, ``progress`` the counts of good rows per
    arrival; either may come first. Each new line restarts a file's idle time. State
    is a few numbers per file that has not been released, and one per arrival; it ends with
    the release, and a file with no good row leaves none behind.
    """
    with_state_store(progress.sparkSession)
    expected = statuses.select(
        "file_name",
        F.lit(None).cast("bigint").alias("arrival"),
        F.col("countGoodRecords").alias("expected"),
        F.lit(0).cast("bigint").alias("held"),
    )
    held = progress.filter(F.col("good") > 0).select(
        "file_name", "arrival", F.lit(None).cast("bigint").alias("expected"), F.col("good").alias("held")
    )
    lines = expected.unionByName(held)
    return per_file(lines, HoldFile(idle_ms, by_row), RELEASE_CUT if by_row else RELEASE)


def released_rows(
    releases: DataFrame, read_rows: Callable[[list[int]], DataFrame], **spread
) -> DataFrame:
    """The rows a table of releases lets go.

    ``read_rows`` gives the good rows of some arrivals, with ``arrival``. Only arrivals
    that a release names are read, and a row meets the release of its file and arrival
    alone, so every row leaves once. Where a release ends within an arrival, that arrival's
    rows are ranked by where they stood in their file (by their values, where that isn't
    known), and each part leaves with its own release.
    """
    number = F.col("at") + 1 == F.size("arrivals")
    is_cut = "upto" in releases.columns
    low = F.when(F.col("at") == 0, F.col("skip")).otherwise(0) if is_cut else F.lit(0)
    high = F.when(number, F.col("upto")) if is_cut else F.lit(None)
    named = releases.select("*", F.posexplode("arrivals").alias("at", "arrival")).select(
        "file_name", "arrival", "is_complete", low.cast("bigint").alias("low"), high.cast("bigint").alias("high")
    )
    whole = named.filter("low = 0 and high is null")
    key = F.struct("file_name", "arrival").alias("key")
    rows = read_rows(_arrivals(whole)).select(key, *PACKET_COLUMNS)
    per_key = whole.select(key, "is_complete", F.lit(1).alias("n"))
    joined = attach_per_key(rows, per_key, on="key", weight="n", **spread)
    out = joined.select(*PACKET_COLUMNS, "is_complete")
    parts = named.filter("low > 0 or high is not null")
    if not is_cut or parts.isEmpty():
        return out
    # Only the rows of arrivals that are cut are ranked, and no file is in one task for that.
    cut = parts.groupBy("file_name", "arrival").agg(
        F.collect_list(F.struct("low", "high", "is_complete")).alias("cuts"), F.lit(1).alias("n")
    )
    rows = read_rows(_arrivals(parts))
    rows = rows.select(key, *(c for c in rows.columns if c != "arrival"))
    rows = attach_per_key(rows, cut.select(key, "cuts", "n"), on="key", weight="n", **spread)
    order = [c for c in ("record_at", *PACKET_COLUMNS[1:]) if c in rows.columns]
    placed = ranked(rows.select("*", "key.arrival").drop("key"), ["file_name", "arrival"], order)
    takes = F.filter(
        "cuts", lambda c: (F.col("rank") > c["low"]) & (F.col("rank") <= F.coalesce(c["high"], F.col("rank")))
    )
    taken = placed.withColumn("cut", F.explode(takes))
    return out.unionByName(taken.select(*PACKET_COLUMNS, "cut.is_complete"))


def _arrivals(named: DataFrame) -> list[int]:
    """The arrivals that lines name; fewer than the micro-batches since the oldest row that waits."""
    return sorted(r["arrival"] for r in named.select("arrival").distinct().collect())
