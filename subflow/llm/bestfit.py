"""Documents packed into as few sequences as best-fit decreasing finds, cut only where they must be.

A document's ids, with an end id, are one piece, or pieces of the capacity and a rest if
there are more. Best-fit decreasing takes pieces from the longest down and puts each into
the open sequence with the least room that holds it. What it does depends on lengths
alone, and those are whole numbers up to the capacity. So it runs over the counts of each
length, at most as many as the capacity, however many documents there are: a segment tree
over the remaining capacities finds the tightest open sequence in logarithmic time, and
pieces of one length that fall to alike sequences are placed together, as one line of a
plan (length, first rank, sequences from, pieces in each, offset).

Pieces are written once and ranged by length, and by the file and row where they were
written, which are theirs alone; so a length that a third of all pieces have is many
tasks. A piece's rank among those of its length is its row in its file, moved by the
counts of the files before, and its line of the plan gives its sequence and offset. The
driver sees a line per file and length of a sorted table, no pieces.

Results in special cases: a null or empty text is the end id alone. A very long text is
cut at every ``capacity`` ids and its rest packed like a document. Ties of length go by
where the pieces were written; rows that repeat are documents of their own, rows without
an id keep a null one. An empty table gives an empty result. Only the id and text columns
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.llm import packing
from subflow.llm.common import BROADCAST_BYTES, Scratch

CAPACITY = 4096


class OpenSequences:
    """Runs of alike open sequences by their remaining capacity, under a segment tree.

    A leaf holds the runs (first number, how many) with one remaining capacity, an inner
    node whether there are any below.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()  # leaves 0 to capacity
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append((first, n))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def _mark(self, room: int) -> None:
        node = room + self.size
        self.any[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open sequence that holds ``length``."""
        node = length + self.size
        while not self.any[node]:
            while node & 1:  # a right child: all that is greater lies above
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Lines (length, first rank, first sequence, pieces in each, offset), by length and rank.

    Pieces of a line fill its sequences one after the other. There are a few lines per
    length: a run of alike sequences is split in two at most per length, and each time it
    is taken what remains of it is less than half as much.
    """
    sequences, made, lines = OpenSequences(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = sequences.tightest(length)
            if room is None:
                room, (first, n) = capacity, (made, -(-left // (capacity // length)))
                made += n
            else:
                first, n = sequences.take(room)
            # The fullest sequence that still has room is the tightest: each takes all it can.
            each = room // length
            full = min(n, left // each)
            lines.append((length, rank, first, each, capacity - room))
            sequences.put(room - full // full * each * length if full else 0, first, full)
            rest = left - full * each if full < n else 0
            if rest:  # fewer than ``each``: the next sequence takes them
                sequences.put(room - rest * length, first + full, 1)
            if full < n:
                sequences.put(room, first + full + bool(rest), n - full - bool(rest))
            placed = full * each + rest
            left, rank = left - placed, rank + placed
    return sorted(lines)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and its ids if asked for."""

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
    names = [name for name in kinds if with_ids or name != "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = packing.encoder(tokenizer)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            doc_ids, row = batch.column("doc_id"), 0
            for encoded in made.encode_column(batch.column("text")):
                at, columns = [], {name: [] for name in names}
                for ids in encoded:
                    ids += end
                    for k, start in enumerate(range(0, len(ids), step)):
                        part = ids[start : start + step]
                        at.append(row)
                        for name, value in zip(names[1:], (k, start // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                            columns[name].append(value)
                    row += 1
                columns["doc_id"] = doc_ids.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_pydict({name: pa.array(columns[name], kinds[name]) for name in names})

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def _ranked(scratch: Scratch, items: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The rows of a staged table with ``_rank`` among those of their ``length``, and each length's count."""
    spark = items.sparkSession
    place = ["length", "_file", "_row"]
    placed = items.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    in_order = placed.repartitionByRange(*place).sortWithinPartitions(*place).drop("_file", "_row")
    in_order = scratch.stage(in_order, "by-length")
    located = in_order.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    runs = located.groupBy("_file", "length").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    totals: dict[int, int] = {}
    moves = []
    # A line per file and one more per length: each file holds a range of (length, place).
    for line in runs.orderBy("_file", "length").toLocalIterator():
        before = totals.get(line["length"], 0)
        totals[line["length"]] = before + line["n"]
        moves.append((line["_file"], line["length"], before - line["first"]))
    moved = spark.createDataFrame(moves, "_file string, length bigint, _move bigint")
    if 64 * len(moves) <= BROADCAST_BYTES:
        moved = F.broadcast(moved)
    ranked = located.join(moved, ["_file", "length"]).withColumn("_rank", F.col("_row") + F.col("_move"))
    return ranked.select(*items.columns, "_rank"), totals


def best_fit(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """A staged table's rows with ``sequence_id`` and ``offset`` by their ``length`` (1 to ``capacity``)."""
    spark = items.sparkSession
    ranked, totals = _ranked(scratch, items)
    lines = np.array(plan(totals, capacity), np.int64).reshape(-1, 5)
    # A few lines per length, so at most some MB whatever the table's size.
    known = spark.sparkContext.broadcast(lines)
    columns = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = known.value
        # Ranks are below 2 ** 48 and lengths below 2 ** 15.
        begins = (lines[:, 0] << 48) + lines[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["_rank"].to_numpy(np.int64)
            line = lines[np.searchsorted(begins, (length << 48) + rank, "right") - 1]
            nth = rank - line[:, 1]
            batch["sequence_id"] = line[:, 2] + nth // line[:, 3]
            batch["offset"] = line[:, 4] + nth % line[:, 3] * length
            if "doc_id" in batch:
                batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(place, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    scratch = Scratch(docs.sparkSession, "bestfit")
    return best_fit(scratch.stage(pieces(docs, tokenizer, end_id, capacity), "pieces"), scratch, capacity)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences: ``sequence_id, n_tokens, doc_ids, offsets, ids`` (little-endian 32-bit numbers).

    A sequence has at most ``capacity`` ids, so its group is small however many there are.
    """
    scratch = Scratch(docs.sparkSession, "bestfit")
    made = scratch.stage(pieces(docs, tokenizer, end_id, capacity, with_ids=True), "pieces")
    placed = best_fit(made, scratch, capacity)
    part = F.struct("offset", "length", "doc_id", "ids")
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda joined, p: F.concat(joined, p["ids"])).alias("ids"),
    )
