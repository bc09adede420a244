"""Token ids in files of fixed-width bits.

An id takes the fewest bits that hold the vocabulary's largest. Ids stand in blocks of
``BLOCK_IDS``, a multiple of 8, so every block starts on a whole byte; a block is unpacked
in one numpy step, and any run of ids is read through its blocks alone.

A file, little-endian throughout:

    the blocks, one after the other, each of BLOCK_IDS ids but the last
    for each document in order: id as int64, whether it has an id as uint8, first id as uint64
    for each block: first byte as uint64
    JSON: bits, block_ids, n_ids, n_docs, where each table starts
    length of the JSON as uint32, then MAGIC

The tables come last, so a task writes blocks as it goes and holds one block and its
documents' starts. Files are named by number in the order of ids: documents are ranged by
id (rows that repeat an id by the hash of their texts), and each range is one file. A file
is written beside its place and then moved there, so a repeated task replaces it with an
equal one.

Words are encoded once per Python worker, as long as its memory of bounded bytes holds
them (see ``encoding``).

Results in special cases: a null or empty text has the end id alone. Rows without an id
come first. Rows that repeat are documents of their own. An empty table gives no file and
an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.llm import encoding
from subflow.llm.common import Scratch, file_system, publish, texts_of

MAGIC = b"FWBITS01"
BLOCK_IDS = 1 << 14
# Words and pieces that a worker remembers, 64 bytes for each at most.
REMEMBERED = 400_000


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as bits, the first id in the lowest bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = spread
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class Encoder(encoding.Encoder):
    def __init__(self, path: str):
        super().__init__(path, REMEMBERED)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass
class _Documents:
    ids: list
    known: list
    starts: list


class Writer:
    """One file, written block by block."""

    def __init__(self, folder: str, number: int, bits: int):
        self.fs, self.folder = file_system(folder)
        self.name = f"tokens-{number:06d}.bin"
        self.bits, self.n_ids, self.at = bits, 0, 0
        self.blocks: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.docs = _Documents([], [], [])
        self.fs.create_dir(self.folder, recursive=True)
        self.made = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.made, compression=None)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.ids.append(0 if doc_id is None else doc_id)
        self.docs.known.append(doc_id is not None)
        self.docs.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        full = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for start in range(0, full, BLOCK_IDS):
            data = pack(ids[start : min(start + BLOCK_IDS, full)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def close(self) -> str:
        self._flush(last=True)
        n = len(self.docs.ids)
        tables = [
            np.array(self.docs.ids, "<i8").tobytes(),
            np.array(self.docs.known, np.uint8).tobytes(),
            np.array(self.docs.starts, "<u8").tobytes(),
            np.array(self.blocks, "<u8").tobytes(),
        ]
        at = self.at
        about = {"bits": self.bits, "block_ids": BLOCK_IDS, "n_ids": self.n_ids, "n_docs": n, "tables": []}
        for table in tables:
            about["tables"].append(at)
            at += len(table)
        text = json.dumps(about).encode()
        self.out.write(b"".join(tables) + text + np.array([len(text)], "<u4").tobytes() + MAGIC)
        self.out.close()
        final = f"{self.folder}/{self.name}"
        publish(self.fs, self.made, final)
        return final


class Reader:
    """Random access to one file: its tables, and any run of ids through its blocks."""

    def __init__(self, folder: str, name: str):
        fs, place = file_system(folder)
        self.file = fs.open_input_file(f"{place}/{name}")
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{name} is not a file of packed ids")
        length = int(np.frombuffer(tail, "<u4", 1)[0])
        self.about = json.loads(self.file.read_at(length, size - 12 - length))
        n, n_blocks = self.about["n_docs"], -(-self.about["n_ids"] // self.about["block_ids"])
        at = self.about["tables"]
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n, at[0]), "<i8")
        self.known = np.frombuffer(self.file.read_at(n, at[1]), np.uint8).astype(bool)
        self.starts = np.frombuffer(self.file.read_at(8 * n, at[2]), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(self.file.read_at(8 * n_blocks, at[3]), "<u8").astype(np.int64)
        self.ends = np.append(self.starts[1:], self.about["n_ids"])

    def ids(self, start: int, end: int) -> np.ndarray:
        """The file's ids from ``start`` to ``end``."""
        if end <= start:
            return np.empty(0, np.uint32)
        size, bits = self.about["block_ids"], self.about["bits"]
        first, last = start // size, (end - 1) // size
        n = min((last + 1) * size, self.about["n_ids"]) - first * size
        data = self.file.read_at(-(-n * bits // 8), int(self.blocks[first]))
        return unpack(data, n, bits)[start - first * size : end - first * size]

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write ``docs`` as files of ids; one line per file: number, name, documents, ids."""
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    numbered = ordered.withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, writer, number = encoder(tokenizer), None, None
        end = np.array([end_id], "<u4").tobytes()
        bits = width(max(made.vocabulary, end_id + 1))
        for batch in batches:
            ids, texts = batch["doc_id"].astype("Int64").tolist(), texts_of(batch["text"])
            for start, stop in encoding.slices(texts):
                if writer is None:
                    number = int(batch["part"].iloc[0])
                    writer = Writer(folder, number, bits)
                for doc_id, data in zip(ids[start:stop], made.encode(texts[start:stop]), strict=True):
                    known = None if doc_id is pd.NA else doc_id
                    writer.add(known, np.frombuffer(data + end, "<u4"))
        if writer is not None:
            writer.close()
            yield pd.DataFrame(
                {"part": [number], "name": [writer.name], "n_docs": [len(writer.docs.ids)], "n_ids": [writer.n_ids]}
            )

    files = numbered.mapInPandas(write, "part int, name string, n_docs bigint, n_ids bigint")
    return scratch.stage(files, "files")


def read_tokens(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    lines = files.orderBy("part").collect()  # a line per file
    start, offsets = 0, []
    for line in lines:
        offsets.append((line["name"], start))
        start += line["n_ids"]
    parts = spark.createDataFrame(offsets, "name string, first bigint")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, first in zip(batch["name"], batch["first"].tolist(), strict=True):
                reader = Reader(folder, name)
                n, at = len(reader.starts), 0
                while at < n:  # as many documents as a few blocks hold, or one
                    upto = int(np.searchsorted(reader.ends, reader.starts[at] + 64 * BLOCK_IDS, "right"))
                    upto = max(at + 1, upto)
                    low = int(reader.starts[at])
                    raw = reader.ids(low, int(reader.ends[upto - 1])).astype("<u4").tobytes()
                    begin, end = reader.starts[at:upto] - low, reader.ends[at:upto] - low
                    pieces = zip(begin.tolist(), end.tolist(), strict=True)
                    ids = pd.array(reader.doc_ids[at:upto], dtype="Int64")
                    ids[~reader.known[at:upto]] = pd.NA
                    yield pd.DataFrame(
                        {
                            "doc_id": ids,
                            "start": reader.starts[at:upto] + first,
                            "n_tokens": end - begin,
                            "ids_crc32": [zlib.crc32(raw[4 * b : 4 * e]) for b, e in pieces],
                        }
                    )
                    at = upto
                reader.close()

    spread = parts.repartition(max(1, len(offsets)), "name")
    return spread.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the files, into a folder of shared storage, and read them back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = folder or scratch.path("files")
    return read_tokens(spark, write_tokens(docs, folder, tokenizer, end_id, scratch), folder)
