"""WARC archives: writing, normalising whole-file gzip, and reading by offset.

Many archives come as one gzip stream over all records, which can only be read from the
start. ``normalise`` inflates such a stream once, piece by piece, writes every record as
a gzip member of its own, and beside the archive a sidecar: a JSON line per record with
its offset and length. A record of any size passes through in pieces. ``read_records``
starts from the sidecars' lines, so any number of tasks can read any records.

``write_pages`` makes the archives to begin with: one per task, each one gzip stream.
Pages with equal payloads share one response record, that of the smallest page id; the
others are revisit records that name it.

A file gets its name only when it is whole, and a repeated task replaces it with an equal
one. Files lie in a folder of shared storage.

Results in special cases: a null page is an empty payload. Pages without an id are
responses. Rows that repeat a page id with the payload of a response of that id are
responses too. A null address leaves out its header; control characters and spaces in it
are percent-encoded. An empty table gives no archive. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.llm.common import BROADCAST_BYTES, Scratch, file_system, publish, texts_of
from subflow.operators.spread import attach_per_key

LEVEL = 4
PIECE = 1 << 18
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payload bytes that a reader puts out at once, or one record's.
BYTES_AT_ONCE = 8 * 1024 * 1024
GZIP = 31  # zlib's window bits for a gzip member

SIDECAR = "archive string, offset bigint, length bigint, id string, type string, uri string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    name = record.rsplit(":", 1)[-1].rstrip(">") if record else "none"
    return None if name == "none" else int(name)


def _safe(uri: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def record(page_id, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record with its headers; a revisit has the payload's digest and length alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces, whether it is one member or several."""
    stream, fed = zlib.decompressobj(GZIP), False
    while raw := source.read(PIECE):
        while raw:
            fed = True
            if out := stream.decompress(raw, PIECE):
                yield out
            raw = stream.unconsumed_tail
            if stream.eof:
                raw = stream.unused_data.lstrip(b"\0") or b""
                stream, fed = zlib.decompressobj(GZIP), False
    if fed and not stream.eof:
        raise EOFError("the gzip stream ends inside a member")


def parted(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """Records as pieces: ("head", bytes) starts one, ("block", bytes) go on with it."""
    held = b""
    for piece in pieces:
        held += piece
        while True:
            held = held.lstrip(b"\r\n")
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break  # the header goes on in the next piece
            head, held = held[: end + 4], held[end + 4 :]
            left = int(headers_of(head)["content-length"])
            yield "head", head
            while left:
                if not held:
                    held = next(pieces, b"")
                    if not held:
                        raise EOFError("the archive ends inside a record")
                yield "block", held[:left]
                taken = min(left, len(held))
                held, left = held[taken:], left - taken
    if held.strip(b"\r\n"):
        raise EOFError("the archive ends inside a header")


def _new_file(folder: str, name: str):
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)
    made = f"{place}/.{name}.{uuid.uuid4().hex}"
    return fs, made, f"{place}/{name}", fs.open_output_stream(made, compression=None)


def normalise_file(folder: str, name: str, to: str) -> int:
    """One archive: every record as a member of its own, and the sidecar. Records written."""
    fs, place = file_system(folder)
    new_fs, made, final, out = _new_file(to, name)
    lines, at, member, about = [], 0, None, {}

    def end_record() -> None:
        nonlocal at
        data = member.compress(b"\r\n\r\n") + member.flush()
        out.write(data)
        at += len(data)
        lines.append(about | {"length": at - about["offset"]})

    with fs.open_input_stream(f"{place}/{name}", compression=None) as source:
        for kind, data in parted(inflated(source)):
            if kind == "head":
                if member:
                    end_record()
                found = headers_of(data)
                about = {
                    "archive": name,
                    "offset": at,
                    "id": found.get("warc-record-id"),
                    "type": found.get("warc-type"),
                    "uri": found.get("warc-target-uri"),
                }
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            data = member.compress(data)
            out.write(data)
            at += len(data)
        if member:
            end_record()
    out.close()
    publish(new_fs, made, final)
    new_fs, made, final, out = _new_file(f"{to}/index", f"{name}.json")
    out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
    out.close()
    publish(new_fs, made, final)
    return len(lines)


def with_first_page(pages: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """``page_id, url, html, refers_to``: for a revisit, the page that has the response.

    Digests are combined before the shuffle, and pages find their digest's first page by
    a join that a payload with very many copies doesn't slow. The texts themselves move
    only if the revisits are too many to send to every task.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    seen = scratch.stage(keyed.select("page_id", "digest", F.octet_length("html").alias("bytes")), "digests")
    copies = (
        seen.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"))
        .filter("first != last")
    )
    again = attach_per_key(
        seen.filter("page_id is not null"), copies.drop("last"), "digest", "n", broadcast_bytes=BROADCAST_BYTES
    ).filter("page_id != first")
    name = F.concat_ws(":", "page_id", "digest")
    revisits = again.select(name.alias("name"), F.col("first").alias("refers_to")).distinct()
    return attach_per_key(
        keyed.withColumn("name", F.when(F.col("page_id").isNotNull(), name)),
        revisits.withColumn("n", F.lit(1)),
        "name",
        "n",
        how="left",
        broadcast_bytes=BROADCAST_BYTES,
    ).select("page_id", "url", "html", "refers_to")


def write_pages(pages: DataFrame, folder: str, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages, each one gzip stream; ``name, records`` of each."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, records = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        opened, stream = None, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        for batch in batches:
            opened = opened or _new_file(folder, name)
            rows = zip(batch["page_id"].astype("Int64"), batch["url"], texts_of(batch["html"]), batch["refers_to"].astype("Int64"), strict=True)
            for page_id, url, html, refers_to in rows:
                known = [None if x is pd.NA else int(x) for x in (page_id, refers_to)]
                made = record(known[0], url if isinstance(url, str) else None, html.encode("utf-8", "replace"), known[1])
                opened[3].write(stream.compress(made))
                records += 1
        if opened:
            opened[3].write(stream.flush())
            opened[3].close()
            publish(opened[0], opened[1], opened[2])
            yield pd.DataFrame({"name": [name], "records": [records]})

    ready = with_first_page(pages, scratch, min_bytes)
    return scratch.stage(ready.mapInPandas(write, "name string, records bigint"), "archives")


def normalise(archives: DataFrame, folder: str, to: str, scratch: Scratch) -> DataFrame:
    """Every archive of ``archives`` (name) normalised, a task each; ``name, records``."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                yield pd.DataFrame({"name": [name], "records": [normalise_file(folder, name, to)]})

    n = max(1, archives.count())
    each = archives.select("name").repartition(n, "name")
    return scratch.stage(each.mapInPandas(rewrite, "name string, records bigint"), "normalised")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """``headers, payload`` of every record that the sidecars name, read at its offset."""
    index = spark.read.schema(SIDECAR).json(f"{folder}/index")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, place = file_system(folder)
        name, source = None, None
        for batch in batches:
            found, held = [], 0
            for archive, offset, length in zip(batch["archive"], batch["offset"], batch["length"], strict=True):
                if archive != name:
                    name, source = archive, fs.open_input_file(f"{place}/{archive}")
                data = zlib.decompress(source.read_at(int(length), int(offset)), GZIP)
                end = data.index(b"\r\n\r\n")
                headers = headers_of(data[: end + 4])
                block = data[end + 4 : end + 4 + int(headers["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                headers["http-content-length"] = headers_of(http).get("content-length", "0")
                found.append((headers, payload))
                held += len(payload)
                if held > BYTES_AT_ONCE:
                    yield pd.DataFrame(found, columns=["headers", "payload"])
                    found, held = [], 0
            yield pd.DataFrame(found, columns=["headers", "payload"])

    return index.select("archive", "offset", "length").mapInPandas(read, "headers map<string,string>, payload binary")


def page_records(records: DataFrame) -> DataFrame:
    """Page ids, digests and types from the records; a response's digest is made anew."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for headers, payload in zip(batch["headers"], batch["payload"], strict=True):
                headers = dict(headers)
                kind, named = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(headers["http-content-length"])
                if kind == "response" and (len(payload), base32_sha1(payload)) != (size, named):
                    raise ValueError(f"{headers['warc-record-id']}: the payload isn't the one that was written")
                refers = page_of(headers.get("warc-refers-to"))
                found.append((page_of(headers["warc-record-id"]), size, named, kind, refers))
            columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            out = pd.DataFrame(found, columns=columns)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return records.mapInPandas(
        describe,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    )


def archived(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages as whole-file gzip, normalise that, and read the records back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = folder or scratch.path("archives")
    archives = write_pages(pages, f"{folder}/whole", scratch, min_bytes)
    normal = normalise(archives, f"{folder}/whole", f"{folder}/records", scratch)
    if not normal.count():
        file_system(f"{folder}/records")[0].create_dir(f"{file_system(folder)[1]}/records/index", recursive=True)
    scratch.drop_path(f"{folder}/whole")
    return page_records(read_records(spark, f"{folder}/records"))
