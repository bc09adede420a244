"""What a stream finds in a folder, written down, so that it finds each thing once.

A streaming source whose input is names needs offsets that mean the same after a restart.
New names are written to a log, a file of JSON lines per step, before their number is given
out as an offset. A step that is there is never changed: a stream that is started again
reads the same names for the same offsets, and a step that was written but never used is
used next.
"""

import json
import os
import uuid
from collections.abc import Iterable

import pyarrow.fs as pafs


def file_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, from its path or URI, and the folder's path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def write_whole(store: pafs.FileSystem, path: str, data: bytes, making: str | None = None) -> None:
    """A small file that appears with all its content, or not at all; made in a folder ``making``."""
    folder, _, name = path.rpartition("/")
    making = making or folder
    for needed in {folder, making}:
        store.create_dir(needed, recursive=True)
    made = f"{making}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(made) as out:
        out.write(data)
    store.move(made, path)


def read_whole(store: pafs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as file:
        return file.read()


class Found:
    """The log of one stream. A key is known once it has been in a step."""

    def __init__(self, log: str) -> None:
        self.store, self.folder = file_store(log)
        self.steps = 0
        self.known: set[str] = set()
        if self._is_file(self._taken):
            self.known.update(read_whole(self.store, self._taken).decode().splitlines())
        self.catch_up()

    def catch_up(self) -> None:
        """Take over the steps that are there; they have no gaps."""
        while self._is_file(self._path(self.steps)):
            self.known.update(entry["key"] for entry in self.entries(self.steps))
            self.steps += 1

    @property
    def _taken(self) -> str:
        return f"{self.folder}/taken"

    def _is_file(self, path: str) -> bool:
        return self.store.get_file_info(path).type == pafs.FileType.File

    def take(self, keys: Iterable[str]) -> None:
        """What has been dealt with elsewhere, before the stream: it is known and in no step."""
        self.known.update(keys)
        write_whole(self.store, self._taken, "\n".join(sorted(self.known)).encode())

    def _path(self, step: int) -> str:
        return f"{self.folder}/{step:09d}.json"

    def add(self, entries: Iterable[dict], most: int | None = None) -> int:
        """Write new entries (each with a ``key``) as steps of at most ``most``; the number of steps."""
        new = [entry for entry in entries if entry["key"] not in self.known]
        for start in range(0, len(new), most or max(len(new), 1)):
            step = new[start : start + (most or len(new))]
            text = "\n".join(json.dumps(entry) for entry in step)
            write_whole(self.store, self._path(self.steps), text.encode())
            self.known.update(entry["key"] for entry in step)
            self.steps += 1
        return self.steps

    def next_offset(self, entries: Iterable[dict], most: int | None = None) -> int:
        """Add entries, and say up to which step the stream may go: one more if steps are bounded.

        What has been said is written down as well, since a stream that is started again
        asks for its next offset before it tells the last one.
        """
        steps = self.add(entries, most)
        if not most:
            return steps
        place = f"{self.folder}/given"
        given = int(read_whole(self.store, place)) if self._is_file(place) else 0
        if given < steps:
            given += 1
            write_whole(self.store, place, str(given).encode())
        return given

    def entries(self, step: int) -> list[dict]:
        return [json.loads(line) for line in read_whole(self.store, self._path(step)).decode().splitlines()]

    def between(self, start: int, end: int) -> list[dict]:
        return [entry for step in range(start, end) for entry in self.entries(step)]
