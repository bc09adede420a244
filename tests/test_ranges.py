"""Byte ranges against a parser that reads one byte after the other."""

import random

import pytest

from subflow.plans.batch import ingest_folder
from subflow.sources import delimited, ranges
from subflow.sources.ranges import BYTE_ORDER_MARK, CLOSING, ESCAPED, PLAIN, QUOTED, START, Bytes

HEAD = "#,StartDate,EndDate,Duration,Price"
TODAY = "2026-12-01"


def one_by_one(data):
    at = len(BYTE_ORDER_MARK) if data.startswith(BYTE_ORDER_MARK) else 0
    state, begin, records = START, 0, []
    while at < len(data):
        byte = data[at : at + 1]
        if state == QUOTED:
            state = {b'"': CLOSING, b"\\": ESCAPED}.get(byte, QUOTED)
        elif state == ESCAPED or (state == CLOSING and byte == b'"'):
            state = QUOTED
        elif byte in (b"\n", b"\r"):
            records.append((begin, data[begin:at]))
            if data[at : at + 2] == b"\r\n":
                at += 1
            begin, state = at + 1, START
        else:
            state = START if byte == b"," else QUOTED if byte == b'"' and state == START else PLAIN
        at += 1
    return records + ([(begin, data[begin:])] if begin < len(data) else [])


def by_ranges(folder, path, size):
    with Bytes(folder, path) as file:
        state, found = START, []
        for start in range(0, max(file.size, 1), size):
            end = min(start + size, file.size)
            for records, at in ranges.records_of(file, start, end, state):
                found += zip(at, records, strict=True)
            skip = ranges.first_state(file)[0] if start == 0 else 0
            state = ranges.end_states(file.read(start + skip, end))[state]
        return found, ranges.first_record(file)


@pytest.mark.parametrize("letters", [b'a",\n', b'a"\\,\r\n', b"ab,\n\r", b'"\n', b'ab,"\n\r\\'])
def test_ranges_equal_one_pass(tmp_path, monkeypatch, letters):
    monkeypatch.setattr(ranges, "AHEAD", 3)
    pick, folder, path = random.Random(letters), str(tmp_path), str(tmp_path / "f")
    for _ in range(250):
        data = bytes(pick.choice(letters) for _ in range(pick.randrange(40)))
        data = (BYTE_ORDER_MARK if pick.random() < 0.2 else b"") + data
        (tmp_path / "f").write_bytes(data)
        want = one_by_one(data)
        for size in range(3, max(len(data), 3) + 2):
            found, first = by_ranges(folder, path, size)
            assert found == want, (data, size)
        if want:
            assert first == want[0][1].decode("utf-8", "replace")
        elif not data:
            assert first is None


def test_a_quote_that_nobody_closes_is_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "MAX_RECORD", 50)
    monkeypatch.setattr(ranges, "AHEAD", 16)
    (tmp_path / "f").write_bytes(b'a,b\n1,"open\n' + b"row\n" * 200)
    found, _ = by_ranges(str(tmp_path), str(tmp_path / "f"), 64)
    assert found[0] == (0, b"a,b") and len(found) == 2 and len(found[1][1]) == 50


def test_bytes_that_are_no_text(tmp_path):
    assert ranges.as_texts([b"a\xffb", "é".encode()]).to_pylist() == ["a\ufffdb", "é"]


@pytest.fixture
def folder(tmp_path):
    note = '"of, two\n""lines"" \\" and\r\nmore"'
    rows = [f"{i},2021-01-01,2021-01-02,1,{i}.5" + (f",{note}" if i % 3 == 0 else "") for i in range(200)]
    (tmp_path / "AAA_1234_12345_01012021.csv").write_bytes(f"{HEAD}\n".encode() + "\n".join([*rows, "end"]).encode())
    (tmp_path / "AAB_1234_12345_01012021.csv").write_bytes("\r\n".join([f'"#"{HEAD[1:]}', *rows[:7], "end", ""]).encode())
    (tmp_path / "AAC_1234_12345_01012021.csv").write_bytes(b"")
    (tmp_path / "_AD_1234_12345_01012021.csv").write_bytes(f"{HEAD}\n{rows[0]}\nend".encode())
    (tmp_path / ".AE_1234_12345_01012021.csv").write_bytes(b"")
    return tmp_path


@pytest.mark.parametrize("size", [7, 64, 1 << 25])
def test_quoted_line_breaks_in_files_of_many_ranges(spark, folder, size):
    files = delimited.of_good_files(delimited.read_files(spark, str(folder)), TODAY)
    headers = delimited.staged(delimited.file_headers(files), "headers")
    records = delimited.header_records(files, headers, range_bytes=size, is_staged=True)
    rows = {}
    for r in sorted(records.collect(), key=lambda r: r.record_at):
        rows.setdefault(r.file_name[:3], []).append((r.id_text, r.price_text, r.headers_ok))
    whole = [(str(i), f"{i}.5", True) for i in range(200)]
    end = ("end", None, False)
    assert rows == {"AAA": [*whole, end], "AAB": [*whole[:7], end], "_AD": [whole[0], end]}


def test_the_text_is_scanned_once(spark, folder, capsys):
    """One step opens the files for their rows; what else reads is the staged headers."""
    files = delimited.of_good_files(delimited.read_files(spark, str(folder)), TODAY)
    headers = delimited.staged(delimited.file_headers(files), "headers")
    delimited.header_records(files, headers, is_staged=True).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "FileFormat: Text" not in plan and "Format: Text" not in plan


def test_every_file_has_its_verdict(spark, folder):
    done = ingest_folder(spark, str(folder), TODAY)
    assert {r.file_name[:3]: r.errors[0].split(": ")[1] for r in done.file_rejects.collect()} == {
        "AAC": "header has no # column",
        ".AE": "filename doesn't correct",
    }
    assert {r.file_name[:3]: r.countGoodRecords for r in done.statuses.collect()} == {"AAA": 200, "AAB": 7, "_AD": 1}
