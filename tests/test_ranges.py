"""Byte ranges against whole files: the same records however a file is cut."""

import csv
import random
import re

import pytest
from pyarrow import fs

from tidewright.plans import onboarding as ob
from tidewright.sources import delimited, ranges

MARKS = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
NAMES = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-8": "UTF-8", "utf-8-sig": "UTF-8", "iso-8859-1": "ISO-8859-1"}


def whole(text, delimiter):
    lines = [line.decode() for line in text.encode().splitlines(keepends=True)]  # line ends of bytes only
    return [r for r in csv.reader(lines, delimiter=delimiter) if r and not (len(r) == 1 and r[0].isspace())]


def cut(path, size, encoding, delimiter):
    """All records of a file read in ranges of `size` bytes, the states composed as `_compose` does."""
    out, state = [], ranges.RECORD
    with ranges.Text(fs.LocalFileSystem(), str(path)) as text:
        for start in range(0, text.size, size):
            stop = min(text.size, start + size)
            out += ranges.records(text, start, stop, encoding, delimiter, state)
            block = text.read(start, stop)
            ends = ranges.end_states(block, delimiter)
            if b'"' not in block and block:
                assert ends == [ranges.QUOTED if s == ranges.QUOTED else ranges.settle(block[-1], delimiter) for s in range(6)]
            state = ends[state]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_records_do_not_depend_on_the_cuts(tmp_path, seed):
    r = random.Random(seed)
    for _ in range(150):
        delimiter = r.choice(ranges.DELIMITERS)
        parts = ['"', '"', '""', "a", "b ", " ", "\n", "\r\n", "\r", delimiter, delimiter, "é", "\U0001f600"]
        text, encoding = "".join(r.choice(parts) for _ in range(r.randrange(1, 70))), r.choice(list(NAMES))
        if encoding == "iso-8859-1":
            text = text.replace("\U0001f600", "x")
        path = tmp_path / "f"
        path.write_bytes(MARKS.get(encoding, b"") + text.encode(encoding))
        assert cut(path, r.choice([4, 6, 10, 16, 1000]), NAMES[encoding], delimiter) == whole(text, delimiter), (text, encoding)


@pytest.mark.parametrize("seed", range(4))
def test_evidence_adds_up_over_ranges(tmp_path, seed):
    r = random.Random(seed)
    for _ in range(80):
        text = "".join(r.choice(["a", "é", ",", ";", "|", '"', "\n", "\r\n", "\r", "\U0001f600"]) for _ in range(r.randrange(1, 120)))
        path = tmp_path / "f"
        path.write_bytes(text.encode())
        lines = [re.sub('"[^"]*("|$)', "", x) for x in re.split("\r\n|\n|\r", text)]
        first = next((re.sub('"[^"]*("|$)', "", x) for x in re.split("\r\n|\n|\r", text) if x.strip()), "")
        heads = [first.count(d) for d in ranges.DELIMITERS]
        want = [sum(x.count(d) == h for x in lines) if h else 0 for d, h in zip(ranges.DELIMITERS, heads)]
        size = r.choice([4, 6, 20, 1000])
        with ranges.Text(fs.LocalFileSystem(), str(path)) as t:
            found = [ranges.evidence(t, s, min(t.size, s + size)) for s in range(0, t.size, size)]
        assert all(f[4] == heads for f in found), text
        assert [sum(f[5][i] for f in found) for i in range(4)] == want, (text, size)
        assert all(f[1] for f in found) and sum(f[2] for f in found) == text.count('"')


def test_invalid_text_is_found_in_any_range(tmp_path):
    for at in range(12):
        data = bytearray("é" * 12, "utf-8")
        data[2 * at + 1] = 0x41
        (tmp_path / "f").write_bytes(bytes(data))
        with ranges.Text(fs.LocalFileSystem(), str(tmp_path / "f")) as t:
            assert not all(ranges.evidence(t, s, min(t.size, s + 4))[1] for s in range(0, t.size, 4))


def test_one_file_of_quoted_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    r = random.Random(1)
    rows = [[str(i), "line\n" * r.randrange(4) + 'say "x", y', r.choice(["", "é", "a,b"])] for i in range(3000)]
    with open(tmp_path / "big.csv", "w", newline="", encoding="utf-16") as f:
        csv.writer(f).writerows([["id", "text", "more\nnames"], *rows])
    some = delimited.read_ranges(spark, str(tmp_path), range_bytes=8192)
    assert some.count() > 10 and {(x.encoding, x.delimiter) for x in some.collect()} == {("UTF-16LE", ",")}
    staged = delimited.read_rows(some, str(tmp_path)).cache()
    assert staged.select("block").distinct().count() > 10
    got = sorted(delimited.with_row_index(staged).collect(), key=lambda x: x.row_index)
    assert [x.row_index for x in got] == list(range(3000))
    assert [[x.raw["id"], x.raw["text"], x.raw["more\nnames"]] for x in got] == rows
    staged.unpersist()


def test_utf16_ragged_and_header_only_files_land(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "wide.csv").write_bytes("id;größe\n1;€ 5\n2\n3;a;b\n".encode("utf-16"))
    (folder / "head.csv").write_text("id,name\n")
    (folder / "other.csv").write_text("id,amount")
    (folder / "empty.csv").write_text("")
    ws = ob.Workspace(spark, str(tmp_path / "state"))
    first = {r.path.rsplit("/", 1)[1]: r for r in ob.land_folder(ws, str(folder), "t", "s", "crm").collect()}
    assert set(first) == {"wide.csv", "head.csv", "other.csv"} and not any(r.is_replay for r in first.values())
    assert len({r.batch_id for r in first.values()}) == 3
    again = ob.land_folder(ws, str(folder), "t", "s", "crm").collect()
    assert all(r.is_replay and r.batch_id == first[r.path.rsplit("/", 1)[1]].batch_id for r in again)
    batches = {r.filename: r for r in ws.read("batches").collect()}
    assert {n: r.row_count for n, r in batches.items()} == {"wide.csv": 3, "head.csv": 0, "other.csv": 0}
    assert batches["wide.csv"].encoding == "UTF-16LE" and batches["wide.csv"].delimiter == ";"
    raw = [r.raw for r in ws.raw().orderBy("row_index").collect()]
    assert raw == [{"id": "1", "größe": "€ 5"}, {"id": "2", "größe": None}, {"id": "3", "größe": "a"}]


def test_tasks_read_many_small_ranges(spark, tmp_path):
    """The number of tasks follows the bytes and the cores, not the number of ranges."""
    (tmp_path / "a.csv").write_bytes(b"x,y\n" + b"1,2\n" * 50_000)
    for i in range(5):
        (tmp_path / f"b{i}.csv").write_bytes(b"x,y\n" + b"3,4\n" * 10)
    some = delimited.read_ranges(spark, str(tmp_path), range_bytes=1 << 10)
    assert some.count() > 200 and delimited.read_rows(some, str(tmp_path)).count() == 50_050
    cores = spark.sparkContext.defaultParallelism
    dealt = ranges.RangeReader(str(tmp_path), 1 << 10, 1 << 27, cores).partitions()
    assert cores <= len(dealt) <= cores + 1 and sum(len(d.value) for d in dealt) == some.count()
    spark.dataSource.register(ranges.ByteRanges)
    with_all = {tuple(r)[:4] for r in spark.read.format("byte_ranges").option("range_bytes", 1 << 10).load(str(tmp_path)).collect()}
    assert with_all == {v for d in dealt for v in d.value}
