"""Byte ranges of delimited files: a Python data source that cuts files into ranges, and what a task does with one.

A range can begin anywhere, even inside a quoted cell. What precedes it only matters through one of six states, so a
range yields, for each state it might begin in, the state it ends in; composing these along a file tells every range
where it really begins, and each can then be parsed on its own.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DELIMITERS = (",", ";", "\t", "|")
UTF16 = {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}
UTF8_MARK = b"\xef\xbb\xbf"

#: Where a scan may stand: at a record, at a cell, in a bare cell, in a quoted cell, behind a quote inside one, or
#: behind a carriage return that may have a line feed after it.
RECORD, CELL, BARE, QUOTED, QUOTE, RETURN = range(6)


def filesystem(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path on it, what makes a path a URI) of a folder given as a URI or a local path."""
    if "://" in root or root.startswith("file:"):
        store, path = fs.FileSystem.from_uri(root)
        return store, path, root.split(":", 1)[0] + "://"
    return fs.LocalFileSystem(), root, "file://"


class Text:
    """A file as UTF-8 bytes, whatever UTF-16 or single-byte text it holds: quotes, separators and line ends are bytes
    of their own in all of these. Reads begin and end at even places."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self.mark = self.file.read_at(min(4, self.size), 0)
        self.utf16 = UTF16.get(self.mark[:2])

    def __enter__(self) -> Text:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, start: int, stop: int) -> bytes:
        raw = self.file.read_at(max(0, min(stop, self.size) - start), start)
        if self.utf16:
            raw = raw[: len(raw) // 2 * 2].decode(self.utf16, "surrogatepass").encode("utf-8", "surrogatepass")
        return raw[3:] if start == 0 and raw.startswith(UTF8_MARK) else raw

    def lines(self, block: bytes, stop: int) -> Iterator[bytes]:
        """The lines of a block that ends at `stop` in the file, and those after it, with their ends. A line that runs
        over the end of the block is read on as far as it goes."""
        step = 1 << 16
        while True:
            pieces = block.splitlines(keepends=True)
            more = stop < self.size
            # a carriage return at the end may belong to a line feed that is still to come
            rest = pieces.pop() if pieces and more and not pieces[-1].endswith(b"\n") else b""
            yield from pieces
            if not more:
                return
            block, stop, step = rest + self.read(stop, stop + step), stop + step, min(step * 4, 1 << 23)

    def first_line(self) -> bytes:
        for line in self.lines(self.read(0, 1 << 16), 1 << 16):
            if line.strip():
                return line
        return b""


def _bare(block: bytes) -> bytes:
    """Lines without their quoted parts (each line for itself)."""
    return re.sub(rb'"[^"\r\n]*(?:"|(?=[\r\n])|\Z)', b"", block)


def _is_utf8(text: Text, start: int, stop: int) -> bool:
    """Are the characters that begin in the range valid? Up to three bytes more are read to finish the last one."""
    raw = text.file.read_at(min(stop + 3, text.size) - start, start)
    skipped = 0
    while start and skipped < min(3, len(raw)) and raw[skipped] & 0xC0 == 0x80:
        skipped += 1
    own = stop - start
    for end in range(min(own, len(raw)), len(raw) + 1):
        try:
            raw[skipped:end].decode("utf-8")
            return True
        except UnicodeDecodeError as e:
            if skipped + e.start < own - 3:  # not just cut short
                return False
    return False


def evidence(text: Text, start: int, stop: int) -> tuple:
    """(mark, valid, quotes, last, heads, lines): what a range says of its file. `heads` counts each candidate
    delimiter in the header line; `lines` counts the lines that begin in the range and hold it as often."""
    mark = text.utf16 or ("UTF-8" if text.mark.startswith(UTF8_MARK) else None)
    block = text.read(start, stop)
    header = _bare(text.first_line())
    heads = [header.count(d.encode()) for d in DELIMITERS]
    before = text.read(start - 2, start)[-1:] if start else b"\n"
    body, at = b"", 0
    for line in text.lines(block, stop):  # up to the first line end behind the range
        if at >= len(block):
            break
        at += len(line)
        if at > len(block):
            body = line[len(line) - (at - len(block)) :]
    whole = _bare(block + body)
    if before not in b"\r\n":  # the first line began in an earlier range
        cut = re.search(rb"\r\n|\n|\r", whole)
        whole = whole[cut.end() :] if cut else b""
    data = np.frombuffer(whole, np.uint8)
    ends = np.flatnonzero((data == 10) | (data == 13))
    lines = []
    for d, often in zip(DELIMITERS, heads):
        at = np.searchsorted(ends, np.flatnonzero(data == ord(d)))
        lines.append(int((np.bincount(at, minlength=len(ends) + 1) == often).sum()) if often else 0)
    return mark, _is_utf8(text, start, stop) if text.utf16 is None else False, block.count(b'"'), block[-1] if block else 10, heads, lines


def _marks(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    d = re.escape(delimiter.encode())
    return re.compile(rb'[\r\n' + d + rb']"'), re.compile(rb'[\r\n]|' + d + rb'"')


def settle(last: int, delimiter: str) -> int:
    """The state behind a byte outside quotes."""
    return RECORD if last == 10 else RETURN if last == 13 else CELL if last == ord(delimiter) else BARE


def _close(block: bytes, at: int) -> tuple[int, int]:
    """From inside a quoted cell: where it ends, and QUOTED, QUOTE (it may end with the block) or BARE."""
    while True:
        quote = block.find(b'"', at)
        if quote < 0:
            return len(block), QUOTED
        if quote + 1 == len(block):
            return len(block), QUOTE
        if block[quote + 1] != 34:
            return quote + 1, BARE
        at = quote + 2


def _enter(block: bytes, state: int) -> tuple[int, bool]:
    """(place, inside quotes) once the state before the block is taken into account."""
    if state == QUOTED:
        return 0, True
    if state == QUOTE:
        return (1, True) if block[:1] == b'"' else (0, False)
    at = 1 if state == RETURN and block[:1] == b"\n" else 0
    if state != BARE and block[at : at + 1] == b'"':
        return at + 1, True
    return at, False


def end_state(block: bytes, state: int, delimiter: str) -> int:
    if not block:
        return state
    opening, _ = _marks(delimiter)
    at, inside = _enter(block, state)
    while True:
        if inside:
            at, how = _close(block, at)
            if how != BARE:
                return how
        found = opening.search(block, at)
        if found is None:
            return settle(block[-1], delimiter) if at < len(block) or not inside else BARE
        at, inside = found.end(), True


def end_states(block: bytes, delimiter: str) -> list[int]:
    return [end_state(block, state, delimiter) for state in range(6)]


def first_record(block: bytes, state: int, delimiter: str) -> int:
    """Where the first record begins inside the block; its length if none does."""
    if state == RECORD:
        return 0
    if state == RETURN:
        return 1 if block[:1] == b"\n" else 0
    _, breaks = _marks(delimiter)
    at, inside = _enter(block, state)
    while True:
        if inside:
            at, how = _close(block, at)
            if how != BARE:
                return len(block)
        found = breaks.search(block, at)
        if found is None:
            return len(block)
        at, inside = found.end(), found.group()[-1:] == b'"'
        if not inside:
            if found.group() == b"\n":
                return at
            if at == len(block):
                return at  # the next range knows whether a line feed follows
            return at + (block[at : at + 1] == b"\n")


def _decoded(line: bytes, encoding: str) -> str:
    if not encoding.startswith("UTF-16"):
        return line.decode(encoding, "replace")
    text = line.decode("utf-8", "surrogatepass")
    if any("\ud800" <= c <= "\udfff" for c in text):  # a pair that was read in two halves
        text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def _filled(record: list[str]) -> bool:
    return bool(record) and not (len(record) == 1 and record[0].isspace())


def records(text: Text, start: int, stop: int, encoding: str, delimiter: str, state: int) -> Iterator[list[str]]:
    """The records that begin in a range; the header is the first of the file's first range. Blank lines are left out."""
    csv.field_size_limit(sys.maxsize)
    block = text.read(start, stop)
    used = 0 if start == 0 else first_record(block, state, delimiter)

    def lines() -> Iterator[str]:
        nonlocal used
        for line in text.lines(block[used:], min(stop, text.size)):
            used += len(line)
            yield _decoded(line, encoding)

    reader = csv.reader(lines(), delimiter=delimiter)
    while used < len(block):
        record = next(reader, None)
        if record is None:
            return
        if _filled(record):
            yield record


def header(text: Text, encoding: str, delimiter: str) -> list[str]:
    first = text.read(0, 1 << 16)
    csv.field_size_limit(sys.maxsize)
    cells = csv.reader((_decoded(line, encoding) for line in text.lines(first, 1 << 16)), delimiter=delimiter)
    return next((c for c in cells if _filled(c)), [])


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads: part of a large file, or some small files. They are read one after another."""

    value: list[tuple[str, int, int, int]]


class ByteRanges(DataSource):
    """`spark.read.format("byte_ranges").option("range_bytes", n).load(folder)`: one row per range of every file below
    a folder, with what it says of its file's encoding and delimiter. Hidden and empty files are left out. A task reads
    ranges of `task_bytes` together, or less where that would leave some of `cores` without any; one range at least."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return ("path string, start bigint, stop bigint, size bigint, mark string, valid boolean, quotes bigint, last int, "
                "heads array<bigint>, lines array<bigint>")

    def reader(self, schema) -> DataSourceReader:
        size = int(self.options.get("range_bytes", 32 << 20))
        return RangeReader(self.options["path"], size, int(self.options.get("task_bytes", size)), int(self.options.get("cores", 1)))


class RangeReader(DataSourceReader):
    def __init__(self, root: str, range_bytes: int, task_bytes: int = 0, cores: int = 1):
        self.root, self.range_bytes = root, max(4, range_bytes // 2 * 2)
        self.task_bytes, self.cores = task_bytes, cores

    def partitions(self) -> list[InputPartition]:
        store, path, prefix = filesystem(self.root)
        one = store.get_file_info(path)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = []
        for info in sorted((i for i in found if i.type == fs.FileType.File and i.size), key=lambda i: i.path):
            below = info.path[len(path) :] if info is not one else info.base_name
            if not any(part.startswith(("_", ".")) for part in below.split("/") if part):
                files.append(info)
        most = max(self.range_bytes, min(self.task_bytes, -(-sum(i.size for i in files) // self.cores)))
        out: list[InputPartition] = []
        together, held = [], 0
        for info in files:
            for start in range(0, info.size, self.range_bytes):
                stop = min(info.size, start + self.range_bytes)
                if together and held + stop - start > most:
                    out.append(Ranges(together))
                    together, held = [], 0
                together.append((prefix + info.path, start, stop, info.size))
                held += stop - start
        return [*out, Ranges(together)] if together else out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _, prefix = filesystem(self.root)
        for path, start, stop, size in partition.value:
            with Text(store, path.removeprefix(prefix)) as text:
                mark, valid, quotes, last, heads, lines = evidence(text, start, stop)
            yield path, start, stop, size, mark, valid, quotes, last, heads, lines
