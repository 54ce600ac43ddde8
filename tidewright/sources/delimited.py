"""Read a folder of delimited files into raw rows (maps of text cells).

Blank cells stay blank text and cells a short row lacks are null; surplus cells
of a long row are kept in `_overflow`. Nothing is inferred: every cell is text.

A file of any size is read by many tasks, also where cells hold line breaks.
Three passes go over its byte ranges: what they say of encoding and delimiter,
the state each begins in (only ranges with quotes of files with several ranges
are read for that), and the records that begin in each. Files never come to the
driver, not even their headers; each task reads the header of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import reliable
from tidewright.sources import ranges
from tidewright.sources.ranges import DELIMITERS

MOST_RANGE_BYTES = 32 << 20
TASK_BYTES = 128 << 20
ROWS_AT_ONCE = 4096
UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def default_range_bytes(spark: SparkSession) -> int:
    """`spark.sql.files.maxPartitionBytes`, as far as a Python worker should hold at once."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return min(MOST_RANGE_BYTES, int(number) * UNITS[unit])


def _delimiter() -> Column:
    """Of all candidates the one that most lines hold as often as the header, then the more frequent in the header,
    then the first; a comma if no line holds any."""
    scored = [
        F.struct(F.sum(F.col("lines")[i]).alias("lines"), F.max(F.col("heads")[i]).alias("often"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter"))
        for i, d in enumerate(DELIMITERS)
    ]
    best = F.greatest(*scored)
    return F.when(best["lines"] > 0, best["delimiter"]).otherwise(",")


def read_ranges(spark: SparkSession, folder: str, fallback_encoding: str = "ISO-8859-1", range_bytes: int | None = None) -> DataFrame:
    """(path, start, stop, size, encoding, delimiter, state): every range of every file, with the state it begins in."""
    spark.dataSource.register(ranges.ByteRanges)
    dealt = {"range_bytes": range_bytes or default_range_bytes(spark), "task_bytes": TASK_BYTES, "cores": spark.sparkContext.defaultParallelism}
    found = reliable(spark.read.format("byte_ranges").options(**dealt).load(folder))
    files = found.groupBy("path").agg(
        F.coalesce(F.max("mark"), F.when(F.bool_and("valid"), "UTF-8").otherwise(fallback_encoding)).alias("encoding"),
        _delimiter().alias("delimiter"), F.count(F.lit(1)).alias("n_ranges"), F.sum("quotes").alias("file_quotes"),
    )
    known = reliable(found.drop("mark", "valid", "heads", "lines").join(files, "path"))
    begin = ["path", "start", "stop", "size", "encoding", "delimiter"]
    alone = known.where("n_ranges = 1").select(*begin, F.lit(ranges.RECORD).alias("state"))
    several = known.where("n_ranges > 1")
    ends = _spread(several.where("quotes > 0").select("path", "start", "stop", "delimiter")).mapInArrow(
        _end_states(folder), "path string, start bigint, ends array<int>")
    states = several.join(ends, ["path", "start"], "left").select(
        "path", "start", "last", "delimiter", "ends").groupBy("path").applyInArrow(_compose, "path string, start bigint, state int")
    return reliable(alone.unionByName(several.join(states, ["path", "start"]).select(*begin, "state")))


def _spread(some: DataFrame) -> DataFrame:
    """Ranges dealt to tasks by their bytes, to all cores at least: rows that stand for ranges are few bytes
    themselves, so nothing else would deal them out."""
    found = some.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    cores = some.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(found["n"], cores), -(-(found["bytes"] or 0) // TASK_BYTES), 1)
    return some.repartition(tasks, "path", "start")


def _end_states(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = ranges.filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with ranges.Text(store, r["path"].removeprefix(prefix)) as text:
                    block = text.read(r["start"], r["stop"])
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "start": [r["start"]], "ends": pa.array([ranges.end_states(block, r["delimiter"])], pa.list_(pa.int32()))})

    return run


def _compose(of_file: pa.Table) -> pa.Table:
    """The states along one file: few numbers per range, so a file of a terabyte is some ten thousand rows."""
    state, out = ranges.RECORD, []
    for r in sorted(of_file.to_pylist(), key=lambda r: r["start"]):
        out.append((r["path"], r["start"], state))
        if r["ends"] is not None:
            state = r["ends"][state]
        elif state != ranges.QUOTED:
            state = ranges.settle(r["last"], r["delimiter"])
    path, start, states = zip(*out)
    return pa.table({"path": path, "start": pa.array(start, pa.int64()), "state": pa.array(states, pa.int32())})


ROWS = ("path string, block bigint, place bigint, raw map<string,string>, _overflow array<string>, encoding string, delimiter string")


def _rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = ranges.filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with ranges.Text(store, r["path"].removeprefix(prefix)) as text:
                    yield from _range_rows(text, **r)

    return run


def _range_rows(text: ranges.Text, path: str, start: int, stop: int, size: int, encoding: str, delimiter: str, state: int) -> Iterator[pa.RecordBatch]:
    names = ranges.header(text, encoding, delimiter)
    last = {name: i for i, name in enumerate(names)}  # of repeated names the last counts
    rows = ranges.records(text, start, stop, encoding, delimiter, state)
    if start == 0:
        next(rows, None)
    place = 0
    while True:
        cells, surplus = [], []
        for row in rows:
            cells.extend(row[i] if i < len(row) else None for i in last.values())
            surplus.append(row[len(names) :] or None)
            if len(surplus) == ROWS_AT_ONCE:
                break
        n = len(surplus)
        if not n:
            return
        raw = pa.MapArray.from_arrays(pa.array(range(0, n * len(last) + 1, len(last)) if last else [0] * (n + 1), pa.int32()),
                                      pa.array(list(last) * n, pa.string()), pa.array(cells, pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), raw,
             pa.array(surplus, pa.list_(pa.string())), pa.array([encoding] * n), pa.array([delimiter] * n)],
            names=["path", "block", "place", "raw", "_overflow", "encoding", "delimiter"])
        place += n


def read_rows(some: DataFrame, folder: str) -> DataFrame:
    """The raw rows of `read_ranges`: path, block, place, raw, _overflow, encoding, delimiter."""
    return _spread(some).mapInArrow(_rows(folder), ROWS)


def read_headers(some: DataFrame, folder: str) -> DataFrame:
    """(path, header): the header cells of every file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = ranges.filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with ranges.Text(store, r["path"].removeprefix(prefix)) as text:
                    cells = ranges.header(text, r["encoding"], r["delimiter"])
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "header": pa.array([cells], pa.list_(pa.string()))})

    return some.where("start = 0").select("path", "encoding", "delimiter").mapInArrow(run, "path string, header array<string>")


def read_folder(spark: SparkSession, folder: str, fallback_encoding: str = "ISO-8859-1", range_bytes: int | None = None) -> DataFrame:
    """All files of a drop folder as raw rows, with encoding and delimiter. A file
    that has a header only gives no rows (`read_ranges` lists it)."""
    some = read_ranges(spark, folder, fallback_encoding, range_bytes)
    if some.isEmpty():
        raise ValueError(f"no non-empty file in {folder}")
    return read_rows(some, folder)


def with_row_index(rows: DataFrame) -> DataFrame:
    """Add `row_index`, the row's position in its file, without sorting a file.

    Rows are counted per range; running totals over these counts, a few per file,
    give each range its offset, so no key holds more rows than one range. `rows`
    should come from storage (`reliable`): they are read twice.
    """
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.join(offsets, ["path", "block"])
        .withColumn("row_index", (F.col("_offset") + F.col("place")).cast("bigint"))
        .drop("_offset", "place", "block")
    )
