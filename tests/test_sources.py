import json

import pytest

from tidewright.functions.hashing import row_hash
from tidewright.session import reliable
from tidewright.sources import delimited, pages
from pyspark.sql import functions as F


def _rows(spark, folder):
    staged = reliable(delimited.read_folder(spark, str(folder)))
    out = {}
    for r in delimited.with_row_index(staged).collect():
        out.setdefault(r.path.rsplit("/", 1)[1], {})[r.row_index] = r
    return out


def test_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "comma.csv").write_text('id,name,note\n1,Ann,"a ""b"", c"\n2,,\n\n3,Zoë\n4,Dan,x,extra,more\n', encoding="utf-8")
    (tmp_path / "semi.csv").write_text("id;amount\n1;1.234,56\n2;-5,00\n", encoding="utf-8")
    (tmp_path / "tab.tsv").write_text("id\tname\n1\tx\n", encoding="utf-8")
    (tmp_path / "pipe.txt").write_text("id|name\n7|y\n", encoding="utf-8")
    (tmp_path / "lines.csv").write_text('id,name\n1,"two\nlines"\n2,b\n', encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes("id,nötig\n1,Café\n".encode("iso-8859-1"))
    (tmp_path / "empty.csv").write_text("")
    got = _rows(spark, tmp_path)
    assert set(got) == {"comma.csv", "semi.csv", "tab.tsv", "pipe.txt", "lines.csv", "latin.csv"}
    comma = got["comma.csv"]
    assert [comma[i].raw for i in range(4)] == [
        {"id": "1", "name": "Ann", "note": 'a "b", c'}, {"id": "2", "name": "", "note": ""},
        {"id": "3", "name": "Zoë", "note": None}, {"id": "4", "name": "Dan", "note": "x"}]
    assert comma[3]._overflow == ["extra", "more"] and comma[0]._overflow is None
    assert got["semi.csv"][1].raw == {"id": "2", "amount": "-5,00"} and got["semi.csv"][0].delimiter == ";"
    assert got["tab.tsv"][0].raw == {"id": "1", "name": "x"}
    assert got["pipe.txt"][0].raw == {"id": "7", "name": "y"}
    assert got["lines.csv"][0].raw == {"id": "1", "name": "two\nlines"} and got["lines.csv"][1].raw["name"] == "b"
    assert got["latin.csv"][0].raw == {"id": "1", "nötig": "Café"} and got["latin.csv"][0].encoding == "ISO-8859-1"


def test_row_index_over_many_splits(spark, tmp_path):
    lines = ["id,name"] + [f"{i},name {i}" for i in range(5000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16000")
    try:
        staged = reliable(delimited.read_folder(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = delimited.with_row_index(staged).select("row_index", F.col("raw")["id"].cast("int").alias("id")).collect()
    assert len(got) == 5000 and all(r.row_index == r.id for r in got)


def test_pull_of_pages(spark, tmp_path):
    page = lambda n, items, more: json.dumps({"items": items, "page": n, "page_size": 2, "total": 3, "has_next": more})
    (tmp_path / "p2.json").write_text(page(2, [{"CustID": "c", "n": 3}], False))
    with pytest.raises(pages.IncompletePull):
        pages.read_pull(spark, str(tmp_path))
    (tmp_path / "p1.json").write_text(page(1, [{"CustID": "a"}, {"CustID": "b"}], True))
    rows = pages.read_pull(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r.row_index, r.raw["CustID"]) for r in rows] == [(0, "a"), (1, "b"), (2, "c")] and rows[2].raw["n"] == "3"


def test_row_hash_ignores_key_order_only(spark):
    df = spark.createDataFrame([({"a": "1", "b": None},), ({"b": None, "a": "1"},), ({"a": "1", "b": ""},)], "raw map<string,string>")
    first, second, third = [r[0] for r in df.select(row_hash(F.col("raw"))).collect()]
    assert first == second != third


def test_quoted_separators_and_late_lines_decide_the_delimiter(spark, tmp_path):
    (tmp_path / "quoted.csv").write_text('id;note;x\n1;"a, b; c, d";1\n2;"e";2\n3;"f, g";3\n')
    (tmp_path / "late.csv").write_text("a,b|c\n" + "".join(f"{i}, x|{i}\n" for i in range(50)) + "".join(f"{i}|{i}\n" for i in range(60)))
    got = _rows(spark, tmp_path)
    assert got["quoted.csv"][0].raw == {"id": "1", "note": "a, b; c, d", "x": "1"} and got["quoted.csv"][0].delimiter == ";"
    assert got["late.csv"][0].delimiter == "|"
