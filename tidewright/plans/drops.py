"""A drop folder of delimited files, written from the invoice extract in the shared folder: every layout that the reader
has to tell apart, each file with the rows of its layout."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans import fixtures
from tidewright.session import shared_folder

CELLS = ("row_no", "invoice_number", "customer_id", "amount", "status", "note")
#: kind: (delimiter, encoding as detected), by row_index % 5; `empty` has a header only
KINDS = {"quoted": (",", "UTF-8"), "ragged": (";", "UTF-8"), "tabs": ("\t", "UTF-8"), "wide": ("|", "UTF-16BE"), "latin": (",", "ISO-8859-1")}
FILES = 2  # files of the first two kinds

NOTE = {
    "quoted": "case when {k} % 3 = 0 then concat('first, ', status, chr(10), 'then \"', amount, '\"', chr(13), chr(10), 'end') else '' end",
    "ragged": "concat('paid; ', status)",
    "tabs": "concat('\"', status, '\" and ', amount)",
    "wide": "concat('größer | ', status, ' €')",
    "latin": "concat('café, ', status)",
}
SHORT, LONG = 1, 2  # remainders by 7 of ragged rows that lack cells or have two more


def _kind() -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("row_index", F.lit(len(KINDS))) + 1).cast("int"))


def _quoted(cell: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.col(cell), F.lit('"'), F.lit('""')), F.lit('"'))


def write_drop(spark: SparkSession, sf_dir: str) -> str:
    """Write the folder; returns its path."""
    folder = f"{shared_folder(spark).rstrip('/')}/drop-{uuid.uuid4().hex}"
    rows = fixtures.flat(spark, sf_dir, "invoices").withColumn("row_no", F.col("row_index").cast("string"))
    rows = rows.select(_kind().alias("kind"), "row_index", *CELLS[:-1])
    of = lambda kind: rows.where(F.col("kind") == kind).withColumn("note", F.expr(NOTE[kind].format(k="row_index")))

    short = F.concat_ws(";", *CELLS[:3])
    whole = F.concat_ws(";", *[_quoted(c) for c in CELLS])
    ragged = F.when(F.col("row_index") % 7 == SHORT, short).when(F.col("row_index") % 7 == LONG, F.concat(whole, F.lit(";more; and more"))).otherwise(whole)
    for kind, line in (("quoted", F.concat_ws(",", *[_quoted(c) for c in CELLS])), ("ragged", ragged)):
        head = spark.range(FILES).select(F.col("id").alias("file"), F.lit(-1).cast("long").alias("row_index"), F.lit(KINDS[kind][0].join(CELLS)).alias("line"))
        body = of(kind).select(F.pmod(F.floor(F.col("row_index") / len(KINDS)), F.lit(FILES)).alias("file"), F.col("row_index").cast("long").alias("row_index"), line.alias("line"))
        lines = head.unionByName(body).repartition("file").sortWithinPartitions("file", "row_index")
        lines.select("file", "line").write.partitionBy("file").text(f"{folder}/{kind}")
    for kind, encoding in (("tabs", "UTF-8"), ("wide", "UTF-16"), ("latin", "ISO-8859-1")):
        (of(kind).select(*CELLS).write.option("header", True).option("sep", KINDS[kind][0]).option("escape", '"').option("encoding", encoding)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{kind}"))
    spark.range(1).select(F.lit(",".join(CELLS)).alias("line")).coalesce(1).write.text(f"{folder}/empty")
    return folder


def kind_of(path: Column) -> Column:
    return F.regexp_extract(path, "/drop-[^/]*/([a-z]+)/", 1)


def expected_sql() -> str:
    """The cells of every row as a reader should find them, from the extract: short rows lack cells, long ones have more."""
    kinds = ", ".join(f"({i}, '{kind}', '{delimiter}', '{encoding}')" for i, (kind, (delimiter, encoding)) in enumerate(KINDS.items()))
    notes = " ".join(f"when '{kind}' then {sql.format(k='row_index')}" for kind, sql in NOTE.items())
    cut = f"kind = 'ragged' and row_index % 7 = {SHORT}"
    return (
        f"select kind, encoding, delimiter, cast(row_index as varchar) as row_no, invoice_number, customer_id, "
        f"case when {cut} then null else amount end as amount, case when {cut} then null else status end as status, "
        f"case when {cut} then null else case kind {notes} end end as note, "
        f"case when kind = 'ragged' and row_index % 7 = {LONG} then 'more/ and more' end as surplus, "
        f"case when kind in ('quoted', 'ragged') then row_number() over (partition by kind, row_index // {len(KINDS)} % {FILES} order by row_index) - 1 end as place "
        f"from ({fixtures.flat_sql('invoices')}) join (values {kinds}) k(r, kind, delimiter, encoding) on row_index % {len(KINDS)} = r"
    )


def drop_rows(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows as read, in the form of `expected_sql`."""
    cells = [F.col("raw")[c].alias(c) for c in CELLS]
    found = rows.select(kind_of(F.col("path")).alias("kind"), "encoding", "delimiter", *cells, F.array_join("_overflow", "/").alias("surplus"), "row_index")
    return found.withColumn("place", F.when(F.col("kind").isin("quoted", "ragged"), F.col("row_index"))).drop("row_index")
