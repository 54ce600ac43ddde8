"""Token counts as delta-maintained rollups.

A batch of events inserts, deletes or revises counts of documents under tokenizer versions. Applying it looks up what
the store holds for the batch's documents, turns the difference into signed rows, and adds one signed sum per source,
language and tokenizer version. Totals are the sum of all deltas, so they never need the documents again.

A batch is committed by a row in the ledger, written last. A batch that is in the ledger is left alone, so a replay
changes nothing; one that broke off before is written anew over its own folders. Uncommitted folders are never read.

Results for odd rows: several events of one batch for a document and version count as one, the one with the largest
`seq`, then op, source, language and count. An insert of a known document replaces it, a revision of an unknown one
inserts it, a deletion of an unknown one is nothing. Null source, language and version are values of their own. Null
counts are 0. A null doc_id is a document like any other. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

_CHANGES = "doc_id long, source string, lang string, tokenizer string, tokens long, sign int"
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"
KEY = ("source", "lang", "tokenizer")


@dataclass(frozen=True)
class Store:
    """A rollup below one shared folder. One writer at a time."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, batch_id long").parquet(f"{self.root}/{name}")
        return rows.join(self.ledger(), "batch_id", "left_semi")

    def _write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def create(self) -> "Store":
        """An empty store: batch -1 with nothing in it."""
        for name, schema in (("changes", _CHANGES), ("deltas", _DELTAS), ("ledger", "at timestamp")):
            self._write(name, -1, self.spark.createDataFrame([], schema))
        return self

    def ledger(self) -> DataFrame:
        """(batch_id) of every committed batch."""
        return self.spark.read.schema("at timestamp, batch_id long").parquet(f"{self.root}/ledger").select("batch_id").distinct()

    def committed(self, batch_id: int) -> bool:
        return not self.ledger().where(F.col("batch_id") == batch_id).isEmpty()

    def current(self) -> DataFrame:
        """(doc_id, source, lang, tokenizer, tokens) of all documents counted now."""
        state = [c.split(" ")[0] for c in _CHANGES.split(", ")][:-1]
        return self._read("changes", _CHANGES).groupBy(*state).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def apply(self, batch_id: int, events: DataFrame) -> bool:
        """Commits a batch of events (seq, op, doc_id, source, lang, tokenizer, tokens); op is insert, delete or revise.
        False if it had been committed before."""
        if self.committed(batch_id):
            return False
        # only the touched keys' history is added up, not the whole store's
        last = events.groupBy("doc_id", "tokenizer").agg(F.max(F.struct(
            "seq", "op", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))).alias("e"))
        last = last.select("doc_id", "tokenizer", "e.*")
        touched = last.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
        held = self._read("changes", _CHANGES)
        held = held.join(touched, held["doc_id"].eqNullSafe(touched["d"]) & held["tokenizer"].eqNullSafe(touched["t"]), "left_semi")
        held = held.groupBy("doc_id", *KEY, "tokens").agg(F.sum("sign").cast("int").alias("sign")).where("sign > 0")
        columns = ["doc_id", *KEY, "tokens", "sign"]
        gone = held.withColumn("sign", -F.col("sign")).select(columns)
        new = last.where("op <> 'delete'").withColumn("sign", F.lit(1)).select(columns)
        self._write("changes", batch_id, gone.union(new).groupBy(*columns[:-1]).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"))
        changes = self.spark.read.schema(_CHANGES).parquet(f"{self.root}/changes/batch_id={batch_id}")
        self._write("deltas", batch_id, changes.groupBy(*KEY).agg(
            F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")))
        self._write("ledger", batch_id, self.spark.range(1).select(F.current_timestamp().alias("at")))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches; groups without a document are gone."""
        return self._read("deltas", _DELTAS).groupBy(*KEY).agg(
            F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs > 0")
