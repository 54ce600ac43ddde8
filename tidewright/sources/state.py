"""State tables whose tenants are replaced one by one, with one commit for all tables of a stage.

Data lies in Parquet, partitioned by generation and tenant. A commit writes the
new rows of the tenants it touches as one more generation, in as many tables as
it likes, and then appends one small pointer file that says which generation
holds which tenant of which table. Spark moves that file into place in one step,
so a commit is seen whole or not at all, in all tables at once. Untouched
tenants keep their generation: neither read nor written. Readers that began
before go on with the old files until `vacuum`.

One stage per tenant is expected to write at a time; of two the later one stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import remove

POINTERS = "seq bigint, table string, tenant_id string, generation string"


class State:
    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)
        self._open: list[tuple[int, str, str, str]] | None = None  # pointers of a transaction, not yet committed

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Commits inside become visible to others together, at the end, or not at all if it breaks off; the
        transaction itself reads what it has written."""
        if self._open is not None:
            raise RuntimeError("a transaction is open")
        self._open = []
        try:
            yield
            if self._open:
                last = {(t, tenant): (0, t, tenant, g) for _, t, tenant, g in self._open}
                self._append(self.spark.createDataFrame(list(last.values()), POINTERS).drop("seq"), None)
        finally:
            self._open = None

    def _append(self, rows: DataFrame, generation: str | None) -> None:
        seq = (self.pointers().agg(F.max("seq")).first()[0] or 0) + 1
        if generation is not None:
            rows = rows.withColumn("generation", F.lit(generation))
        rows = rows.select(F.lit(seq).cast("bigint").alias("seq"), "table", "tenant_id", "generation")
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/pointers")

    def pointers(self) -> DataFrame:
        """All pointers ever committed."""
        try:
            return self.spark.read.schema(POINTERS).parquet(f"{self.root}/pointers")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], POINTERS)

    def current(self, table: str, tenants: Sequence[str] | None = None) -> DataFrame:
        """(tenant_id, generation): where the tenants of a table are now."""
        mine = self.pointers().where(F.col("table") == table)
        if self._open:
            last = {(t, tenant): (10**15 + i, t, tenant, g) for i, (_, t, tenant, g) in enumerate(self._open) if t == table}
            if last:
                mine = mine.unionByName(self.spark.createDataFrame(list(last.values()), POINTERS))
        if tenants is not None:
            mine = mine.where(F.col("tenant_id").isin(list(tenants)))
        return mine.groupBy("tenant_id").agg(F.max_by("generation", F.struct("seq", "generation")).alias("generation"))

    def columns(self, table: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[table]).columns

    def read(self, table: str, tenants: Sequence[str] | str | None = None) -> DataFrame:
        """The rows of a table, of some tenants only if named: then only their partitions are scanned."""
        tenants = [tenants] if isinstance(tenants, str) else tenants
        current = self.current(table, tenants)
        # generations in use, as a file listing would name them; at most one per tenant
        live = sorted(r["generation"] for r in current.select("generation").distinct().collect())
        if not live:
            return self.spark.createDataFrame([], self.schemas[table])
        base = f"{self.root}/data/{table}"
        reader = self.spark.read.schema(f"{self.schemas[table]}, generation string").option("basePath", base)
        rows = reader.parquet(*[f"{base}/generation={g}" for g in live])
        if tenants is not None:
            rows = rows.where(F.col("tenant_id").isin(list(tenants)))
        if len(live) > 1:
            rows = rows.join(current, ["generation", "tenant_id"], "left_semi")
        elif tenants is None or len(tenants) > 1:
            rows = rows.join(current.select("tenant_id"), "tenant_id", "left_semi")
        return rows.select(*self.columns(table))

    def commit(self, tables: Mapping[str, DataFrame], tenants: Sequence[str] | None = None) -> None:
        """Replace the rows of `tenants` in `tables` (of all tenants if None). The frames may read the current state."""
        generation = uuid.uuid4().hex
        moved = []
        for name, df in tables.items():
            target = f"{self.root}/data/{name}/generation={generation}"
            df = df.select(*self.columns(name))
            if tenants is not None:
                df = df.where(F.col("tenant_id").isin(list(tenants)))
            # a tenant's rows meet in one task, a large tenant's in several: files grow with tenants, not tenants by tasks
            df.hint("rebalance", "tenant_id").write.partitionBy("tenant_id").parquet(target)
            if tenants is None:
                written = self.spark.read.schema(self.schemas[name]).parquet(target).select("tenant_id")
                touched = written.union(self.current(name).select("tenant_id")).distinct()
            else:
                touched = self.spark.createDataFrame([(t,) for t in sorted(set(tenants))], "tenant_id string")
            moved.append(touched.select(F.lit(name).alias("table"), "tenant_id"))
        rows = moved[0]
        for more in moved[1:]:
            rows = rows.unionByName(more)
        if self._open is None:
            self._append(rows, generation)
        else:  # one row per tenant that the transaction touches
            self._open += [(0, r["table"], r["tenant_id"], generation) for r in rows.collect()]

    def vacuum(self) -> int:
        """Remove the generations that no tenant is in any more, and tell how many. Readers must have ended."""
        pointers = self.pointers()
        used = pointers.groupBy("table", "tenant_id").agg(F.max_by("generation", F.struct("seq", "generation")).alias("generation"))
        stale = pointers.select("table", "generation").distinct().join(used, ["table", "generation"], "left_anti").collect()
        for r in stale:
            remove(self.spark, f"{self.root}/data/{r['table']}/generation={r['generation']}")
        return len(stale)
