"""State tables: tenants replaced one by one, whole commits, readers that stay."""

import glob

import pytest
from pyspark.sql import functions as F

from tidewright.sources.state import State

SCHEMAS = {"a": "id int, tenant_id string, x string", "b": "tenant_id string, n bigint"}


@pytest.fixture
def state(spark, tmp_path):
    return State(spark, str(tmp_path / "state"), SCHEMAS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["a"])


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_commit_touches_its_tenants_only(spark, state):
    assert rows(state.read("a")) == [] and state.read("a").columns == ["id", "tenant_id", "x"]
    state.commit({"a": frame(spark, (1, "t1", "old"), (2, "t2", "old"), (3, "t'3", "old"))})
    before = state.read("a")
    files = set(glob.glob(f"{state.root}/data/a/generation=*/tenant_id=t2/*.parquet"))
    # the new rows of t1 read the old ones; rows of other tenants are no part of the commit
    state.commit({"a": state.read("a", "t1").withColumn("x", F.lit("new")).unionByName(frame(spark, (4, "t1", None), (9, "t2", "lost")))}, ["t1"])
    assert sorted(map(tuple, state.read("a").collect()), key=str) == [(1, "t1", "new"), (2, "t2", "old"), (3, "t'3", "old"), (4, "t1", None)]
    assert {r.x for r in state.read("a", "t2").collect()} == {"old"} and {r.id for r in state.read("a", "t1").collect()} == {1, 4}
    assert rows(before.select("id")) == [(1,), (2,), (3,)]  # a reader from before the commit
    assert files == {f for f in glob.glob(f"{state.root}/data/a/generation=*/tenant_id=t2/*.parquet")}
    assert {r.id for r in state.read("a", ["t1", "t'3"]).collect()} == {1, 3, 4}


def test_scans_of_a_tenant_are_pruned(spark, state):
    state.commit({"a": frame(spark, *((i, f"t{i % 5}", "x") for i in range(50)))})
    read = state.read("a", "t3")
    assert "PartitionFilters: [" in plan(read) and "(tenant_id" in plan(read).split("PartitionFilters: [")[1].split("]")[0]
    assert len(read.inputFiles()) >= 1 and read.count() == 10


def test_tables_move_together_and_empty_tenants_stay_empty(spark, state):
    state.commit({"a": frame(spark, (1, "t", "x"), (2, "u", "x")), "b": spark.createDataFrame([("t", 1)], SCHEMAS["b"])})
    state.commit({"a": frame(spark).limit(0), "b": state.read("b", "t").selectExpr("tenant_id", "n + 1 AS n")}, ["t"])
    assert rows(state.read("a")) == [(2, "u", "x")] and rows(state.read("b")) == [("t", 2)] and rows(state.read("a", "t")) == []
    state.commit({"a": frame(spark, (5, "v", "y"))})  # all tenants: those without rows have none from now on
    assert rows(state.read("a")) == [(5, "v", "y")]


def test_a_broken_commit_changes_nothing(spark, state):
    state.commit({"a": frame(spark, (1, "t", "x"))})
    broken = frame(spark, (2, "t", "y")).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception):
        state.commit({"a": frame(spark, (3, "t", "z")), "b": broken.selectExpr("tenant_id", "cast(x as bigint) AS n")}, ["t"])
    assert rows(state.read("a")) == [(1, "t", "x")] and rows(state.read("b")) == []
    state.commit({"a": frame(spark, (3, "t", "z"))}, ["t"])
    assert rows(state.read("a")) == [(3, "t", "z")]


def test_vacuum_keeps_what_is_in_use(spark, state):
    for i in range(4):
        state.commit({"a": frame(spark, (i, "t", "x"), (i, "u", "x"))}, ["t", "u"] if i == 0 else ["t"])
    assert state.vacuum() == 2
    assert rows(state.read("a")) == [(0, "u", "x"), (3, "t", "x")]
    assert len(glob.glob(f"{state.root}/data/a/generation=*")) == 2


def test_files_grow_with_tenants_not_with_tenants_by_tasks(spark, tmp_path):
    state = State(spark, str(tmp_path / "s"), {"t": "tenant_id string, v bigint"})
    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit("t"), F.col("id") % 20).alias("tenant_id"), F.col("id").alias("v"))
    state.commit({"t": rows})
    files = list((tmp_path / "s" / "data" / "t").rglob("*.parquet"))
    assert len(files) == 20 and state.read("t").count() == 400
