"""Hot keys, hot blocks and merges against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tidewright.functions.similarity import indel_ratio, jaro_winkler_batch
from tidewright.operators import dedupe, joins, link
from tidewright.operators.joins import key_counts, spread_lookup


def test_spread_lookup_with_hot_and_null_keys(spark):
    facts = spark.range(3000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    names = spark.range(40).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", 999)], "key string, v long"))
    lookup = names.join(key_counts(facts, ["key"]), "key")
    plain = {(r.row, r.v) for r in facts.join(names, "key", "left").select("row", "v").collect()}
    got = spread_lookup(facts, lookup, ["key"], ["row"]).collect()
    assert len(got) == 3000 and {(r.row, r.v) for r in got} == plain


def test_adaptive_execution_splits_a_hot_key(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 60000, 1, 8).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("key"))
        lookup = spark.range(60000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
        joined = spread_lookup(facts, lookup, ["key"], ["row"])
        assert len(joined.collect()) == 60000 and joined.where("v = 2 * key").count() == 60000
        joined.collect()
        assert "skew" in joined._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_suggestions_match_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("AB12") for _ in range(n))
    known = sorted({make(rng.choice([5, 8, 11, 14, 16, 18, 22])) for _ in range(60)})
    orphans = set()
    for k in known:
        cut = list(k)
        for _ in range(rng.randint(1, 4)):
            place = rng.randrange(len(cut))
            if rng.random() < 0.5:
                cut.insert(place, rng.choice("AB12"))
            else:
                del cut[place]
        orphans.add("".join(cut))
    orphans |= {make(9), make(20), "ZZZZ"}
    customers = spark.createDataFrame([("t", k) for k in known], "tenant_id string, natural_key string")
    keys = spark.createDataFrame([("t", k) for k in orphans], "tenant_id string, link_key string")
    got = {r.link_key: (r.natural_key, r.score) for r in link.suggest_customer_fix(keys, customers).collect()}
    wanted = {}
    for o in orphans:
        score, key = min((-indel_ratio(o, k), k) for k in known)
        if -score >= 85 - 1e-9:
            wanted[o] = (key, round(-score, 4))
    assert got == wanted and len(wanted) > 20


def _customers(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, id string, natural_key string, legal_name string, email string, country string")


def test_known_duplicate_scores_as_published(spark):
    people = _customers(spark, [
        ("t", "1", "1", "Whitfield & Sons", "contact@whitfield.example", "US"),
        ("t", "2", "2", "Whitfield and Sons Ltd", "contact@whitfield.example", "US"),
        ("t", "3", "3", "Totally Unrelated Corp", "other@unrelated.example", "FR"),
    ])
    got = [tuple(r) for r in dedupe.duplicate_candidates(people).collect()]
    assert got == [("t", "1", "2", 0.9914)]


def test_candidates_match_brute_force_at_every_threshold(spark):
    rng = random.Random(4)
    rows = [("t", f"{i:03d}", str(i), rng.choice(["Acme", "Acne", "Beta", "Acm"]) + rng.choice([" Ltd", "", " Works", f" {i}"]),
             rng.choice(["a@x", "b@x", None, None]), rng.choice(["US", "FR", None])) for i in range(70)]
    people = _customers(spark, rows)
    seen = {}
    for r in rows:
        seen.setdefault((r[3], r[4] or "", r[5] or ""), r[1])
    import pandas as pd

    def brute(threshold):
        out = {}
        reps = {v: k for k, v in seen.items()}
        for r in rows:
            rep = seen[(r[3], r[4] or "", r[5] or "")]
            if rep != r[1]:
                out[(rep, r[1])] = (r[3], r[4] or "", r[5] or "", r[3], r[4] or "", r[5] or "")
        for x, y in combinations(sorted(reps), 2):
            a, b = reps[x], reps[y]
            if a[0][:3] == b[0][:3] or a[1] == b[1]:
                out[(x, y)] = (*a, *b)
        found = {}
        for pair, (n1, e1, c1, n2, e2, c2) in out.items():
            jw = jaro_winkler_batch(pd.Series([n1]), pd.Series([n2]))[0]
            level = "exact" if n1 == n2 else "close" if jw >= 0.9 else "alike" if jw >= 0.7 else "other"
            p = dedupe._probability(level, "exact" if e1 == e2 else "other", "exact" if c1 == c2 else "other")
            if p >= threshold:
                found[pair] = round(p, 4)
        return found

    for threshold in (0.5, 0.02, 0.0):
        got = dedupe.duplicate_candidates(people, threshold, tile_rows=4).collect()
        assert {(r.customer_id_a, r.customer_id_b): r.match_probability for r in got} == brute(threshold)
        assert len(got) == len(brute(threshold))


def test_merge_map_matches_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"{a:03d}", f"{b:03d}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a != b]
    pairs += [(f"{i:03d}", f"{i + 1:03d}") for i in range(100, 112)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([("t", a, b) for a, b in pairs], "tenant_id string, customer_id_a string, customer_id_b string")
    got = {r.loser: r.winner for r in dedupe.merge_map(df).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_rows_are_dealt_evenly_however_the_file_is_split(spark, tmp_path, monkeypatch):
    """A file of one row group has as many splits as one likes, and all rows in one of them."""
    path = str(tmp_path / "one.parquet")
    spark.range(40_000).coalesce(1).write.parquet(path)
    conf = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        scan = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() >= cores
        sizes = lambda: [r["count"] for r in joins.use_all_cores(scan, "id").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes()) == 40_000 and max(sizes()) < 1.3 * 40_000 / cores + 100
        monkeypatch.setattr(joins, "DEALT", 100)
        assert max(sizes()) < 200 and len(sizes()) == 400  # more rows, more tasks
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
