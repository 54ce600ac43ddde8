import zlib
from dataclasses import replace

import pytest

from tidewright.llm import shards


def test_sizes_slots_and_checksums(spark):
    rows = [(i, f"text {i} " * (i % 57)) for i in range(3000)] + [(5000 + i, "one hot text " * 9) for i in range(1500)]
    # small ranges, so that the hot text and others are subdivided
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), replace(shards.DEFAULT, splitters=63, range_bytes=4096)).collect()
    texts = dict(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    size, slots = [0] * 40, [[] for _ in range(40)]
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) - min(size) <= 2 * max(r["size"] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1023])
def test_binary_search(spark, n):
    bounds = sorted(range(-5, 10 * n - 5, 10))
    keys = spark.range(-20, 10 * n + 20, 3).selectExpr("id AS key")
    for r in keys.select("key", shards.range_of(keys["key"], bounds).alias("at")).collect():
        assert r["at"] == sum(b <= r["key"] for b in bounds)


def test_odd_rows(spark, odd_docs, no_docs):
    got = shards.shard(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["shard"] < 40 for r in got)
    null = next(r for r in got if r["doc_id"] == 3)
    assert (null["size"], null["text_crc32"]) == (16, 0)
    assert shards.shard(no_docs).count() == 0
