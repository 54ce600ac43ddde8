"""The manifest against a plain recursive one."""

import hashlib
import random
import zlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewright.llm import merkle, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FORM = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(map(part, (doc_id, source, lang, n_chars, text))))


def fold(nodes, at, other, fan):
    """(root, siblings of node `at` level by level, root with `other` in its place)."""
    siblings = []
    while len(nodes) > 1:
        first = at - at % fan
        run = nodes[first : first + fan]
        siblings += run[: at - first] + run[at - first + 1 :]
        other = H("".join(run[: at - first] + [other] + run[at - first + 1 :]))
        nodes = [H("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at //= fan
    return nodes[0], siblings, other


def brute(rows, fan):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        trees[source] = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    subroots = [fold([leaf(*r) for r in trees[s]], 0, "", fan)[0] for s in order]
    out = []
    for k, source in enumerate(order):
        leaves = [leaf(*r) for r in trees[source]]
        for i, r in enumerate(trees[source]):
            lost = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            replay = leaf(r[0], r[1].translate(LOWER) if lost and r[1] is not None else r[1], *r[2:])
            sub, own, changed = fold(leaves, i, replay, fan)
            root, more, changed = fold(subroots, k, changed, fan)
            out.append((r[0], leaves[i], sub, root, H("".join(own + more)), changed, changed == root))
    return out


def run(docs, p):
    lost = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = merkle.manifest(docs, F.when(lost, merkle.without_capitals(F.col("text"))).otherwise(F.col("text")), p)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in got.collect()]


none_first = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("fan,levels,n,sources", [(2, 2, 150, 7), (3, 1, 120, 11), (16, 2, 700, 3), (2, 3, 40, 40), (16, 2, 1, 1)])
def test_every_row_equals_the_recursive_manifest(spark, fan, levels, n, sources):
    r = random.Random(n)
    rows = []
    for i in range(n):
        source = None if r.random() < 0.1 else "hot" if r.random() < 0.4 else f"é{r.randrange(sources)}" if r.random() < 0.3 else f"S{r.randrange(sources)}"
        text = None if r.random() < 0.1 else r.choice(["", "Plain Text", "lower only", "ÀÉ \U0001f600 Ü"]) + str(r.randrange(5))
        rows.append((i * 7 - 50 if r.random() < 0.95 else None, text, r.choice(["en", None, ""]), source, r.choice([None, 0, 12])))
    p = replace(merkle.DEFAULT, fan=fan, levels=levels)
    got = run(spark.createDataFrame(rows, FORM).repartition(5), p)
    assert sorted(got, key=none_first) == sorted(brute(rows, fan), key=none_first)


def test_values_do_not_run_into_each_other(spark):
    rows = [(1, "1:a-", "-", "s", None), (1, "a-", "-1:", "s", None), (1, None, "-", "s", None)]
    got = run(spark.createDataFrame(rows, FORM), merkle.DEFAULT)
    assert len({g[1] for g in got}) == 3


def test_odd_rows(spark, odd_docs, no_docs):
    got = run(odd_docs, merkle.DEFAULT)
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in odd_docs.collect()]
    assert sorted(got, key=none_first) == sorted(brute(rows, 16), key=none_first)
    assert run(no_docs, merkle.DEFAULT) == []
    one = run(odd_docs.where("doc_id = 6"), merkle.DEFAULT)[0]
    assert one[1] == one[2] == one[3] and one[4] == H("")


def test_the_query_reads_every_row(spark):
    got = queries.op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, got)) == sorted(brute(rows, 16))
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 3
