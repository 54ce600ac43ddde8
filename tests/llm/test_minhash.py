"""Near duplicates against all pairs on small tables."""

import math
import random
import re
from dataclasses import replace

import pytest

from tidewright.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(smallest reachable id, set size) by id."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (find(i), len(sets[i])) for i in sets}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(60):
        rows.append([word() for _ in range(r.randint(1, 120))])
    for _ in range(60):  # copies with a growing number of changes: similarities on both sides of the threshold
        w = list(r.choice(rows[:60]))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        rows.append(w)
    for _ in range(60):  # a passage that many share, in texts that are otherwise their own
        rows.append([word() for _ in range(r.randint(20, 60))] + passage + [word() for _ in range(r.randint(20, 60))])
    for _ in range(60):  # mostly the passage
        rows.append([word() for _ in range(r.randint(1, 14))] + passage)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_long_bands_miss_hardly_more_links_than_short_ones():
    p, at = minhash.DEFAULT, minhash.DEFAULT.percent / 100
    n = p.bands * p.rows
    short = (1 - at**p.rows) ** p.bands
    agree = [math.comb(n, k) * at**k * (1 - at) ** (n - k) for k in range(n + 1)]
    long = sum(x * (1 - math.comb(k, p.long_rows) / math.comb(n, p.long_rows)) ** p.long_bands for k, x in enumerate(agree))
    assert short < 2.6e-7 and long < 3.3e-7


@pytest.mark.parametrize("params", [minhash.DEFAULT, replace(minhash.DEFAULT, crowded=2)])
def test_links_equal_all_pairs(spark, params):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hot_groups_of_copies_and_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(200)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 500 and {r["component_id"] for r in got} == {0}


def test_chain_of_links_is_one_component(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[3 * k : 3 * k + 60])) for k in range(13)]
    want = brute(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (c, _) in want.items()}


def test_odd_rows(spark, odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    for i in (3, 4, 5):
        assert by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"]
    assert by[6]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert minhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in minhash.components(edges).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(41)}


def edited_copies(n=150, seed=5):
    """Copies of one text on both sides of the threshold, so that all share buckets and many are no links."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(64)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(i % 6):
            w[r.randrange(64)] = f"x{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_crowd_of_edited_copies_makes_few_rows_for_each(spark, monkeypatch):
    counts = []
    reliable = minhash.reliable

    def counted(df):
        out = reliable(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "reliable", counted)
    rows = edited_copies()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == brute(rows)
    assert max(counts) <= 64 * len(rows)  # 60 shingles or 40 bands for each, not 400 bands


@pytest.mark.parametrize("tiles", [{"tile": 4}, {"tile": 8, "tiled": 16}])
def test_tiles_and_long_bands_of_large_buckets_equal_all_pairs(spark, tiles):
    rows = edited_copies(90) + [(1000 + i, t) for i, t in corpus()]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), replace(minhash.DEFAULT, crowded=2, **tiles)).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == brute(rows)


def test_members_of_tiles_are_joined_once(spark):
    rows = [(1, bytes([i]), bytes([i]), 9, 9, b"s", [0]) for i in range(6)]
    members = spark.createDataFrame(rows, "band long, set_key binary, root binary, size long, common long, signature binary, bands array<long>")
    sizes = spark.createDataFrame([(1, 6)], "band long, n long")
    plan = minhash._within(members, sizes, replace(minhash.DEFAULT, tile=4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
