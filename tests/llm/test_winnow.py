"""Decontamination against every window of every text."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tidewright.llm import winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w = split(text)
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items):
    got = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()}


def test_every_shared_window_is_found(spark):
    r = random.Random(5)
    word = lambda: r.choice(["the", "of", "and", "Über", "x1", "É", "a", "b"])  # noqa: E731  few words: many near misses
    items = [(i, " ".join(word() for _ in range(r.randint(10, 40)))) for i in range(40)]
    items += [(100, "short one, of five WORDS"), (101, "a b"), (102, "..."), (103, None), (104, "the"), (100, "also five words of hundred")]
    docs = []
    for i in range(150):
        w = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            cut = split(r.choice(items)[1])
            a = r.randrange(len(cut) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = cut[a : a + r.randint(1, 25)]
        docs.append((i, "; ".join(w).upper() if i % 3 else " ".join(w)))
    docs += [(900, " ".join(["a"] * 300)), (901, None), (902, ""), (903, "short ONE of -- five words")]
    items += [(200, " ".join(["a"] * 12))]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_items_alone_need_no_short_windows(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = [(1, "before " + text + " after"), (2, " ".join(text.split()[:9])), (3, " ".join(text.split()[20:30]))]
    got = run(spark, docs, [(1, text)])
    assert (got[1][1], got[2][1], got[3][1]) == (50, 0, 10) and got == brute(docs, [(1, text)])


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the same words are here twice in a row the same"), (None, "one two")], "item_id long, text string")
    got = winnow.decontaminate(odd_docs, items).collect()
    assert len(got) == odd_docs.count()
    assert {r["doc_id"] for r in got if r["contaminated"]} == {1, 2, 6}
    assert [(r["n_hit"], r["n_items"], r["items_sha256"]) for r in got if r["doc_id"] == 6] == [(2, 0, hashlib.sha256(b"").hexdigest())]
    assert winnow.decontaminate(no_docs, items).count() == 0
    assert not any(r["contaminated"] for r in winnow.decontaminate(odd_docs, items.limit(0)).collect())


RULE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_listed_characters_are_those_of_the_rule(spark):
    every = [(c, f"a{chr(c)}b{chr(c)}{chr(c)}") for c in [*range(0xD800), *range(0xE000, 0x110000, 97), 0xFFFF, 0x10FFFF]]
    df = spark.createDataFrame(every, "c int, text string")
    differ = df.where(F.regexp_extract_all("text", F.lit(winnow.WORD), F.lit(0)) != F.regexp_extract_all("text", F.lit(RULE), F.lit(0)))
    assert differ.count() == 0


def test_words_take_less_time_than_with_negated_ranges(spark):
    df = spark.range(0, 4, 1, 4).select(F.repeat(F.lit("some words, of a text. "), 60_000).alias("text")).localCheckpoint()
    took = {}
    for pattern in (winnow.WORD, RULE) * 2:  # the second round counts, when code is compiled
        start = time.perf_counter()
        assert df.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))).first()[0] == 4 * 60_000 * 5
        took[pattern] = time.perf_counter() - start
    assert took[winnow.WORD] < took[RULE] / 2
