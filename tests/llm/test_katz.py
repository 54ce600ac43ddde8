"""The language model against dictionaries, and that it is a distribution."""

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright.llm import katz

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["</s>"]


class Brute:
    def __init__(self, texts, keep_from=2):
        self.keep_from = keep_from
        train = [tokens(t) for t in texts]
        self.c1 = Counter(w for t in train for w in t)
        self.c2 = Counter(p for t in train for p in zip(["<s>", *t], t))
        self.total, self.vocabulary = sum(self.c1.values()), len(self.c1)
        self.d1, self.d2 = (katz.discounts(Counter(c.values()), 5) for c in (self.c1, self.c2))
        kept = sum(self.d1.get(c, 1) * c for c in self.c1.values()) / max(1, self.total)
        self.unknown = max(1 - kept, 1 / (self.total + 1))
        self.single = {w: (1 - self.unknown) / kept * self.d1.get(c, 1) * c / self.total for w, c in self.c1.items()}
        self.seen, self.used, self.taken = Counter(), Counter(), Counter()
        for (h, w), c in self.c2.items():
            self.seen[h] += c
            if c >= keep_from:
                self.used[h] += self.d2.get(c, 1) * c
                self.taken[h] += self.single[w]

    def p(self, h, w):
        c = self.c2.get((h, w), 0)
        if h not in self.used:
            return self.single.get(w, self.unknown)
        left = max(1 - self.used[h] / self.seen[h], 0.5 / (self.seen[h] + 1))
        if c >= self.keep_from:
            return self.d2.get(c, 1) * c * (1 - left) / self.used[h]
        return left / (1 - self.taken[h]) * self.single.get(w, self.unknown)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(*x)) for x in zip(["<s>", *t], t))

    def base(self, text):
        return sum(math.log10((self.c1.get(w, 0) + 1) / (self.total + self.vocabulary + 1)) for w in tokens(text))


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "É", "x,"]
    texts = [" ".join(words[min(int(r.expovariate(0.1)), 43)] for _ in range(r.randint(0, 60))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, " \n"), (1002, "never seen words"), (1003, "always after always after " * 50)]


@pytest.mark.parametrize("params", [katz.DEFAULT, replace(katz.DEFAULT, block_tokens=500, part_bytes=2000, word_parts=2)])
def test_scores_equal_dictionaries(spark, params):
    rows = corpus()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    model = Brute([t for i, t in rows if i not in held])
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), params).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] in held) and r["train_tokens"] == model.total
        assert (r["n_tokens"], r["n_known"]) == (len(tokens(text)), sum(w in model.c1 for w in tokens(text)))
        assert r["base_score"] == pytest.approx(model.base(text), rel=1e-9) and r["score"] == pytest.approx(model.score(text), rel=1e-9)


@pytest.mark.parametrize("params", [katz.WHOLE, replace(katz.WHOLE, block_tokens=500, part_bytes=2000, word_parts=2)])
def test_pairs_seen_once_are_scored_with_their_discount(spark, params):
    rows = corpus()
    model = Brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], keep_from=1)
    once = {p for p, c in model.c2.items() if c == 1}
    assert once and katz.Params().keep_from == 1
    df, texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), dict(rows)
    for got in (katz.score(df, params).collect(), katz.score(df).collect()):
        assert len(got) == len(rows)
        assert any(once & set(zip(["<s>", *t], t)) for t in (tokens(texts[r["doc_id"]]) for r in got if r["held_out"]))
        for r in got:
            assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]]), rel=1e-9)


def test_every_pair_seen_is_kept_and_histories_sum_to_one():
    model = Brute([t for _, t in corpus()], keep_from=1)
    for h in [*model.seen, "unknown"]:
        assert sum(model.p(h, w) for w in model.c1) + model.p(h, "unknown") == pytest.approx(1)


def test_every_history_sums_to_one():
    model = Brute([t for _, t in corpus()])
    for h in [*model.seen, "unknown"]:
        assert sum(model.p(h, w) for w in model.c1) + model.p(h, "unknown") == pytest.approx(1)


def test_odd_rows(spark, odd_docs, no_docs):
    got = katz.score(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert katz.score(no_docs).count() == 0
    # nothing to learn from: every token is unknown
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = katz.score(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(3, 0, 0)} and all(math.isfinite(r["score"]) for r in got)


def test_no_stored_row_is_a_single_pair(spark):
    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(200))) for i in range(100)]
    pairs = {p for _, t in rows for p in zip(["<s>", *tokens(t)], tokens(t))}
    files = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet"))
    before = files()
    katz.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert len(pairs) > 15_000 and sum(pq.read_metadata(f).num_rows for f in files() - before) < 100
