import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from tidewright.llm import packing


def check(rows, texts, length=4096):
    """Every id of every document in one piece, sequences gapless; returns the share of padding."""
    tokenizer = Tokenizer.from_file(packing.DEFAULT.path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert set(by_sequence) == set(range(len(by_sequence)))
    return 1 - sum(r["length"] for r in rows) / (length * len(by_sequence))


def test_ids_pieces_and_padding(spark):
    r = random.Random(2)
    words = ["the", "Größe", "of", "don't", "x1y2", "été", "<|endoftext|>", "áb", "\U0001f600", "three parts", "ΑΣ", "naïve,", "...", "'s", "1234"]
    texts = {i: r.choice([" ", "\n", "\t ", "  "]).join(r.choice(words) + r.choice(["", "", "s", "ing"]) for _ in range(int(r.lognormvariate(4.5, 1.4)))) for i in range(400)}
    texts |= {900: None, 901: "", 902: " \n ", 903: "word " * 9000, 904: "x" * 20000, 905: "word " * 4095, 906: "word " * 4096}
    got = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert check(got, texts) < 0.05


def test_a_small_cache_gives_the_same_ids(spark):
    texts = {i: " ".join(f"w{(i * j) % 97}" for j in range(50)) for i in range(40)}
    path = packing.DEFAULT.path()
    small, large = packing.WordEncoder(path, 5), packing.WordEncoder(path, 10_000)
    from tidewright.llm import words
    import pyarrow as pa

    for s in words.slices(pa.array(list(texts.values())), lower=False):
        for _ in range(2):
            assert all(np.array_equal(a, b) for a, b in zip(small.encode(s), large.encode(s)))


def test_linear_program_comes_near_its_bound():
    r = np.random.default_rng(1)
    lengths = np.clip(r.lognormal(6, 1, 50_000).astype(int), 2, 4096)
    step = np.where(lengths <= 1024, 4, np.where(lengths <= 2048, 8, 16))
    classes = -(-lengths // step) * step
    demand = Counter(classes.tolist())
    patterns = packing.plan(dict(demand), packing.DEFAULT)
    held = Counter()
    for pattern, uses in patterns:
        assert sum(size * n for size, n in pattern) <= 4096
        for size, n in pattern:
            held[size] += n * uses
    assert held == demand
    bound = classes.sum() / 4096
    assert sum(u for _, u in patterns) <= 1.01 * bound + 300 * 0  # pieces of every size: the bound is nearly met


def test_equal_lengths_in_many_buckets(spark):
    texts = {i: "a b c" for i in range(3000)}
    p = packing.Params(bucket_rows=50)
    assert check(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), p).collect(), texts) < 0.5


def test_odd_rows(spark, odd_docs, no_docs):
    got = packing.pack(odd_docs).collect()
    assert sum(r["length"] for r in got if r["doc_id"] in (3, 4, 5)) == 3
    assert sum(r["doc_id"] == 2 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert packing.pack(no_docs).count() == 0
