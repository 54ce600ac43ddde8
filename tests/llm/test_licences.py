"""Licence scans against plain searches."""

import random
import re
from dataclasses import replace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewright.llm import licences, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base(text):
    w = split(text)
    phrases = [(p.split(), label) for p, label in licences.BASE]
    places = [(i, label) for i in range(len(w)) for p, label in phrases if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_and_places(seed):
    r = random.Random(seed)
    word = lambda: r.randrange(2 + seed % 3)  # noqa: E731  few words: many repeats inside and between sequences
    sequences = [[word() for _ in range(r.randrange(0, 25))] for _ in range(6)]
    sequences.append(list(sequences[0]))
    auto = licences.Automaton(sequences)
    assert len(auto.step) <= 2 * sum(map(len, sequences)) + 1
    text = [word() for _ in range(300)] + [9, 9] + sequences[1] + [word()]
    occurs = lambda part: {(n, i + len(part)) for n, s in enumerate(sequences) for i in range(len(s) - len(part) + 1) if s[i : i + len(part)] == part}
    for i, (state, length) in enumerate(auto.statistics(text)):
        want = max((k for k in range(0, min(i + 1, 25) + 1) if k == 0 or occurs(text[i + 1 - k : i + 1])), default=0)
        assert length == want
        if length:
            assert set(auto.ends[state]) == occurs(text[i + 1 - length : i + 1])


def test_spans_chain_over_changed_words():
    scanner = licences.Scanner(replace(licences.DEFAULT, long=4, gap=3))
    notice = split(dict(licences.TEMPLATES[::-1])["bsd"])  # 22 words
    changed = ["x"] * 5 + notice[:9] + ["and", "zzz"] + notice[10:] + ["y"] * 40 + notice[:5]
    number = lambda w: scanner.numbers.get(w.encode(), -1)
    import numpy as np

    _, spans = scanner.scan(np.array([number(w) for w in changed]))
    spans = [s for s in spans if scanner.labels[s.template] == "bsd"]
    assert [(s.first, s.last, s.covered) for s in spans] == [(5, 5 + len(notice) + 1, len(notice) - 1), (len(changed) - 5, len(changed), 5)]


def test_labels_of_planted_notices(spark):
    r = random.Random(3)
    noise = lambda n: " ".join(r.choice(["the", "of", "software", "any", "lorem", "ipsum", "license"]) for _ in range(n))
    docs, want = [], {}
    for i, (label, text) in enumerate(licences.TEMPLATES):
        docs.append((i, f"{noise(30)} lorem. {text.upper()} Lorem {noise(30)}"))
        want[i] = label
        half = text.split()
        docs.append((1000 + i, f"{noise(20)} lorem {' '.join(half[: max(1, len(half) // 3)])} lorem"))
    got = {x["doc_id"]: x for x in licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == base(text)
        assert set(filter(None, x["base_labels"].split(","))) <= set(filter(None, x["labels"].split(",")))
        if i < 1000:
            assert want[i] in x["labels"].split(",") and x["score"] == 1.0
            span = next(s for s in x["spans"] if s["label"] == want[i] and s["cover"] == 1.0)
            assert split(text)[span["first"] : span["last"] + 1] == split(licences.TEMPLATES[i][1])
        elif x["n_base"] == 0:
            assert x["labels"] == ""


def test_the_query_finds_every_base_place(spark):
    folder = "/root/testdata/sf0.01"
    texts = {x["doc_id"]: x["text"] for x in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = queries.op13_suffix_automaton_licences(spark, folder).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == base(texts[x["doc_id"]])
        assert 0 <= x["score"] <= 1 and (x["labels"] or not x["n_base"])
    assert any(x["labels"] == "cc-by-nc" for x in got) and any(x["n_base"] for x in got)


def test_odd_rows(spark, odd_docs, no_docs):
    got = licences.scan(odd_docs).collect()
    assert len(got) == odd_docs.count() and licences.scan(no_docs).count() == 0
    by = {x["doc_id"]: x for x in got}
    for i in (3, 4, 5):
        assert (by[i]["n_words"], by[i]["n_base"], by[i]["first_word"], by[i]["last_word"], by[i]["base_labels"], by[i]["labels"], by[i]["score"]) == (0, 0, None, None, "", "", 0.0)
    assert by[7]["n_words"] == 40_000


def test_very_long_text_and_many_places(spark):
    text = "under the MIT License, " * 30_000
    x = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["labels"]) == (120_000, 30_000, 2, 119_998, "mit")


def test_no_templates_at_all():
    p = replace(licences.DEFAULT, base=(), templates=())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["the mit license"])], names=["doc_id", "text"])
    (out,) = licences._scan(p)([batch])
    assert out.to_pylist()[0]["n_words"] == 3 and out.to_pylist()[0]["labels"] == ""
