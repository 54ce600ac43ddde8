import random
from collections import Counter

from tidewright.llm import rollups

EVENTS = "seq long, op string, doc_id long, source string, lang string, tokenizer string, tokens long, extra int"


def store(spark, tmp_path):
    return rollups.Store(spark, str(tmp_path / "rollup")).create()


def totals(s):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in s.totals().collect()}


def test_any_history_equals_a_recount(spark, tmp_path):
    r = random.Random(6)
    s, state = store(spark, tmp_path), {}
    for batch in range(4):
        events = [(seq, r.choice(["insert", "insert", "revise", "delete"]), r.choice([None, *range(30)]), r.choice(["hot", "hot", "b", None]), r.choice(["en", None]),
                   r.choice(["v1", "v2"]), r.choice([None, 0, 5, 17])) for seq in range(60)]
        for seq, op, doc, source, lang, tokenizer, tokens in events:
            if op == "delete":
                state.pop((doc, tokenizer), None)
            else:
                state[doc, tokenizer] = (source, lang, tokens or 0)
        frame = spark.createDataFrame([(*e, 1) for e in events], EVENTS)
        assert s.apply(batch, frame) and not s.apply(batch, frame)
        docs, tokens = Counter(), Counter()
        for (doc, tokenizer), (source, lang, n) in state.items():
            docs[source, lang, tokenizer] += 1
            tokens[source, lang, tokenizer] += n
        assert totals(s) == {k: (docs[k], tokens[k]) for k in docs}


def test_a_broken_batch_is_not_seen_and_can_be_sent_again(spark, tmp_path):
    s = store(spark, tmp_path)
    first = spark.createDataFrame([(1, "insert", 1, "a", "en", "v1", 10, 0)], EVENTS)
    s.apply(1, first)
    s._write("deltas", 2, spark.createDataFrame([("a", "en", "v1", 99, 99)], rollups._DELTAS))  # broke off before its ledger row
    assert totals(s) == {("a", "en", "v1"): (1, 10)}
    s.apply(2, spark.createDataFrame([(1, "revise", 1, "a", "de", "v1", 12, 0)], EVENTS))
    assert totals(s) == {("a", "de", "v1"): (1, 12)}


def test_empty_batches(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.apply(5, spark.createDataFrame([], EVENTS)) and totals(s) == {}
