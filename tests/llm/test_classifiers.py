"""Quality and toxicity on held-out rows of planted texts, and their parts against plain versions."""

import random
import tracemalloc
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import quality, toxicity

SMALL = replace(toxicity.DEFAULT, buckets=1 << 12, rounds=6, learners=2)


def planted(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "an", "er", "tion", "on", "re", "st"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 90))]
        good, toxic = r.random() < 0.7, r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["scum", "vorlix"]) + r.choice(["", "ed", "ings"]))
        if not good:
            w = [x.upper() + "!!" if i % 2 else x + r.choice(["***", "$$$"]) for x in w]
        rows.append((i, " ".join(w), r.choice(["en", "de"]), int(good), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(got, truth):
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r["score"] <= 1 for r in got)
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_quality_on_held_out_rows(spark):
    rows = planted(900)
    got = quality.classify(*frames(spark, rows)).collect()
    assert accuracy(got, {r[0]: r[3] for r in rows}) > 0.97


def test_toxicity_on_held_out_rows(spark):
    rows = planted(900)
    got = toxicity.classify(*frames(spark, rows), SMALL).collect()
    truth = {r[0]: r[4] for r in rows}
    assert accuracy(got, truth) > 0.9
    assert all(r["rejected"] == (r["score"] >= r["threshold"]) and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_labels_of_held_out_rows_are_never_learned(spark):
    rows = [r for r in planted(300) if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    got = quality.classify(*frames(spark, rows)).collect()
    assert {r["score"] for r in got} == {0.5}


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_odd_rows(spark, odd_docs, no_docs, which):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (3, None, None), (6, 0, 0), (7, 1, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    run = quality.classify if which == "quality" else lambda d, l: toxicity.classify(d, l, SMALL)
    got = run(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert len(run(odd_docs, labels.limit(0)).collect()) == odd_docs.count()
    assert run(no_docs, labels).count() == 0


def test_gradients(monkeypatch):
    """One step moves every weight against a numeric derivative of the loss."""
    p = replace(toxicity.DEFAULT, buckets=32, filters=2, rate=1.0)
    r = np.random.default_rng(3)
    ids = [r.integers(1, 32, (n, 3)).astype(np.int32) for n in (5, 1, 7)]
    y = np.array([1, 0, 1], np.float32)
    model = {k: v.astype(np.float64) for k, v in toxicity.initial(p).items()}
    model["bias"] = r.normal(0, 0.05, len(model["bias"]))  # away from the rectifier's kink, where texts without a positive response stand

    def loss():
        q = toxicity.forward(model, *toxicity._padded(ids, p), p)
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    before = {k: v.copy() for k, v in model.items()}
    state = {k: np.full_like(v, 1e9) for k, v in model.items()}  # Adagrad divides all by the same
    toxicity._step(model, state, ids, y, p)
    moves = {k: (before[k] - model[k]) * np.sqrt(1e9) for k in model}
    model.update(before)
    for name, index in (("prior", 0), ("out", 1), ("bias", 3), ("w1", (2, 0)), ("w3", (30, 1)), ("e0", (ids[0][2, 0], 1)), ("e2", (ids[2][3, 2], 0))):
        kept = model[name][index]
        model[name][index] = kept + 1e-5
        up = loss()
        model[name][index] = kept - 1e-5
        down = loss()
        model[name][index] = kept
        assert moves[name][index] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_isotonic_curve_is_monotone_and_pooled():
    at, level = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 6, 2, 9]), np.array([10.0, 10, 10, 10]))
    assert np.allclose(at, [0.1, 0.25, 0.4]) and np.allclose(level, [0.5 / 11, 8.5 / 21, 9.5 / 11])


def test_normal_equations_sum_over_partitions(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(60, len(quality.STATISTICS))), r.integers(0, 2, 60).astype(float)
    p = replace(quality.DEFAULT, features=16)
    kernel = quality.Kernel(x.mean(axis=0), x.std(axis=0), p)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "stats array<double>, y double").repartition(7)
    z = kernel(x)
    want = np.linalg.solve(z.T @ z + 60 * p.ridge * np.eye(17), z.T @ y)
    assert np.allclose(quality.ridge(rows, kernel, p), want, rtol=1e-6, atol=1e-8)


def test_statistics_see_whole_texts():
    text = "plain words here. " * 3000
    a, b = (next(iter(quality.statistics(pa.array([t])))) for t in (text, text + "A|B|C|D!!" * 500))
    assert not np.allclose(a, b)


def test_forward_pass_equals_plain_loops_and_ignores_neighbours():
    """Each text alone, window by window: words and stems looked up, filters of every width, the maximum, the output."""
    p = replace(toxicity.DEFAULT, buckets=64, filters=3)
    r = np.random.default_rng(4)
    ids = [r.integers(1, 64, (n, 3)).astype(np.int32) for n in (4, 0, 1, 9, 2, 30)]
    model = {k: v.astype(np.float64) for k, v in toxicity.initial(p).items()}
    model["bias"] = r.normal(size=len(model["bias"]))
    want = []
    for text in ids:
        vectors = [np.concatenate([model[f"e{j}"][row[j]] for j in range(3)]) for row in text]
        hidden = []
        for w in p.widths:
            for f in range(p.filters):
                best = -np.inf
                for at in range(len(text) + 1):  # windows that begin at a word, or behind the last one
                    response = 0.0
                    for k in range(w):
                        if at + k < len(text):
                            response += sum(vectors[at + k][c] * model[f"w{w}"][k * p.width + c, f] for c in range(p.width))
                    best = max(best, response)
                hidden.append(max(best + model["bias"][len(hidden)], 0))
        want.append(1 / (1 + np.exp(-(sum(h * o for h, o in zip(hidden, model["out"])) + model["prior"][0]))))
    assert np.allclose(toxicity.forward(model, *toxicity._padded(ids, p), p), want)
    alone = [toxicity.forward(model, *toxicity._padded([x], p), p)[0] for x in ids]
    assert np.allclose(alone, want)


def test_every_training_label_is_learned_from_or_calibrates(spark, monkeypatch):
    """No sample of the labels, however many there are: learners get all rows but the calibration fold."""
    n, seen = 20_000, {}
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 50) as text", "'en' as lang")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    cut = toxicity.thresholds
    monkeypatch.setattr(toxicity, "fit", lambda rows, p, *more: seen.update(fit=rows.count()) or toxicity.initial(p))
    monkeypatch.setattr(toxicity, "thresholds", lambda rows, p: seen.update(cut=rows.count()) or cut(rows, p))
    toxicity.classify(docs, labels, SMALL).count()
    training = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(n))
    assert seen["fit"] + seen["cut"] == training and seen["fit"] > 0.75 * training


def test_many_learners_learn_what_few_do(spark):
    rows = planted(900)
    got = toxicity.classify(*frames(spark, rows), replace(SMALL, learner_rows=40, fan_in=3, rounds=12)).collect()
    assert accuracy(got, {r[0]: r[4] for r in rows}) > 0.9


def test_moves_add_up_alike_in_any_tree():
    p = replace(toxicity.DEFAULT, buckets=32, filters=2)
    r = np.random.default_rng(6)
    parts = []
    for n in (5, 9, 2):
        out = {}
        for k, v in toxicity.initial(p).items():
            rows = np.flatnonzero(r.random(len(v)) < 0.5) if k in p.tables else np.arange(len(v))
            out |= {f"{k}_rows": rows.astype(np.int32), f"{k}_move": r.normal(size=v[rows].shape).astype(np.float32),
                    f"{k}_weight": np.full(len(rows), 1.0 if k in p.tables else n), f"{k}_state": r.random(v[rows].shape).astype(np.float32)}
        parts.append(toxicity._pack(out))
    flat = toxicity._load(toxicity.add_moves(parts, p))
    tree = toxicity._load(toxicity.add_moves([toxicity.add_moves(parts[:2], p), parts[2]], p))
    assert flat.keys() == tree.keys() and all(np.allclose(flat[k], tree[k], atol=1e-6) for k in flat)
    assert flat["prior_weight"][0] == 16


def test_moves_are_unpacked_one_learner_at_a_time():
    p = replace(toxicity.DEFAULT, buckets=1 << 14)
    out = {}
    for k, v in toxicity.initial(p).items():
        out |= {f"{k}_rows": np.arange(len(v), dtype=np.int32), f"{k}_move": v, f"{k}_weight": np.ones(len(v)), f"{k}_state": np.abs(v)}
    packed = toxicity._pack(out)
    tracemalloc.start()
    toxicity.add_moves([packed] * 24, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(packed)


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    def sizes(shared, p, packed):
        def run(batches):
            for b in batches:
                rest = [c for c in b.schema.names if c not in ("ids", "text")]
                size = pa.array([b.nbytes / 2**20] * b.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), size], names=[*rest, "score"])

        return run

    monkeypatch.setattr(toxicity, "_scorer", sizes)
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 1800) AS text", "'en' AS lang")  # 22 MB
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = [r["score"] for r in toxicity.classify(docs, labels, SMALL).select("score").collect()]
    assert len(got) == 2000 and 0 < max(got) < 8
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit
