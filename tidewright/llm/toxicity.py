"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Each word has hashed vectors of itself and of its stems (its first bytes), so inflected forms share what is learned. Filters of several widths slide over the whole text, the maximum of each over the text goes through a logistic layer. Training is
data parallel over all labelled rows: they are dealt to learners of a bounded number of rows, each round every learner
trains on all of its rows from the same weights, the moves are added up in a tree of tasks and reach the driver as one set
of weights (their size is fixed by `Params`). Scoring maps over all documents and never sees label, language, source or
id. Thresholds come from a fold of the labelled rows that is left out of the fit, per language, and only decide the extra
column `rejected`.

Results for odd rows: null and empty texts are scored as a text without words. Rows without an id are scored, not
learned from. Repeated rows are scored each. Languages too rare in the calibration part, or null, use the default
threshold. No labels at all: every score is the model's untrained prior. Extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from ..session import in_small_batches, reliable
from . import words
from .labelled import held_out, share, text_key, training_labels


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 16
    size: int = 8  # numbers per hashed vector
    stems: tuple[int, ...] = (4, 6)  # bytes of a word that make a stem
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # per width
    least_texts: int = 3  # words and stems in fewer labelled texts have no vector
    learners: int = 2  # at least; there are as many as `learner_rows` asks for
    learner_rows: int = 10_000  # in expectation
    fan_in: int = 8  # learners, or sums of learners, that one task adds up
    rounds: int = 10  # passes over all rows where they are few
    least_rounds: int = 5  # where they are many
    visits: int = 120_000  # rows times rounds that suffice beyond `least_rounds`
    epochs: int = 1  # in each round
    batch: int = 8
    rate: float = 0.1
    calibration: float = 0.2  # share of the labelled rows that only sets thresholds
    threshold: float = 0.7
    lowest: float = 0.3  # no language's threshold goes below, whatever single texts of the calibration part ask for
    least_positives: int = 20
    seed: int = 10

    @property
    def tables(self) -> list[str]:
        return [f"e{j}" for j in range(1 + len(self.stems))]

    @property
    def width(self) -> int:
        return self.size * len(self.tables)

    @property
    def stored(self) -> type:
        return np.uint16 if self.buckets <= 1 << 16 else np.int32


DEFAULT = Params()

#: Everything that is no word byte of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[ord("0") : ord("9") + 1] = SEPARATOR[ord("a") : ord("z") + 1] = SEPARATOR[0x80:] = False


def word_buckets(s: words.Slice, p: Params) -> np.ndarray:
    """The buckets of each word of a slice and of its stems; bucket 0 is padding."""
    parts = [s.hashes(), *(words.hash_spans(s.data, s.starts, np.minimum(s.ends, s.starts + n)) for n in p.stems)]
    return np.stack([h % np.uint64(p.buckets - 1) for h in parts], axis=1).astype(np.int32) + 1


def initial(p: Params) -> dict[str, np.ndarray]:
    random = np.random.default_rng(p.seed)
    draw = lambda *shape, scale: random.normal(0, scale, shape).astype(np.float32)
    out = {name: draw(p.buckets, p.size, scale=0.1) for name in p.tables}
    for name in p.tables:
        out[name][0] = 0
    for w in p.widths:
        out[f"w{w}"] = draw(w * p.width, p.filters, scale=(p.width * w) ** -0.5)
    n = len(p.widths) * p.filters
    return out | {"bias": np.zeros(n, np.float32), "out": draw(n, scale=n**-0.5), "prior": np.full(1, -1.0, np.float32)}


def _padded(ids: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The texts' buckets end to end, each followed by padding as wide as the widest filter; and where each begins."""
    gap = max(p.widths)
    begins = np.concatenate([[0], np.cumsum([len(x) + gap for x in ids])])
    flat = np.zeros((begins[-1] + gap, len(p.tables)), np.int32)
    for x, at in zip(ids, begins):
        flat[at : at + len(x)] = x
    return flat, begins


def _features(model: dict[str, np.ndarray], flat: np.ndarray, begins: np.ndarray, p: Params) -> tuple:
    """Per text and filter the largest response before the rectifier; the vectors; all responses, by width."""
    x = np.concatenate([model[name][flat[:, j]] for j, name in enumerate(p.tables)], axis=1)
    n, size = begins[-1], x.shape[1]
    responses = []
    for w in p.widths:
        kernel = model[f"w{w}"]
        r = x[:n] @ kernel[:size]
        for k in range(1, w):
            r += x[k : n + k] @ kernel[k * size : (k + 1) * size]
        for k in range(1, w):  # these windows would reach into the next text
            r[begins[1:] - k] = -np.inf
        responses.append(r)
    top = np.concatenate([np.maximum.reduceat(r, begins[:-1], axis=0) for r in responses], axis=1)
    return top, x, responses


def forward(model: dict[str, np.ndarray], flat: np.ndarray, begins: np.ndarray, p: Params) -> np.ndarray:
    top, _, _ = _features(model, flat, begins, p)
    z = np.maximum(top + model["bias"], 0) @ model["out"] + model["prior"][0]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _step(model: dict, state: dict, ids: list[np.ndarray], y: np.ndarray, p: Params) -> None:
    """One Adagrad step on a batch of whole texts."""
    flat, begins = _padded(ids, p)
    top, x, responses = _features(model, flat, begins, p)
    hidden = np.maximum(top + model["bias"], 0)
    z = hidden @ model["out"] + model["prior"][0]
    d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
    grads = {"prior": d.sum(keepdims=True), "out": hidden.T @ d}
    up = d[:, None] * model["out"] * (top + model["bias"] > 0)
    grads["bias"] = up.sum(axis=0)
    at, push = [], []
    size, lengths = x.shape[1], np.diff(begins)
    for i, w in enumerate(p.widths):
        r = responses[i]
        cols = slice(i * p.filters, (i + 1) * p.filters)
        hit = r == np.repeat(top[:, cols], lengths, axis=0)
        grad = np.zeros_like(model[f"w{w}"])
        for f in range(p.filters):
            where = np.flatnonzero(hit[:, f])
            owner = np.searchsorted(begins, where, "right") - 1
            owner, first = np.unique(owner, return_index=True)
            where, g = where[first], up[owner, i * p.filters + f]
            for k in range(w):
                grad[k * size : (k + 1) * size, f] += x[where + k].T @ g
                at.append(where + k)
                push.append(g[:, None] * model[f"w{w}"][k * size : (k + 1) * size, f])
        grads[f"w{w}"] = grad
    for name, g in grads.items():
        state[name] += g * g
        model[name] -= p.rate * g / np.sqrt(state[name] + 1e-8)
    at, push = np.concatenate(at), np.concatenate(push)
    for j, name in enumerate(p.tables):
        rows, group = np.unique(flat[at, j], return_inverse=True)
        g = np.zeros((len(rows), p.size), np.float32)
        np.add.at(g, group, push[:, j * p.size : (j + 1) * p.size])
        g[rows == 0] = 0
        state[name][rows] += g * g
        model[name][rows] -= p.rate * g / np.sqrt(state[name][rows] + 1e-8)


def _text_counts(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(p.tables) * p.buckets, np.int64)
        for batch in batches:
            for x in _unpacked(batch.column("ids"), p):
                counts[np.unique(x + np.arange(len(p.tables), dtype=np.int32) * p.buckets)] += 1
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(counts[codes], pa.int64())], names=["code", "n"])

    return run


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(packed: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(packed)))


def label_bits(known: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the hashes of `n` labels' ids, at most 16 MB: what has no bit has no label."""
    bits = min(1 << 27, max(1 << 15, 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    blocks = known.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in blocks.collect():  # 4 KB each
        out[r["block"] - 1] = np.frombuffer(r["bitmap"], np.uint8)
    return out.ravel()


def _texts_to_buckets(shared, p: Params):
    """The buckets of the texts that may have a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            bit = batch.column("hash").to_numpy() % (8 * len(bitmap))
            batch = batch.filter(pa.array((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            at = 0
            for s in words.slices(batch.column("text"), separator=SEPARATOR):
                ids, begins = word_buckets(s, p), s.word_offsets
                part = batch.slice(at, s.last - s.first)
                at = s.last
                packed = [ids[a:b].astype(p.stored).tobytes() for a, b in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(packed, pa.binary())], names=["doc_id", "lang", "ids"])

    return run


def _unpacked(column: pa.Array, p: Params) -> list[np.ndarray]:
    return [np.frombuffer(x, p.stored).reshape(-1, len(p.tables)) for x in column.to_pylist()]


def _learner(shared, round_: int, p: Params):
    """What each learner's rows, which lie together, move: per learner one row (learner, learned)."""

    def learned(rows: list[tuple]) -> bytes:
        first, used = shared.value["model"], shared.value["used"]
        model = {k: v.copy() for k, v in first.items()}
        state = {k: v.copy() for k, v in shared.value["state"].items()}
        doc_ids, y = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        ids = [np.frombuffer(r[2], p.stored)[a:b].reshape(-1, len(p.tables)) for r in rows for a, b in zip(r[3][:-1], r[3][1:])]
        order = np.argsort(doc_ids, kind="stable")  # the same order whenever the task is run again
        ids, y = [ids[i] for i in order], y[order].astype(np.float32)
        known = lambda x: np.where(used[np.arange(len(p.tables)), x], x, 0)
        for epoch in range(p.epochs):
            order = np.random.default_rng([p.seed, round_, epoch]).permutation(len(ids))
            for at in range(0, len(order), p.batch):
                pick = order[at : at + p.batch]
                _step(model, state, [known(ids[i]) for i in pick], y[pick], p)
        out = {}
        for k, v in model.items():  # of the hashed vectors only those that moved
            rows = np.flatnonzero((v != first[k]).any(axis=1)) if k in p.tables else np.arange(len(v))
            weight = 1 if k in p.tables else len(ids)
            out |= {f"{k}_rows": rows.astype(np.int32), f"{k}_move": (v[rows] - first[k][rows]) * np.float32(weight),
                    f"{k}_weight": np.full(len(rows), weight, np.float64), f"{k}_state": state[k][rows]}
        return _pack(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bare(rows: pa.RecordBatch) -> tuple:
            """Ids, labels, all texts' buckets end to end and where each begins: a copy, so that no batch stays in memory."""
            packed = rows.column("ids").to_pylist()
            begins = np.concatenate([[0], np.cumsum([len(x) for x in packed])]) // np.dtype(p.stored).itemsize
            return rows.column("doc_id").to_numpy(zero_copy_only=False).copy(), rows.column("y").to_numpy().copy(), b"".join(packed), begins

        def row(learner: int, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([learner], pa.int64()), pa.array([learned(rows)], pa.binary())], names=["learner", "learned"])

        now, held = None, []
        for batch in batches:
            learners = batch.column("learner").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(learners)) + 1), len(learners)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and learners[a] != now:
                    yield row(now, held)
                    held = []
                now = int(learners[a])
                for at in range(a, b, 500):
                    held.append(bare(batch.slice(at, min(500, b - at))))
        if held:
            yield row(now, held)

    return run


def add_moves(learned: Iterable[bytes], p: Params) -> bytes:
    """Moves and weights of several learners added up, of the optimizer's states the largest. One learner's are unpacked
    at a time."""
    like, out = initial(p), {}
    sums = {k: (np.zeros_like(v), np.zeros_like(v), np.zeros(len(v))) for k, v in like.items()}
    for packed in learned:
        x = _load(packed)
        for k, (move, state, weight) in sums.items():
            rows = x[f"{k}_rows"]
            move[rows] += x[f"{k}_move"]
            weight[rows] += x[f"{k}_weight"]
            state[rows] = np.maximum(state[rows], x[f"{k}_state"])
    for k, (move, state, weight) in sums.items():
        rows = np.flatnonzero(weight)
        out |= {f"{k}_rows": rows.astype(np.int32), f"{k}_move": move[rows], f"{k}_weight": weight[rows], f"{k}_state": state[rows]}
    return _pack(out)


def _adder(p: Params):
    def run(table: pa.Table) -> pa.Table:
        learners, column = table.column("learner").to_numpy(), table.column("learned")
        moves = (column[int(i)].as_buffer() for i in np.argsort(learners))
        return pa.table({"learner": pa.array([int(learners[0]) // p.fan_in], pa.int64()), "learned": pa.array([add_moves(moves, p)], pa.binary())})

    return run


def fit(rows: DataFrame, p: Params, learners: int, rounds: int) -> dict[str, np.ndarray]:
    """Weights from all rows (learner, doc_id, y, ids), where a learner's rows lie together: rounds of local training,
    averaged.

    A hashed vector is averaged over the learners that moved it, all other weights over all learners. Words of a few
    texts only could be learned by heart, so they, like words that no labelled text has, have the vector zero."""
    spark = rows.sparkSession
    model = initial(p)
    counted = rows.select("ids").mapInArrow(_text_counts(p), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    codes = counted.where(F.col("n") >= p.least_texts).select("code").toPandas()["code"].to_numpy(np.int64)  # one per bucket at most
    used = np.zeros((len(p.tables), p.buckets), bool)
    used[codes // p.buckets, codes % p.buckets] = True
    for j, name in enumerate(p.tables):
        model[name][~used[j]] = 0
    state = {k: np.full_like(v, 1e-3) for k, v in model.items()}
    for round_ in range(rounds):
        shared = spark.sparkContext.broadcast({"model": model, "state": state, "used": used})
        sums, left = rows.mapInArrow(_learner(shared, round_, p), "learner long, learned binary"), learners
        while True:  # the driver gets one sum, however many learners there are
            sums = sums.groupBy(F.floor(F.col("learner") / p.fan_in).alias("group")).applyInArrow(_adder(p), "learner long, learned binary")
            left = -(-left // p.fan_in)
            if left == 1:
                break
        got = sums.select("learned").collect()
        shared.destroy()
        if not got:
            return model
        x = _load(got[0]["learned"])
        del got
        for k, weights in model.items():
            at = x[f"{k}_rows"]
            share_of = x[f"{k}_weight"].reshape(-1, *[1] * (weights.ndim - 1))
            weights[at] += (x[f"{k}_move"] / share_of).astype(np.float32)
            state[k][at] = np.maximum(state[k][at], x[f"{k}_state"])
    return model


def _scorer(shared, p: Params, packed: bool):
    """Appends `score` to batches that have the column `ids` (packed) or `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            source = "ids" if packed else "text"
            scores = []
            if packed:
                for at in range(0, batch.num_rows, 256):
                    scores.append(forward(model, *_padded(_unpacked(batch.column(source).slice(at, 256), p), p), p))
            else:
                for s in words.slices(batch.column(source), separator=SEPARATOR):
                    ids, begins = word_buckets(s, p), s.word_offsets
                    step = 64
                    for at in range(0, len(begins) - 1, step):
                        texts = [ids[a:b] for a, b in zip(begins[at : at + step], begins[at + 1 : at + step + 1])]
                        scores.append(forward(model, *_padded(texts, p), p))
            rest = [c for c in batch.schema.names if c != source]
            score = pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), score], names=[*rest, "score"])

    return run


def thresholds(scored: DataFrame, p: Params) -> DataFrame:
    """(lang, threshold): per language the cut with the best F1 on calibration rows (lang, y, score), the one nearest
    the default cut among equals. Cuts are hundredths, so a language has at most 101 rows here."""
    cut = F.floor(F.col("score") * 100).cast("int")
    bins = scored.where("lang is not null").groupBy("lang", cut.alias("cut")).agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    every = Window.partitionBy("lang")
    above = every.orderBy(F.desc("cut"))
    marked = bins.select("lang", (F.col("cut") / 100).alias("threshold"), F.sum("bad").over(above).alias("caught"),
                         F.sum("good").over(above).alias("wrong"), F.sum("bad").over(every).alias("all_bad"))
    # a cut that lies between two occupied bins is as good as any other there: take the one nearest the default
    lower = F.coalesce(F.lead("threshold").over(Window.partitionBy("lang").orderBy(F.desc("threshold"))) + 0.01, F.lit(0.0))
    marked = marked.withColumn("threshold", F.least(F.col("threshold"), F.greatest(lower, F.lit(p.threshold))))
    f1 = 2 * F.col("caught") / (F.col("caught") + F.col("wrong") + F.col("all_bad"))
    best = marked.where(F.col("all_bad") >= p.least_positives).groupBy("lang").agg(
        F.max_by("threshold", F.struct(f1, -F.abs(F.col("threshold") - p.threshold))).alias("threshold"))
    return best.withColumn("threshold", F.greatest("threshold", F.lit(p.lowest)))


@in_small_batches
def classify(docs: DataFrame, labels: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, threshold (of its language), rejected, text_key."""
    spark = docs.sparkSession
    known = reliable(training_labels(labels, "toxic"))
    n = max(1, known.count())
    learners = max(p.learners, -(-n // p.learner_rows))
    rounds = min(p.rounds, max(p.least_rounds, -(-p.visits // n)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_key(F.col("text")).alias("text_key"), "text")
    marked = spark.sparkContext.broadcast(label_bits(known, n))
    # no text is shuffled: the join sees the buckets of the few texts that the bitmap lets through
    taught = base.where("doc_id is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(
        _texts_to_buckets(marked, p), "doc_id long, lang string, ids binary").join(known.hint("merge"), "doc_id")
    taught = taught.withColumn("learner", F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(learners).cast("long")))
    taught = taught.withColumn("fold", share(p.seed + 1) < p.calibration)
    taught = reliable(taught.repartition(learners, "learner").sortWithinPartitions("learner", "fold", "doc_id"))
    model = fit(taught.where(~F.col("fold")).select("learner", "doc_id", "y", "ids"), p, learners, rounds)
    shared = spark.sparkContext.broadcast(model)
    checked = taught.where("fold").select("lang", "y", "ids").mapInArrow(_scorer(shared, p, True), "lang string, y double, score double")
    cuts = reliable(thresholds(checked, p))
    scored = reliable(base.mapInArrow(_scorer(shared, p, False), "doc_id long, lang string, text_key binary, score double"))
    return scored.join(cuts, "lang", "left").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"),
        F.coalesce("threshold", F.lit(p.threshold)).alias("threshold"),
        (F.col("score") >= F.coalesce("threshold", F.lit(p.threshold))).alias("rejected"), "text_key")
