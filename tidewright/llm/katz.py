"""Language-model scoring: a bigram Katz backoff model with Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = t d(c(h, w)) c(h, w) / c(h)    for pairs kept in the model, t being 1 for all but a few histories
             = alpha(h) P(w)                  for all others
    P(w)     = s d(c(w)) c(w) / N             for known words, the rest of the mass for the one class of unknown words

Counting and scoring both shuffle one packed row per block of texts and part of the key space, holding each distinct
word or pair of the block once, so a word that is everywhere costs no more than a rare one. Parts grow in number with
the corpus, so their size stays put. The model is stored packed too, hashed words standing for words: per part of words
their counts and, as histories, their backoff weights; per part of pairs, which holds all pairs of its histories, the
pairs by history, a pair's word being its place in the part's own vocabulary. A part of pairs asks the parts of words
for the counts of its distinct words; from these and its own it derives P(w) and alpha(h). No pair is a row of its own.
For scoring, the recursion is unrolled once per stored pair: gain = log P(w | h) - log alpha(h) - log P(w), so a text's
score is the sum over its tokens of log alpha(h) + log P(w), plus the gain of each pair that the model keeps. Gains are
added up where they are looked up.

Every pair is kept, those seen once with their Good-Turing discount. `keep_from=2` is Katz's own cut-off instead: the mass
of single pairs goes to the backoff weight of their history, and the counts of counts that set the discounts include them.
Every text is counted whole.

Results for odd rows: null and empty texts are one end token. Rows without an id are scored and trained on (their id's
checksum is not held out). Repeated rows count and are scored each. Without any training row, N = V = 0 and every
token is unknown. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard, reliable
from . import words


@dataclass(frozen=True)
class Params:
    keep_from: int = 1  # smallest count of a pair in the model
    discounted: int = 5  # Good-Turing discounts counts up to this one
    block_tokens: int = 2_000_000
    part_bytes: int = 16 << 20  # of text per part of the pairs' key space
    word_parts: int = 3  # parts of pairs per part of words


WHOLE = Params()  # what the query runs: every pair is kept
DEFAULT = Params(keep_from=2)  # Katz's own cut-off: pairs seen once are left to the backoff
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFA7B1C1D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
PACKED = "kind string, part int, block long, data binary"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


# ---------------------------------------------------------------- packed arrays

def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: equal high bytes of sorted numbers shrink to nothing."""
    head, body = [], []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() if len(x) else b""
        squeezed = zstandard.ZstdCompressor(level=1).compress(raw)
        head.append(f"{name}:{x.dtype.str}:{len(x)}:{len(squeezed)}")
        body.append(squeezed)
    return ",".join(head).encode() + b"\n" + b"".join(body)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    head, _, body = data.partition(b"\n")
    out, at = {}, 0
    for entry in head.decode().split(","):
        name, kind, n, size = entry.split(":")
        kind, n, size = np.dtype(kind), int(n), int(size)
        raw = zstandard.ZstdDecompressor().decompress(body[at : at + size], max_output_size=max(1, n * kind.itemsize))
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.empty(0, kind)
        at += size
    return out


def _spread(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _pair_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return words.mix(history * _PAIR + word)


def _runs(order_sorted: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], order_sorted[1:] != order_sorted[:-1]])) if len(order_sorted) else np.empty(0, np.int64)


# ---------------------------------------------------------------- blocks

@dataclass
class _Block:
    """Token streams of some whole texts: each text is its words and one end."""

    doc_ids: list
    texts: np.ndarray  # of each token, its text in the block
    tokens: np.ndarray
    histories: np.ndarray

    @property
    def n(self) -> int:
        return len(self.doc_ids)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Block]:
    ids, streams, sizes, held = [], [], [], 0
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for s in words.slices(batch.column("text")):
            counts = np.diff(s.word_offsets)
            tokens = np.insert(s.hashes(), s.word_offsets[1:], END)
            ids += doc_ids[s.first : s.last]
            streams.append(tokens)
            sizes.append(counts + 1)
            held += len(tokens)
            if held >= most:
                yield _block(ids, streams, sizes)
                ids, streams, sizes, held = [], [], [], 0
    if ids:
        yield _block(ids, streams, sizes)


def _block(ids: list, streams: list[np.ndarray], sizes: list[np.ndarray]) -> _Block:
    tokens, sizes = np.concatenate(streams), np.concatenate(sizes)
    histories = np.empty_like(tokens)
    histories[1:] = tokens[:-1]
    histories[np.cumsum(sizes) - sizes] = START
    return _Block(ids, np.repeat(np.arange(len(ids), dtype=np.uint32), sizes), tokens, histories)


def _rows(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


# ---------------------------------------------------------------- counting

def _count_block(parts: dict[str, int], most: int):
    """Per block and part of the key space: the distinct words, or pairs by history, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, most):
            word, n = np.unique(block.tokens, return_counts=True)
            part = _spread(word, parts["words"])
            for i in range(parts["words"]):
                own = part == i
                if own.any():
                    yield _rows([("words", i, 0, _pack(word=word[own], n=n[own].astype(np.uint32)))], PACKED)
            for i, own in _by_part(_spread(block.histories, parts["pairs"]), parts["pairs"]):
                h, w = block.histories[own], block.tokens[own]
                order = np.argsort(_pair_key(h, w))
                h, w = h[order], w[order]
                at = _runs(_pair_key(h, w))
                n = np.diff(np.append(at, len(h)))
                h, w = h[at], w[at]
                order = np.argsort(h, kind="stable")
                h, w, n = h[order], w[order], n[order]
                at = _runs(h)
                yield _rows([("pairs", i, 0, _pack(history=h[at], span=np.diff(np.append(at, len(h))).astype(np.uint32), word=w, n=n.astype(np.uint32)))], PACKED)

    return run


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for i in range(parts):
        if cuts[i] < cuts[i + 1]:
            yield i, order[cuts[i] : cuts[i + 1]]


MERGED = "kind string, part int, data binary, times array<long>, mass array<long>"


def _merge_counts(p: Params):
    """All counts of a part, as one packed row: words, or pairs by history, their words as places in the part's own
    vocabulary. Pairs under the cut-off are only in `times`, how many had a count of 1, 2, ..., discounted + 1, and more,
    and in `mass`, the sums of these counts."""

    def run(table: pa.Table) -> pa.Table:
        kind, part = (table.column(c)[0].as_py() for c in ("kind", "part"))
        blocks = [_unpack(x) for x in table.column("data").to_pylist()]
        word, n = (np.concatenate([b[c] for b in blocks]) for c in ("word", "n"))
        history = np.concatenate([np.repeat(b["history"], b["span"]) for b in blocks]) if kind == "pairs" else np.zeros(len(word), np.uint64)
        del blocks
        order = np.argsort(_pair_key(history, word) if kind == "pairs" else word)
        history, word, n = history[order], word[order], n[order].astype(np.int64)
        at = _runs(_pair_key(history, word) if kind == "pairs" else word)
        history, word, n = history[at], word[at], np.add.reduceat(n, at)
        low = np.minimum(n, p.discounted + 2)
        times = np.bincount(low, minlength=p.discounted + 3)[1:]
        mass = [int(n[low == r].sum()) for r in range(1, p.discounted + 3)]
        if kind == "pairs":
            keep = n >= p.keep_from
            history, word, n = history[keep], word[keep], n[keep]
            order = np.argsort(history, kind="stable")
            history, word, n = history[order], word[order], n[order]
            at = _runs(history)
            vocabulary, slot = np.unique(word, return_inverse=True)
            data = _pack(history=history[at], span=np.diff(np.append(at, len(history))).astype(np.uint32), word=vocabulary, slot=slot.astype(np.uint32), n=n)
        else:
            data = _pack(word=word, n=n)
        return pa.table({"kind": [kind], "part": pa.array([part], pa.int32()), "data": pa.array([data], pa.binary()),
                         "times": pa.array([times.tolist()], pa.list_(pa.int64())), "mass": pa.array([mass], pa.list_(pa.int64()))})

    return run


def discounts(times: dict[int, int], k: int) -> dict[int, float]:
    """Katz's Good-Turing discounts of counts 1 to k from the counts of counts. Where the formula leaves (0, 1], as it
    may in small corpora, half a count is taken off instead."""
    first = times.get(1, 0)
    common = (k + 1) * times.get(k + 1, 0) / first if first else 1.0
    out = {}
    for r in range(1, k + 1):
        d = ((r + 1) * times.get(r + 1, 0) / (r * times[r]) - common) / (1 - common) if times.get(r) and common < 1 else 0.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Counts:
    """Counts as the model takes them: discounted, and for single words as probabilities."""

    pair_factors: tuple[float, ...]  # of the counts 0, 1, ..., the last one of all that follow
    word_factors: tuple[float, ...]  # these make a word's count its probability
    log_unknown: float

    def used(self, n: np.ndarray) -> np.ndarray:
        return np.array(self.pair_factors)[np.minimum(n, len(self.pair_factors) - 1)] * n

    def p(self, n: np.ndarray) -> np.ndarray:
        return np.array(self.word_factors)[np.minimum(n, len(self.word_factors) - 1)] * n


def _settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished steps now, not at its next half-hourly round. Python's references
    are given up in the background, so a first collection alone still finds the last step's files in use."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@dataclass
class Model:
    stored: DataFrame  # packed rows (kind, part, block, data) by part: words with counts, words' backoff weights, pairs
    counts: Counts
    total: int  # N, training tokens
    vocabulary: int  # V, distinct training tokens
    parts: dict[str, int]


def _counted_words(q: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words whose counts a part of pairs needs, and of each history the one that tells how often it was followed by
    anything: itself, and for the start of texts their end."""
    heads = np.where(q["history"] == START, END, q["history"])
    return np.union1d(q["word"], heads), heads


def _wanted(parts: dict[str, int]):
    """What each part of pairs asks the parts of words: a row per pair of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                known, _ = _counted_words(_unpack(data.as_py()))
                for i, own in _by_part(_spread(known, parts["words"]), parts["words"]):
                    yield _rows([("wanted", i, part, _pack(word=known[own]))], PACKED)

    return run


def _told(wanted: pa.Table, stored: pa.Table) -> pa.Table:
    """The counts of the wanted words, in their order; `part` and `block` change places."""
    q = _unpack(stored.column("data")[0].as_py()) if len(stored) else {}
    rows = [("pairs", block, part, _pack(n=q["n"][np.searchsorted(q["word"], _unpack(data)["word"])]))
            for part, block, data in zip(*(wanted.column(c).to_pylist() for c in ("part", "block", "data")))]
    return pa.Table.from_batches([_rows(rows, PACKED)])


def _backoff(q: dict[str, np.ndarray], counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a part of pairs: P(w) of its vocabulary, and per history log alpha(h) and the logarithm of what one discounted
    count is worth."""
    if not len(q["history"]):
        return np.empty(0), np.empty(0), np.empty(0)
    single = counts.p(q["count"])
    begins = np.cumsum(q["span"], dtype=np.int64) - q["span"]
    used, taken = np.add.reduceat(counts.used(q["n"]), begins), np.add.reduceat(single[q["slot"]], begins)
    # a history whose pairs are all frequent would leave nothing to back off to: half a token of mass is left at least
    left = np.maximum(1 - used / q["seen"], 0.5 / (q["seen"] + 1))
    return single, np.log10(left / (1 - taken)), np.log10((1 - left) / used)


def _weighted(counts: Counts, parts: dict[str, int]):
    """A part of pairs with the counts of its vocabulary and histories, and the histories' backoff weights for the parts of
    words. The weight of the start of texts goes with their end, as every text has one of each."""

    def run(stored: pa.Table, told: pa.Table) -> pa.Table:
        part, q = stored.column("part")[0].as_py(), _unpack(stored.column("data")[0].as_py())
        known, heads = _counted_words(q)
        n = np.zeros(len(known), np.int64)
        answers = dict(zip(told.column("block").to_pylist(), told.column("data").to_pylist()))
        for i, own in _by_part(_spread(known, parts["words"]), parts["words"]):
            n[own] = _unpack(answers[i])["n"]
        q |= {"count": n[np.searchsorted(known, q["word"])], "seen": n[np.searchsorted(known, heads)]}
        _, log_alpha, _ = _backoff(q, counts)
        rows = [("pairs", part, 0, _pack(**q))]
        for i, own in _by_part(_spread(heads, parts["words"]), parts["words"]):
            rows.append(("words", i, part + 1, _pack(word=heads[own], log_alpha=log_alpha[own])))
        return pa.Table.from_batches([_rows(rows, PACKED)])

    return run


def train(docs: DataFrame, p: Params = WHOLE, parts: dict[str, int] | None = None) -> Model:
    """The model of all texts of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    parts = parts or key_parts(docs, p)
    packed = docs.select("doc_id", "text").mapInArrow(_count_block(parts, p.block_tokens), PACKED)
    counted = reliable(packed.groupBy("kind", "part").applyInArrow(_merge_counts(p), MERGED))
    _settle(spark)
    times, mass = ({"words": {}, "pairs": {}} for _ in range(2))
    tallies = counted.select("kind", F.posexplode(F.arrays_zip("times", "mass")).alias("at", "x")).groupBy("kind", "at")
    for r in tallies.agg(F.sum("x.times").alias("times"), F.sum("x.mass").alias("mass")).collect():
        times[r["kind"]][r["at"] + 1], mass[r["kind"]][r["at"] + 1] = r["times"], r["mass"]
    total, vocabulary = sum(mass["words"].values()), sum(times["words"].values())

    word_d, pair_d = (discounts(times[kind], p.discounted) for kind in ("words", "pairs"))
    kept = sum(m * word_d.get(r, 1.0) for r, m in mass["words"].items()) / max(1, total)
    unknown = max(1 - kept, 1 / (total + 1))
    scale = (1 - unknown) / kept if kept else 0.0
    every = range(p.discounted + 2)
    counts = Counts(tuple(pair_d.get(r, 1.0) for r in every), tuple(scale * word_d.get(r, 1.0) / max(1, total) for r in every), float(np.log10(unknown)))

    row = ["kind", "part", F.lit(0).cast("long").alias("block"), "data"]
    singles = reliable(counted.where("kind = 'words'").select(*row))
    pairs = counted.where("kind = 'pairs'").select(*row)
    wanted = pairs.select("part", "data").mapInArrow(_wanted(parts), PACKED)
    told = wanted.groupBy("part").cogroup(singles.groupBy("part")).applyInArrow(_told, PACKED)
    weighted = reliable(pairs.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_weighted(counts, parts), PACKED))
    discard(counted)
    _settle(spark)
    return Model(singles.unionByName(weighted), counts, int(total), int(vocabulary), parts)


def key_parts(docs: DataFrame, p: Params) -> dict[str, int]:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pairs = max(1, -(-size // p.part_bytes))
    return {"pairs": pairs, "words": max(1, -(-pairs // p.word_parts))}


# ---------------------------------------------------------------- scoring

def _incidence(keys: np.ndarray, texts: np.ndarray) -> dict[str, np.ndarray]:
    """The distinct keys, how many tokens have each, and those tokens' texts, in the order of the keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _runs(keys)
    return {"key": keys[at], "span": np.diff(np.append(at, len(keys))).astype(np.uint32), "text": texts[order]}


def _ask(parts: dict[str, int], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, block in enumerate(_blocks(batches, most)):
            name = base + number
            texts = block.texts.astype(np.uint16) if block.n <= 1 << 16 else block.texts
            ids = np.array([0 if x is None else x for x in block.doc_ids], np.int64)
            null = np.array([x is None for x in block.doc_ids], np.uint8)
            yield _rows([("texts", 0, name, _pack(doc_id=ids, null=null, n=np.bincount(block.texts, minlength=block.n)))], PACKED)
            for i, own in _by_part(_spread(block.tokens, parts["words"]), parts["words"]):
                yield _rows([("words", i, name, _pack(size=np.array([block.n]), **_incidence(block.tokens[own], texts[own])))], PACKED)
            for i, own in _by_part(_spread(block.histories, parts["pairs"]), parts["pairs"]):
                keys = _pair_key(block.histories[own], block.tokens[own])
                yield _rows([("pairs", i, name, _pack(size=np.array([block.n]), **_incidence(keys, texts[own])))], PACKED)

    return run


def _answer(counts: Counts, log_base: float):
    """Joins a part's questions to its stored keys; per block, the sums of each text over the part's tokens."""

    def pairs(q: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = _pair_key(np.repeat(q["history"], q["span"]), q["word"][q["slot"]])
        single, log_alpha, log_per_count = _backoff(q, counts)
        gain = np.log10(counts.used(q["n"])) - np.log10(single)[q["slot"]] + np.repeat(log_per_count - log_alpha, q["span"])
        order = np.argsort(key)
        return key[order], gain[order]

    def singles(all_of: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = next((q["word"], q["n"]) for q in all_of if "n" in q)
        value = np.log10(counts.p(n))
        for q in all_of:
            if "log_alpha" in q:
                value[np.searchsorted(key, q["word"])] += q["log_alpha"]
        return key, value, n

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        rows = []
        key, value, n = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)
        if len(stored) and len(asked):
            found = [_unpack(x) for x in stored.column("data").to_pylist()]
            if stored.column("kind")[0].as_py() == "pairs":
                key, value = pairs(found[0])
            else:
                key, value, n = singles(found)
        for kind, part, block, data in zip(*(asked.column(c).to_pylist() for c in ("kind", "part", "block", "data"))):
            if kind == "texts":
                rows.append((kind, part, block, data))
                continue
            q = _unpack(data)
            size, text = int(q["size"][0]), q["text"]
            at = np.searchsorted(key, q["key"])
            hit = at < len(key)
            hit[hit] = key[at[hit]] == q["key"][hit]
            found = np.zeros(len(at))
            found[hit] = value[at[hit]]
            total = lambda x: np.bincount(text, weights=np.repeat(x, q["span"]), minlength=size)
            if kind == "pairs":
                rows.append((kind, part, block, _pack(score=total(found))))
            else:
                count = np.zeros(len(at))
                count[hit] = n[at[hit]]
                rows.append((kind, part, block, _pack(score=total(np.where(hit, found, counts.log_unknown)),
                                                      base=total(np.log10(count + 1) - log_base), known=total(hit.astype(float)).astype(np.uint32))))
        return pa.Table.from_batches([_rows(rows, PACKED)])

    return run


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _gather(table: pa.Table) -> pa.Table:
    """One row per text of a block from the sums of its parts, added in the order of the parts."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "data"))), key=lambda r: r[:2])
    texts = next(_unpack(d) for k, _, d in rows if k == "texts")
    out = {"score": 0.0, "base": 0.0, "known": 0}
    for kind, _, data in rows:
        if kind != "texts":
            for name, x in _unpack(data).items():
                out[name] = out[name] + (x.astype(np.int64) if name == "known" else x)
    return pa.table({"doc_id": pa.array(texts["doc_id"], pa.int64(), mask=texts["null"].astype(bool)), "n_tokens": texts["n"].astype(np.int64),
                     "n_known": out["known"], "base_score": out["base"], "score": out["score"]})


def evaluate(docs: DataFrame, model: Model, p: Params = WHOLE) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of `docs`."""
    parts = model.parts
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ask(parts, p.block_tokens), PACKED)
    # texts' own rows go round the model by their block, so that no part receives all of them
    asked = asked.withColumn("part", F.when(F.col("kind") == "texts", F.pmod(F.xxhash64("block"), F.lit(1 << 20)).cast("int")).otherwise(F.col("part")))
    log_base = float(np.log10(model.total + model.vocabulary + 1))
    answered = asked.groupBy("kind", "part").cogroup(model.stored.groupBy("kind", "part")).applyInArrow(_answer(model.counts, log_base), PACKED)
    return answered.groupBy("block").applyInArrow(_gather, SCORED)


def score(docs: DataFrame, p: Params = WHOLE) -> DataFrame:
    """Learns from the rows that are not held out and scores all rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), p, key_parts(docs, p))
    out = evaluate(docs, model, p)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                      "base_score", "score")
