"""Near duplicates: many universal hash minima with banding, signature verification, an exact check on full sets, and
connected components by alternating large-star and small-star.

Nodes are distinct shingle sets, so a group of copies is one node however many rows it has. Candidates come from
buckets of equal bands, and no bucket is ever expanded into all its pairs:

1. every member of a bucket is compared with the bucket's smallest member (a star);
2. members of buckets with more than `crowded` components are counted shingle by shingle. Those that share a shingle which
   at most `rare` members have are compared with each other. All others can only have their common shingles in common,
   which leaves out texts around a passage; what is left of a bucket is compared with its centre, the member with most
   common and fewest own shingles;
3. members of one bucket that still lie in different components, and have enough common shingles for a link, are compared
   with each other inside the tasks: a bucket is cut into tiles of `tile` members, tile against tile, and only pairs whose
   signatures agree become rows, each in the first bucket that both share. This step grows with the square of what is left
   in a bucket; a bucket of which more than `tiled` members are left is dealt anew into longer bands of the stored
   signatures, and these are cut into tiles instead.

A pair inside one component needs no comparison, so the rounds find the same components as all pairs of all buckets.
With 40 bands of 4 minima, two sets at similarity 0.75 share no bucket with probability (1 - 0.75^4)^40 = 2.5e-7. The 400
long bands of 8 places are all drawn from one signature of 160 minima, k of which agree, so they miss a pair with
probability sum over k of Binom(160, 0.75)(k) (1 - C(k, 8) / C(160, 8))^400 = 3.2e-7. Both are less the more alike two sets
are. Candidates whose
signatures agree up to six deviations under the threshold are confirmed on the full sets with integer arithmetic.

Results for odd rows: null, empty and blank texts have an empty set, are linked with nothing and are their own
component. Rows without an id belong to their text's component; if no row of a component has an id, it is null.
Repeated rows stay repeated. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import in_small_batches, reliable
from . import words
from .labelled import text_key


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 75  # link when 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 4
    crowded: int = 16  # components of a bucket whose members are compared without counting their shingles
    rare: int = 10  # a shingle of as many of the crowded members pairs them all
    tile: int = 1024  # members of a bucket that meet in one step of a task
    tiled: int = 1 << 15  # members of a bucket that are compared tile by tile, not by long bands
    long_bands: int = 400
    long_rows: int = 8
    seed: int = 8


DEFAULT = Params()
PROFILE = "doc_id long, text_key binary, n_shingles long, set_key binary, signature binary, bands array<long>"


def shingle_sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """The distinct shingle hashes of each text, sorted; lists of a slice of rows at a time."""
    for s in words.slices(column):
        grams, begins = words.windows(s.hashes(), s.word_offsets, k, seed=5)
        yield [np.unique(grams[a:b]) for a, b in zip(begins[:-1], begins[1:])]


def _minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of minima per non-empty set: for each function, the least of a * x + b modulo 2^32."""
    begins = np.concatenate([[0], np.cumsum([len(x) for x in sets])])[:-1]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(a), len(sets)), np.uint32)
    hashed = np.empty_like(x)
    for j in range(len(a)):
        np.multiply(x, a[j], out=hashed)
        hashed += b[j]
        np.minimum.reduceat(hashed, begins, out=out[j])
    return np.ascontiguousarray(out.T)


def _profile(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(p.seed)
        n = p.bands * p.rows
        a = random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = random.integers(0, 1 << 32, n, dtype=np.uint32)
        fold = random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text"), p.shingle):
                full = [i for i, x in enumerate(sets) if len(x)]
                signature, bands = [None] * len(sets), [None] * len(sets)
                if full:
                    low = _minima([sets[i] for i in full], a, b)
                    folded = words.mix((low * fold).reshape(len(full), p.bands, p.rows).sum(axis=2, dtype=np.uint64)
                                       + np.arange(p.bands, dtype=np.uint64)).view(np.int64)
                    for row, i in enumerate(full):
                        signature[i] = (low[row] >> np.uint32(4)).astype(np.uint8).tobytes()
                        bands[i] = folded[row]
                keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                part = batch.slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "signature", "bands"])

    return run


def _least(p: Params) -> int:
    """Places in which the signatures of a link agree: the threshold less six standard deviations."""
    n, share = p.bands * p.rows, p.percent / 100
    return int(n * share - 6 * (n * share * (1 - share)) ** 0.5)


def _agreement(p: Params):
    """Pairs whose signatures agree in as many places as those of a link."""
    n, least = p.bands * p.rows, _least(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in ("sig_a", "sig_b"))
            keep = (left == right).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(p: Params):
    """Pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, at = [], 0
            step = 64
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                left, right = ([x for xs in shingle_sets(part.column(c), p.shingle) for x in xs] for c in ("text_a", "text_b"))
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


MEMBER = "band long, lo int, hi int, tile int, set_key binary, root binary, size long, common long, signature binary, bands array<long>"


def _tile_pairs(p: Params):
    """Likely links between the members of a tile, or of two tiles, of one bucket; rows of a pair of tiles are neighbours.
    Members of one component are not compared, nor those with too few common shingles, nor in any but the first of the
    `bands` that both have (where these are given)."""
    least = _least(p)

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, roots = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64).reshape(-1, 2) for c in ("set_key", "root"))
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(keys), -1)
        band, lo, hi, tile, size, common = (rows.column(c).to_numpy() for c in ("band", "lo", "hi", "tile", "size", "common"))
        own = rows.column("bands").combine_chunks()
        listed = own.is_valid().to_numpy(zero_copy_only=False)
        bands = np.zeros((len(keys), p.bands), np.int64)
        bands[listed] = own.flatten().to_numpy().reshape(-1, p.bands)
        edges = np.flatnonzero((np.diff(band) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        for begin, end in zip([0, *edges], [*edges, len(keys)]):
            place = np.arange(begin, end)
            same = lo[begin] == hi[begin]
            left = place if same else place[tile[begin:end] == lo[begin]]
            right = place if same else place[tile[begin:end] == hi[begin]]
            if not len(left) or not len(right):
                continue
            meet = (roots[left, None] != roots[None, right]).any(axis=2)
            meet &= (100 + p.percent) * np.minimum(common[left, None], common[None, right]) >= p.percent * (size[left, None] + size[None, right])
            if same:
                meet = np.triu(meet, 1)
            i, j = np.nonzero(meet)
            for at in range(0, len(i), 1 << 15):
                x, y = left[i[at : at + (1 << 15)]], right[j[at : at + (1 << 15)]]
                keep = (signature[x] == signature[y]).sum(axis=1) >= least
                x, y = x[keep], y[keep]
                both = bands[x] == bands[y]
                first = ~listed[x] | (bands[x, both.argmax(axis=1)] == band[begin])
                a, b = (rows.column("set_key").take(pa.array(z[first])).combine_chunks() for z in (x, y))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("band", "lo", "hi"))))
            cut = ids.index(ids[-1])  # the last group may go on in the next batch
            if open_rows and (cut or ids[0] != tuple(open_rows[-1].column(c)[-1].as_py() for c in ("band", "lo", "hi"))):
                yield from compare(pa.Table.from_batches([*open_rows, batch.slice(0, cut)]))
                open_rows = []
            elif cut:
                yield from compare(pa.Table.from_batches([batch.slice(0, cut)]))
            open_rows.append(batch.slice(cut))
        if open_rows:
            yield from compare(pa.Table.from_batches(open_rows))

    return run


def _long_bands(p: Params):
    """The bands of a signature that join only sets alike in most of their text: bytes at places drawn once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(p.seed + 1)
        places = np.stack([random.choice(p.bands * p.rows, p.long_rows, replace=False) for _ in range(p.long_bands)])
        fold = random.integers(0, 1 << 63, p.long_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                drawn = signature[at : at + 1024][:, places].astype(np.uint64)
                folded = words.mix((drawn * fold).sum(axis=2, dtype=np.uint64) * np.uint64(p.long_bands) + np.arange(p.long_bands, dtype=np.uint64))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(folded.view(np.int64).ravel()), p.long_bands).cast(pa.list_(pa.int64()))
                kept = ["set_key", "root", "size", "common", "signature"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), bands], names=[*kept, "bands"])

    return run


def _shingles(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text"), p.shingle):
                keys = batch.column("set_key").slice(at, len(sets)).take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
                at += len(sets)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(sets).view(np.int64))], names=["set_key", "shingle"])

    return run


def _counted(many: DataFrame, sets: DataFrame, texts: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Of the sets `many` (set_key, root): the pairs (a, b) that share a rare shingle, and the sets that common shingles
    alone can link, with `size` and `common`, the number of their common ones."""
    grams = reliable(many.join(texts, "set_key").select("set_key", "text").mapInArrow(_shingles(p), "set_key binary, shingle long"))
    rare = reliable(grams.groupBy("shingle").agg(F.count("*").alias("n"), F.min("set_key").alias("only")).where(F.col("n") <= p.rare))
    shared = reliable(grams.join(rare.where("n > 1").select("shingle"), "shingle"))
    rooted = shared.join(many, "set_key").select("shingle", "set_key", "root")
    pairs = rooted.select("shingle", F.col("set_key").alias("a"), F.col("root").alias("root_a")).join(
        rooted.select("shingle", F.col("set_key").alias("b"), F.col("root").alias("root_b")), "shingle")
    pairs = pairs.where("a < b and root_a <> root_b").select("a", "b").distinct()
    # a shingle of one set alone names it, so only shared ones are joined
    own = rare.where("n = 1").select(F.col("only").alias("set_key")).union(shared.select("set_key")).groupBy("set_key").agg(F.count("*").alias("own"))
    out = many.join(sets.select("set_key", F.col("n_shingles").alias("size")), "set_key").join(own, "set_key", "left")
    out = out.withColumn("common", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")
    return pairs, reliable(out.where(100 * F.col("common") >= p.percent * F.col("size")))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of set keys that are links. `sets` has a signature per set, `texts` a text."""
    side = lambda name: sets.select(
        F.col("set_key").alias(name), F.col("signature").alias(f"sig_{name}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
    return _confirmed(reliable(likely.mapInArrow(_agreement(p), "a binary, b binary")), texts, p)


def _confirmed(likely: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of set keys whose full texts are links."""
    text = lambda name: texts.select(F.col("set_key").alias(name), F.col("text").alias(f"text_{name}"))
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    return reliable(both.mapInArrow(_confirm(p), "a binary, b binary"))


def _shared(buckets: DataFrame) -> DataFrame:
    """(band, set_key, leader, ...) of the rows of `buckets` whose band has several sets; the smallest leads."""
    several = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("set_key").alias("leader")).where("n > 1")
    return reliable(buckets.join(several.drop("n"), "band"))


def _rooted(crowd: DataFrame, found: DataFrame) -> DataFrame:
    return reliable(crowd.drop("root").join(found.select(F.col("node").alias("set_key"), "root"), "set_key", "left")
                    .withColumn("root", F.coalesce("root", "set_key")))


def _open(members: DataFrame) -> DataFrame:
    """(band, n) of the buckets that hold members of several components."""
    return reliable(members.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
                    .where("least <> most").select("band", "n"))


def _within(members: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """Likely links (a, b) inside the buckets of `sizes` (band, n)."""
    own = members.join(sizes, "band").withColumn("tiles", F.ceil(F.col("n") / p.tile).cast("int"))
    own = own.withColumn("tile", F.pmod(F.xxhash64("set_key", F.lit(1)), "tiles").cast("int"))
    # a bucket of one tile meets itself; in one pass, so that members are joined once
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = own.select("band", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "set_key",
                                      "root", "size", "common", "signature", "bands")
    dealt = dealt.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return dealt.mapInArrow(_tile_pairs(p), "a binary, b binary")


def _left(members: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Likely links (a, b) of `members` (band, set_key, root, size, common) that lie in one bucket but in different
    components."""
    sizes = _open(members)
    members = members.join(sets.select("set_key", "signature", "bands"), "set_key")
    pairs = _within(members, sizes.where(F.col("n") <= p.tiled), p)
    huge = sizes.where(F.col("n") > p.tiled).select("band")
    if not huge.isEmpty():
        # of several rows of a set those with most common shingles leave out least
        again = members.join(huge, "band", "left_semi").groupBy("set_key").agg(
            F.first("root").alias("root"), F.first("size").alias("size"), F.max("common").alias("common"), F.first("signature").alias("signature"))
        again = again.select("set_key", "root", "size", "common", "signature").mapInArrow(
            _long_bands(p), "set_key binary, root binary, size long, common long, signature binary, bands array<long>")
        again = reliable(again.select(F.explode("bands").alias("band"), "set_key", "root", "size", "common", "signature", F.lit(None).cast("array<long>").alias("bands")))
        pairs = pairs.union(_within(again, _open(again), p))
    return reliable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _enough(p: Params) -> Column:
    return (100 + p.percent) * F.least("common_a", "common_b") >= p.percent * (F.col("size_a") + F.col("size_b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge (a, b) can reach; roots themselves included.

    Large-star hangs each node's larger neighbours on its smallest one, small-star its smaller ones, until all hang on
    their roots. Each round is written to the shared folder. A hub's neighbours are only ever joined to one row, its
    minimum, which Spark can split.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stars(e: DataFrame) -> bool:
        """Whether each node hangs on one node only, on which none hangs in turn: b < a, so these are the roots."""
        hangs = e.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("b", F.lit(0), F.lit(1)))
        return hangs.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above")).where(
            "below > 1 or below = 1 and above > 0").count() == 0

    edges = reliable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not stars(edges):
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = reliable(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = reliable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@in_small_batches
def near_duplicates(docs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept; and
    text_key and group_key (null for empty sets, which are no group), with which a filter can find one row per group."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    profile = reliable(keyed.mapInArrow(_profile(p), PROFILE))
    sets = reliable(profile.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles"), F.min("text_key").alias("text_key"), F.min("signature").alias("signature"),
        F.min("bands").alias("bands")))
    # in short bands every shingle counts as common
    whole = [F.col("n_shingles").alias("size"), F.col("n_shingles").alias("common")]
    crowd = _shared(sets.select("set_key", *whole, F.explode("bands").alias("band")))
    wanted = crowd.select("set_key").distinct().join(sets.select("set_key", "text_key"), "set_key")
    texts = reliable(keyed.join(wanted, "text_key").groupBy("set_key").agg(F.first("text").alias("text")))

    star = crowd.where("set_key <> leader").select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
    links = _verified(star, sets, texts, p)
    found = components(links)

    rooted = _rooted(crowd, found)
    sizes = reliable(rooted.select("band", "root").distinct().groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    few = rooted.join(sizes.where(F.col("n") <= p.crowded).select("band"), "band")
    many = rooted.join(sizes.where(F.col("n") > p.crowded).select("band"), "band").select("band", "set_key", "root", "leader")
    rare_pairs, linkable = _counted(reliable(many.select("set_key", "root").distinct()), sets, texts, p)
    many = reliable(many.drop("root").join(linkable, "set_key"))
    centre = many.groupBy("band").agg(F.max(F.struct(2 * F.col("common") - F.col("size"), "set_key", "root", "size", "common")).alias("centre"))
    many = many.join(centre, "band")
    spokes = many.withColumnsRenamed({"root": "root_b", "size": "size_b", "common": "common_b"}).select(
        "*", *(F.col(f"centre.{c}").alias(f"{c}_a") for c in ("set_key", "root", "size", "common")))
    spokes = spokes.where("root_a <> root_b and set_key <> leader and set_key_a <> leader").where(_enough(p)).select(
        F.least("set_key_a", "set_key").alias("a"), F.greatest("set_key_a", "set_key").alias("b"))
    links = links.union(_verified(rare_pairs.union(spokes).distinct(), sets, texts, p))
    found = components(links)

    # leaders and centres have met all members of their buckets
    members = ["band", "set_key", "size", "common"]
    left = few.where("set_key <> leader").select(members).union(
        many.where("set_key <> leader and set_key <> centre.set_key").select(members))
    rest = _confirmed(_left(_rooted(left, found), sets, p), texts, p)
    if not rest.isEmpty():
        found = components(links.union(rest))

    named = sets.select("set_key", "first_id").join(found.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = named.withColumn("root", F.coalesce("root", "set_key"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select("set_key", "component_id", F.col("root").alias("group_key"))
    out = profile.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"),
                      "text_key", "group_key")
