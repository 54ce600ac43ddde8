"""A Merkle manifest of a dataset whose parents retain SHA-256 states.

Every row is a leaf. Leaves of one source ascend by doc_id; runs of `fan` nodes become parents until one node, the
subroot of the source, is left; the subroots, ordered by source, become the root in the same way. A parent hashes its
children one after another and retains a copy of the hash state before each child slot. To fold a changed child, the
matching state is resumed with the replacement and the siblings to its right only; what lies left is never hashed again.

Trees are built in blocks of `fan ** levels` neighbouring nodes, the largest group that any task ever holds: a block
yields its top node, and the tops are blocks again. Going back down, each block is handed one path, the siblings above
it, and from the path the states before its slots; all its leaves are then folded to the root at once. So no task sees
a whole source, and the work per leaf is the same in small and large sources.

Positions within a source come from a sort by range over all rows and the numbers of rows before each range, so one
source with a third of the rows is spread as evenly as many small ones. Only digests are shuffled, never texts.

Results for odd rows: a null in any column is hashed as `-`, apart from every value; null sources make a source of their
own, before all others. Null doc_ids come first; rows with equal source and doc_id follow each other in the order of
their leaves, and equal leaves are interchangeable. Each row has a result. A single row is its own root, with the
digest of nothing as its proof. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import discard, reliable

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    fan: int = 16
    levels: int = 2  # levels that one task builds at once

    @property
    def block(self) -> int:
        return self.fan**self.levels


DEFAULT = Params()


class Parent:
    """Children in a run, with the hash state before each of them."""

    def __init__(self, children: list[bytes]):
        self.states, self.right, h = [], [], sha256()
        for child in children:
            self.states.append(h.copy())
            h.update(child)
        self.digest = h.hexdigest().encode()
        whole, size = b"".join(children), len(children[0])
        self.right = [whole[size * (i + 1) :] for i in range(len(children))]
        self.others = [whole[: size * i] + whole[size * (i + 1) :] for i in range(len(children))]

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in `slot`."""
        h = self.states[slot].copy()
        h.update(child)
        h.update(self.right[slot])
        return h.hexdigest().encode()


class Above:
    """One step of a path above a block: the state before its slot and the siblings right of it."""

    def __init__(self, left: bytes, right: bytes):
        self.state, self.right, self.others = sha256(left), right, left + right

    def fold(self, child: bytes) -> bytes:
        h = self.state.copy()
        h.update(child)
        h.update(self.right)
        return h.hexdigest().encode()


def parents(nodes: list[bytes], size: int, p: Params) -> list[list[Parent]]:
    """The levels of parents over a block of a tree that has `size` nodes at the block's level: none where it ends."""
    out: list[list[Parent]] = []
    for _ in range(p.levels):
        if size <= 1:
            break
        out.append([Parent(nodes[i : i + p.fan]) for i in range(0, len(nodes), p.fan)])
        nodes, size = [x.digest for x in out[-1]], -(-size // p.fan)
    return out


def without_capitals(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def leaf(*values: Column) -> Column:
    """The digest of some values, each with its length in bytes, so that no two rows of values read alike."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, values)), 256)


def numbered(rows: DataFrame, order: Iterable[Column]) -> DataFrame:
    """`rows` (stored, with a `tree`), stored with the `place` of each in its tree's order and the tree's `size`."""
    order = [F.col("tree"), *order, F.col("_tie")]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    placed = reliable(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    # one row per range and tree in it: about as many as there are ranges and trees
    runs = placed.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                       F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    out = reliable(placed.join(runs, ["tree", "_range"]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
                   .drop("_range", "_first", "_before", "_at"))
    discard(placed)
    return out


NODE = "tree string, place long, size long, digest string"
PATH = "tree string, place long, subroot string, path array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _nodes(block: pa.Table) -> tuple[list[int], list[bytes]]:
    order = block.column("place").combine_chunks().to_pylist()
    digests = block.column("digest").to_pylist()
    rank = sorted(range(len(order)), key=order.__getitem__)
    return rank, [digests[i].encode() for i in rank]


def _top(p: Params) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        _, nodes = _nodes(block)
        size = block.column("size")[0].as_py()
        levels = parents(nodes, size, p)
        top = levels[-1][0].digest if levels else nodes[0]
        return pa.table({"tree": block.column("tree").slice(0, 1), "place": [block.column("place")[0].as_py() // p.block],
                         "size": [max(1, -(-size // p.block))], "digest": [top.decode()]})

    return run


def _down(p: Params) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The path of every node of a block, given the block's own."""
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        rank, nodes = _nodes(block)
        levels = parents(nodes, block.column("size")[0].as_py(), p)
        rest = above.column("path")[0].as_py()
        paths = []
        for i in range(len(nodes)):
            path, at = [], i
            for level in levels:
                at, slot = divmod(at, p.fan)
                cut = 64 * slot
                others = level[at].others[slot].decode()
                path.append({"left": others[:cut], "right": others[cut:]})
            paths.append(path + rest)
        return pa.table({"tree": block.column("tree"), "place": block.column("place").take(pa.array(rank)),
                         "subroot": pa.array([above.column("subroot")[0].as_py()] * len(nodes), pa.string()), "path": pa.array(paths, _PATH)})

    return run


def _fold(p: Params) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Every leaf of a block folded to the root, with what it is in the replay."""
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        rank, nodes = _nodes(block)
        levels = parents(nodes, block.column("size")[0].as_py(), p)
        steps = [Above(s["left"].encode(), s["right"].encode()) for s in above.column("path")[0].as_py()]
        higher = b"".join(s.others for s in steps)
        replayed = block.column("replayed").to_pylist()
        proofs, roots = [], []
        for i, row in enumerate(rank):
            value = replayed[row].encode() if replayed[row] else nodes[i]
            proof, at = sha256(), i
            for level in levels:
                at, slot = divmod(at, p.fan)
                proof.update(level[at].others[slot])
                value = level[at].fold(slot, value)
            proof.update(higher)
            for step in steps:
                value = step.fold(value)
            proofs.append(proof.hexdigest())
            roots.append(value.decode())
        order = pa.array(rank)
        return pa.table({"doc_id": block.column("doc_id").take(order), "leaf": block.column("digest").take(order),
                         "subroot": pa.array([above.column("subroot")[0].as_py()] * len(nodes), pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})

    return run


def _blocks(nodes: DataFrame, p: Params) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / p.block))


class Trees:
    """The stored nodes of some trees, one table per `levels` levels; the last tables hold the tops of the tallest."""

    def __init__(self, leaves: DataFrame, p: Params):
        self.p, self.stages = p, [leaves]
        todo = leaves
        while True:
            todo = reliable(_blocks(todo.select("tree", "place", "size", "digest"), p).groupBy("tree", "block").applyInArrow(_top(p), NODE))
            self.stages.append(todo)
            if (todo.agg(F.max("size")).first()[0] or 1) <= 1:
                break
            todo = todo.where("size > 1")

    def tops(self) -> DataFrame:
        """(tree, digest): the root of every tree."""
        out = self.stages[1]
        for stage in self.stages[2:]:
            out = out.unionByName(stage)
        return out.where("size = 1").select("tree", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """The path of every block of leaves (tree, place), given those of the trees (tree, subroot, path)."""
        out = None
        for stage in reversed(self.stages[1:]):
            ended = stage.where("size = 1").join(above, "tree").select("tree", "place", "subroot", "path")
            if out is None:
                out = ended
            else:
                out = self.under(stage.where("size > 1"), out, _down(self.p), PATH).unionByName(ended)
            out = reliable(out)
        return out

    def under(self, nodes: DataFrame, above: DataFrame, what: Callable, form: str) -> DataFrame:
        """`what` of every block of `nodes` with the path of the block."""
        blocks = _blocks(nodes, self.p).groupBy("tree", "block")
        return blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(what, form)

    def discard(self) -> None:
        for stage in self.stages:
            discard(stage)


def manifest(docs: DataFrame, replayed: Column, p: Params = DEFAULT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `replayed` is the text as some other reader finds it; `folded_root` is the root that follows from that text and the
    leaf's original siblings, and `verified` tells whether it is the root."""
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    same = replayed.eqNullSafe(text)
    # a null source is the empty tree name and comes first, others keep their order
    leaves = reliable(docs.select(
        F.col("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"), leaf(*named, text).alias("digest"),
        F.when(~same, leaf(*named, replayed)).alias("replayed")))
    placed = numbered(leaves, [F.col("doc_id"), F.col("digest")])
    discard(leaves)
    sources = Trees(placed, p)

    subroots = reliable(sources.tops().select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"))
    whole = Trees(numbered(subroots, [F.col("source")]), p)
    top = whole.tops().first()
    root = top["digest"] if top else None
    ends = whole.paths(whole.tops().select("tree", F.col("digest").alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("path")))
    above = reliable(whole.under(whole.stages[0], ends, _down(p), PATH).join(
        whole.stages[0].select("place", "source", F.col("digest").alias("own")), "place").select(F.col("source").alias("tree"), F.col("own").alias("subroot"), "path"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    folded = sources.under(placed, sources.paths(above), _fold(p), f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return folded.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.lit(root)).alias("verified"))
