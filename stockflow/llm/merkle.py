"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf, every source a tree of runs of FAN, and the roots of the sources, in order, form the tree above.
A witness is what a leaf needs to be checked against the root: per level the digests left and right of it.

An Appender takes digests one after the other and keeps one open run per level. A digest that arrives gets the siblings
before it as its partial witness; each sibling that is completed later extends those of the run that are still open. A
full run closes to a subtree, which is appended to the level above in the same way. So a leaf's witness is complete
when the subtrees above it are, and levels above are held once per subtree, not per leaf.

Distributed, leaves are numbered in order (a source may hold most rows: split_windows) and dealt in aligned blocks of
BLOCK = FAN ** LEVELS, one task at a time holding one block. The roots of the blocks are appended to the next round in
the same way, until each tree is one node; then the rounds are walked back, each block passing the witness of its root on to
its nodes. A table of n rows takes log_BLOCK(n) rounds, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.split_windows import row_numbers
from stockflow.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 16
#: levels inside a block
LEVELS = 3


def digest(*parts: bytes) -> bytes:
    """Lower-case hex of the SHA-256 of the parts."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Subtree:
    """A digest with its witness in its own run, and the subtree it went into."""

    __slots__ = ("digest", "left", "right", "above")

    def __init__(self, value: bytes, left: bytes):
        self.digest, self.left, self.right, self.above = value, left, b"", None

    def witness(self) -> list[tuple[bytes, bytes]]:
        """Left and right per level, up to the root of what has been appended."""
        node, found = self, []
        while node.above is not None:
            found.append((node.left, node.right))
            node = node.above
        return found


class Appender:
    def __init__(self, fan: int = FAN):
        self.fan, self.open = fan, []

    def append(self, value: bytes, level: int = 0) -> Subtree:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        node = Subtree(value, b"".join(n.digest for n in run))
        for earlier in run:
            earlier.right += value
        run.append(node)
        if len(run) == self.fan:
            self.close(level)
        return node

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        above = self.append(digest(*[n.digest for n in run]), level + 1)
        for node in run:
            node.above = above

    def finish(self) -> tuple[bytes, int]:
        """Close the open runs while more than one node remains: the root and its level."""
        level = 0
        while len(self.open[level]) != 1 or any(self.open[level + 1:]):
            if self.open[level]:
                self.close(level)
            level += 1
        return self.open[level][0].digest, level


def raised(value: bytes, levels: int) -> bytes:
    """The digest after so many runs of its own."""
    for _ in range(levels):
        value = digest(value)
    return value


def _appended(nodes: pa.Table) -> tuple[list[Subtree], bytes, int]:
    """The nodes of one block, by position, and its root."""
    appender = Appender()
    made = [appender.append(value.encode()) for value in nodes.column("_digest").to_pylist()]
    return made, *appender.finish()


def _block_root(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("_pos")
    _, root, level = _appended(nodes)
    first = nodes.slice(0, 1)
    return pa.table({
        "_tree": first.column("_tree"), "_pos": first.column("_block"), "closed": [root.decode()],
        "aligned": [raised(root, LEVELS - level).decode()],
    })


BLOCKS = "_tree string, _pos long, closed string, aligned string"
WITNESS = "subroot string, root string, lefts array<string>, rights array<string>"


def _witnesses(nodes: pa.Table, above: pa.Table) -> tuple[pa.Table, list[list[tuple[bytes, bytes]]]]:
    """The nodes of one block by position, and their witnesses up to the root of all."""
    nodes, held = nodes.sort_by("_pos"), above.to_pylist()[0]
    made, _, level = _appended(nodes)
    alone = [] if held["_only"] else [(b"", b"")] * (LEVELS - level)
    upper = alone + [(a.encode(), b.encode()) for a, b in zip(held["lefts"], held["rights"])]
    return nodes, [node.witness() + upper for node in made]


def _passed_down(nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes, witnesses = _witnesses(nodes, above)
    return pa.table({
        "_tree": nodes.column("_tree"), "_pos": nodes.column("_pos"),
        **{c: pa.repeat(above.column(c)[0], len(nodes)) for c in ("subroot", "root")},
        "lefts": pa.array([[a.decode() for a, _ in w] for w in witnesses], pa.list_(pa.string())),
        "rights": pa.array([[b.decode() for _, b in w] for w in witnesses], pa.list_(pa.string())),
    })


def _proved(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Per leaf the digest of its witness, and the root folded from the leaf that was seen."""
    nodes, witnesses = _witnesses(nodes, above)
    proofs, folded = [], []
    for seen, witness in zip(nodes.column("_seen").to_pylist(), witnesses):
        proofs.append(digest(*[part for pair in witness for part in pair]))
        value = seen.encode()
        for left, right in witness:
            value = digest(left, value, right)
        folded.append(value)
    return pa.table({
        "_row": nodes.column("_row"), "leaf": nodes.column("_digest"),
        **{c: pa.repeat(above.column(c)[0], len(nodes)) for c in ("subroot", "root")},
        "proof_sha256": pa.array([p.decode() for p in proofs], pa.string()),
        "folded_root": pa.array([f.decode() for f in folded], pa.string()),
    })


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_pos") / FAN ** LEVELS))


def grow(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From nodes (_tree, _pos, _digest) the root of each tree, and the nodes of every round, the given ones first."""
    rounds = []
    while True:
        rounds.append(nodes)
        roots = cut(_blocked(nodes).select("_tree", "_block", "_pos", "_digest").groupBy("_tree", "_block").applyInArrow(_block_root, BLOCKS))
        counts = roots.groupBy("_tree").agg(F.max("_pos").alias("_last"))
        if not counts.filter("_last > 0").limit(1).count():
            return roots.select("_tree", F.col("closed").alias("_digest")), rounds
        # a tree of one block is finished and stays as it is; in any other all blocks have the same number of levels
        joined = roots.join(counts, "_tree")
        nodes = cut(joined.select("_tree", "_pos", F.when(F.col("_last") == 0, F.col("closed")).otherwise(F.col("aligned")).alias("_digest")))


def descend(rounds: list[DataFrame], above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the first round in blocks, and per block the witness of its root; `above` holds that of each tree.

    Per round, the only block of a tree gets the tree's own witness, and other blocks that of a node one round up.
    """
    held = above.select("_tree", F.lit(0).cast("long").alias("_pos"), "subroot", "root", "lefts", "rights")
    for i in range(len(rounds) - 1, -1, -1):
        nodes = _blocked(rounds[i])
        several = held.groupBy("_tree").agg((F.max("_pos") == 0).alias("_only"))
        held = held.join(several, "_tree").withColumnRenamed("_pos", "_block")
        if i:
            held = cut(cogrouped(nodes.select("_tree", "_block", "_pos", "_digest"), held).applyInArrow(_passed_down, f"_tree string, _pos long, {WITNESS}"))
    return nodes, held


def cogrouped(nodes: DataFrame, held: DataFrame):
    return nodes.groupBy("_tree", "_block").cogroup(held.groupBy("_tree", "_block"))


def field(value: Column) -> Column:
    """A value as it goes into a leaf: - for null, else its length in bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, values)), "utf-8"), 256)


def prove(docs: DataFrame, fields: list[str], seen: Column | None = None, id: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row: _row (id and source), leaf, subroot, root, proof_sha256 and folded_root.

    A leaf is made of the fields. folded_root is the root as it follows from the witness and the leaf `seen` (default: the row's
    own), equal to root just where that leaf is the one in the manifest. Rows go by id inside their source, a null one
    first, rows of the same id by leaf; rows that repeat each have their own place. A null source is a tree of its own and
    comes first, an empty one next. An empty table has no rows and no root. Other columns than the fields count for nothing.
    """
    own = leaf(*[F.col(c) for c in fields])
    rows = cut(docs.select(
        F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string"))).alias("_tree"),
        F.col(id).alias("_id"), F.struct(F.col(id).alias("id"), F.col(source).alias("source")).alias("_row"), own.alias("_digest"),
        (own if seen is None else seen).alias("_seen"),
    ))
    leaves = cut(row_numbers(rows, ["_tree"], ["_id", "_digest", "_seen"], "_pos"))
    subroots, rounds = grow(leaves)
    whole = cut(row_numbers(
        subroots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_source"), "_digest"), ["_tree"], ["_source"], "_pos"
    ))
    root, upper = grow(whole)
    nothing = F.array().cast("array<string>")
    top = root.select("_tree", F.lit("").alias("subroot"), F.col("_digest").alias("root"), nothing.alias("lefts"), nothing.alias("rights"))
    nodes, held = descend(upper, top)
    above = cogrouped(nodes.select("_tree", "_block", "_pos", "_digest"), held).applyInArrow(_passed_down, f"_tree string, _pos long, {WITNESS}")
    by_source = whole.select("_pos", "_source", "_digest").join(above.drop("_tree", "subroot"), "_pos")
    nodes, held = descend(rounds, cut(by_source.select(F.col("_source").alias("_tree"), F.col("_digest").alias("subroot"), "root", "lefts", "rights")))
    row = rows.schema["_row"].dataType.simpleString()
    return cogrouped(nodes.select("_tree", "_block", "_pos", "_digest", "_seen", "_row"), held).applyInArrow(
        _proved, f"_row {row}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )
