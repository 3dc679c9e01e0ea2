"""Prefix trie of conversations from padded matrices of turn ids.

Every conversation is a row of turn ids: 127 bits of hashes of place, role and text, so that the XOR of the ids of a
prefix names the prefix. Rows are cut into panels of WIDTH turns, so a conversation of any length is many short rows;
a panel carries the name of all turns before it. Panels are range-partitioned by (panel, name before it, ids,
conversation): the rows of one node lie next to each other, and many equal conversations spread over many shards.

Inside a shard numpy does the work: ids are padded to a matrix, lexsort orders its rows, the masks of changes from row
to row are OR-accumulated along the columns and mark where a node starts at each depth, and reduceat adds up every depth.
Nodes that hold the first or the last row of a shard may go on in the next one: their pieces are put together
afterwards, in the order of the shards, as a stream. What does not touch a border is done.

Sums over subtrees need no walk of the tree. Each node belongs to its smallest conversation, which then owns all its later nodes
as well. A node's subtree sum is the sum, over its members, of all that each of them owns, less what its own
conversation owns above it. So one more pass over the same matrices, and one running sum, give it at any depth.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.split_windows import Stretches, row_numbers
from stockflow.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: turns in one row of a matrix
WIDTH = 32
#: rows of a shard, about
SHARD_ROWS = 100_000
#: turns of an earlier conversation that a rebuilt one may start with, at most
HEAD = 5
#: conversations of one hundred share the first turns of its first one
FAMILY = 100
#: conversation ids in one line of a node's ends
CHUNK = 500
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "k1", "k2"]


def before(df: DataFrame, keys: list[str], order: list[str], states: dict[str, tuple[str, Callable]]) -> DataFrame:
    """Add, per key, what the rows before come to, {name: (column, sum or bit_xor)}; 0 where there are none."""
    cuts = Stretches(df, keys, order)
    rows = cuts.inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cuts.rows.withColumns({f"_l_{n}": f(c).over(rows) for n, (c, f) in states.items()})
    joined = cuts.carry(local, {f"_c_{n}": (f(c), f) for n, (c, f) in states.items()})
    both = lambda n, f: (
        lambda a, b: (a + b if f is F.sum else a.bitwiseXOR(b)).cast("long").alias(n)
    )(F.coalesce(f"_l_{n}", F.lit(0)), F.coalesce(f"_c_{n}", F.lit(0)))
    return joined.select(*df.columns, *[both(n, f) for n, (_, f) in states.items()])


def ordered(conversations: DataFrame) -> DataFrame:
    """Per turn its number in the conversation, from 0: by turn, null first, then role, then the MD5 of the text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    slim = cut(conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), F.md5(F.encode(text, "utf-8")).alias("_text"),
        F.char_length(text).alias("chars"),
    ))
    return row_numbers(slim, ["conv_id"], ["_turn", "_role", "_text"], "_i").select("conv_id", "_i", "_role", "_text", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: per turn its place, and per conversation its length.

    The first h turns are those of the first conversation of its hundred, h = crc32(conv_id) % 6; its own follow from
    the h-th on. Only the first HEAD turns of a conversation travel; of the others only the place changes.
    """
    turns = cut(turns)
    turn = F.when(F.col("_i") < HEAD, F.struct("_i", "_role", "_text", "chars"))
    heads = cut(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_head"), (F.max("_i") + 1).alias("_own")))
    first = heads.select(F.col("conv_id").alias("_base"), F.col("_head").alias("_first"))
    joined = heads.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_base"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    lent = F.coalesce(F.slice("_first", F.lit(1), h), F.slice("_head", 1, 0))
    whole = cut(joined.select(
        "conv_id", F.concat(lent, F.slice("_head", h + 1, F.lit(HEAD))).alias("_turns"), (F.size(lent) - h).alias("_shift"),
        (F.size(lent) + F.greatest(F.col("_own") - h, F.lit(0))).alias("length"),
    ))
    near = whole.select("conv_id", "length", F.posexplode("_turns").alias("place", "t")).select(
        "conv_id", "length", F.col("place").cast("long").alias("place"), "t._role", "t._text", "t.chars"
    )
    far = turns.filter(F.col("_i") >= HEAD).join(whole.select("conv_id", "_shift", "length"), "conv_id").select(
        "conv_id", "length", (F.col("_i") + F.col("_shift")).alias("place"), "_role", "_text", "chars"
    )
    return near.unionByName(far), whole.select("conv_id", "length")


def panels(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows of at most WIDTH turns: ids, two numbers a turn, characters, and p1, p2, the name of the turns before."""
    name = lambda seed: F.xxhash64(F.lit(seed), "place", "_role", "_text")
    named = turns.select(
        "conv_id", "length", F.floor(F.col("place") / WIDTH).alias("panel"), "place", "chars",
        # not negative: what is padded comes first, as a shorter array does
        name(1).bitwiseAND(F.lit(2 ** 63 - 1)).alias("k1"), name(2).alias("k2"),
    )
    listed = named.groupBy("conv_id", "panel").agg(
        F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("place", "k1", "k2", "chars"))).alias("t"),
        F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"),
    )
    prefixed = before(cut(listed), ["conv_id"], ["panel"], {"p1": ("x1", F.bit_xor), "p2": ("x2", F.bit_xor)})
    rows = prefixed.select(
        "conv_id", "length", "panel", "p1", "p2", F.flatten(F.transform("t", lambda t: F.array(t.k1, t.k2))).alias("ids"),
        F.transform("t", lambda t: t.chars).alias("chars"),
    )
    zero = F.lit(0).cast("long")
    nothing = conversations.filter("length = 0").select(
        "conv_id", "length", zero.alias("panel"), zero.alias("p1"), zero.alias("p2"),
        F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<int>").alias("chars"),
    )
    return rows.unionByName(nothing)


class Matrix:
    """The panels of one shard in order, padded; `start` marks the rows at which a node of that column starts."""

    def __init__(self, rows: pa.Table):
        numbers = lambda c: rows.column(c).to_numpy().astype(np.int64)
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n, size = len(rows), pa.compute.list_value_length(rows.column("chars")).to_numpy().astype(np.int64)
        width = int(size.max())
        row, column = np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids, chars = np.full((n, width, 2), -1, np.int64), np.zeros((n, width), np.int64)
        ids[row, column], chars[row, column] = flat("ids").reshape(-1, 2), flat("chars")
        conv, panel, p1, p2 = (numbers(c) for c in ("conv_id", "panel", "p1", "p2"))
        keys = [conv, *[ids[:, j, k] for j in range(width - 1, -1, -1) for k in (1, 0)], p2, p1, panel]
        order = self.order = np.lexsort(keys)
        self.conv, self.panel, self.p1, self.p2, self.size = (a[order] for a in (conv, panel, p1, p2, size))
        self.length, self.chars, ids = numbers("length")[order], chars[order], ids[order]
        head = np.stack([self.panel, self.p1, self.p2], axis=1)
        changed = np.concatenate([(head[1:] != head[:-1]).any(axis=1)[:, None], (ids[1:] != ids[:-1]).any(axis=2)], axis=1)
        self.start = np.concatenate([np.ones((1, width), bool), np.logical_or.accumulate(changed, axis=1)[:, 1:]])
        name = lambda k, p: np.concatenate([p[:, None], p[:, None] ^ np.bitwise_xor.accumulate(np.where(ids[:, :, k] == -1, 0, ids[:, :, k]), axis=1)], axis=1)
        # past the end of a row names mean nothing and are not read
        self.k1, self.k2, self.width, self.n = name(0, self.p1), name(1, self.p2), width, n

    def segments(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per depth in the panel, the rows that reach it and the places among them where nodes start; 0 is the root."""
        top = np.flatnonzero(self.panel == 0)
        if len(top):
            yield 0, top, np.zeros(1, np.int64)
        for j in range(self.width):
            rows = np.flatnonzero(self.size > j)
            yield j + 1, rows, np.flatnonzero(self.start[rows, j])


def ids_of(rows: np.ndarray) -> bytes:
    return ",".join(map(str, rows.tolist())).encode()


NODES = "depth long, k1 long, k2 long, up1 long, up2 long, conv_id long, n_convs long, chars long, ends string"
PIECES = f"{NODES}, whole boolean, shard int, seq int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard. Of a node at a border, `ends` are ids, in as many lines as needed, else their digest."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    m, shard = Matrix(pa.Table.from_batches(batches)), TaskContext.get().partitionId()
    for depth, rows, starts in m.segments():
        first = rows[starts]
        stop = np.append(starts[1:], len(rows))
        level = m.panel[first] * WIDTH + depth
        ends_here = m.length[rows] == m.panel[rows] * WIDTH + depth
        ending, ended = np.add.reduceat(ends_here.astype(np.int64), starts), m.conv[rows[ends_here]]
        whole = (first != 0) & (rows[stop - 1] != m.n - 1) & (depth > 0)
        out = {
            "depth": level, "k1": m.k1[first, depth], "k2": m.k2[first, depth],
            "up1": m.k1[first, max(depth - 1, 0)], "up2": m.k2[first, max(depth - 1, 0)],
            "conv_id": np.minimum.reduceat(m.conv[rows], starts), "n_convs": stop - starts,
            "chars": m.chars[first, depth - 1] if depth else np.zeros(len(first), np.int64),
        }
        ends, source, seq = [], [], []
        for i, (last, count, done) in enumerate(zip(np.cumsum(ending).tolist(), ending.tolist(), whole.tolist())):
            mine = ended[last - count:last]
            lines = [hashlib.sha256(ids_of(mine)).hexdigest() if count else EMPTY] if done else (
                [ids_of(mine[k:k + CHUNK]).decode() for k in range(0, count, CHUNK)] or [""]
            )
            ends += lines
            source += [i] * len(lines)
            seq += range(len(lines))
        source, seq = np.array(source, np.int64), np.array(seq, np.int32)
        columns = {c: v[source] for c, v in out.items()}
        columns["n_convs"] = np.where(seq == 0, columns["n_convs"], 0)
        yield pa.RecordBatch.from_pydict({
            **columns, "ends": pa.array(ends, pa.string()), "whole": whole[source],
            "shard": np.full(len(source), shard, np.int32), "seq": seq,
        })


def _recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node, shard and line: each node once, its ends digested as they pass."""
    node, digest, some = None, None, False
    for batch in batches:
        done = []
        for piece in batch.to_pylist():
            key = (piece["depth"], piece["k1"], piece["k2"])
            if node is None or key != (node["depth"], node["k1"], node["k2"]):
                if node:
                    done.append({**node, "ends": digest.hexdigest()})
                node, digest, some = {**piece, "n_convs": 0}, hashlib.sha256(), False
            node["n_convs"] += piece["n_convs"]
            node["conv_id"] = min(node["conv_id"], piece["conv_id"])
            if piece["ends"]:
                digest.update((b"," if some else b"") + piece["ends"].encode())
                some = True
        if done:
            yield _node_batch(done)
    if node:
        yield _node_batch([{**node, "ends": digest.hexdigest()}])


def _node_batch(nodes: list[dict]) -> pa.RecordBatch:
    names = [c.split()[0] for c in NODES.split(", ")]
    return pa.RecordBatch.from_pydict({c: [n[c] for n in nodes] for c in names})


def _member_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node and batch, the sum over its members of what each owns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        m = Matrix(rows)
        saved, leaves = (rows.column(c).to_numpy().astype(np.int64)[m.order] for c in ("owned_saved", "owned_leaves"))
        for depth, at, starts in m.segments():
            first = at[starts]
            yield pa.RecordBatch.from_pydict({
                "depth": m.panel[first] * WIDTH + depth, "k1": m.k1[first, depth], "k2": m.k2[first, depth],
                "saved": np.add.reduceat(saved[at], starts), "leaves": np.add.reduceat(leaves[at], starts),
            })


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of the panels: depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = cut(rows)
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))
    dealt = rows.repartitionByRange(shards, "panel", "p1", "p2", "ids", "conv_id")
    pieces = cut(dealt.mapInArrow(_pieces, PIECES))
    border = pieces.filter("not whole").repartition(*KEY).sortWithinPartitions(*KEY, "shard", "seq").mapInArrow(_recombined, NODES)
    nodes = cut(pieces.filter("whole").drop("whole", "shard", "seq").unionByName(border))

    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    counted = cut(nodes.join(children, KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")), "_saved": (F.col("n_convs") - 1) * F.col("chars"),
    }))
    owned = cut(counted.groupBy("conv_id").agg(F.sum("_saved").alias("owned_saved"), F.count_if(F.col("n_children") == 0).alias("owned_leaves")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("owned_saved", "owned_leaves")}
    sums = rows.join(owned, "conv_id", "left").withColumns(zero).mapInArrow(
        _member_sums, "depth long, k1 long, k2 long, saved long, leaves long"
    ).groupBy(*KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    above = before(counted, ["conv_id"], ["depth"], {"_above": ("_saved", F.sum)})
    parents = counted.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("_d"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    at = (F.col("depth") - 1 == F.col("_d")) & (F.col("up1") == F.col("_k1")) & (F.col("up2") == F.col("_k2"))
    return above.join(sums, KEY).join(parents, at, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("_above")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def build(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; columns as in trie().

    Role and text count as empty where null, a null turn comes first, and turns of the same number go by role, then by
    the MD5 of their text. Rows that repeat are turns of their own. Rows without a conv_id belong to no conversation and
    are left out. An empty table has no nodes, not even a root. Other columns count for nothing.
    """
    turns, conversations = rebuilt(ordered(conversations))
    return trie(panels(turns, conversations))
