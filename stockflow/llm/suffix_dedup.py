"""Bytes that stand in a long string met earlier, by a logarithmic family of sparse suffix arrays.

Documents are cut into batches by ranges of their id. A batch's suffixes are told apart by their first LENGTH bytes, so
its array holds one 64-bit key of those bytes per suffix, in order of the keys; equal suffixes meet there as they would
in an array ordered by letters. Only suffixes that can matter enter: in every window of LENGTH bytes the K-gram with the
least hash is its anchor, and a window whose anchor occurs nowhere else has no equal. So the anchors are indexed
first, and then the windows whose anchor occurs twice.

An index is a family of levels. The runs of the batches come in order; each is merge-scanned against every level,
which tells the keys met earlier, and becomes a new level; the last two levels are merged while they are of like
size. Keys are split into ranges, each with a family of its own, so an index has as many tasks as the data needs. A
batch sends every key once, however often it occurs. What comes back to a batch is one bit per key.
"""

from __future__ import annotations

import hashlib
import math
import sys
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import whole_text
from stockflow.llm.warc import edges
from stockflow.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, K = 100, 40
#: bytes of a batch at least, the most batches, and bytes of keys in a range of anchors and of windows
BATCH_BYTES, BATCHES, RANGE_BYTES, WINDOW_BYTES = 2 << 20, 100_000, 32 << 20, 64 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Family:
    """Levels of sorted keys; each more than twice as long as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, run: np.ndarray) -> np.ndarray:
        """Which keys of a sorted run are in a level; then the run becomes one."""
        met = np.zeros(len(run), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, run), len(level) - 1)
            met |= level[at] == run
        if len(run):
            self.levels.append(run[~met])
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = np.sort(np.concatenate([self.levels[-1], last]), kind="stable")
        self.levels = [level for level in self.levels if len(level)]
        return met


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Batch:
    """The bytes of a batch, its documents one after another, with prefix sums of a polynomial hash."""

    def __init__(self, data: bytes, sizes: np.ndarray, skip: np.ndarray, length: int):
        """skip: documents that are whole copies of earlier ones; they take no part."""
        self.length, self.n = length, len(data)
        self.ends = np.cumsum(sizes)
        raw = np.frombuffer(data, np.uint8)
        letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
        powers = np.full(self.n + 1, MULTIPLIER, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(letters[raw] * powers[: self.n], out=self.sums[1:])
        powers[1:] = pow(MULTIPLIER, -1, 1 << 64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.inverse = powers
        # starts of windows: `length` bytes of one document that takes part
        limit = np.where(skip, 0, np.maximum(sizes - length + 1, 0))
        begin = self.ends - sizes
        self.starts = np.repeat(begin - (np.cumsum(limit) - limit), limit) + np.arange(limit.sum())

    def hashes(self, at: np.ndarray | slice, size: int) -> np.ndarray:
        if isinstance(at, slice):
            n = max(self.n - size + 1, 0)
            return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])
        return mix((self.sums[at + size] - self.sums[at]) * self.inverse[at])

    def anchors(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows in runs of one anchor: its key by run, and how many windows the run has."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams, window = self.hashes(slice(None), k), self.length - k + 1
        least = sliding(np.minimum, grams, window, LAST)[self.starts]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)
        at = np.flatnonzero(new)
        return least[at], np.diff(at, append=len(least))

    def repeated(self, by_run: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
        """Keys of anchors that stand at two places or more of the batch, sorted.

        A place is an anchor if its gram is the least of a window that holds it, so if the greatest of those windows'
        least grams is its own.
        """
        grams, window = self.hashes(slice(None), k), self.length - k + 1
        least = np.zeros(len(grams) + window - 1, np.uint64)
        least[self.starts + window - 1] = np.repeat(by_run, lengths)
        places = grams[sliding(np.maximum, least, window, np.uint64(0))[: len(grams)] == grams]
        keys, counts = np.unique(places, return_counts=True)
        return keys[counts > 1]


def sliding(pick: np.ufunc, values: np.ndarray, window: int, outer: np.uint64) -> np.ndarray:
    """pick (minimum or maximum) over every `window` neighbours, by blocks from both ends; the end is filled up."""
    padded = np.full((-(-len(values) // window) + 1) * window, outer)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, window)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: len(values)], ahead[window - 1 : window - 1 + len(values)])


def split(keys: np.ndarray, ranges: int) -> list[np.ndarray]:
    """Sorted keys by range."""
    at = np.searchsorted(keys, [np.uint64((r << 64) // ranges) for r in range(1, ranges)])
    return np.split(keys, at)


def joined(masks, keys: np.ndarray, ranges: int) -> np.ndarray:
    """The bits that came back, in order of the sorted keys."""
    out = np.zeros(len(keys), bool)
    at = np.cumsum([0, *(len(p) for p in split(keys, ranges))])
    for mask in masks or ():
        r = mask["range"]
        out[at[r] : at[r + 1]] = np.unpackbits(np.frombuffer(mask["bits"], np.uint8), count=at[r + 1] - at[r])
    return out


class Work:
    """What a batch knows in each pass."""

    def __init__(self, row: dict, length: int, k: int, ranges: int, window_ranges: int):
        sizes = np.array(row["sizes"], np.int64)
        known, skip = {bytes(d) for d in row["copies"] or ()}, np.zeros(len(sizes), bool)
        for i, digest in enumerate(row["digests"]):
            skip[i] = digest in known
            known.add(digest)
        self.copies = skip
        self.batch = Batch(row["data"], sizes, skip, length)
        self.ranges, self.window_ranges = ranges, window_ranges
        self.by_run, self.lengths = self.batch.anchors(k)
        self.anchor_keys, self.run_of = np.unique(self.by_run, return_inverse=True)
        self.k = k

    def windows(self, masks) -> None:
        """Windows whose anchor occurs elsewhere: their keys, in order, and for each window its key and whether it is the
        first of the batch with it."""
        twice = self.batch.repeated(self.by_run, self.lengths, self.k)
        again = np.isin(self.anchor_keys, twice, assume_unique=True) | joined(masks, self.anchor_keys, self.ranges)
        self.at = self.batch.starts[np.repeat(again[self.run_of], self.lengths)]
        self.keys, first, self.key_of = np.unique(self.batch.hashes(self.at, self.batch.length), return_index=True, return_inverse=True)
        self.first = np.zeros(len(self.at), bool)
        self.first[first] = True

    def removed(self, masks) -> np.ndarray:
        """By byte, whether it goes."""
        earlier = joined(masks, self.keys, self.window_ranges)
        hit = self.at[~self.first | earlier[self.key_of]]
        edge = np.zeros(self.batch.n + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.batch.length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i in np.flatnonzero(self.copies).tolist():
            end = self.batch.ends[i]
            size = end - (self.batch.ends[i - 1] if i else 0)
            if size >= self.batch.length:
                gone[end - size : end] = True
        return gone


def batches(docs: DataFrame, id: str, text: str) -> tuple[str, int, int]:
    """A table of batches, bucketed by batch so that later joins need not move it; its name, bytes and buckets."""
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.encode(whole_text(text), "utf-8").alias("raw"))
    sizes = cut(rows.select("id", (F.octet_length("raw") + 1).cast("long").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    low = np.array(edges(sizes.filter("id is not null"), "id", "size", max(BATCH_BYTES, total // BATCHES))[1:], np.int64)
    shared = spark.sparkContext.broadcast(low)  # 8 bytes per batch

    def place(parts):
        for part in parts:
            ids = pa.compute.fill_null(part.column("id").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            batch = np.searchsorted(shared.value, ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(batch), part.column("id"), part.column("raw")], names=["batch", "id", "raw"])

    def pack(group: pa.Table) -> pa.Table:
        ids, raw = group.column("id").to_pylist(), group.column("raw").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, raw[i]))
        texts = [raw[i] for i in order]
        return pa.Table.from_pylist([{
            "batch": group.column("batch")[0].as_py(), "ids": [ids[i] for i in order], "sizes": [len(t) for t in texts],
            "digests": [hashlib.blake2b(t, digest_size=16).digest() for t in texts], "data": b"".join(texts),
        }], schema=pa.schema([
            ("batch", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
            ("digests", pa.list_(pa.binary())), ("data", pa.binary()),
        ]))

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((len(low) + 1) / 100))
    packed = rows.mapInArrow(place, f"batch int, id {kind}, raw binary").repartition(buckets, "batch").groupBy("batch").applyInArrow(
        pack, "batch int, ids array<bigint>, sizes array<bigint>, digests array<binary>, data binary"
    )
    name = f"suffix_batches_{uuid.uuid4().hex}"
    packed.write.option("compression", "zstd").bucketBy(buckets, "batch").saveAsTable(name)
    return name, total, buckets


def index(runs: DataFrame, both_ways: bool) -> DataFrame:
    """Per batch the bits of its keys, by range: met in an earlier batch, or with `both_ways` in any other one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("batch")
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        family = Family()
        met = [family.add(k) for k in keys]
        if both_ways:
            family = Family()
            met = [a | b for a, b in zip(met, [family.add(k) for k in reversed(keys)][::-1])]
        return pd.DataFrame({"batch": group["batch"], "range": group["range"], "bits": [np.packbits(m).tobytes() for m in met]})

    bits = runs.groupBy("range").applyInPandas(run, "batch int, range int, bits binary")
    return cut(bits.groupBy("batch").agg(F.collect_list(F.struct("range", "bits")).alias("masks")))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, digest: bool = False) -> DataFrame:
    """Per row: id, n_bytes, spans (array of removed (start, end) in bytes) and kept, the bytes that are left; with
    `digest` n_removed, n_spans and kept_sha256 in place of spans and kept.

    A byte goes if it lies in a string of `length` bytes that also starts earlier, in a document with a smaller id or
    further up in the same one; strings overlap freely and are judged on the input. Strings do not cross documents. A
    null text counts as empty. Ids are integers; rows with a null id come first, rows that repeat an id follow each
    other in order of their texts. Every row comes back; other columns are left out. Keys are 64-bit hashes.
    """
    spark = docs.sparkSession
    name, total, buckets = batches(docs, id, text)
    # anchors take a quarter of the bytes
    ranges = max(buckets, math.ceil(total / 4 / RANGE_BYTES))
    # where everything is repeated, every byte starts a window with a key of its own
    window_ranges = max(buckets, math.ceil(total * 8 / WINDOW_BYTES))
    table = spark.table(name)
    digests = table.select("batch", F.explode(F.arrays_zip("digests", "sizes")).alias("d")).select("batch", "d.digests", "d.sizes").filter(F.col("sizes") > 0)
    digests = digests.groupBy("digests", "batch").agg(F.count(F.lit(1)).alias("_n"))
    first = digests.groupBy("digests").agg(F.min("batch").alias("low"), F.max("batch").alias("high")).filter("low < high")
    copies = cut(digests.join(first.select("digests", "low"), "digests").filter("batch > low").groupBy("batch").agg(F.collect_list("digests").alias("copies")))
    schema = "range int, batch int, keys binary"

    def with_side(left: DataFrame, side: DataFrame) -> DataFrame:
        # the side is small by batch; the batches stay where their buckets are
        return left.join(side.hint("shuffle_hash"), "batch", "left")

    def emit(batch: int, keys: np.ndarray, ranges: int) -> pa.RecordBatch:
        parts = [(r, p) for r, p in enumerate(split(keys, ranges)) if len(p)]
        return pa.RecordBatch.from_arrays([
            pa.array([r for r, _ in parts], pa.int32()), pa.array([batch] * len(parts), pa.int32()),
            pa.array([p.tobytes() for _, p in parts], pa.binary()),
        ], names=["range", "batch", "keys"])

    def each(parts):
        for part in parts:
            for i in range(len(part)):
                yield {c: part.column(c)[i].as_py() for c in part.schema.names}

    def anchors(parts):
        for row in each(parts):
            yield emit(row["batch"], Work(row, length, k, ranges, window_ranges).anchor_keys, ranges)

    def windows(parts):
        for row in each(parts):
            work = Work(row, length, k, ranges, window_ranges)
            work.windows(row["anchors"])
            yield emit(row["batch"], work.keys, window_ranges)

    def results(parts):
        for row in each(parts):
            work = Work(row, length, k, ranges, window_ranges)
            work.windows(row["anchors"])
            gone = work.removed(row["windows"])
            raw, out, at = np.frombuffer(row["data"], np.uint8), [], 0
            for key, size in zip(row["ids"], row["sizes"]):
                own = gone[at : at + size]
                turns = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                left = raw[at : at + size][~own].tobytes()
                at += size
                if digest:
                    out.append((key, size, int(own.sum()), len(turns) // 2, hashlib.sha256(left).hexdigest()))
                else:
                    out.append((key, size, [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)], left))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] if digest else [pa.int64(), pa.int64(), span, pa.binary()]
    names = [id, "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else [id, "n_bytes", "spans", "kept"]
    types = ["bigint"] * 4 + ["string"] if digest else ["bigint", "bigint", "array<struct<start: bigint, end: bigint>>", "binary"]

    base = with_side(table, copies)
    met = index(base.mapInArrow(anchors, schema), both_ways=True).withColumnRenamed("masks", "anchors")
    known = with_side(base, met)
    earlier = index(known.mapInArrow(windows, schema), both_ways=False).withColumnRenamed("masks", "windows")
    done = cut(with_side(known, earlier).mapInArrow(results, ", ".join(f"`{n}` {t}" for n, t in zip(names, types))))
    spark.sql(f"drop table {name}")
    return done
