"""Near copies by BagMinHash signatures, banded, verified by exact multiset overlap, joined to classes.

Each shingle (SHINGLE words) with count w carries independent Poisson processes over the weight levels (0,1], (1,2],
(2,4], (4,8], …: rate = length of the level, each point with a register and a place inside its level; only points at
places up to w count. A register keeps its earliest point. Two texts agree in a register with the probability of their
weighted Jaccard similarity. Points come in order of time, so a process is left as soon as its next point is later
than every register of the text: about n + m·log m points for n shingles and m registers, not n·m.

Texts with equal words are one class from the start, and only its representative is compared. In a bucket of a band,
members are compared with a leader, the member met in most buckets; then only documents of different classes that hang
together through buckets remain, which are compared by whole signatures in blocks. Nothing is capped.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import slices, whole_text
from stockflow.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
#: 42 bands of 6: at similarity 0.8 all bands miss with probability 3e-6, at 0.5 half of the pairs are compared
BANDS, ROWS = 42, 6
#: documents in a tile; registers of the signatures compared there, and how far an estimate from them may lie under the
#: similarity (4 deviations)
TILE, REGISTERS, SLACK = 1024, 1024, 0.05
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x + GOLDEN).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every shingle in order, and the number of words by row.

    Words are separated by white space and lower-cased. A text of fewer words than a shingle, but some, is one shingle.
    """
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())))
    words = pc.list_flatten(parts)
    row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(words)
    values = coded.dictionary.to_numpy(zero_copy_only=False)
    known = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
    code = known[coded.indices.to_numpy(zero_copy_only=False)]
    full = values != "" if len(values) else np.zeros(0, bool)
    there = full[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, bool)
    row, code = row[there], code[there]
    counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
    last = np.cumsum(counts)[row]  # one past the row's last word
    at = np.arange(len(row))
    h = np.zeros(len(row), np.uint64)
    for k in range(size):
        inside = at + k < last
        h[inside] = mix(h[inside] ^ code[at[inside] + k])
    starts = last - counts[row]
    use = (at + size <= last) | (at == starts)
    return row[use], h[use], counts


def weighted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    return row[starts], h[starts], np.diff(starts, append=len(row))


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """The point of each register by text (rows × registers), as hashes; 0 for texts without shingles."""
    # one process per shingle and weight level: level 0 is (0, 1], level l is (2^(l-1), 2^l]
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    length = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    below = np.where(level > 0, length, 0.0)
    text, weight = row[owner], count[owner].astype(float)
    seed = mix(h[owner] ^ mix(level.astype(np.uint64)))
    time = np.zeros(len(owner))
    best = np.full(rows * registers, np.inf)
    point = np.zeros(rows * registers, np.uint64)
    step = 0
    while len(text):
        step += 1
        draw = mix(seed + np.uint64(step))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 1) / 2.0**53) / length
        other = mix(draw)
        at = text * registers + ((other >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        place = below + length * (((other & np.uint64(0xFFFFFFFF)).astype(float) + 1) / 2.0**32)
        hit = np.flatnonzero((place <= np.ceil(weight)) & (time < best[at]))
        # of several points in a register the earliest, in a tie the least hash
        order = hit[np.lexsort((other[hit], time[hit], at[hit]))]
        first = np.ones(len(order), bool)
        first[1:] = at[order[1:]] != at[order[:-1]]
        order = order[first]
        best[at[order]], point[at[order]] = time[order], other[order]
        latest = best.reshape(rows, registers).max(axis=1)
        live = time < latest[text]
        text, weight, seed, time, length, below = (x[live] for x in (text, weight, seed, time, length, below))
    return point.reshape(rows, registers)


def bands(signature: np.ndarray, count: int, size: int) -> np.ndarray:
    """A 64-bit key per band, different between bands."""
    keys = np.zeros((len(signature), count), np.uint64)
    for b in range(count):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(size):
            key = mix(key ^ signature[:, b * size + r])
        keys[:, b] = key
    return keys


def sketch(docs: DataFrame, id: str, text: str, shingle: int, count: int, size: int) -> DataFrame:
    """_id, _content (128-bit key of the lower-cased words), _bands (array, empty for texts without words)."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "text"):
            n = len(batch)
            row, h, words = shingles(batch.column("text"), shingle)
            keys = bands(signatures(*weighted(row, h), n, count * size), count, size)
            # the shingles in order give the words in order
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            np.add.at(a, row, mix(h ^ mix(place.astype(np.uint64))))
            np.add.at(b, row, mix(mix(h) ^ mix(place.astype(np.uint64) + np.uint64(1 << 40))))
            content = [f"{x:016x}{y:016x}" for x, y in zip(a.tolist(), b.tolist())]
            some = [k if w else k[:0] for k, w in zip(keys.view(np.int64), words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(content), pa.array(some, pa.list_(pa.int64()))], names=["_id", "_content", "_bands"]
            )

    return docs.selectExpr(f"`{id}` as id", f"`{text}` as text").mapInArrow(run, f"_id {kind}, _content string, _bands array<bigint>")


def similar(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs a, b with text_a, text_b those whose shingle multisets overlap enough: Σ min ÷ Σ max ≥ similarity."""
    kinds = dict(pairs.dtypes)

    def numbered(texts):
        """Each shingle with the number of its occurrence, so that multisets compare as sets."""
        row, h, _ = shingles(texts, shingle)
        row, h, count = weighted(row, h)
        again = np.repeat(np.arange(len(row)), count)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
        return row[again], mix(h[again] + nth.astype(np.uint64) * GOLDEN)

    def run(batches):
        for batch in slices(batches, "text_a"):
            n = len(batch)
            (ra, ha), (rb, hb) = numbered(batch.column("text_a")), numbered(batch.column("text_b"))
            row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            both = row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])]
            shared, total = np.bincount(both, minlength=n), np.bincount(row, minlength=n)
            keep = (total > 0) & (shared >= similarity * (total - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def components(edges: DataFrame) -> DataFrame:
    """node, class: the smallest node that is linked to it, by stars that are pulled to smaller centres until they rest.

    Each round every node hands its smallest neighbour to the larger ones, then to the smaller ones. What was grouped is
    written before it is joined by the same key, so that the join can split a node with many links.
    """
    pairs = cut(edges.selectExpr("greatest(a, b) u", "least(a, b) v").filter("u != v").distinct())
    while True:
        both = pairs.unionByName(pairs.selectExpr("v u", "u v"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").selectExpr("v u", "m v").distinct()
        large = cut(large.filter("u != v"))
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").selectExpr("v u", "m v").filter("u != v").unionByName(least.selectExpr("u", "m v"))
        after = cut(small.distinct())
        # at rest when every node but the centres has one link, and no centre has a link itself
        state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state(after) == state(pairs):
            return after.selectExpr("u node", "v class")
        pairs = after


def candidates(rows: DataFrame, texts: DataFrame, shingle: int, similarity: float, registers: int = REGISTERS) -> DataFrame:
    """Pairs a, b of different classes whose signatures agree in nearly `similarity` of the registers.

    rows: band, id, class. Documents that hang together through buckets are a family. A family is cut into tiles of
    about TILE documents by hash, and every two tiles are compared in a task of their own, by whole signatures; only
    pairs that pass leave it. An estimate under similarity - SLACK happens to one in 30,000 pairs that are alike.
    """
    centre = cut(rows.groupBy("band").agg(F.min("id").alias("v")))
    families = components(rows.join(centre, "band").selectExpr("id a", "v b")).withColumnRenamed("node", "id")
    families = families.withColumnRenamed("class", "family").unionByName(families.selectExpr("class id", "class family").distinct())
    tiles = cut(families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    kind = dict(texts.dtypes)["id"]

    def sign(batches):
        for batch in slices(batches, "text"):
            row, h, _ = shingles(batch.column("text"), shingle)
            found = signatures(*weighted(row, h), len(batch), registers).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in found])], names=["id", "signature"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        signature = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), registers)
        ids, kinds, tile = group["id"].to_numpy(), group["class"].to_numpy(), group["tile"].to_numpy()
        left, right = np.flatnonzero(tile == group["lo"].iloc[0]), np.flatnonzero(tile == group["hi"].iloc[0])
        out = []
        for i in left:
            other = right[(kinds[right] != kinds[i]) & ((tile[i] != tile[right]) | (ids[right] > ids[i]))]
            alike = (signature[other] == signature[i]).sum(axis=1)
            near = other[alike >= (similarity - SLACK) * registers]
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near]
        return pd.DataFrame(out, columns=["a", "b"])

    signed = texts.join(families.select("id"), "id", "left_semi").select("id", "text").mapInArrow(sign, f"id {kind}, signature binary")
    placed = rows.select("id", "class").distinct().join(families, "id").join(tiles, "family").join(signed, "id")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    return spread.select("family", "lo", "hi", "tile", "id", "class", "signature").groupBy("family", "lo", "hi").applyInPandas(
        compare, f"a {kind}, b {kind}"
    )


def links(docs: DataFrame, contents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Classes (node, class) of representatives that have a link. docs: id, text; contents: id, _bands."""
    members = contents.select("id", F.explode("_bands").alias("band"))
    # grouped tables are written before they are joined by the same key: only then can Spark split a large bucket
    shared = cut(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(members.join(shared, "band"))
    # the more buckets and fellows a member has, the nearer it stands to the middle of its group
    weights = cut(members.groupBy("id").agg(F.sum("n").alias("weight")))
    texts = cut(docs.join(weights.select("id"), "id"))

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.selectExpr("id a", "text text_a"), "a")
        return cut(similar(with_a.join(texts.selectExpr("id b", "text text_b"), "b"), shingle, similarity))

    # each member with the leader of its bucket
    leader = cut(members.join(weights, "id").groupBy("band").agg(F.max_by("id", F.struct("weight", "id")).alias("top")))
    pairs = members.join(leader, "band").filter("id != top").selectExpr("least(id, top) a", "greatest(id, top) b")
    found = verified(cut(pairs.distinct()))
    linked = components(found)
    # buckets that still hold several classes
    now = members.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = cut(now.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high"))
    rows = cut(now.join(mixed.select("band"), "band", "left_semi").select("band", "id", "class"))
    rest = verified(cut(candidates(rows, texts, shingle, similarity).distinct()))
    return linked if rest.isEmpty() else components(found.unionByName(rest))


def classes(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    count: int = BANDS, size: int = ROWS,
) -> DataFrame:
    """Per row: id, and class_id, the smallest id linked to it through near copies.

    Words are separated by white space and compared in lower case. Texts with equal words are one class; a text of
    fewer words than a shingle is a single shingle. A text without words, or a null one, is a class of its own. Rows
    that repeat an id are one document with several texts, linked by any of them. Rows with a null id are not compared
    and get a null class. Every row comes back; other columns are left out. Links between different texts are found
    with the probability of the bands (see BANDS).
    """
    sketched = cut(sketch(docs, id, text, shingle, count, size))
    usable = sketched.filter(F.col("_id").isNotNull() & (F.size("_bands") > 0))
    contents = cut(usable.groupBy("_content").agg(F.min("_id").alias("id"), F.first("_bands").alias("_bands")))
    linked = links(docs.select(F.col(id).alias("id"), whole_text(text).alias("text")), contents, shingle, similarity)
    named = contents.select("_content", "id").join(linked, F.col("id") == F.col("node"), "left")
    named = named.select("_content", F.coalesce("class", "id").alias("class_id"))
    rows = sketched.select("_id", F.when((F.size("_bands") > 0) & F.col("_id").isNotNull(), F.col("_content")).alias("_content"))
    return rows.join(named, "_content", "left").select(F.col("_id").alias(id), F.coalesce("class_id", "_id").alias("class_id"))
