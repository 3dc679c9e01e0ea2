"""Shards of near-equal bytes by Karmarkar-Karp differencing; equal texts stay together.

A partial partition is a list of k parts with their sums. The two with the largest spread are joined again and again,
the largest part of one with the smallest of the other, until one is left. That is done twice: first inside buckets of
groups, each bucket giving a bounded number of bundles, then over the bundles of all buckets, whose number does not
follow the data. Groups too large for a bundle are handed on as they are. Bundles come in steadily smaller sizes, so
the last round can even out what the large ones leave.
"""

from __future__ import annotations

import heapq
import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.common import whole_text
from stockflow.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 8
#: groups of a bucket (one task), and the most bundles that are dealt out in one place
BUCKET_GROUPS, TOP = 50_000, 20_000
#: share of a bucket's groups by kind of bundle, and bundles of each kind
SHARES, BUNDLES = (0.9, 0.09, 0.009, 0.001), 64


def difference(sizes: list[int], k: int) -> list[int]:
    """A part (0 … k-1) for each size. Ties go by place, so the result depends on the list alone."""
    if not sizes:
        return []
    # parts as (sum, members as a linked tree), in falling order; members are joined without copying
    heap = [(-s, i, [(s, i)] + [(0, None)] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x + y, (m, n) if m is not None and n is not None else n if m is None else m) for (x, m), (y, n) in zip(a, reversed(b))]
        joined.sort(key=lambda p: -p[0])
        number += 1
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], number, joined))
    out = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2]):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                out[node] = part
    return out


def bundle(items: DataFrame, buckets: int, large: float) -> DataFrame:
    """item, size -> item, bundle: items above `large` keep to themselves, the others of a bucket share bundles."""
    kind = dict(items.dtypes)["item"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item"], ascending=[False, True])
        parts = []
        for level, rows in group.groupby("level"):
            parts.append(rows.assign(part=difference(rows["size"].tolist(), BUNDLES), level=level))
        done = pd.concat(parts)
        done["bundle"] = [f"{b}/{v}/{p}" for b, v, p in zip(done["bucket"], done["level"], done["part"])]
        return done[["item", "size", "bundle"]]

    share = F.pmod(F.xxhash64(F.lit(1), "item"), F.lit(1 << 20)) / float(1 << 20)
    level, edge = F.lit(len(SHARES) - 1), 0.0
    for i, part in reversed(list(enumerate(SHARES[:-1]))):
        level = F.when(share < sum(SHARES[: i + 1]), F.lit(i)).otherwise(level)
    small = items.filter(F.col("size") <= large).withColumns({"bucket": F.pmod(F.xxhash64("item"), F.lit(buckets)), "level": level})
    shared = small.groupBy("bucket").applyInPandas(run, f"item {kind}, size bigint, bundle string")
    alone = items.filter(F.col("size") > large).select("item", "size", F.concat(F.lit("+"), F.col("item").cast("string")).alias("bundle"))
    return shared.unionByName(alone)


def shards_of(items: DataFrame, shards: int) -> DataFrame:
    """item, size -> item, shard. The driver sees at most about TOP bundles."""
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).first()
    if facts["n"] > TOP:
        buckets = max(math.ceil(facts["n"] / BUCKET_GROUPS), 1)
        # at most TOP / 4 items can be larger than this
        bundled = cut(bundle(items, buckets, 4 * facts["total"] / TOP))
        inner = shards_of(cut(bundled.groupBy("bundle").agg(F.sum("size").alias("size")).withColumnRenamed("bundle", "item")), shards)
        return bundled.join(inner.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
    rows = sorted(((r["size"], str(r["item"]), r["item"]) for r in items.collect()), key=lambda r: (-r[0], r[1]))
    parts = difference([r[0] for r in rows], shards)
    kind = dict(items.dtypes)["item"]
    return items.sparkSession.createDataFrame([(r[2], p) for r, p in zip(rows, parts)], f"item {kind}, shard int")


def shard(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text plus 1), text_crc32, shard (0 … shards-1) and slot (0 … in the shard).

    Rows with equal texts form a group, which one shard takes whole; a null text counts as empty. A group larger than a
    shard's share makes its shard larger than the others. Slots follow no order of the ids but are the same in every
    run. Every row comes back, repeated rows too; other columns are left out; an empty table gives an empty result.
    """
    rows = cut(docs.select(F.col(id).alias("_id"), F.encode(whole_text(text), "utf-8").alias("_raw")).select(
        "_id", (F.octet_length("_raw") + 1).cast("long").alias("size"), F.crc32("_raw").alias("text_crc32"),
        F.concat(F.md5("_raw"), F.octet_length("_raw").cast("string")).alias("item"),
    ))
    # copies are added up in each task first, so a large group is a few rows here
    groups = cut(rows.groupBy("item").agg(F.sum("size").alias("size")))
    placed = cut(rows.join(shards_of(groups, shards), "item"))
    # places inside small buckets, shifted by the counts of the buckets before; buckets follow the row count
    buckets = max(shards, math.ceil(placed.count() / BUCKET_GROUPS) * 8)
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_id", "item"), F.lit(buckets)))
    sizes = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_id", "item")
    numbered = placed.withColumn("_place", F.row_number().over(inside) - 1).join(starts, ["shard", "_bucket"])
    return numbered.select(F.col("_id").alias(id), "size", "text_crc32", "shard", (F.col("_place") + F.col("_start")).cast("long").alias("slot"))
