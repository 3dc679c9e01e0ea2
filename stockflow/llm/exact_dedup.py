"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Texts are equal when they are identical after each run of white space is replaced by one space; they are compared by
the SHA-256 of that form.

First pass: every digest is put into a blocked Bloom filter of HASHES cells a digest, all in one block. What is kept is
not which cells are set, but which are set more than once: the filter of what came a second time. Cells are counted
map-side first, so a text on a third of the rows is one line per task. Second pass: a row whose cells all came a second
time is possibly repeated. Only such rows are shuffled, by digest; any other text is certainly the only one of its kind
and its row passes straight through, without a shuffle.

The filter is broadcast. Its size follows the number of rows, BITS_A_ROW for each, up to MAX_BLOCKS blocks of
BLOCK_BITS / 8 bytes, 64 MB: more is never sent. Up to 33 million rows about 1.4 % of the unique rows are shuffled
needlessly; beyond, that share grows by and by to all of them, which is the plain shuffle of digests. No result depends
on it: the filter has no false negatives, and possibly repeated rows are grouped by their whole digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import whole_text
from stockflow.session import cut

BITS_A_ROW = 16
HASHES = 2
#: bits that one row of bitmap_construct_agg holds
BLOCK_BITS = 32768
#: blocks that are broadcast at most: 64 MB
MAX_BLOCKS = 16384


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t-\\r]+", " ")


def cells(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a digest, and its HASHES places in it."""
    place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), digest), F.lit(BLOCK_BITS)).cast("int")
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int"), [place(seed) for seed in range(1, HASHES + 1)]


def repeated_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """First pass: per block, the bitmap of the cells that were set more than once. At most `blocks` rows of 4 KB."""
    block, places = cells(F.col("_digest"), blocks)
    # both cells of one digest may be the same: it is set once by it
    cell = F.explode(F.array_distinct(F.array(*places)))
    counted = rows.select(block.alias("_block"), cell.alias("_cell")).groupBy("_block", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter("_n > 1").groupBy("_block").agg(F.bitmap_construct_agg("_cell").alias("_bits"))


def is_set(bits: Column, place: Column) -> Column:
    """Whether the bit is set; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))


def possibly_repeated(rows: DataFrame, blocks: int) -> DataFrame:
    """Second pass: the rows with `_again`, false where the digest is certainly the only one of its kind."""
    came_again = cut(repeated_cells(rows, blocks))
    block, places = cells(F.col("_digest"), blocks)
    met = rows.withColumn("_at", block).join(F.broadcast(came_again), F.col("_at") == F.col("_block"), "left")
    again = is_set(F.col("_bits"), places[0])
    for place in places[1:]:
        again &= is_set(F.col("_bits"), place)
    return met.withColumn("_again", again).drop("_at", "_block", "_bits")


def mark(docs: DataFrame, id: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row with keep_id, the id of the row of the same text that stays, group_size, kept and text_sha256.

    The row with the smallest id stays; a null id comes last, and of rows with the same id any one stays, always one.
    Null text counts as empty, and empty texts are equal. `columns` are those of docs that come back (default: all);
    columns with the names of the new ones are replaced.
    """
    wanted = docs.columns if columns is None else columns
    digest = F.unhex(F.sha2(F.encode(normalised(whole_text(text)), "utf-8"), 256))
    rows = cut(docs.select(
        F.struct(*wanted, F.lit(0).alias("_none")).alias("_row"), F.col(id).alias("_id"), F.monotonically_increasing_id().alias("_n"),
        digest.alias("_digest"),
    ))
    tested = possibly_repeated(rows, max(1, min(MAX_BLOCKS, -(-rows.count() * BITS_A_ROW // BLOCK_BITS))))
    candidates = tested.filter("_again")
    smallest = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_n")).alias("_first")
    # written before the join by the same key, so that a frequent text can be split
    groups = cut(candidates.groupBy("_digest").agg(F.count(F.lit(1)).alias("_size"), smallest).filter("_size > 1"))
    grouped = candidates.join(groups, "_digest", "left").select(
        "_row", "_digest", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_first._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("_first._n") == F.col("_n"), F.lit(True)).alias("kept"),
    )
    alone = tested.filter("not _again").select(
        "_row", "_digest", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
    )
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    return alone.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("_digest"))).select(
        *[F.col("_row").getField(c).alias(c) for c in wanted if c not in new], *new
    )


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one of each text, with all their columns; see mark()."""
    marked = mark(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id).alias("_key"), F.col(text).alias("_text")), "_key", "_text", ["_doc"])
    return marked.filter("kept").select("_doc.*")
