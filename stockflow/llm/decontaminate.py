"""Benchmark passages in documents, by winnowing over k-gram hashes of words (DataFrame functions only).

The least hash of K-grams in every window of PASSAGE words is a fingerprint, on both sides; a passage of that many
words that both sides share therefore has a fingerprint that both sides picked. Documents whose fingerprints meet one
of the benchmark are read again, and each meeting place is extended both ways: all windows around it are compared with
the items' windows, word by word. Items shorter than a window are looked up whole, at every place of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import index, let, whole_text
from stockflow.session import cut

PASSAGE = 10
K = 5
BREAK = r"[\x00-/:-`{-\x7F]+"
#: the same before lower-casing
BREAK_ANY_CASE = r"[\x00-/:-@\[-`{-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z are lower-cased, nothing else."""
    # lower() alone would also change letters beyond ASCII
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(folded, BREAK), lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of words, without lower-casing."""
    return F.size(F.filter(F.split(text, BREAK_ANY_CASE), lambda w: w != ""))


def hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def widened(values: Column, size: int, combine) -> Column:
    """combine() over every `size` neighbours, from windows that grow by doubling; empty for fewer values."""
    def step(more: int):
        return lambda x: F.transform(
            F.slice(x, 1, F.greatest(F.size(x) - more, F.lit(0))), lambda y, i: combine(y, F.get(x, i + more))
        )

    have = 1
    while have < size:
        more = min(have, size - have)
        values, have = let(values, step(more)), have + more
    return values


def grams(h: Column, k: int) -> Column:
    """A hash of every k hashes in a row."""
    return widened(h, k, F.xxhash64)


def minima(g: Column, window: int) -> Column:
    """The least of every `window` hashes in a row."""
    return widened(g, window, F.least)


def fingerprints(h: Column, passage: int, k: int) -> Column:
    """The least k-gram hash of every window of `passage` words; empty for fewer words."""
    return minima(grams(h, k), passage - k + 1)


def window_texts(words_: Column, starts: Column, size: int) -> Column:
    """(first word, text) of the windows that start at those places."""
    return F.transform(starts, lambda i: F.struct(
        i.alias("i"), F.array_join(F.slice(words_, i + 1, size), " ").alias("passage")
    ))


def find(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", passage: int = PASSAGE, k: int = K,
) -> DataFrame:
    """Per row: id, n_words, n_hit (words inside a passage of an item), items (array of item ids as strings, in order)
    and hits (array of (first, last) word places, joined where they touch).

    A window is `passage` consecutive words of an item; an item of fewer words, but at least one, is one window. Null
    texts have no words, on both sides. Rows that repeat id and text get the same result each; items with equal texts
    are all named. Other columns are left out.
    """
    keyed = _keyed(docs, id, text)
    hits = cut(_hits(keyed, items, item, item_text, passage, k))
    counted = keyed.select("_id", "_key", count_words(F.col("_text")).cast("long").alias("n_words"))
    same = F.col("_id").eqNullSafe(F.col("h_id")) & (F.col("_key") == F.col("h_key"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"] + 1)
    return counted.join(hits, same, "left").select(
        F.col("_id").alias(id), "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<first: int, last: int>>")).alias("hits"),
    )


def remove(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", passage: int = PASSAGE, k: int = K,
) -> DataFrame:
    """The documents, all columns, without the rows whose own text holds a passage of an item; see find().

    Rows are told apart by id and text: a null id hides nothing, and a clean row stays whatever shares its id.
    """
    hits = _hits(_keyed(docs, id, text), items, item, item_text, passage, k)
    dirty = cut(hits.select(F.struct(F.col("h_id").alias("id"), F.col("h_key").alias("key")).alias("dirty"))).select("dirty")
    own = F.struct(docs[id].alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("key"))
    return docs.join(dirty, own["id"].eqNullSafe(dirty["dirty.id"]) & (own["key"] == dirty["dirty.key"]), "left_anti")


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """_id, _text and _key, the hash of the text."""
    return docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text")).withColumn("_key", F.xxhash64("_text"))


def _hits(keyed: DataFrame, items: DataFrame, item: str, item_text: str, passage: int, k: int) -> DataFrame:
    """h_id, h_key, items and hits of the documents that hold a passage."""
    known = items.select(F.col(item).cast("string").alias("item"), words(whole_text(item_text)).alias("w")).filter(F.size("w") > 0)
    long_items, short_items = known.filter(F.size("w") >= passage), known.filter(F.size("w") < passage)
    # lengths of short items: at most passage - 1 numbers
    lengths = sorted(r[0] for r in short_items.select(F.size("w")).distinct().collect())
    item_prints = long_items.select(F.explode(F.array_distinct(fingerprints(hashes(F.col("w")), passage, k))).alias("print"), F.lit(passage).alias("n"))
    item_windows = long_items.select("item", F.explode(window_texts(F.col("w"), index(F.size("w") - passage), passage)).alias("x"))
    passages = item_windows.select("item", "x.passage").unionByName(short_items.select("item", F.array_join("w", " ").alias("passage")))
    # grouped tables are written before they are joined by the same key: only then can Spark split a frequent passage
    passages = cut(passages.groupBy("passage").agg(F.sort_array(F.collect_set("item")).alias("items")))
    for n in lengths:
        prints = short_items.filter(F.size("w") == n).select(grams(hashes(F.col("w")), n)[0].alias("print"), F.lit(n).alias("n"))
        item_prints = item_prints.unionByName(prints)
    item_prints = cut(item_prints.distinct())

    def kinds(h):
        """All fingerprints of a document, each with the length of the windows it stands for."""
        tag = lambda prints, n: F.transform(F.array_distinct(prints), lambda p: F.struct(p.alias("print"), F.lit(n).alias("n")))
        return F.concat(tag(fingerprints(h, passage, k), passage), *[tag(grams(h, n), n) for n in lengths])

    # first reading: fingerprints that meet the benchmark; only those travel
    prints = keyed.select("_id", "_key", F.explode(let(hashes(words(F.col("_text"))), kinds)).alias("p")).select("_id", "_key", "p.*")
    met = prints.join(item_prints, ["print", "n"]).groupBy("_id", "_key").agg(F.collect_set(F.struct("print", "n")).alias("_met"))
    # second reading: only the documents that were met; written first, so Spark knows how few and need not move the texts
    met = cut(met).withColumnsRenamed({"_id": "m_id", "_key": "m_key"})
    same = F.col("_id").eqNullSafe(F.col("m_id")) & (F.col("_key") == F.col("m_key"))
    return _extended(keyed.join(met, same), passages, lengths, passage, k)


def _extended(met: DataFrame, passages: DataFrame, lengths: list[int], passage: int, k: int) -> DataFrame:
    """Per document that meets the benchmark, the hits among the windows whose own fingerprint was met."""

    def of(w, known, n, prints):
        fits = lambda some: F.filter(
            F.transform(prints, lambda p, i: F.when(F.array_contains(some, p), i)), lambda i: i.isNotNull()
        )
        starts = let(F.transform(F.filter(known, lambda m: m.n == n), lambda m: m.print), fits)
        return F.transform(window_texts(w, starts, n), lambda x: F.struct(x.i, (x.i + n - 1).alias("last"), x.passage))

    def around(w, known):
        return let(hashes(w), lambda h: F.concat(
            of(w, known, passage, fingerprints(h, passage, k)), *[of(w, known, n, grams(h, n)) for n in lengths]
        ))

    windows = met.select(
        "_id", "_key", F.explode(let(words(F.col("_text")), lambda w: around(w, F.col("_met")))).alias("x")
    ).select("_id", "_key", "x.i", "x.last", "x.passage")
    hits = windows.join(passages, "passage").groupBy("_id", "_key").agg(
        F.sort_array(F.collect_set(F.struct("i", "last"))).alias("_hits"), F.collect_set("items").alias("_items")
    )

    def grown(done, x):
        """The stretches so far with one more window, which starts at or after the last of them."""
        here = F.struct(x.i.alias("first"), x["last"].alias("last"))
        return let(F.get(done, F.size(done) - 1), lambda end: F.when(
            end.isNotNull() & (x.i <= end["last"] + 1),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(here))))

    return hits.select(
        F.col("_id").alias("h_id"), F.col("_key").alias("h_key"),
        F.aggregate("_hits", F.array().cast("array<struct<first: int, last: int>>"), grown).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"),
    )
