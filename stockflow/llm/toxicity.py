"""Toxicity by two Kneser-Ney models of words, one of toxic and one of ordinary texts, with shared backoff counts.

A class discounts its own word counts. What it sets aside goes to a backoff by continuation counts, in how many of the
classes a word occurs, so one occurrence weighs little; and what that sets aside to the class's model of spelling,
letter n-grams inside the word, which discounts likewise and falls back on one model by continuation counts. The words are a table that grows with the corpus and is joined to the documents' words. Only two things
are sent to every task, both of fixed size: at most SYMBOLS^ORDER letter n-grams, and the FREQUENT commonest words, which would
be hot keys of the join; filters of at most 2^SIEVE bits spare the joins most rows without a partner. All other words
of the documents meet the table by a shuffle of hashes, and their values the row; texts are not moved for it.

The difference of the log-likelihoods is normalised by length, over windows as well as over short texts as a whole: of
each width in WINDOWS (words) the window with the highest mean counts, so a few toxic words are found in a text of any
length. The score is the logistic value of the average over the widths.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import slices
from stockflow.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
SYMBOLS = 32
DISCOUNT = 0.75
#: words of the windows whose highest mean counts
WINDOWS = (1, 4, 16)
#: a longer word counts by its mean difference over so many symbols
WORD_SYMBOLS = 12
#: words sent to every task; the others are joined
FREQUENT = 1 << 16
#: bits of a filter of hashes are at most 2^SIEVE, 16 MB; a fuller one lets more rows through, which the joins then drop
SIEVE = 27
#: values of words are moved in steps of 1 / UNIT
UNIT = 512
#: steps of the scores whose counts set the logistic curve
STEPS, SPAN = 4000, 20.0


def symbol_table() -> np.ndarray:
    """A symbol for each byte."""
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[ord("0") : ord("9") + 1] = 27
    table[128:] = 28 + np.arange(128) % 4
    return table


@dataclass
class Words:
    """The words of some texts in order: their text, hash, and letter n-grams, which do not reach beyond the word."""

    row: np.ndarray  # by word
    key: np.ndarray
    start: np.ndarray  # its bytes in data
    end: np.ndarray
    data: np.ndarray
    code: np.ndarray  # by symbol of all words; the last of a word is its end, 0
    size: np.ndarray  # symbols by word


def words(texts: pa.Array, order: int = ORDER) -> Words:
    """Runs of letters, digits and bytes beyond ASCII; a to z in either case are the same."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    symbol = symbol_table()[data]
    inside, new = symbol > 0, np.zeros(len(data) + 1, bool)
    new[offsets[:-1] - offsets[0]] = True  # a text begins
    before = np.concatenate([[False], inside[:-1]]) & ~new[:-1] if len(data) else inside
    start = np.flatnonzero(inside & ~before)
    length = np.add.reduceat(inside.astype(np.int64), start) if len(start) else start
    row = np.searchsorted(offsets[1:] - offsets[0], start, side="right")
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    letters = data[inside]
    # a polynomial over mixed bytes, mixed again
    power = np.multiply.accumulate(np.full(int(length.max(initial=1)), HASH[0], np.uint64))
    terms = mixed(letters.astype(np.uint64) + HASH[1]) * power[place]
    key = mixed(np.add.reduceat(terms, np.cumsum(length) - length)) if len(start) else np.zeros(0, np.uint64)
    # symbols with an end after each word
    size = length + 1
    code = np.zeros(int(size.sum()), np.int64)
    at = np.arange(len(word)) + word
    code[at] = symbol[inside]
    deep = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    plain = code.copy()
    for back in range(1, order):
        there = np.flatnonzero(deep >= back)
        code[there] += plain[there - back] << (5 * back)
    return Words(row, key.view(np.int64), start, start + length, data, code, size)


HASH = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * HASH[2]
    x = (x ^ (x >> np.uint64(27))) * HASH[3]
    return x ^ (x >> np.uint64(31))


def spelled(found: Words, which: np.ndarray) -> pa.Array:
    """The text of some of the words."""
    return pa.array([found.data[a:b].tobytes() for a, b in zip(found.start[which].tolist(), found.end[which].tolist())], pa.large_binary())


def count(docs: DataFrame) -> DataFrame:
    """word, toxic, ordinary: how often each word occurs in texts of each label. docs: text, toxic (0 or 1)."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = words(batch.column("text"), 1)
            keys, first, back = np.unique(found.key, return_index=True, return_inverse=True)
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[found.row]
            toxic, every = np.bincount(back, label, len(keys)).astype(np.int64), np.bincount(back, minlength=len(keys))
            yield pa.RecordBatch.from_arrays(
                [spelled(found, first).cast(pa.binary()), pa.array(toxic), pa.array(every - toxic)], names=["word", "toxic", "ordinary"]
            )

    counted = docs.select("text", "toxic").mapInArrow(run, "word binary, toxic bigint, ordinary bigint")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def spellings(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """code, toxic, ordinary: in how many different words of each class a letter n-gram occurs, each time counted."""

    def run(batches):
        for batch in slices(batches, "word"):
            found = words(batch.column("word").cast(pa.large_binary()), order)
            codes, back = np.unique(found.code, return_inverse=True)
            sides = [np.repeat(batch.column(c).to_numpy() > 0, found.size) for c in ("toxic", "ordinary")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes), *[pa.array(np.bincount(back, s, len(codes)).astype(np.int64)) for s in sides]], names=["code", "toxic", "ordinary"]
            )

    found = counted.mapInArrow(run, "code bigint, toxic bigint, ordinary bigint")
    return found.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Model:
    """Spelling: the log-likelihoods of the n-grams seen, and of contexts the ratio of what the classes set aside."""

    codes: np.ndarray
    toxic: np.ndarray
    ordinary: np.ndarray
    contexts: np.ndarray
    missing: np.ndarray

    def likelihoods(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """By word the log-likelihoods of its spelling; of n-grams that no class has, what both share is left out."""
        if not len(found.size):
            return np.zeros(0), np.zeros(0)
        first = np.cumsum(found.size) - found.size
        toxic, ordinary = self._at(self.codes, self.toxic, found.code, np.nan), self._at(self.codes, self.ordinary, found.code, 0.0)
        unseen = np.flatnonzero(np.isnan(toxic))
        toxic[unseen] = self._at(self.contexts, self.missing, found.code[unseen] >> 5, 0.0)
        return np.add.reduceat(toxic, first), np.add.reduceat(ordinary, first)

    @staticmethod
    def _at(keys, values, wanted, default):
        if not len(keys):
            return np.full(len(wanted), default)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, values[place], default)


@dataclass
class Totals:
    """Occurrences and different words by class, and different words in all."""

    toxic: int
    ordinary: int
    toxic_words: int
    ordinary_words: int
    words: int

    def aside(self) -> tuple[float, float]:
        """What each class sets aside for spelling; all of it where it has no words."""
        part = lambda kinds, all: np.log(DISCOUNT * kinds / all) if all else 0.0
        return part(self.toxic_words, self.toxic), part(self.ordinary_words, self.ordinary)


def shortened(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return value * np.minimum(1.0, WORD_SYMBOLS / np.maximum(size, 1))


def unseen_values(found: Words, model: Model, totals: Totals) -> np.ndarray:
    """By word the difference of the log-likelihoods if no class has the word."""
    (p, q), (a, b) = model.likelihoods(found), totals.aside()
    return shortened(p - q + a - b, found.size)


def seen_values(found: Words, toxic: np.ndarray, ordinary: np.ndarray, model: Model, totals: Totals) -> np.ndarray:
    """By word of the table the difference of its log-likelihoods."""
    (p, q), (a, b) = model.likelihoods(found), totals.aside()

    # the backoff that both share: in how many classes a word occurs, then its spelling
    kinds, occurring = (toxic > 0).astype(int) + (ordinary > 0), totals.toxic_words + totals.ordinary_words
    either = np.log(DISCOUNT * max(totals.words, 1) / max(occurring, 1))

    def one(counts, all, aside, spelled):
        with np.errstate(divide="ignore"):
            backoff = np.logaddexp(np.log(np.maximum(kinds - DISCOUNT, 0) / max(occurring, 1)), either + spelled)
            return np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 0) / max(all, 1)), aside + backoff)

    return shortened(one(toxic, totals.toxic, a, p) - one(ordinary, totals.ordinary, b, q), found.size)


def stepped(value: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(value, -60, 60) * UNIT + 0.5).astype(np.int16)


def highest(row: np.ndarray, each: np.ndarray, rows: int, windows: tuple[int, ...] = WINDOWS) -> np.ndarray:
    """By row the highest mean in a window, averaged over the widths; 0 for rows without words."""
    counts = np.bincount(row, minlength=rows)
    sums, place = np.concatenate([[0.0], np.cumsum(each)]), np.arange(len(row))
    total = np.zeros(rows)
    for width in windows:
        # a text shorter than the window is one window
        best = np.bincount(row, each, minlength=rows) / np.maximum(counts, 1)
        inside = place[place + width <= np.cumsum(counts)[row]] if len(row) else place
        if len(inside):
            first = np.flatnonzero(np.diff(row[inside], prepend=-1))
            best[row[inside[first]]] = np.maximum.reduceat((sums[inside + width] - sums[inside]) / width, first)
        total += best / len(windows)
    return total


def continuation(codes: np.ndarray, order: int) -> np.ndarray:
    """The shared backoff probability of each n-gram's last symbol after its context less one symbol.

    Kneser-Ney over n-gram types: of every shorter n-gram the number of symbols that come before it, discounted, down
    to the single symbol, which falls back on all symbols alike.
    """
    types = {order: codes}
    for n in range(order - 1, 0, -1):
        types[n] = np.unique(types[n + 1] & ((1 << (5 * n)) - 1))
    lower = np.full(len(types[1]), 1.0 / SYMBOLS)  # by 1-gram
    probability = None
    for n in range(1, order):
        own = types[n]
        # how many different symbols stand before each n-gram
        before = np.bincount(np.searchsorted(own, types[n + 1] & ((1 << (5 * n)) - 1)), minlength=len(own)).astype(float)
        contexts, back = np.unique(own >> 5, return_inverse=True)
        total = np.bincount(back, before)
        kinds = np.bincount(back)
        base = lower if n == 1 else probability[np.searchsorted(types[n - 1], own & ((1 << (5 * (n - 1))) - 1))]
        probability = np.maximum(before - DISCOUNT, 0) / total[back] + DISCOUNT * kinds[back] / total[back] * base
    if probability is None:
        return np.full(len(codes), 1.0 / SYMBOLS)
    return probability[np.searchsorted(types[order - 1], codes & ((1 << (5 * (order - 1))) - 1))]


def fit(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER) -> Model:
    """The model of spelling from the counts of all letter n-grams."""
    by_code = np.argsort(codes)
    codes, toxic, ordinary = codes[by_code], toxic[by_code].astype(float), ordinary[by_code].astype(float)
    if not len(codes):
        return Model(codes, toxic, ordinary, codes, toxic)
    shared = continuation(codes, order)
    contexts, back = np.unique(codes >> 5, return_inverse=True)

    def model(counts):
        total, kinds = np.bincount(back, counts), np.bincount(back, counts > 0)
        # a context the class never saw goes to the backoff whole
        aside = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        return np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[back] + aside[back] * shared, aside

    (p, set_p), (q, set_q) = model(toxic), model(ordinary)
    return Model(codes, np.log(p), np.log(q), contexts, np.log(set_p) - np.log(set_q))


def curve(values: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over counted values, both classes weighed alike, slightly flattened."""
    if not toxic.sum() or not ordinary.sum():
        return 1.0, 0.0
    x = np.concatenate([values, values])
    y = np.concatenate([np.ones(len(values)), np.zeros(len(values))])
    w = np.concatenate([toxic / toxic.sum(), ordinary / ordinary.sum()])
    centre, spread = np.average(x, weights=w), np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)) or 1.0
    z = (x - centre) / spread
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        gradient = np.array([np.sum(w * (p - y) * z) + 1e-3 * a, np.sum(w * (p - y))])
        s = w * p * (1 - p)
        hessian = np.array([[np.sum(s * z * z) + 1e-3, np.sum(s * z)], [np.sum(s * z), np.sum(s) + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / spread), float(b - a * centre / spread)


def fold(id: str) -> Column:
    """0 to 4 by the id: 0 is held out, 1 sets the curve, the others are counted."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5


def sieve(hashes: DataFrame, number: int) -> np.ndarray:
    """A bit for each hash, by its low bits. hashes: one bigint column h, number: how many rows at most."""
    bits = 1 << min(max(10, int(number * 8).bit_length()), SIEVE)
    place = hashes.select(F.col("h").bitwiseAND(bits - 1).alias("p"))
    filled = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toPandas()
    found = np.zeros(bits >> 6, np.int64)
    found[filled["w"].to_numpy()] = filled["b"].to_numpy()
    return found


def passed(filter: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & (len(filter) * 64 - 1)
    return (filter[place >> 6] >> (place & 63)) & 1 == 1


def taught_labels(labels: DataFrame, id: str, label: str) -> DataFrame:
    """_id, toxic, _fold of the labels that may be learned from."""
    told = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("toxic"))
    return told.withColumn("_fold", fold("_id")).filter("_fold != 0")


def values(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", order: int = ORDER,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row _id and value: the mean difference of the log-likelihoods in the windows where it is highest."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("text"))
    # the same way at every size: labels and words grow with the table, so they are not sent to all tasks
    told = taught_labels(labels, id, label).filter("_fold > 1")
    kind = dict(texts.dtypes)["_id"]
    hashed = F.xxhash64(F.col("_id").cast("string")).alias("h")
    labelled = spark.sparkContext.broadcast(sieve(told.select(hashed), told.count()))

    def may_be_told(batches):
        for batch in batches:
            yield batch.filter(pa.array(passed(labelled.value, batch.column("h").to_numpy()))).select(["_id", "text"])

    asked = texts.filter(F.col("_id").isNotNull() & (fold("_id") > 1)).select("_id", "text", hashed)
    taught = asked.mapInArrow(may_be_told, f"_id {kind}, text string").join(told.hint("merge"), "_id")
    counted = cut(count(taught))
    sums = counted.agg(*[F.coalesce(F.expr(e), F.lit(0)) for e in (
        "sum(toxic)", "sum(ordinary)", "count_if(toxic > 0)", "count_if(ordinary > 0)", "count(*)")]).first()
    letters = spellings(counted, order).toPandas()  # at most SYMBOLS^order rows
    model, totals = fit(letters["code"].to_numpy(), letters["toxic"].to_numpy(), letters["ordinary"].to_numpy(), order), Totals(*sums)
    sent = spark.sparkContext.broadcast((model, totals))

    def weigh(batches):
        own, all = sent.value
        for batch in slices(batches, "word"):
            found = words(batch.column("word").cast(pa.large_binary()), order)
            seen = seen_values(found, batch.column("toxic").to_numpy(), batch.column("ordinary").to_numpy(), own, all)
            number = pc.add(batch.column("toxic"), batch.column("ordinary"))
            yield pa.RecordBatch.from_arrays([pa.array(found.key), number, pa.array(seen)], names=["key", "number", "value"])

    weighed = cut(counted.mapInArrow(weigh, "key bigint, number bigint, value double"))
    common = weighed.orderBy(F.desc("number"), "key").limit(frequent).toPandas().sort_values("key")  # at most `frequent` rows
    common = spark.sparkContext.broadcast((common["key"].to_numpy(), common["value"].to_numpy()))
    learned = spark.sparkContext.broadcast(sieve(weighed.select(F.col("key").alias("h")), totals.words))
    rows = texts.select("_id", F.xxhash64("_id", "text").alias("_row"), "text")

    def listed(found: Words, which: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(np.bincount(found.row[which], minlength=rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))

    def known_here(batches):
        """By row the values of its words, as if no class had those that are not in every task."""
        (own, all), (keys, values) = sent.value, common.value
        for batch in slices(batches, "text"):
            found = words(batch.column("text"), 1)
            different, first, back = np.unique(found.key, return_index=True, return_inverse=True)
            each = Model._at(keys, values, different, np.nan)
            rare = np.flatnonzero(np.isnan(each))
            each[rare] = unseen_values(words(spelled(found, first[rare]), order), own, all)
            moved = stepped(each)[back]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), listed(found, np.arange(len(moved)), moved, len(batch))], names=["_row", "_id", "each"]
            )

    def looked_up(batches):
        """Place and hash of the other words, where a class may have them."""
        keys, values = common.value
        for batch in slices(batches, "text"):
            found = words(batch.column("text"), 1)
            rare = np.flatnonzero(np.isnan(Model._at(keys, values, found.key, np.nan)) & passed(learned.value, found.key))
            place = rare - np.searchsorted(found.row, found.row)[rare]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(found.row[rare])), pa.array(place), pa.array(found.key[rare])], names=["_row", "place", "key"]
            )

    rare = rows.select("_row", "text").mapInArrow(looked_up, "_row bigint, place bigint, key bigint")
    # place and value in one number; equal rows bring equal ones
    pair = F.shiftleft("place", 16) + F.floor(F.greatest(F.least(F.col("value"), F.lit(60.0)), F.lit(-60.0)) * UNIT + 0.5) + 32768
    known = rare.join(weighed.select("key", "value").hint("merge"), "key").groupBy("_row").agg(F.collect_set(pair).alias("known"))

    def best(batches):
        for batch in batches:
            each, own = batch.column("each"), batch.column("known")
            counts = pc.list_value_length(each).to_numpy().astype(np.int64)
            values, row = each.flatten().to_numpy().astype(float), np.repeat(np.arange(len(batch)), counts)
            pairs, at = own.flatten().to_numpy(), pc.list_parent_indices(own).to_numpy()
            values[(np.cumsum(counts) - counts)[at] + (pairs >> 16)] = (pairs & 65535) - 32768
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(highest(row, values / UNIT, len(batch)))], names=["_id", "value"])

    base = rows.mapInArrow(known_here, f"_row bigint, _id {kind}, each array<smallint>")
    joined = base.join(known.hint("merge"), "_row", "left").select("_id", "each", "known")
    return joined.mapInArrow(best, f"_id {kind}, value double")


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", order: int = ORDER,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Learns from labelled rows that are not held out; rows without a label, and labels other than 0 and 1, teach
    nothing. An id with several labels counts as toxic if one of them says so. A null or empty text, and every text
    where no label of one class is known, scores by the curve alone. A null id is held out. Every row comes back; other
    columns are left out. Two words, or two rows, are taken for one if hashes of 64 bits are equal.
    """
    valued, told = cut(values(docs, labels, id, text, label, order, frequent)), taught_labels(labels, id, label)
    # how the curve lies: counts per step of the value and label, a table of fixed size
    steps = valued.join(told.filter("_fold = 1").hint("merge"), "_id")
    steps = steps.groupBy(F.floor(F.greatest(F.least("value", F.lit(SPAN)), F.lit(-SPAN)) * STEPS / SPAN).alias("step")).agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary")
    ).toPandas().sort_values("step")
    slope, offset = curve((steps["step"].to_numpy() + 0.5) * SPAN / STEPS, steps["toxic"].to_numpy(), steps["ordinary"].to_numpy())
    value = 1 / (1 + F.exp(-(F.col("value") * slope + offset)))
    return valued.select(
        F.col("_id").alias(id), F.coalesce(fold("_id") == 0, F.lit(True)).alias("held_out"), value.alias("score"),
        (value >= 0.5).cast("int").alias("predicted"),
    )
