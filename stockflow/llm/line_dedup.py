"""Repeated runs of lines, found by winnowing over line hashes (DataFrame functions only).

Lines without a word are passed over. In every window of RUN_LINES consecutive lines the line with the least hash is
a fingerprint, so two places that share such a run share a fingerprint at the same line of it. Lines of LONG_CHARS
characters or more are fingerprints and runs of their own. Fingerprints that occur at one place only end here. From
the places of the others every match is extended both ways, over all the windows that hold the fingerprint; windows
of equal content are grouped, and all but the first in order of (id, place) are deleted. Windows that overlap join to
longer runs by themselves. No pairs are made: a window with many places gives one row per place and one first place.

Result: a line goes if it lies in a run of RUN_LINES lines, or is a line of LONG_CHARS, that also starts earlier, in a
document with a smaller id or higher up in the same one. "Earlier" is judged on the input, not on what is left.

With `words` given, a run of any number of lines, one included, that holds more than so many words goes too. Of these
only the shortest from each line onwards and the shortest up to each line are looked at, and a line
that is long enough alone with each line beside it: any longer run is made of them, and each is at most words + 1 lines
long, as every line looked at holds a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import index, let, whole_text
from stockflow.session import cut

RUN_LINES = 3
LONG_CHARS = 300
#: passages of more words than this are the ones the pipeline deletes
PASSAGE_WORDS = 50
BLANK = " \t\n\x0b\f\r"


def sequence(text: Column, counted: bool = False) -> Column:
    """The lines that hold a word: place among all lines, two independent hashes, its characters, if asked its words."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: let(
        F.trim(line, F.lit(BLANK)), lambda x: F.struct(
            i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"),
            F.char_length(x).alias("n"), *([F.size(F.split(x, "[ \t\n\x0b\f\r]+")).alias("words")] if counted else []),
        )
    ))
    return F.filter(lines, lambda x: x.n > 0)


def passages(lines: Column, words: int) -> Column:
    """The shortest runs of more than that many words from each line onwards, and up to each line, as windows()."""
    def window(s, start, size):
        part = F.slice(s, start + 1, size)
        least = F.array_min(F.transform(part, lambda p: F.struct(p.h, p.i)))
        return F.struct(
            least["h"].alias("print"), F.xxhash64(F.transform(part, lambda p: p.h)).alias("a"),
            F.xxhash64(F.transform(part, lambda p: p.g)).alias("b"),
            F.get(s, start).i.alias("first"), F.get(s, start + size - 1).i.alias("last"), least["i"].alias("at"),
        )

    def reach(part):
        """Lines and words of the shortest run of more than the words, from the first of these lines on."""
        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("total"))
        return F.aggregate(part, zero, lambda r, p: F.when(r.total > words, r).otherwise(
            F.struct((r.size + 1).alias("size"), (r.total + p.words).alias("total"))
        ))

    def both(s):
        places = index(F.size(s) - 1)
        # most runs are of few lines, so a few are tried first
        tried = lambda part: let(reach(part(F.lit(min(8, words + 1)))), lambda r: (
            F.when(r.total > words, r).otherwise(reach(part(F.lit(words + 1))))
        ))
        below = lambda j: lambda n: F.slice(s, j + 1, n)
        above = lambda j: lambda n: F.reverse(F.slice(s, F.greatest(j - n + 2, F.lit(1)), F.least(n, j + 1)))
        onwards = F.transform(places, lambda j: F.struct(j.alias("j"), tried(below(j)).alias("r")))
        upto = F.transform(places, lambda j: F.struct(j.alias("j"), tried(above(j)).alias("r")))
        # with the next line, so that what lies between two long ones goes with them
        pairs = F.filter(index(F.size(s) - 2), lambda j: (F.get(s, j).words > words) | (F.get(s, j + 1).words > words))
        return F.concat(
            F.transform(pairs, lambda j: window(s, j, F.lit(2))),
            F.transform(F.filter(onwards, lambda w: w.r.total > words), lambda w: window(s, w.j, w.r.size)),
            # long enough without its last line too: no run onwards ends here
            F.transform(
                F.filter(upto, lambda w: w.r.total - F.get(s, w.j).words > words), lambda w: window(s, w.j - w.r.size + 1, w.r.size)
            ),
        )

    return let(lines, both)


def windows(lines: Column, run: int, long_chars: int) -> Column:
    """Per run: fingerprint, content (128 bits), first and last line, line of the fingerprint."""
    at = lambda s, i: F.get(s, i)

    def window(s, i):
        parts = [at(s, i + k) for k in range(run)]
        least = F.least(*[F.struct(p.h, p.i) for p in parts])
        return F.struct(
            least["h"].alias("print"), F.xxhash64(*[p.h for p in parts]).alias("a"), F.xxhash64(*[p.g for p in parts]).alias("b"),
            parts[0].i.alias("first"), parts[-1].i.alias("last"), least["i"].alias("at"),
        )

    runs = lambda s: F.transform(index(F.size(s) - run), lambda i: window(s, i))
    single = lambda s: F.transform(F.filter(s, lambda x: x.n >= long_chars), lambda x: F.struct(
        x.h.alias("print"), F.xxhash64(x.h).alias("a"), F.xxhash64(x.g).alias("b"),
        x.i.alias("first"), x.i.alias("last"), x.i.alias("at"),
    ))
    return let(lines, lambda s: F.concat(runs(s), single(s)))


def repeated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN_LINES, long_chars: int = LONG_CHARS,
    words: int | None = None,
) -> DataFrame:
    """One row per document with a line to delete: _id, _key (a hash of its text) and _lines, the places in order."""
    found = let(sequence(whole_text(text), words is not None), lambda s: (
        windows(s, run, long_chars) if words is None else F.concat(windows(s, run, long_chars), passages(s, words))
    ))
    rows = docs.select(
        F.col(id).alias("_id"), F.xxhash64(whole_text(text)).alias("_key"), F.explode(found).alias("w"),
    ).select("_id", "_key", "w.*")
    # places of each fingerprint; a place chosen by several windows counts once
    places = rows.select("print", "_id", "_key", "at").distinct()
    # grouped tables are written before they are joined by the same key: only then can Spark split a frequent line
    shared = cut(places.groupBy("print").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("print"))
    matched = cut(rows.join(shared, "print", "left_semi"))
    place = F.struct("_id", "_key", "first")
    first = matched.groupBy("a", "b").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first != _last")
    later = matched.join(cut(first.select("a", "b", "_first")), ["a", "b"]).filter(place != F.col("_first"))
    gone = later.select("_id", "_key", F.explode(F.sequence("first", "last")).alias("line"))
    return gone.groupBy("_id", "_key").agg(F.sort_array(F.collect_set("line")).alias("_lines"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at those places."""
    return let(F.split(text, "\n"), lambda lines: F.array_join(
        F.transform(F.array_except(index(F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"
    ))


def deduplicate(
    docs: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN_LINES, long_chars: int = LONG_CHARS,
    words: int | None = None,
) -> DataFrame:
    """The documents with the repeated lines deleted from their text, and removed_lines, the deleted places (0-based).

    Rows that repeat both id and text are one document and get the same result. Rows with a null id come first. A null
    text stays null, an empty one empty. Lines compare without white space at their ends; lines without a word stay
    unless they lie inside a deleted run. Other columns are kept, one named removed_lines is replaced.
    """
    found = repeated_lines(docs, id, text, run, long_chars, words)
    keyed = docs.select(
        F.struct("*").alias("_row"), F.col(id).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(whole_text(text)).alias("_hash")
    )
    joined = keyed.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    left = F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(without(F.col("_text"), F.col("_lines")))
    return joined.select(
        *[left.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c != "removed_lines"],
        F.coalesce("_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )
