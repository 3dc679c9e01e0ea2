"""Quality rules as a short-circuit cascade (DataFrame functions only).

A rule is a condition over a row, or over counts of its text, that rejects it. The cost of each rule and the share it
rejects are measured on a sample; the rules then run in the order of rejections per cost, and a row met by one rule is
not shown to the next. A count is made when the first rule that needs it has its turn, and no rule makes it again.
The order decides only how much work is done: a row is kept when no rule rejects it, whatever the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.common import let, whole_text
from stockflow.session import cut

WORD_BREAK = r"[ \t-\r]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for rows that go; a null counts as false.

    A rule over counts has `test`, a function of those named in `needs`, as well; see counting().
    """

    name: str
    rejects: Column
    needs: tuple[str, ...] = ()
    test: Callable[..., Column] | None = None

    def condition(self, have: dict[str, Column]) -> Column:
        """The rule over counts at hand."""
        return F.coalesce(self.test(*(have[n] for n in self.needs)) if self.test else self.rejects, F.lit(False))


def words(text: Column) -> Column:
    """The runs of characters other than the six ASCII white-space ones."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def word_chars(words_: Column) -> Column:
    """Code points in the words."""
    return F.char_length(F.array_join(words_, "")).cast("long")


def symbols(text: Column) -> Column:
    return (F.size(F.split(text, SYMBOL)) - 1).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(" \t\n\x0b\f\r")) != "")
    return let(lines, lambda kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("long"))


def repeated_words(words_: Column, window: int = WINDOW) -> Column:
    """Words inside windows of that many words which occur at least twice in the row, the first time included.

    Windows are compared by a 64-bit hash made of word hashes, doubled in length step by step. Only rows in which a
    hash comes back sort their windows; neighbours in that order give the places of the repeated ones.
    """

    def longer(hashes, have, step):
        # hashes of windows of `have` words -> of `have + step` words
        return let(hashes, lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step))
        ))

    hashes, have = F.transform(words_, lambda w: F.xxhash64(w)), 1
    while have < window:
        step = min(have, window - have)
        hashes, have = longer(hashes, have, step), have + step

    def covered(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, at: F.coalesce(F.get(s, at).h == x.h, F.lit(False))
        again = let(placed, lambda s: F.transform(
            F.filter(s, lambda x, at: same(s, x, at - 1) | same(s, x, at + 1)), lambda x: x.i
        ))
        return let(F.sort_array(again), lambda p: F.aggregate(
            F.transform(p, lambda x, at: F.least(F.coalesce(F.get(p, at + 1) - x, F.lit(window)), F.lit(window))),
            F.lit(0), lambda total, x: total + x,
        ))

    repeats = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    return let(hashes, lambda h: F.when(repeats(h), covered(h)).otherwise(F.lit(0)).cast("long"))


#: counts of a text: what each is made from, and how
COUNTS = {
    "words": ((), words),
    "n_words": (("words",), lambda text, found: F.size(found).cast("long")),
    "word_chars": (("words",), lambda text, found: word_chars(found)),
    "n_repeat_words": (("words",), lambda text, found: repeated_words(found)),
    "n_symbols": ((), symbols),
    "n_dup_lines": ((), duplicate_lines),
    "n_lines": ((), lambda text: F.size(F.split(text, "\n")).cast("long")),
    "n_exclaimed": ((), lambda text: (F.size(F.split(text, "!")) - 1).cast("long")),
}
REPORTED = tuple(name for name in COUNTS if name != "words")


def with_counts(names: Sequence[str], have: dict[str, Column], text: str, body: Callable[[dict[str, Column]], Column]) -> Column:
    """body(counts) with the named counts of the text made, and what they are made from; those in `have` are not made again."""
    for name in names:
        if name in have:
            continue
        needs, make = COUNTS[name]
        first = [n for n in needs if n not in have]
        if first:
            return with_counts([*first, *names], have, text, body)
        value = make(whole_text(text), *(have[n] for n in needs))
        return let(value, lambda made: with_counts(names, {**have, name: made}, text, body))
    return body(have)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every count of their whole text (REPORTED), as cascade() without rules reports them."""
    return cascade(docs, [], report=REPORTED, text=text).select(*[c for c in docs.columns if c not in REPORTED], *REPORTED)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def counting(name: str, needs: tuple[str, ...], test: Callable[..., Column], text: str = "text") -> Rule:
    """A rule over counts of the text."""
    return Rule(name, with_counts(needs, {}, text, lambda have: test(*(have[n] for n in needs))), needs, test)


def standard_rules(text: str = "text") -> list[Rule]:
    """The rules over a whole text; thresholds as whole numbers, so every engine agrees on the edge cases."""
    return [
        counting("few_words", ("n_words",), lambda n: n < MIN_WORDS, text),
        counting("repeated_words", ("n_repeat_words", "n_words"), lambda again, n: 100 * again > MAX_REPEATED_PERCENT * n, text),
        counting("symbols", ("n_symbols", "n_words"), lambda found, n: 5 * found > n, text),
        counting("exclamations", ("n_exclaimed", "n_words"), lambda found, n: 2 * found > n, text),
        counting("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, again: (n >= 6) & (10 * again > 6 * n), text),
        counting("word_length", ("word_chars", "n_words"), lambda chars, n: (chars < 2 * n) | (chars > 25 * n), text),
    ]


def sample_rows(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About that many rows from all over the table, written once."""
    total = df.count()
    return cut(df if total <= rows else df.sample(min(1.0, rows / total), seed))


def order(docs: DataFrame, rules: list[Rule], rows: int = 2000) -> list[Rule]:
    """The rules by rejections per cost on a sample of about `rows` rows; ties and an empty table keep the given order.

    The cost is the time of a pass that applies only this rule, less that of a pass that applies none.
    """
    sample = sample_rows(docs, rows)

    def seconds(condition: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):  # the first pass also compiles
            start = time.perf_counter()
            hits = sample.agg(F.count_if(condition)).first()[0]
            best = min(best, time.perf_counter() - start)
        return best, hits

    nothing, _ = seconds(F.lit(False))
    gains = {}
    for rule in rules:
        taken, hits = seconds(rule.rejects)
        gains[rule.name] = hits / max(taken - nothing, 1e-3)
    return sorted(rules, key=lambda rule: -gains[rule.name])


def judged(rules: list[Rule], report: Sequence[str] = (), text: str = "text") -> Column:
    """A struct of rejected_by, the first rule in the order that rejects the row or null, and of the reported counts.

    Later rules are not evaluated, nor are counts that only they need, unless these are to be reported.
    """

    def verdict(by: Column, have: dict[str, Column]) -> Column:
        fields = lambda all_: F.struct(by.alias("rejected_by"), *[all_[n].alias(n) for n in report])
        return with_counts(report, have, text, fields)

    def step(at: int, have: dict[str, Column]) -> Column:
        if at == len(rules):
            return verdict(F.lit(None).cast("string"), have)
        rule = rules[at]
        return with_counts(rule.needs, have, text, lambda now: F.when(
            rule.condition(now), verdict(F.lit(rule.name), now)
        ).otherwise(step(at + 1, now)))

    return step(0, {})


def rejected_by(rules: list[Rule], text: str = "text") -> Column:
    """The first rule in the order that rejects the row, else null; later rules are not evaluated."""
    return judged(rules, text=text)["rejected_by"]


def cascade(
    docs: DataFrame, rules: list[Rule] | None = None, rows: int = 2000, report: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """The documents with `kept`, true where no rule rejects them, and with the counts named in `report` (of REPORTED).

    Every row comes back. Null and empty texts have no words and are rejected by few_words. `rules` defaults to
    standard_rules(); with an empty list every row is kept. Columns named kept or like a reported count are replaced.
    """
    rules = standard_rules(text) if rules is None else rules
    ordered = order(docs, rules, rows) if len(rules) > 1 else rules
    spare = "_judged"
    while spare in docs.columns:
        spare += "_"
    found = docs.withColumn(spare, judged(ordered, report, text))
    return found.withColumns({
        **{n: F.col(f"{spare}.{n}") for n in report}, "kept": F.col(f"{spare}.rejected_by").isNull(),
    }).drop(spare)
