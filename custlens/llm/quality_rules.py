"""Quality rules as a cascade that stops at the first rejection.

Rules are cheap or dear, and reject much or little. Their cost and selectivity are measured on a sample of documents,
and the rules are then tried in the order of rejection per cost. The order decides how much work is done, never which
documents are kept: a document is rejected if any rule rejects it.

All work on documents is done by built-in expressions. Words are runs of characters other than ASCII white space.

Defined results: a missing text counts as empty and has no words, so ``too_short`` rejects it; rows are judged one by
one, so repeated rows and repeated or missing ids get the same verdict each; an empty table gives an empty result; other
columns of the input are kept as they are, and a column with the name of an added one is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.functions.stages import written
from custlens.llm.common import let, rows_of, words_of

SYMBOLS = "#*$%&|<>"
NOT_SYMBOL = "[^#*$%&|<>]+"

#: Documents in the sample that costs and selectivities are measured on, on average.
SAMPLE_ROWS = 1000


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_SYMBOL, ""))


def full_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))


def dup_lines(lines: Column) -> Column:
    """Lines equal to an earlier one."""
    return F.size(lines) - F.size(F.array_distinct(lines))


def _span_words(starts: Column) -> Column:
    """The number of words in the three-word windows that start at these places."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


#: With more distinct repeated windows than this, they are found by ordering instead of by lookup; same result.
LOOKUP = 256


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Windows are compared by hash first. Few repeated hashes are looked up, and counted again as words in case that two
    different windows share a hash; many are found by ordering all windows and comparing neighbours word by word.
    """

    def ordered_places(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(order: Column, a: Column, b: Column) -> Column:
            x, y = F.get(order, a), F.get(order, b)
            equal = x["h"] == y["h"]
            for k in range(3):
                equal = equal & (words[x["i"] + k] == words[y["i"] + k])
            return F.coalesce(equal, F.lit(False))

        return let(placed, lambda order: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda k: same(order, k, k - 1) | same(order, k, k + 1)),
            lambda k: order[k]["i"],
        ))

    def looked_up(hashes: Column, twice: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, hashes[i]))
        windows = lambda at: F.transform(at, lambda i: F.struct(words[i], words[i + 1], words[i + 2]).cast("string"))
        return let(starts, lambda at: F.when(F.size(F.array_distinct(windows(at))) == F.size(twice), at).otherwise(
            ordered_places(hashes)))

    def covered(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i - 1))))
        return let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(
            _span_words(F.when(F.size(d) <= LOOKUP, looked_up(hashes, d)).otherwise(ordered_places(hashes)))))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered))


@dataclass(frozen=True)
class Rule:
    """A rule; ``rejects`` makes a condition from the text and its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share(words: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(words, test)) * 100


#: Limits are chosen for text that isn't prose: noise, tables, broken or repeated lines.
RULES = (
    Rule("too_short", lambda text, words: F.size(words) < 50),
    Rule("repetitive", lambda text, words: repeat_words(words) * 100 > F.size(words) * 50),
    Rule("symbol_noise", lambda text, words: symbols(text) > F.size(words)),
    Rule("same_lines", lambda text, words: let(
        full_lines(text), lambda lines: (F.size(lines) >= 4) & (dup_lines(lines) * 100 > F.size(lines) * 60))),
    Rule("word_length", lambda text, words: let(
        word_chars(words), lambda chars: (chars < F.size(words) * 2) | (chars > F.size(words) * 20))),
    Rule("few_letters", lambda text, words: _share(words, lambda w: w.rlike("\\p{L}")) < F.size(words) * 80),
    Rule("cut_lines", lambda text, words: let(full_lines(text), lambda lines: (F.size(lines) >= 4) & (
        _share(lines, lambda line: line.rlike("(\\.\\.\\.|…)[ \\t-\\r]*$")) > F.size(lines) * 60))),
    Rule("digits", lambda text, words: F.length(F.regexp_replace(text, "[^0-9]+", "")) * 2 > word_chars(words)),
)
BASE = ("too_short", "repetitive")


def verdict(text: Column, words: Column, rules: Sequence[Rule]) -> Column:
    """The name of the first rule in order that rejects, else null; later rules are not computed then."""
    if not rules:
        return F.lit(None).cast("string")
    chain = F
    for rule in rules:
        chain = chain.when(rule.rejects(text, words), F.lit(rule.name))
    return chain.otherwise(F.lit(None).cast("string"))


def measured(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """For each rule its name, the share of sampled documents that it rejects, and its seconds for the sample."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = docs.count()
    sample = written(texts.sample(min(1.0, sample_rows / max(total, 1)), seed=7), "quality_sample")
    rows = max(sample.count(), 1)

    def rejected(rule: Rule) -> tuple[int, float]:
        start = time.perf_counter()
        hit = let(words_of(F.col("text")), lambda words: rule.rejects(F.col("text"), words))
        count = sample.agg(F.count_if(hit)).first()[0]
        return count, time.perf_counter() - start

    nothing = Rule("nothing", lambda text, words: F.size(words) < 0)
    rejected(nothing)
    floor = rejected(nothing)[1]
    found = []
    for rule in rules:
        count, seconds = rejected(rule)
        found.append((rule.name, count / rows, max(seconds - floor, 1e-3)))
    return found


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejection per cost; ties keep the given order."""
    gain = {name: share / seconds for name, share, seconds in measured(docs, rules, sample_rows)}
    return sorted(rules, key=lambda r: -gain[r.name])


def judged(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The documents with ``rejected_by``, the first rule in the order given that rejects, or null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("rejected_by", let(words_of(text), lambda words: verdict(text, words, rules)))


def kept(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    rules = ordered(docs) if rules is None else rules
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(let(words_of(text), lambda words: verdict(text, words, rules)).isNull())


def report(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per document: the base counts and the verdict.

    The base counts are asked of every document, so the base rules read them; the other rules run as a cascade behind.
    """
    further = [r for r in rules if r.name not in BASE]

    def counted(words: Column) -> Column:
        text, long = F.col("text"), lambda c: c.cast("long")
        return let(
            F.struct(
                long(F.size(words)).alias("n_words"), long(word_chars(words)).alias("word_chars"),
                long(symbols(text)).alias("n_symbols"), long(let(full_lines(text), dup_lines)).alias("n_dup_lines"),
                long(repeat_words(words)).alias("n_repeat_words"),
            ),
            lambda s: let(
                (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50),
                lambda failed: F.struct(
                    *(s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    failed.alias("base_failed"),
                    F.when(failed, False).otherwise(verdict(text, words, further).isNull()).alias("kept"),
                ),
            ),
        )

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", rows_of(let(words_of(F.col("text")), counted)))
