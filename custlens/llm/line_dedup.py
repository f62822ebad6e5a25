"""Line deduplication by overlapping three-line windows.

A window is three consecutive lines that hold a word, each without white space at its ends. A window whose lines stand
earlier too, in a document before (by id) or further up, is a later occurrence; all lines under later occurrences are
removed, and the first occurrence stays. Windows are judged on the input, so overlapping ones merge to longer passages.

Windows travel as digests. The first place of every repeated digest is found by an aggregate, which merges before the
shuffle, and joined back to the places; a digest that a third of all documents share is split by the adaptive skew join.
Texts move once, to meet the line numbers that go.

Defined results: a missing text counts as empty; texts with fewer than three such lines lose nothing; a missing id comes
before all others; rows with the same id and the same text are one document, so each of them gets its result; of rows
with the same id and different texts, the one whose digest is smaller comes first; an empty table gives an empty result;
``deduplicated`` keeps all columns and replaces the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.functions.stages import written
from custlens.llm.common import SPACES, document_key, let, rows_of

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _full(text: Column) -> Column:
    """Lines with a word as (their number, their trimmed text)."""
    return F.filter(
        F.transform(_lines(text), lambda s, i: F.struct(i.alias("at"), F.btrim(s, F.lit(SPACES)).alias("s"))),
        lambda line: line["s"] != "")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def windows(docs: DataFrame) -> DataFrame:
    """One row per window: digest of its lines, document, place, and the numbers of the lines that it covers."""
    def here(full: Column) -> Column:
        return F.when(F.size(full) < WINDOW, None).otherwise(F.transform(
            F.sequence(F.lit(0), F.size(full) - WINDOW),
            lambda i: F.struct(
                F.unhex(F.md5(F.concat_ws("\n", *(full[i + k]["s"] for k in range(WINDOW))))).alias("digest"),
                i.alias("place"), F.array(*(full[i + k]["at"] for k in range(WINDOW))).alias("covers"))))

    # the key is computed before windows become rows, once per document
    keyed = docs.select("doc_id", document_key().alias("doc_key"), "text")
    return keyed.select("doc_id", "doc_key", F.inline(let(_full(_text()), here)))


def removed_lines(docs: DataFrame) -> DataFrame:
    """For each document with later occurrences, the numbers of all lines that they cover."""
    found = written(windows(docs), "line_windows")
    place = F.struct("doc_id", "doc_key", "place")
    firsts = written(
        found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first"), "first_windows")
    later = found.join(firsts, "digest").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_key").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("gone"))


def _joined(docs: DataFrame) -> DataFrame:
    """The rows of the documents as one column ``row``, and ``gone``, the numbers of lines to remove or null."""
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), document_key().alias("doc_key"))
    return base.join(removed_lines(docs), "doc_key", "left")


def _kept(text: Column, gone: Column) -> Column:
    """The text without these lines."""
    return F.when(gone.isNull(), text).otherwise(let(_lines(text), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: lines[i]), "\n")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; a document of which nothing remains is left out."""
    text = F.col("row.text")
    new = _joined(docs).select("row", "gone", rows_of(F.struct(_kept(text, F.col("gone")).alias("rest"))))
    left = new.where(F.col("gone").isNull() | (F.btrim("rest", F.lit(SPACES)) != ""))
    return left.select(*((F.col("rest") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: lines with a word, how many of them are removed, and the text that remains."""
    text, gone = F.coalesce(F.col("row.text"), F.lit("")), F.col("gone")
    return _joined(docs).select(F.col("row.doc_id").alias("doc_id"), rows_of(F.struct(
        F.size(_full(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), _kept(text, gone).alias("text"))))
