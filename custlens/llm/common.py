"""What the text operators share: reading, words, and stage tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents; a missing text counts as empty."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space, as an array; none for an empty or missing text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


#: ASCII control characters, blanks and punctuation, for texts in which A-Z are still to be lowered.
NOT_PLAIN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def plain_words(text: Column) -> Column:
    """The runs of letters, digits and characters outside ASCII, as an array."""
    def inner(w: Column) -> Column:
        """Without the empty pieces that a separator at the beginning or the end leaves."""
        before = F.when(w[0] == "", 1).otherwise(0)
        behind = F.when((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == ""), 1).otherwise(0)
        return F.when((before == 0) & (behind == 0), w).otherwise(F.slice(w, before + 1, F.size(w) - before - behind))

    return let(F.split(text, NOT_PLAIN), inner)


def document_key() -> Column:
    """A digest of id and text: rows with the same id and the same text are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(struct: Column) -> Column:
    """A generator of one row with the fields of ``struct``.

    The optimizer doesn't move expressions across a generator, so what the struct holds is computed once.
    """
    return F.inline(F.array(struct))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ARROW_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Hands batches of about ``most`` bytes to Python workers in jobs that run meanwhile.

    Batches are otherwise counted by rows, so that long texts take much memory, in the executor and in the worker.
    """
    before = spark.conf.get(ARROW_BYTES_CONF)
    spark.conf.set(ARROW_BYTES_CONF, most)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES_CONF, before)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``most_bytes`` of text; a longer text is a part of its own."""
    text = batch.column(column)
    sizes = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()
