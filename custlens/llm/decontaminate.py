"""Benchmark decontamination: short test items inside long documents.

An item is found in a document that holds at least a given share of its distinct word shingles (five words, 80 % if not
told otherwise). Comparing MinHash sketches of both sides would miss a short item in a long document, as their Jaccard
similarity is small. So items are partitioned by size, and each partition has its own length of signature: an item with q
shingles of which at least c must occur keeps its q - c + 1 smallest hashes or more, so that a document with c of them
holds at least one hash of the signature. Documents are probed with all their hashes, so no pair is lost. Documents that
are hit are then compared with the items shingle by shingle, as words.

Words are runs of letters, digits and characters outside ASCII, in lower case. An item with fewer words than a shingle
has is one shingle by itself. Everything is done by built-in expressions; the signatures are broadcast up to a checked
number, and joined by shuffle beyond.

Defined results: missing or empty texts, and items without a word, match nothing; rows with the same id and the same
text are one document; items with the same id are one item with the shingles of all its rows; missing ids count as a
value; an empty table of either kind gives no pairs; ``clean`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.functions.stages import written
from custlens.llm.common import document_key, let, plain_words, rows_of

WORDS, PERCENT = 5, 80

#: Signature hashes that are broadcast at most (8 bytes each); beyond, they are joined by shuffle.
MOST_BROADCAST = 500_000


def _words() -> Column:
    return plain_words(F.lower(F.coalesce(F.col("text"), F.lit(""))))


def _grams(words: Column, n: int, of) -> Column:
    """``of`` each run of n words."""
    return F.when(F.size(words) < n, None).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(words) - n), lambda i: of([words[i + k] for k in range(n)])))


def _hash(parts: list[Column]) -> Column:
    """Shingles of different lengths differ in their hash, too."""
    return F.xxhash64(F.lit(len(parts)), *parts)


def _phrase(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def item_shingles(items: DataFrame, words: int = WORDS) -> DataFrame:
    """The distinct shingles of every item: item_id, n (words in the shingle), phrase, hash, size (of the item's set).

    No word holds a blank, so phrases of different lengths differ.
    """
    each = items.select("item_id", rows_of(F.struct(_words().alias("words")))).where(F.size("words") > 0)
    parts = []
    for n in range(1, words + 1):
        own = each.where(F.size("words") >= n) if n == words else each.where(F.size("words") == n)
        both = lambda parts: F.struct(_phrase(parts).alias("phrase"), _hash(parts).alias("hash"))
        parts.append(own.select("item_id", F.lit(n).alias("n"), F.inline(_grams(F.col("words"), n, both))))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    distinct = written(all_.distinct(), "item_shingles")
    sizes = distinct.groupBy("item_id").agg(F.count("*").alias("size"))
    same = distinct["item_id"].eqNullSafe(sizes["item_id"])
    return written(distinct.join(sizes, same).drop(sizes["item_id"]), "sized_shingles")


def signatures(shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The signature hashes by size partition: sizes up to the next power of two share a signature length."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2("size")) + 1).cast("long") - 1
    length = largest - F.ceil(largest * percent / 100) + 1
    # smallest hashes first; the set of one item is small, and its rows are ordered by item
    chosen = shingles.groupBy("item_id", length.alias("length")).agg(
        F.sort_array(F.collect_list("hash")).alias("sorted"))
    return chosen.select(F.explode(F.slice("sorted", 1, F.col("length").cast("int"))).alias("gram")).distinct()


def matches(docs: DataFrame, items: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document and item that it holds: doc_key, doc_id, item_id, n_shared, n_item, containment."""
    spark = docs.sparkSession
    shingles = item_shingles(items, words)
    probes = written(signatures(shingles, percent), "item_signatures")
    lengths = sorted(r["n"] for r in shingles.select("n").distinct().collect())  # at most `words` values
    few = probes.count() <= MOST_BROADCAST
    # the key is computed before shingles become rows, once per document
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", document_key().alias("doc_key"), "text")

    def shingled(frame: DataFrame, of) -> DataFrame:
        """One row per shingle of the lengths in use: doc_key, doc_id, gram."""
        kind = "array<bigint>" if of is _hash else "array<string>"
        one = lambda w, n: F.coalesce(_grams(w, n, of), F.array().cast(kind))
        grams = let(_words(), lambda w: F.concat(*(one(w, n) for n in lengths)) if len(lengths) > 1 else one(w, lengths[0]))
        return frame.select("doc_key", "doc_id", F.explode(grams if of is _hash else F.array_distinct(grams)).alias("gram"))

    if not lengths:
        return spark.createDataFrame([], "doc_key binary, doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, "
                                         "containment double")
    hit = shingled(texts, _hash).select("doc_key", "gram").join(F.broadcast(probes) if few else probes, "gram", "left_semi")
    near = written(hit.select("doc_key").distinct(), "documents_hit")
    # repeated rows are one document, whose shingles count once
    suspects = texts.join(near, "doc_key", "left_semi").dropDuplicates(["doc_key"])
    exact = shingles.select(F.col("phrase").alias("gram"), "item_id", "size")
    shared = shingled(suspects, _phrase).join(exact, "gram").groupBy("doc_key", "doc_id", "item_id").agg(
        F.count("*").alias("n_shared"), F.max("size").alias("n_item"))
    return shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).withColumn(
        "containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item."""
    held = written(matches(docs, items, words, percent).select("doc_key").distinct(), "documents_with_items")
    return docs.join(held, document_key() == held["doc_key"], "left_anti")
