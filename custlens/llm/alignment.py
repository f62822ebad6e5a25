"""Alignment of the tokens of two tokenizers by the bytes that they cover.

Both tokenizers cut the same bytes (a blank and the text). The incidence matrix A of one has a row per token and a column per
byte, that of the other is B; both are built as compressed rows. The product A·Bᵀ, formed row by row (each row of A picks rows
of Bᵀ and adds them up), holds for each pair of tokens the number of bytes they share: its entries are the overlap links. Byte
offsets where tokens of both end cut the tokens into groups; the product of the incidence matrices of tokens and groups holds
the links of tokens in the same group. Rows are multiplied in blocks of bounded size, so a long text needs no more memory than
its links.

How many documents hold a pair of ids linked is counted over all documents: tasks count the pairs of a chunk of texts, the
counts are added up by pair and compared within each first id, and go back to the chunks that hold the pair. Documents keep
their links as numbers of the chunk's pairs meanwhile, so neither documents nor links are joined one by one.

Defined results: a missing or empty text, and one whose tokens don't give its bytes back, has no tokens: zeros, and an empty
digest; repeated rows, and rows with the same or no id, are documents of their own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from custlens.functions.stages import written
from custlens.llm.common import slices
from custlens.llm.hashing import text_bytes

CHUNK_BYTES = 4 << 20
BLOCK = 1 << 20


# ---- matrices ----


@dataclass
class Rows:
    """A matrix as compressed rows: row k has the columns ``indices[indptr[k]:indptr[k + 1]]``; without data all are ones."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    data: np.ndarray | None = None


def product(a: Rows, b: Rows) -> Rows:
    """The product of two incidence matrices: for each row of ``a`` the sum of the rows of ``b`` that it names."""
    terms = np.diff(b.indptr)[a.indices]
    ends = np.concatenate([[0], np.cumsum(terms)])
    columns = b.indices[np.repeat(b.indptr[a.indices] - ends[:-1], terms) + np.arange(ends[-1])]
    of_row = ends[a.indptr]
    rows = np.repeat(np.arange(len(a.indptr) - 1), np.diff(of_row))
    keys = rows * b.columns + columns
    if len(keys) and (keys[1:] < keys[:-1]).any():
        keys = np.sort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    kept = keys[first]
    indptr = np.searchsorted(kept, np.arange(len(a.indptr)) * b.columns)
    return Rows(indptr, kept % b.columns if b.columns else kept, b.columns, np.diff(np.append(first, len(keys))))


def row_sizes(a: Rows, b: Rows) -> np.ndarray:
    """The entries of each row of the product if no column comes twice, without forming it."""
    before = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return np.diff(before[a.indptr])


def entries(m: Rows, first_row: int, first_column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    return rows + first_row, m.indices + first_column, m.data


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token of a, token of b, shared bytes) of all links, for tokens that end at these bytes."""
    start_a, start_b = (np.concatenate([[0], ends[:-1]]) for ends in (ends_a, ends_b))
    at = 0
    while at < len(ends_a):
        to = max(at + 1, int(np.searchsorted(ends_a, start_a[at] + block, side="right")))
        low, high = int(start_a[at]), int(ends_a[to - 1])
        first, last = int(np.searchsorted(ends_b, low, side="right")), int(np.searchsorted(ends_b, high)) + 1
        within = np.minimum(ends_b[first:last], high) - np.maximum(start_b[first:last], low)
        a = Rows(np.concatenate([[0], ends_a[at:to] - low]), np.arange(high - low), high - low)
        b = Rows(np.arange(high - low + 1), np.repeat(np.arange(len(within)), within), len(within))
        yield entries(product(a, b), at, first)
        at = to


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of its group; a group ends where tokens of both end."""
    out = []
    for own, other in ((ends_a, ends_b), (ends_b, ends_a)):
        place = np.searchsorted(other, own)
        closes = other[np.minimum(place, len(other) - 1)] == own if len(other) else np.zeros(len(own), dtype=bool)
        out.append(np.concatenate([[0], np.cumsum(closes)[:-1]]) if len(own) else np.zeros(0, dtype=np.int64))
    return out[0], out[1]


def group_matrices(group_a: np.ndarray, group_b: np.ndarray) -> tuple[Rows, Rows]:
    """Tokens of a by groups, and groups by tokens of b."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    return (Rows(np.arange(len(group_a) + 1), group_a, n),
            Rows(np.searchsorted(group_b, np.arange(n + 1)), np.arange(len(group_b)), len(group_b)))


def group_links(group_a: np.ndarray, group_b: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token of a, token of b, 1) of all pairs in one group; a block ends with the row with which it is full."""
    a, b = group_matrices(group_a, group_b)
    before = np.concatenate([[0], np.cumsum(row_sizes(a, b))])
    at = 0
    while at < len(group_a):
        to = max(at + 1, int(np.searchsorted(before, before[at] + block, side="right")) - 1)
        part = Rows(a.indptr[at:to + 1] - a.indptr[at], a.indices[a.indptr[at]:a.indptr[to]], a.columns)
        yield entries(product(part, b), at, 0)
        at = to


# ---- tokenizers ----

#: Texts with characters from U+0400 on, other than common marks, go to the slower of two libraries with the same vocabulary,
#: so that no difference between their tables of characters counts.
_LATER = re.compile("[Ѐ-῿⁀-\U0010ffff]")


class ByteTokenizer:
    """Byte-level pairs: ids and their bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.bytes: list[bytes] = [b""] * self.exact.get_vocab_size(with_added_tokens=True)
        special = {token.content for token in self.exact.get_added_tokens_decoder().values()}
        for token, nr in self.exact.get_vocab(with_added_tokens=True).items():
            self.bytes[nr] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        ranks = {b: nr for nr, b in enumerate(self.bytes) if self.exact.id_to_token(nr) not in special}
        self.fast = tiktoken.Encoding("pairs", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _LATER.search(text):
            return np.array(self.exact.encode(" " + text, add_special_tokens=False).ids, dtype=np.int64)
        return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte: itself if it can be seen, else one from 256 on, in the order of the bytes."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceTokenizer:
    """Pieces with single bytes for what no piece covers: ids and their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(nr) else piece.replace("▁", " ").encode()
            for nr, piece in ((nr, self.model.id_to_piece(nr)) for nr in range(self.model.get_piece_size()))]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)


class Pair:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.length_a, self.length_b = (np.array(list(map(len, t.bytes)), dtype=np.int64) for t in (self.a, self.b))
        self.shift = max(1, (len(self.b.bytes) - 1).bit_length())
        n, m = len(self.a.bytes), len(self.b.bytes)
        #: how ids are written: those of a, within and at the end of their group's part, then those of b
        self.written = pa.array(
            [f"{k}," for k in range(n)] + [f"{k}|" for k in range(n)] + [f"{k}," for k in range(m)] + [f"{k};" for k in range(m)],
            pa.large_string())

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a and b; none if either doesn't give the bytes of blank and text back."""
        none = np.zeros(0, dtype=np.int64)
        if not text:
            return none, none
        a, b = self.a.ids(text), self.b.ids(text)
        raw = b" " + text.encode()
        for ids, tokenizer in ((a, self.a), (b, self.b)):
            if b"".join(map(tokenizer.bytes.__getitem__, ids.tolist())) != raw:
                return none, none
        return a, b


@lru_cache(2)
def pair(path_a: str, path_b: str) -> Pair:
    """One for each Python worker, kept over its tasks."""
    return Pair(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- a chunk of texts ----


@dataclass
class Aligned:
    """The tokens of a chunk of texts, one text after another, and where each text's begin, with the end behind."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    @property
    def doc_a(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first_a) - 1), np.diff(self.first_a))


def aligned(texts: list[str | None], by: Pair) -> Aligned:
    found = [by.ids(text) for text in texts]
    a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *(f[k] for f in found)]) for k in (0, 1))
    first_a, first_b = (np.concatenate([[0], np.cumsum([len(f[k]) for f in found], dtype=np.int64)]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(by.length_a[a]), np.cumsum(by.length_b[b])
    return Aligned(a, b, first_a, first_b, ends_a, ends_b, *groups(ends_a, ends_b))


def group_digests(x: Aligned, by: Pair) -> list[str]:
    """For each text the digest of its groups, ids of a, a bar, ids of b, groups apart by semicolons; '' without tokens."""
    n, m = len(by.a.bytes), len(by.b.bytes)
    last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else np.zeros(0, dtype=bool) for g in (x.group_a, x.group_b))
    codes = np.zeros(len(x.a) + len(x.b), dtype=np.int64)
    codes[np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a)] = x.a + n * last_a
    codes[np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, side="right")] = 2 * n + x.b + m * last_b
    data, offsets = text_bytes(by.written.take(pa.array(codes)))
    raw, cut = memoryview(data), offsets[x.first_a + x.first_b].tolist()
    return [hashlib.sha256(raw[low:high - 1]).hexdigest() if high > low else "" for low, high in zip(cut, cut[1:])]


STAGE = (
    "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_group_links bigint, "
    "groups_sha256 string, pairs binary, times binary, is_chunk boolean")
_STAGE_TYPES = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.bool_()]


def chunk_rows(chunk: int, doc_ids: list[int | None], texts: list[str | None], by: Pair) -> pa.RecordBatch:
    """One row per text, with its pairs as numbers of the chunk's pairs and how often each is linked; and one row for the chunk,
    with its pairs in order and how many of its texts hold each."""
    x = aligned(texts, by)
    n, doc = len(texts), x.doc_a
    keys, n_links = [], np.zeros(n, dtype=np.int64)
    pairs_of = 1 << (len(by.a.bytes) - 1).bit_length() + by.shift
    for i, j, _ in overlap_links(x.ends_a, x.ends_b):
        n_links += np.bincount(doc[i], minlength=n)
        keys.append(np.unique(doc[i] * pairs_of + (x.a[i] << by.shift | x.b[j]), return_counts=True))
    found, times = (np.concatenate([np.zeros(0, dtype=np.int64), *(k[c] for k in keys)]) for c in (0, 1))
    if len(keys) > 1:  # a text may go on in the next block
        found, back = np.unique(found, return_inverse=True)
        times = np.bincount(back, weights=times, minlength=len(found)).astype(np.int64)
    pairs, nr, held = np.unique(found % pairs_of, return_inverse=True, return_counts=True)
    cut = np.searchsorted(found, np.arange(n + 1) * pairs_of).tolist()
    nr_raw, times_raw = (memoryview(v.astype("<u4").tobytes()) for v in (nr, times))
    group_before = np.concatenate([[0], np.cumsum(np.concatenate([x.group_a[1:] != x.group_a[:-1], [True]]))]) if len(x.a) else np.zeros(1, dtype=np.int64)
    linked_before = np.concatenate([[0], np.cumsum(row_sizes(*group_matrices(x.group_a, x.group_b)))])
    columns = [
        [chunk] * (n + 1), [*doc_ids, None], [*np.diff(x.first_a).tolist(), None], [*np.diff(x.first_b).tolist(), None],
        [*np.diff(group_before[x.first_a]).tolist(), None], [*n_links.tolist(), None],
        [*np.diff(linked_before[x.first_a]).tolist(), None], [*group_digests(x, by), None],
        [*(bytes(nr_raw[4 * a:4 * b]) for a, b in zip(cut, cut[1:])), pairs.astype("<u8").tobytes()],
        [*(bytes(times_raw[4 * a:4 * b]) for a, b in zip(cut, cut[1:])), held.astype("<u8").tobytes()],
        [False] * n + [True]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _STAGE_TYPES)], names=[c.split()[0] for c in STAGE.split(", ")])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _chunk_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, pairs, held in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "times"))):
            own = np.frombuffer(pairs, "<u8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(np.frombuffer(held, "<u8").astype(np.int64))],
                names=["chunk", "pair", "n"])


# ---- over all documents ----


def prepared(docs: DataFrame, paths: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The written rows of all texts and chunks."""
    a, b = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, chunk = pair(a, b), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", chunk_bytes):
                yield chunk_rows(chunk, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), by)
                chunk += 1

    return written(_texts(docs).mapInArrow(run, STAGE), "alignment", ("is_chunk",))


def pair_counts(rows: DataFrame, shift: int) -> DataFrame:
    """For each linked pair of ids: pair, n (documents that hold it), best (no other pair of its first id has more)."""
    in_chunks = rows.filter("is_chunk").select("chunk", "pairs", "times").mapInArrow(_chunk_pairs, "chunk bigint, pair bigint, n bigint")
    counts = written(in_chunks.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    first = F.shiftright("pair", shift).alias("a")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", shift)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


REPORT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string, n_group_links bigint")


def report(docs: DataFrame, paths: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: the numbers of its tokens, groups and links, and what the whole corpus says of its links."""
    paths = paths or default_paths()
    rows = prepared(docs, paths, chunk_bytes)
    counts = written(pair_counts(rows, pair(*paths).shift), "pair_best")
    in_chunks = rows.filter("is_chunk").select("chunk", "pairs", "times").mapInArrow(_chunk_pairs, "chunk bigint, pair bigint, n bigint")
    known = in_chunks.select("chunk", "pair").join(counts, "pair").select("chunk", "pair", "n", "best")

    def told(own: pa.Table, of_chunk: pa.Table) -> pa.Table:
        order = np.argsort(of_chunk.column("pair").to_numpy())
        n, best = of_chunk.column("n").to_numpy()[order], of_chunk.column("best").to_numpy()[order]
        pairs, times = own.column("pairs").to_pylist(), own.column("times").to_pylist()
        nr, often = (np.frombuffer(b"".join(v), "<u4").astype(np.int64) for v in (pairs, times))
        cut = np.concatenate([[0], np.cumsum([len(p) // 4 for p in pairs], dtype=np.int64)]).astype(np.int64)

        def sums(values: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[cut]), pa.int64())

        held = n[nr] if len(nr) else np.zeros(0, dtype=np.int64)
        is_best = best[nr].astype(bool) if len(nr) else np.zeros(0, dtype=bool)
        return pa.table(
            [*(own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), sums(often * is_best), sums(often * held),
             own.column("groups_sha256"), own.column("n_group_links")], names=[c.split()[0] for c in REPORT.split(", ")])

    documents = rows.filter("not is_chunk").select(
        "chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "pairs", "times")
    return documents.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(told, REPORT)


LINKS = "doc_id bigint, place_a bigint, place_b bigint, id_a bigint, id_b bigint, shared bigint"


def links(docs: DataFrame, kind: str = "overlap", paths: tuple[str, str] | None = None) -> DataFrame:
    """All links, one row each: places and ids of both tokens, and the bytes they share. ``kind`` "group" gives the pairs within
    each group, whose ``shared`` is 1."""
    a, b = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = pair(a, b)
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                x = aligned(batch.column("text").to_pylist(), by)
                doc, ids = x.doc_a, batch.column("doc_id")
                found = overlap_links(x.ends_a, x.ends_b) if kind == "overlap" else group_links(x.group_a, x.group_b)
                for i, j, shared in found:
                    own = doc[i]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(own)), *(pa.array(v) for v in (i - x.first_a[own], j - x.first_b[own], x.a[i], x.b[j], shared))],
                        names=[c.split()[0] for c in LINKS.split(", ")])

    return _texts(docs).mapInArrow(run, LINKS)
