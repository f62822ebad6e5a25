"""Token ids in files that give any token without decoding a block: directly addressable codes.

An id is cut into chunks of bits, the lowest first. Level 1 holds the first chunk of every id, one after another at a fixed
width, and a bitmap that tells which ids go on; level 2 holds the second chunk of those, and so on. The place of an id in the
next level is the number of bits set before it, which a directory of counts per 512 bits and one count inside such a run give.
So a token costs a few short reads, and the tokens of a document a few ranges. Widths are chosen for each file by its numbers
of ids of each bit length, for the least bits in all.

Documents are dealt by ranges of their id, so that files in the order of their tasks hold ascending ids; a task writes a file
whenever it has ``FILE_TOKENS``. Names of files are new for each attempt and the manifest, a Parquet table that Spark commits,
names those of the attempts that count: a task that runs again leaves no token twice.

Layout of a file, little-endian, parts at multiples of 8 bytes: magic, number of levels, of documents, of tokens; for each
level its width, number of chunks and the places of its chunks, bitmap and directory; the documents' ids, a bitmap of missing
ids, and where each document begins, with the end behind.

Defined results: a missing or empty text is the end token alone; rows without id come first; rows with one id are in the order
of their texts' digests, repeated rows are documents of their own; an empty table gives no file and an empty result; other
columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlens.functions.stages import new_path
from custlens.llm.common import slices
from custlens.llm.tokens import encoder, word_tokenizer

END = 2
MAGIC = b"TOKENDAC"
RANK_BITS = 512
#: Ids gathered before a file is written, and the width of the buckets in which positions find their file.
FILE_TOKENS = 8_000_000
_HEAD, _LEVEL, _DOCS = struct.Struct("<8sQQQ"), struct.Struct("<QQQQQ"), struct.Struct("<QQQ")
_BLOCK = 1 << 18  # ids coded at once, a multiple of 8
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


# ---- codes ----


def best_widths(n_of_bits: np.ndarray) -> list[int]:
    """The widths of the levels that take the least bits; ``n_of_bits[b]`` ids have b bits."""
    most = max(1, int(np.flatnonzero(n_of_bits)[-1]) if n_of_bits.any() else 1)
    longer = np.concatenate([np.cumsum(n_of_bits[::-1])[::-1], [0]])  # ids of at least b bits
    best: dict[int, tuple[int, list[int]]] = {most: (0, [])}
    for start in range(most - 1, -1, -1):
        here = int(longer[start + 1] if start else n_of_bits.sum())
        best[start] = min(
            (here * (stop - start + (stop < most)) + best[stop][0], [stop - start, *best[stop][1]]) for stop in range(start + 1, most + 1))
    return best[0][1]


def packed(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of all values, one after another."""
    shift = np.arange(width, dtype=np.uint32)
    return b"".join(
        np.packbits(((values[a:a + _BLOCK, None] >> shift) & np.uint32(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        for a in range(0, len(values), _BLOCK))


def encoded(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, widths: list[int] | None = None) -> bytes:
    """A whole file. ``starts``: where each document begins, with the end behind."""
    if widths is None:
        widths = best_widths(np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=33))
    if sum(widths) < 32 and len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError(f"an id needs more than {sum(widths)} bits")
    parts: list[bytes] = []
    at = _HEAD.size + _LEVEL.size * len(widths) + _DOCS.size

    def put(data: bytes) -> int:
        nonlocal at
        here, fill = at, -len(data) % 8
        parts.append(data + bytes(fill))
        at += len(data) + fill
        return here

    levels, values = [], ids.astype(np.uint32)
    for nr, width in enumerate(widths):
        chunks, count = put(packed(values, width)), len(values)
        if nr == len(widths) - 1:
            levels.append((width, count, chunks, 0, 0))
            break
        rest = values >> np.uint32(width) if width < 32 else np.zeros_like(values)
        goes_on = rest > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[bitmap], dtype=np.int64)])
        levels.append((width, count, chunks, put(bitmap.tobytes()), put(ones[::RANK_BITS // 8].astype("<u8").tobytes())))
        values = rest[goes_on]
    missing = np.array([d is None for d in doc_ids], dtype=bool)
    docs = _DOCS.pack(
        put(np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()),
        put(np.packbits(missing, bitorder="little").tobytes()), put(starts.astype("<u8").tobytes()))
    head = _HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)) + b"".join(_LEVEL.pack(*x) for x in levels) + docs
    return head + b"".join(parts)


class TokenFile:
    """A file through ``read(offset, size)``; only what is asked for is read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, levels, self.n_docs, self.n_tokens = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        more = read(_HEAD.size, _LEVEL.size * levels + _DOCS.size)
        self.levels = [_LEVEL.unpack_from(more, k * _LEVEL.size) for k in range(levels)]
        self.docs_at = _DOCS.unpack_from(more, levels * _LEVEL.size)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and where each begins, with the end behind."""
        ids = np.frombuffer(self.read(self.docs_at[0], 8 * self.n_docs), "<i8").tolist()
        missing = np.unpackbits(np.frombuffer(self.read(self.docs_at[1], -(-self.n_docs // 8)), np.uint8), bitorder="little")
        starts = np.frombuffer(self.read(self.docs_at[2], 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        return [None if gone else d for d, gone in zip(ids, missing)], starts

    def _bits(self, at: int, first: int, last: int) -> np.ndarray:
        low = first // 8
        raw = np.frombuffer(self.read(at + low, -(-last // 8) - low), np.uint8)
        return np.unpackbits(raw, bitorder="little")[first - 8 * low:last - 8 * low]

    def _rank(self, level: tuple, place: int) -> int:
        """The number of bits set before ``place``."""
        _, _, _, bitmap, ranks = level
        run = place // RANK_BITS
        before = int.from_bytes(self.read(ranks + 8 * run, 8), "little")
        return before + int(self._bits(bitmap, run * RANK_BITS, place).sum())

    def tokens(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to, not including, ``last``."""
        if not 0 <= first <= last <= self.n_tokens:
            raise IndexError("no such tokens")
        out = np.zeros(last - first, dtype=np.uint32)
        open_, shift = np.arange(last - first), 0
        for level in self.levels:
            if first == last:
                break
            width = level[0]
            bits = self._bits(level[2], first * width, last * width).reshape(-1, width)
            out[open_] |= (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32) << np.uint32(shift)
            if level[3] == 0:
                break
            goes_on = self._bits(level[3], first, last).astype(bool)
            first = self._rank(level, first)
            last, open_, shift = first + int(goes_on.sum()), open_[goes_on], shift + width
        return out

    def token(self, place: int) -> int:
        return int(self.tokens(place, place + 1)[0])


# ---- files ----


def store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder, and its path there; for executors, which reach the shared folder by its address."""
    if "://" not in folder and not folder.startswith("file:"):
        return arrow_fs.LocalFileSystem(), folder
    if folder.startswith("s3a://"):
        folder = "s3://" + folder[6:]
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return arrow_fs.FileSystem.from_uri(folder)


MANIFEST = "part int, seq int, path string, n_docs bigint, n_tokens bigint"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the token files of all documents below ``folder`` and returns their manifest."""
    path = tokenizer or word_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, (files, place) = TaskContext.get().partitionId(), 0, store(folder)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            files.create_dir(f"{place}/files", recursive=True)
            with files.open_output_stream(f"{place}/files/{name}") as out:
                out.write(encoded(np.concatenate(ids), doc_ids, starts))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "path": f"files/{name}", "n_docs": len(doc_ids), "n_tokens": int(starts[-1])}],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()),
                                  ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found, offsets = encoder(path).ids(batch.column("text"), end)
                own, at = batch.column("doc_id").to_pylist(), 0
                while at < len(own):  # up to the document with which a file is full
                    to = min(len(own), int(np.searchsorted(offsets, offsets[at] + file_tokens - held)))
                    ids.append(found[offsets[at]:offsets[to]])
                    sizes.append(np.diff(offsets[at:to + 1]))
                    doc_ids += own[at:to]
                    held, at = held + len(ids[-1]), to
                    if held >= file_tokens:
                        yield flush()
                        doc_ids, ids, sizes, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    by = [F.asc_nulls_first("doc_id"), F.col("digest"), F.col("tie")]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.select("*", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("tie"))
    placed = dealt.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(run, MANIFEST)
    placed.write.parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: path, n_docs, n_tokens, and start, the tokens of all files before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before, total = {}, 0  # one number for each range, as many as shuffle partitions at most
    for row in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        before[row["part"]], total = total, total + row["n"]
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    of_part = spark.createDataFrame(list(before.items()), "part int, before bigint")
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(F.broadcast(of_part), "part").select(
        "path", "n_docs", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def opened(folder: str, path: str) -> tuple[pa.NativeFile, TokenFile]:
    files, place = store(folder)
    source = files.open_input_file(f"{place}/{path}")
    return source, TokenFile(lambda at, size: source.read_at(size, at))


def report(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                source, file = opened(folder, path)
                with source:
                    docs, starts = file.documents()
                    checks: list[int] = []
                    at = 0
                    while at < len(docs):  # documents of about one block at once
                        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK, side="right")) - 1)
                        raw = file.tokens(int(starts[at]), int(starts[to])).astype("<u4").tobytes()
                        cut = (4 * (starts[at:to + 1] - starts[at])).tolist()
                        checks += [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])]
                        at = to
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(base + starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()),
                     pa.array(checks, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest(spark, folder).select("path", "start")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame, width: int = FILE_TOKENS) -> DataFrame:
    """``positions`` (position, from 0 over all documents) with the token there; positions beyond the end are left out.

    A position meets its file by the bucket it falls into and the file's first and last token; each file is then read at its
    positions only.
    """
    files = manifest(spark, folder).filter("n_tokens > 0").select(
        "path", F.col("start").alias("from"), (F.col("start") + F.col("n_tokens")).alias("to"),
        F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + n_tokens - 1) div {width}"))).alias("bucket"))
    asked = positions.select(F.col("position").cast("bigint").alias("position")).withColumn("bucket", F.expr(f"position div {width}"))
    met = asked.join(files, "bucket").filter((F.col("position") >= F.col("from")) & (F.col("position") < F.col("to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, file = None, None, None
        for batch in batches:
            out = []
            for position, path, base in zip(*(batch.column(c).to_pylist() for c in ("position", "path", "from"))):
                if path != now:
                    if source is not None:
                        source.close()
                    now, (source, file) = path, opened(folder, path)
                out.append(file.token(position - base))
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(out, pa.int64())], names=["position", "token"])
        if source is not None:
            source.close()

    return met.select("position", "path", "from").sortWithinPartitions("path", "position").mapInArrow(
        run, "position bigint, token bigint")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files into the shared folder and reports what they hold."""
    spark = docs.sparkSession
    folder = new_path(spark, "token_files")
    write(docs, folder, tokenizer)
    return report(spark, folder)
