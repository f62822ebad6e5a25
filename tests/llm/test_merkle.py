"""The Merkle manifest against a plain version, and what a proof must tell."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from custlens.llm import merkle
from tests.llm import cases

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, digest string, path string, rank bigint, lo bigint"


def sha(text: str) -> str:
    return cases.sha(text.encode())


def stated(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climbed(own: str, pos: int, tree: list[list[str]]) -> tuple[str, str]:
    proof = ""
    for level in tree[:-1]:
        first = pos // 16 * 16
        left, right = "".join(level[first:pos]), "".join(level[pos + 1:first + 16])
        own, proof, pos = sha(left + own + right), proof + left + right, pos // 16
    return own, proof


def plain(rows: list[tuple]) -> list[tuple]:
    by_source: dict = {}
    for row in rows:
        leaf = sha("".join(map(stated, row)))
        doc, text = row[0], row[4]
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        given = sha("".join(map(stated, (*row[:4], text.translate(cases.LOWER))))) if hit and text is not None else leaf
        by_source.setdefault(row[1], []).append((doc is not None, doc or 0, leaf, given, doc))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([r[2] for r in sorted(own)]) for s, own in by_source.items()}
    top = levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for nr, source in enumerate(order):
        for pos, (_, _, leaf, given, doc) in enumerate(sorted(by_source[source])):
            own, low = climbed(given, pos, trees[source])
            own, high = climbed(own, nr, top)
            out.append((doc, leaf, trees[source][-1][0], root, sha(low + high), own, own == root, source, pos))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, 1) for r in rows], SCHEMA).repartition(5)


def test_report_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None, "", "Ä", "z" * 40]), "en", len(t or ""), t) for i, t in cases.odd_rows()]
    rows += [(1000 + k, "hot", None, k, rng.choice(["Text", "", None, "ünï"])) for k in range(700)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "alone", "en", 4, "Some")]
    cases.same(merkle.report(frame(spark, rows)).collect(), plain(rows))


@pytest.mark.parametrize("n", [1, 16, 257])
def test_sizes_of_one_source(spark, n):
    rows = [(k, "s", "en", 1, f"T{k}") for k in range(n)]
    cases.same(merkle.report(frame(spark, rows)).collect(), plain(rows))


def test_many_sources_and_repeated_rows(spark):
    rows = [(k, f"s{k % 300:03d}", "en", 1, "T") for k in range(600)] + [(7, "s007", "en", 1, "T")] * 400
    cases.same(merkle.report(frame(spark, rows)).collect(), plain(rows))


def test_empty(spark):
    assert merkle.report(frame(spark, []).limit(0)).count() == 0


def test_a_proof_needs_its_own_leaf(spark):
    """Any other leaf with this path gives another root; other columns come through."""
    rows = [(k, "ab"[k % 2], "en", 1, f"T{k}") for k in range(80)]
    leaves = frame(spark, rows).select("doc_id", merkle.tree_key(F.col("source")).alias("tree"), merkle.leaf_digest().alias("digest"), "lang")
    proved = merkle.manifest(merkle.ranked(leaves, ["doc_id"]))
    assert {"doc_id", "lang", "path", "subroot", "root"} <= set(proved.columns)
    check = proved.select(
        (merkle.folded(F.col("digest"), F.col("path")) == F.col("root")).alias("right"),
        (merkle.folded(merkle.digest(F.col("digest"), F.lit("x")), F.col("path")) == F.col("root")).alias("wrong")).collect()
    assert all(r["right"] and not r["wrong"] for r in check)
    assert proved.select("root").distinct().count() == 1
