"""The n-gram join where many texts share a template."""

from __future__ import annotations

import random

import numpy as np
import pytest

from custlens.llm import ngram_join
from tests.llm import cases


@pytest.mark.parametrize("n, percent", [(3, 90), (2, 60)])
def test_large_keys_lose_no_link(spark, monkeypatch, n, percent):
    """Every key counts as large, blocks and slices hold two sets, and chunks a few."""
    monkeypatch.setattr(ngram_join, "FEW", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "CHUNK_HASHES", 200)
    rng = random.Random(percent)
    rows = list(cases.odd_rows())
    for family in range(6):
        base = [f"w{family}x{k}" for k in range(rng.randrange(12, 60))]
        for k in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(6)}"
            rows.append((1000 + family * 100 + k, " ".join(own[:len(own) - rng.randrange(0, 3)])))
    assert sorted(map(repr, ngram_join.linked(cases.frame(spark, rows), n, percent).collect())) == sorted(
        map(repr, [_row(r) for r in cases.components(rows, n, percent)]))


def _row(values):
    from pyspark.sql import Row

    return Row(doc_id=values[0], n_shingles=values[1], component_id=values[2])


@pytest.mark.parametrize("words", [12, 40])
def test_an_unlinked_template(spark, monkeypatch, words):
    """Texts of one template that are not linked: what is compared grows with the texts, not with their pairs."""
    made = []
    original = ngram_join.candidate_pairs

    def counted(*args, **kwargs):
        pairs = original(*args, **kwargs)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_join, "candidate_pairs", counted)
    template = [f"word{k}" for k in range(words)]
    own = 1 if words == 12 else 5
    rows = [(k, " ".join([*template[:-own], *(f"own{k}x{j}" for j in range(own))])) for k in range(2000)]
    rows += [(5000 + k, rows[k][1]) for k in range(50)]
    found = ngram_join.linked(cases.frame(spark, rows), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: k % 5000 for k, _ in rows}
    assert sum(made) < 3 * len(rows)


@pytest.mark.parametrize("n", [1, 20, 1000, 100_000])
def test_points_are_packed_without_loss(n):
    values = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    heavy = np.append(values, np.full(300, 7, np.uint64))  # a count above a byte
    for some in (values, heavy):
        want = ngram_join.point(some)
        assert (ngram_join.unpacked([ngram_join.packed(want)] * 2) == want).all()
    assert ngram_join.unpacked([]).shape == (0, ngram_join.DIMENSIONS)
