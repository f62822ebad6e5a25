"""Token alignment against a plain version, and the matrix products against NumPy's."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from custlens.llm import alignment
from tests.llm import cases


@pytest.fixture(scope="module")
def by():
    return alignment.pair(*alignment.default_paths())


def plain_tokens(by, text):
    """Ids and the bytes that each covers, by the libraries that the vocabularies are for."""
    if not text:
        return [], [], [], []
    a = by.a.exact.encode(" " + text, add_special_tokens=False).ids
    b = by.b.model.encode(text)
    raw = (" " + text).encode()
    if b"".join(by.a.bytes[i] for i in a) != raw or b"".join(by.b.bytes[i] for i in b) != raw:
        return [], [], [], []

    def spans(ids, table):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(table[i])))
            at += len(table[i])
        return out

    return a, b, spans(a, by.a.bytes), spans(b, by.b.bytes)


def plain_links(by, text):
    a, b, sa, sb = plain_tokens(by, text)
    out, low = [], 0
    for i, (x, y) in enumerate(sa):
        while low < len(sb) and sb[low][1] <= x:
            low += 1
        j = low
        while j < len(sb) and sb[j][0] < y:
            out.append((i, j, a[i], b[j], min(y, sb[j][1]) - max(x, sb[j][0])))
            j += 1
    return out


def plain_groups(by, text):
    a, b, sa, sb = plain_tokens(by, text)
    both = sorted({y for _, y in sa} & {y for _, y in sb})
    out, low = [], 0
    for end in both:
        out.append(([i for i, (x, y) in zip(a, sa) if low <= x and y <= end], [i for i, (x, y) in zip(b, sb) if low <= x and y <= end]))
        low = end
    return out


def plain_report(by, rows):
    links = [plain_links(by, t) for _, t in rows]
    held = Counter(p for own in links for p in {(x[2], x[3]) for x in own})
    most: dict = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (doc, text), own in zip(rows, links):
        a, b, _, _ = plain_tokens(by, text)
        groups = plain_groups(by, text) if len(a) < 3000 else None
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) if groups is not None else None
        counts = [held[x[2], x[3]] for x in own]
        out.append((
            doc, len(a), len(b), None if groups is None else len(groups), len(own), sum(held[x[2], x[3]] == most[x[2]] for x in own),
            sum(counts), None if said is None else cases.sha(said.encode()) if said else "",
            None if groups is None else sum(len(x) * len(y) for x, y in groups)))
    return out


TEXTS = [
    "Hello world", " ", "  two  blanks ", "<|endoftext|> and <s> </s> <unk> are text", "a▁b", "▁", "日本語 текст 👍🏽", "tab\tand\nline\r\n",
    "x" * 300, "\x00\x01", "don't I'LL", "naïve café — “quoted” …", "1234567890 3.14", "ﬁ ½ ² İ", "\x1c\x85\xa0 x", "�",
]


def test_report_on_odd_rows(spark, by):
    rows = cases.odd_rows() + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(100, TEXTS[0])] * 3
    for size in (1 << 22, 2000):
        got = [tuple(r) for r in alignment.report(cases.frame(spark, rows), chunk_bytes=size).collect()]
        want = plain_report(by, rows)
        assert len(got) == len(want)
        short = [w for w in want if w[3] is not None]
        long = [w for w in want if w[3] is None]
        left = list(got)
        for w in short:
            left.remove(w)
        assert sorted((g[0], g[1], g[2], g[4], g[5], g[6]) for g in left) == sorted((w[0], w[1], w[2], w[4], w[5], w[6]) for w in long)
    assert {g[0]: g[1:] for g in got}[47] == (0, 0, 0, 0, 0, 0, "", 0)


def test_empty(spark):
    assert alignment.report(cases.frame(spark, []).limit(0)).count() == 0


def test_links(spark, by):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    got = alignment.links(cases.frame(spark, rows)).collect()
    cases.same(got, [(doc, *x) for doc, t in rows for x in plain_links(by, t)])
    got = alignment.links(cases.frame(spark, rows), "group").collect()
    want = []
    for doc, t in rows:
        i = j = 0
        for x, y in plain_groups(by, t):
            want += [(doc, i + p, j + q, x[p], y[q], 1) for p in range(len(x)) for q in range(len(y))]
            i, j = i + len(x), j + len(y)
    cases.same(got, want)


def test_both_libraries_agree(by):
    """The fast one is used for texts below U+0400 and common marks only; there it gives the same ids."""
    rng = random.Random(8)
    signs = "aZé×Σʰ͵ĸſ 's'll\t\n\r\x0b\x0c\x1c\x85\xa0  ​  ’…—1²½¼ª<|>_-.,́ͰϿ"
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 25)))
        assert alignment._LATER.search(text) is None
        assert by.a.ids(text).tolist() == by.a.exact.encode(" " + text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_product(n, k, m, rng):
    a = np.array([[rng.randrange(2) for _ in range(k)] for _ in range(n)]).reshape(n, k)
    b = np.array([[rng.randrange(2) for _ in range(m)] for _ in range(k)]).reshape(k, m)

    def rows(x):
        return alignment.Rows(np.concatenate([[0], np.cumsum(x.sum(axis=1, dtype=np.int64))]).astype(np.int64), np.nonzero(x)[1], x.shape[1])

    got = alignment.product(rows(a), rows(b))
    dense = np.zeros((n, m), dtype=np.int64)
    for r in range(n):
        for c, v in zip(got.indices[got.indptr[r]:got.indptr[r + 1]], got.data[got.indptr[r]:got.indptr[r + 1]]):
            dense[r, c] = v
    assert (dense == a @ b).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 30))
def test_blocks_change_nothing(a, b, block):
    total = max(sum(a), sum(b))
    a, b = [*a, *([total - sum(a)] * (total > sum(a)))], [*b, *([total - sum(b)] * (total > sum(b)))]
    ends = np.cumsum(a), np.cumsum(b)

    def joined(parts):
        parts = list(parts)
        return [np.concatenate([p[c] for p in parts]).tolist() for c in range(3)]

    assert joined(alignment.overlap_links(*ends, block)) == joined(alignment.overlap_links(*ends))
    assert sum(joined(alignment.overlap_links(*ends))[2]) == total
    groups = alignment.groups(*ends)
    assert joined(alignment.group_links(*groups, block)) == joined(alignment.group_links(*groups))
