"""Token files: codes, random access, and the documents read back."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from custlens.functions.stages import new_path
from custlens.llm import token_file, tokens
from tests.llm import cases


@pytest.fixture(scope="module")
def rows():
    return cases.odd_rows()


def plain_ids(texts):
    tokenizer = tokens.encoder(tokens.word_tokenizer()).tokenizer
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def opened(data: bytes) -> token_file.TokenFile:
    return token_file.TokenFile(lambda at, size: data[at:at + size])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=1600), st.sampled_from([None, [8, 8, 16], [1, 31], [32], [3, 4, 5, 6, 14]]))
def test_codes_round_trip(ids, widths):
    file = opened(token_file.encoded(np.array(ids, dtype=np.uint32), [None, 4], np.array([0, len(ids) // 2, len(ids)]), widths))
    assert file.tokens(0, len(ids)).tolist() == ids
    for k in range(0, len(ids), 7):
        assert file.token(k) == ids[k]
    assert file.tokens(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3:len(ids) // 2]
    docs, starts = file.documents()
    assert docs == [None, 4] and starts.tolist() == [0, len(ids) // 2, len(ids)]


def test_a_token_takes_few_bytes():
    """Neither a block nor what stands before it is decoded."""
    ids = np.random.default_rng(1).integers(0, 49408, 200_000).astype(np.uint32)
    data, read = token_file.encoded(ids, [1], np.array([0, len(ids)])), []
    file = token_file.TokenFile(lambda at, size: read.append(size) or data[at:at + size])
    read.clear()
    assert file.token(150_001) == ids[150_001]
    assert sum(read) < 300
    assert len(data) < 2.3 * len(ids)


def test_widths_are_the_best():
    counts = np.zeros(33, dtype=np.int64)
    counts[[3, 9, 16]] = 1000, 500, 20

    def cost(widths):
        total, start = 0, 0
        for k, w in enumerate(widths):
            n = counts.sum() if start == 0 else counts[start + 1:].sum()
            start += w
            total += n * (w + (k < len(widths) - 1))
        return total

    def every(left):
        return [[]] if left == 0 else [[w, *more] for w in range(1, left + 1) for more in every(left - w)]

    assert cost(token_file.best_widths(counts)) == min(cost(w) for w in every(16))
    with pytest.raises(ValueError):
        token_file.encoded(np.array([300], dtype=np.uint32), [1], np.array([0, 1]), [8])


def plain_report(rows):
    def order(k):
        doc, text = rows[k]
        return (doc is not None, doc or 0, cases.hashlib.md5((text or "").encode()).hexdigest())

    ids, out, start = plain_ids([t for _, t in rows]), [], 0
    for k in sorted(range(len(rows)), key=order):
        own = [*ids[k], token_file.END]
        out.append((rows[k][0], start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    return out


def test_round_trip(spark, rows):
    got = token_file.round_trip(cases.frame(spark, rows + [(42, "word " * 3000)] * 5)).collect()
    cases.same(got, plain_report(rows + [(42, "word " * 3000)] * 5))
    assert token_file.round_trip(cases.frame(spark, []).limit(0)).count() == 0


def test_small_files_and_positions(spark, rows):
    folder = new_path(spark, "tokens")
    files = token_file.write(cases.frame(spark, rows), folder, file_tokens=1)
    assert files.count() > 8
    cases.same(token_file.report(spark, folder).collect(), plain_report(rows))
    every = [i for doc in sorted_ids(rows) for i in doc]
    rng = random.Random(2)
    places = [0, len(every) - 1, len(every), *(rng.randrange(len(every)) for _ in range(200))]
    found = token_file.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in places], "position int"), width=500).collect()
    assert sorted((r["position"], r["token"]) for r in found) == sorted((p, every[p]) for p in places if p < len(every))


def sorted_ids(rows):
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0, cases.hashlib.md5((rows[k][1] or "").encode()).hexdigest())
    ids = plain_ids([t for _, t in rows])
    return [[*ids[k], token_file.END] for k in sorted(range(len(rows)), key=order)]


def test_encoder_on_odd_texts():
    import pyarrow as pa

    rng = random.Random(4)
    signs = "aZqéÉßÿ×÷Σσ.,;:!?'\"<|>-_s t\n\t\r\u0301\u030aİ😂<1 2世ﬁ\u200d\xa0"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["", "<|endoftext|> x<|ENDOFTEXT|>y", "it's, don't. '1 .'s", "ΑΣ. ΑΣ,x aΣ.b a.Σ", "x" * 5000, "é,É.Ö", *[t or "" for _, t in cases.odd_rows()]]
    encode = tokens.Encoder(tokens.word_tokenizer())
    encode.MOST = 500
    for chunk in (1, 7, 400):
        for a in range(0, len(texts), chunk if chunk > 1 else 9):
            some = texts[a:a + chunk]
            ids, at = encode.ids(pa.array(some), 7)
            for k, want in enumerate(plain_ids(some)):
                assert ids[at[k]:at[k + 1]].tolist() == [*want, 7], some[k]
