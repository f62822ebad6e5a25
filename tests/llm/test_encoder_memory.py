"""Memory of the encoding of texts in a worker: one thread, and batches of bounded size."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa

from custlens.llm import packing
from custlens.llm.common import ARROW_BYTES_CONF, arrow_bytes
from custlens.llm.tokens import Encoder, word_tokenizer

THREADS = """
import os
import pyarrow as pa
from custlens.llm.tokens import Encoder, word_tokenizer
encoder = Encoder(word_tokenizer())
before = len(os.listdir("/proc/self/task"))
encoder.ids(pa.array([" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17576))]))
print(len(os.listdir("/proc/self/task")) - before)
"""


def test_a_worker_encodes_in_one_thread():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    done = subprocess.run(
        [sys.executable, "-c", THREADS], cwd=Path(__file__).resolve().parents[2], env=env, capture_output=True, text=True, check=True)
    assert int(done.stdout) == 0


def test_ids_of_odd_texts_are_those_of_the_tokenizer():
    texts = ["", "\t\n", "A", "it's 2x", "<|endoftext|> B", "ΟΔΟΣ Σ", "ÀÉ×÷ß", "à 　b", "", "x" * 5000, "'s ''t .'d"]
    encoder = Encoder(word_tokenizer())
    for some in [texts, [""], ["", ""], [], texts[:5], texts[6:]]:
        ids, offsets = encoder.ids(pa.array(some, pa.string()), 1)
        expected = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in some]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected


def test_workers_get_batches_of_bounded_bytes(spark, monkeypatch):
    docs = spark.range(64).selectExpr("id AS doc_id", "repeat('word ', 50000) AS text").coalesce(1)
    before, seen = spark.conf.get(ARROW_BYTES_CONF), []
    write = packing.written

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)

    def watched(df, name):
        if name == "pieces":
            seen.extend(r.n for r in docs.mapInArrow(sizes, "n bigint").collect())
        return write(df, name)

    monkeypatch.setattr(packing, "written", watched)
    assert packing.packed(docs).count() > 64
    assert sum(seen) > 64 * 250_000 and max(seen) < 2 * packing.BATCH_BYTES
    assert spark.conf.get(ARROW_BYTES_CONF) == before


def test_the_limit_of_batches_ends_with_an_error(spark):
    before = spark.conf.get(ARROW_BYTES_CONF)
    try:
        with arrow_bytes(spark, 1000):
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(ARROW_BYTES_CONF) == before
