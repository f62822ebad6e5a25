"""Token ids of many texts by a tokenizer with word ends that drops white space.

Texts are cut where no token can cross: at blanks, tabs and line feeds, and where letters, digits and marks meet. The distinct pieces of a slice are encoded once and remembered up to a bound; ids of the texts are gathered from theirs.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from custlens.llm.hashing import text_bytes

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[9, 10]] = 32
_LOWERED = _PLAIN.copy()
_LOWERED[65:91] += 32
_LETTER, _DIGIT, _MARK, _APOSTROPHE = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = _MARK
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
#: Second bytes of letters that begin with the byte C3, and of the capitals among them.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_CAPITAL = _LATIN.copy()
_CAPITAL[0x9F:] = False
#: Two successive kinds between which a blank changes nothing: the tokenizer cuts letters, single digits, and runs of other
#: signs apart, but an apostrophe may belong to the letters behind it.
_CUT = np.zeros((5, 5), dtype=bool)
_CUT[1:, 1:] = ~np.eye(4, dtype=bool)
_CUT[_DIGIT, _DIGIT] = True
_CUT[_APOSTROPHE, _LETTER] = _CUT[_MARK, _APOSTROPHE] = _CUT[_APOSTROPHE, _MARK] = False
#: The same as tables for ``translate``, which needs no index arrays.
_PLAIN_BYTES, _LOWERED_BYTES, _KIND_BYTES = _PLAIN.tobytes(), _LOWERED.tobytes(), _KIND.tobytes()
_CUT_BYTES = _CUT.tobytes().ljust(256, b"\0")  # at 5 * kind + next kind
#: Pieces that are one word for the tokenizer, already in its form.
_WORD = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


def prepared(texts: pa.Array) -> pa.Array:
    """The texts with blanks for tabs and line feeds, capitals of plain Latin letters lowered, and blanks where letters,
    digits and marks meet.

    The ids are the same, and there are fewer different pieces. Texts in which the strings of special tokens may occur, or
    a capital sigma, which is lowered by what stands around it, get blanks for tabs and line feeds only.
    """
    raw, offsets = text_bytes(texts)
    whole = raw.tobytes()
    if b"<|" in whole or b"\xce\xa3" in whole:
        data = np.frombuffer(whole.translate(_PLAIN_BYTES), dtype=np.uint8)
    else:
        lowered = bytearray(whole.translate(_LOWERED_BYTES))
        kinds = bytearray(lowered.translate(_KIND_BYTES))
        data, kind = np.frombuffer(lowered, dtype=np.uint8), np.frombuffer(kinds, dtype=np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        data[lead[_CAPITAL[second]] + 1] += 32
        letters = lead[_LATIN[second]]
        kind[letters] = kind[letters + 1] = _LETTER
        both = kind[:-1] * np.uint8(5) + kind[1:]
        at = np.flatnonzero(np.frombuffer(both.tobytes().translate(_CUT_BYTES), dtype=bool)) + 1
        if len(at):
            data = np.insert(data, at, 32)
            offsets = offsets + np.searchsorted(at, offsets)
    return pa.Array.from_buffers(
        pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)])


class Encoder:
    #: Remembered pieces; beyond, the memory starts anew.
    MOST = 500_000
    PER_LINE = 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of a worker keep memory each
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.of_words = Tokenizer(self.tokenizer.model)  # for words in the tokenizer's own form, cut at blanks
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        is_word = _WORD.fullmatch
        words = [p for p in pieces if is_word(p) and "<|" not in p]
        for at in range(0, len(words), 50 * self.PER_LINE):
            some = words[at:at + 50 * self.PER_LINE]
            lines = [" ".join(some[k:k + self.PER_LINE]) for k in range(0, len(some), self.PER_LINE)]
            encoded = self.of_words.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in encoded])
            stops = np.flatnonzero(self.is_end[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("a word has no end in this vocabulary")
            raw, start = ids.tobytes(), 0
            for piece, stop in zip(some, (4 * stops).tolist()):
                self.known[piece] = raw[start:stop]
                start = stop
        if len(words) < len(pieces):
            for piece in pieces:
                if piece not in self.known:
                    self.known[piece] = np.array(self._ids(piece), dtype="<u4").tobytes()

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as one array, and where each text's begin, with the end behind; ``end`` closes each text."""
        cut = pc.split_pattern(prepared(texts), " ")
        words = cut.flatten().dictionary_encode()
        pieces = words.dictionary.to_pylist()
        missing = [p for p in pieces if p not in self.known]
        if missing:
            if len(self.known) + len(missing) > self.MOST:
                self.known = {"": b""}
                missing = [p for p in pieces if p]
            self._learn(missing)
        coded = pa.array(map(self.known.__getitem__, pieces), pa.large_binary(), size=len(pieces))
        all_ids = coded.take(words.indices)  # their bytes stand one behind the other
        _, starts, raw = all_ids.buffers()
        until = np.frombuffer(starts, dtype=np.int64, count=len(all_ids) + 1) // 4
        out = np.frombuffer(raw, dtype="<u4", count=until[-1]) if until[-1] else np.empty(0, dtype="<u4")
        offsets = until[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        if end is not None:
            out = np.insert(out, offsets[1:], np.uint32(end))
            offsets = offsets + np.arange(len(offsets))
        return out, offsets


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept over its tasks."""
    return Encoder(path)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
