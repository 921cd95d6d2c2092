"""Word rules that several operators share."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of licence, benchmark and decontamination operators, as a regular expression of Spark, DuckDB and Python.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lowering, as a plain union: Java matches it many times faster than a negated one.
JAVA_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"

_word_bytes = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def lower_ascii(text: str) -> bytes:
    """UTF-8 of ``text`` with only A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower()


def words_of(text: str | None) -> list[bytes]:
    """The words of :data:`WORD` after lowering A-Z, as UTF-8 (every byte of a non-ASCII character is a word byte)."""
    return _word_bytes(lower_ascii(text)) if text else []


class WordHashes(dict):
    """64-bit hash of a word, with the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
