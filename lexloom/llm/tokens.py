"""Token counts by rank-synchronous array merging.

A batch of distinct pre-tokens is held as one ragged array of symbols.  Each
round looks up the rank of every adjacent pair, takes each sequence's lowest
rank, merges all occurrences of that pair at once and drops sequences that
have nothing left to merge; the symbols that survive are the tokens.  Merging
all occurrences together equals merging them one by one, left to right,
because no pair that contains a new symbol ranks before the pair that made it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens that a worker remembers before it starts anew.
CACHE_SIZE = 400_000

_NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each of the 256 bytes in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    visible = set(shown)
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class MergeTable:
    """Byte symbols and ranked merges of a byte-level vocabulary, as sorted arrays."""

    def __init__(self, model: dict, specials: list[str]) -> None:
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        self.width = max(vocab.values()) + 1
        keys = np.array(left, dtype=np.int64) * self.width + np.array(right, dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys = keys
        self.rank = first.astype(np.int32)
        self.made = np.array(made, dtype=np.int64)[first]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return cls(spec["model"], [t["content"] for t in spec.get("added_tokens", [])])

    def lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols left in each of ``tokens`` after all merges."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        while len(symbols) > 1:
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], _NO_RANK)
            rank = np.append(rank, _NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(symbols)))
            done = lowest == _NO_RANK
            out[owner[starts[done]]] = size[done]
            if done.all():
                break
            marked = np.flatnonzero((rank == np.repeat(lowest, size)) & (rank != _NO_RANK))
            # In a run of adjacent marks (as in "aaa") every other one, from the left, is a merge.
            fresh = np.append(True, np.diff(marked) != 1)
            run_start = np.maximum.accumulate(np.where(fresh, marked, 0))
            marked = marked[(marked - run_start) % 2 == 0]
            symbols[marked] = self.made[at[marked]]
            keep = ~np.repeat(done, size)
            keep[marked + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        else:
            if len(symbols):
                out[owner[0]] = 1
        return out


class _Known(dict):
    """Pre-token -> position; unknown ones get the next position."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


class TokenCounter:
    """Counts tokens of whole texts with a bounded memory of pre-tokens seen before."""

    def __init__(self, table: MergeTable, cache_size: int = CACHE_SIZE) -> None:
        self.table, self.cache_size = table, cache_size
        self.split = regex.compile(PATTERN).findall
        self.known, self.sizes = _Known(), np.zeros(0, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.cache_size:
            self.known, self.sizes = _Known(), np.zeros(0, np.int64)
        special, known, split = self.table.special, self.known, self.split
        before, codes, extra = len(known), [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text or ""]
            if special is not None and text and special.search(text):
                parts = special.split(text)
                extra[i] = len(parts) - 1
            codes.append([np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)) for tokens in map(split, parts)])
        if len(known) > before:
            fresh = [t.encode("utf-8", "surrogatepass") for t in list(known)[before:]]
            self.sizes = np.append(self.sizes, self.table.lengths(fresh))
        return extra + np.array([sum(int(self.sizes[c].sum()) for c in parts) for parts in codes], np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty (0 bytes, 0 tokens).  Ids may be null or
    repeated: every input row gives one output row.  Other columns, also ones
    named like the results, are ignored.  Texts are never truncated.
    """
    table = docs.sparkSession.sparkContext.broadcast(MergeTable.load(vocabulary))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(table.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = [counter.count(texts.slice(at, 256).to_pylist()) for at in range(0, batch.num_rows, 256)]
            n_tokens = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            n_bytes = np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
