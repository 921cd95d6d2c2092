"""Repeated passages of a few short lines, at several offsets."""

import random

import pytest

from lexloom.llm import linededup


@pytest.mark.parametrize("size", [3, 4, 5, 6, 8, 30])
def test_passage_is_removed_whole(spark, size):
    rng = random.Random(size)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows, expected, passages = [], {}, []
    for k in range(12):
        passage = [line(rng.randint(-(-50 // size), 22)) for _ in range(size)]
        for doc in (2 * k, 2 * k + 1):
            before, after = [[line(rng.randint(1, 22)) for _ in range(rng.randint(0, 9))] for _ in range(2)]
            rows.append((doc, "\n".join([*before, *passage, *after])))
            expected[doc] = (size, f"{len(before)}-{len(before) + size}", len("\n".join(passage))) if doc % 2 else (0, "", 0)
        passages.append("\n".join(passage))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed_lines, r.removed, r.removed_bytes) for r in linededup.report(linededup.find_repeats(docs)).collect()}
    assert got == expected
    left = [r.text for r in linededup.remove_repeats(docs).collect()]
    assert all(sum(p in t for t in left) == 1 for p in passages)
