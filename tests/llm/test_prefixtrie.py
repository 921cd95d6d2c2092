"""The prefix trie against plain Python."""

import hashlib
import random
import zlib

import pytest
from lexloom.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, rep string, weight string"


def brute(rows, graft=True):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if graft else 0
        path = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members, ends = nodes.setdefault(tuple(path[:d]), (set(), set()))
            members.add(c)
            if d == len(path):
                ends.add(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + ((len(nodes[path][0]) - 1) * len(path[-1][1].encode()) if path else 0)
    out = []
    for path, (members, ends) in nodes.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members), len(kids.get(path, [])), leaves[path], saved[path], digest))
    return out


def made(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        rows += [(c, t if rng.random() < 0.97 or t else None, rng.choice(["user", "assistant", None]), rng.choice(["", "yes", "no", "é" * 9, None, f"only {c} {t}"])) for t in range(rng.choice([1, 2, 3, 5, 8, 12]))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(7)]  # exact copies
    rows += [(2000, t, "user", f"long {t % 50}") for t in range(3000)]  # over several pieces
    rows += [(2001, t, "user", f"long {t % 50}") for t in range(2500)] + [(None, 1, "user", "nobody's")]
    return rows


def found(spark, rows, graft=prefixtrie.Graft()):
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, prefixtrie.prefix_trie(df, graft).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_python(spark, seed):
    rows = made(seed)
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_a_full_sketch_and_no_graft_change_nothing(spark, monkeypatch):
    rows = made(3, 40)
    monkeypatch.setattr(prefixtrie, "WIDTH", 64)  # every estimate is above one
    monkeypatch.setattr(prefixtrie, "HOT", 3)
    assert found(spark, rows, None) == sorted(brute(rows, graft=False), key=str)


def test_small_and_awkward_tables(spark):
    assert found(spark, []) == []
    lone = [(7, None, None, None)]
    assert found(spark, lone) == sorted(brute(lone), key=str)
    turnless = [(c, 1, "user", "x") for c in (1, 2, 3, 4, 6, 8)]  # heads that do not exist
    assert found(spark, turnless) == sorted(brute(turnless), key=str)
    tied = [(9, 1, "user", "b"), (9, 1, "user", "a"), (9, 1, "user", "a")]
    assert len(found(spark, tied, None)) == 4
