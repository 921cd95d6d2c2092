"""The whole pipeline on planted documents against plain Python versions of its stages."""

import math
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lexloom.llm import mixing, quality  # noqa: E402

from test_corpuswide import brute_capacity, shingles  # noqa: E402
from test_rowwise import accepted_brute, brute_hits  # noqa: E402


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(vocab) + rng.choice(["###", "$$$ |", "!!!"]) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        rows.append((i, junk(60) if bad else text(rng.randint(60, 120)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"])))
        labels.append((i, int(not bad), 0))
    for k in range(12):  # near copies
        w = rows[1 + 5 * (k % 3)][1].split()
        w[k] = "edited"
        rows.append((200 + k, " ".join(w), "en", "a"))
    rows += [(300, rows[2][1], "fr", "b"), (301, None, "en", "a"), (302, "", None, None), (303, text(3000), "en", "c")]
    items = [(k, text(30)) for k in range(4)]
    rows += [(400 + k, text(30) + " " + " ".join(b.split()[5:20]) + " " + text(40), "en", "b") for k, b in items]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    best = {}
    for k, (i, *_) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), i), i)
    return [r for k, r in enumerate(rows) if not sets[k] or r[0] == best[find(k)]]


def share(budget, children):
    """Water filling: ``children`` as name -> (weight, cap)."""
    out, left, open_ = {}, budget, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: cap for k, (w, cap) in open_.items() if cap <= w * left / total}
        if not full:
            return out | {k: w * left / total for k, (w, _) in open_.items()}
        out |= full
        left -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def mix(rows):
    """Copies per row."""
    weights, seed = mixing.WEIGHTS, 17
    words = lambda t: len((t or "").encode().split())
    leaf = lambda r: (f"domain{zlib.crc32((r[3] or '').encode()) % 4}", r[2] or "", r[3] or "")
    supply = Counter()
    for r in rows:
        supply[leaf(r)] += words(r[1])
    cap = {k: 2.0 * v for k, v in supply.items()}
    level = lambda n: {k: sum(v for x, v in cap.items() if x[:n] == k) for k in {x[:n] for x in cap}}
    w = lambda name, value: weights.get(name, {}).get(value, 1.0)
    budgets = {(): float(sum(supply.values()))}
    for n, name in enumerate(mixing.LEVELS, 1):
        for above in {k[: n - 1] for k in cap}:
            below = {k: (w(name, k[-1]), v) for k, v in level(n).items() if k[: n - 1] == above}
            budgets |= share(budgets[above], below)
    out = []
    for key in supply:
        target = math.floor(round(budgets[key], 3))
        epochs, rest = divmod(target, supply[key]) if supply[key] else (0, 0)
        place = lambda r, e=epochs: int(hashlib.md5(f"{seed}:{e}:{r[0]}".encode()).hexdigest()[:15], 16)
        used = 0
        for r in sorted((r for r in rows if leaf(r) == key), key=place):
            used += words(r[1])
            out += [r] * (epochs + (bool(rest) and used <= rest))
    return out


def test_run_equals_plain_stages(spark, planted):
    folder, rows, items = planted
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.fit(docs, labels)
    left = [r for r, ok in zip(rows, accepted_brute(rows, machine)) if ok]
    assert not any(r[0] % 5 == 0 for r in left if r[0] < 160) and sum(r[0] < 160 for r in left) == 128
    left = components(left)
    assert not {200 + k for k in range(12)} & {r[0] for r in left} and 300 not in {r[0] for r in left}
    left = [r for r in left if not brute_hits(r[0], r[1], items)[4]]
    assert not {400, 401, 402, 403} & {r[0] for r in left}
    left = mix(left)
    sizes = Counter()
    for r in left:
        sizes[hashlib.md5((r[1] or "").encode()).hexdigest()] += len((r[1] or "").encode()) + 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in left)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load.values()) == brute_capacity([sizes[g] for g in sorted(sizes)], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_on_an_empty_table(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)
