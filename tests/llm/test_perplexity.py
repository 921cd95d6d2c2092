"""The n-gram model of the quality rules: planted documents, and probabilities and verdicts against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import perplexity


@pytest.mark.parametrize("letters", ["aeioustrnl", "аеиоустрнл"])
def test_planted_documents(spark, letters):
    rng = random.Random(4)
    vocab = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(400)})
    after = {w: rng.sample(vocab, 12) for w in vocab}
    phrases = [rng.sample(vocab, 5) for _ in range(25)]  # stock phrases, met everywhere

    def walk(size):
        out = [rng.choice(vocab)]
        while len(out) < size:
            out += rng.choice(phrases) if rng.random() < 0.05 else [rng.choice(after[out[-1]])]
        return out

    clean = [walk(rng.randint(100, 300)) for _ in range(300)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    rows += [(300 + i, " ".join([*w[:40], "edited", *w[41:]])) for i, w in enumerate(clean[:90])]  # near copies do not make a text predictable
    shuffled = [rng.sample(w, len(w)) for w in clean[:20]]
    gibberish = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(200)]
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate(shuffled)] + [(2000, " ".join(gibberish)), (3000, " ".join(sum(phrases, [])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    assert sum(got[i].kept for i in range(390)) >= 380
    assert not got[2000].kept and got[2000].perplexity > got[2000].most_perplexity
    for i in range(1000, 1020):
        assert not got[i].base_failed and not got[i].kept and got[i].perplexity > got[i].most_perplexity
    assert not got[3000].base_failed and not got[3000].kept and got[3000].perplexity < got[3000].least_perplexity


def brute_surprises(texts):
    """Per text the mean surprise, each place judged by counts of the corpus without it (discounts as of the whole corpus)."""
    fold = lambda t: ["blank"] * (perplexity.ORDER - 1) + ["blank" if c in " \t\n\r\v\f" else "digit" if c in "0123456789" else c for c in t.lower()]
    top = Counter()
    for t in texts:
        s = fold(t)
        top.update(tuple(s[i : i + perplexity.ORDER]) for i in range(len(t.lower())))

    class Level:
        def __init__(self, counts):
            self.counts, self.inside = counts, defaultdict(dict)
            for g, n in counts.items():
                self.inside[g[:-1]][g] = n
            n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
            self.d = [0.5] * 3 if y is None else [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5, 0.05), k - 0.01) for k in (1, 2, 3)]

    levels = [Level(top)]
    while len(next(iter(levels[-1].counts))) > 1:
        levels.append(Level(Counter(g[1:] for g in levels[-1].counts)))
    symbols = len(levels[-1].counts)

    def p(k, gram, left_out):
        if k == len(levels):
            return 1 / (symbols + 1)
        level = levels[k]
        inside = dict(level.inside[gram[:-1]])
        gone = False
        if left_out:
            inside[gram] -= 1
            gone = not inside[gram]
        rest = p(k + 1, gram[1:], gone)
        total, n = sum(inside.values()), inside.get(gram, 0)
        off = lambda n: level.d[min(n, 3) - 1] if n else 0
        return rest if not total else (n - off(n)) / total + sum(map(off, inside.values())) / total * rest

    out = []
    for t in texts:
        s = fold(t)
        each = [-math.log(p(0, tuple(s[i : i + perplexity.ORDER]), True)) for i in range(len(t.lower()))]
        out.append(sum(each) / len(each) if each else None)
    return out


@pytest.mark.parametrize("block", [perplexity.BLOCK_KEYS, 12_000])
def test_against_recounting(docs, documents, block):
    """Perplexities and verdicts, with the model in one block and in many."""
    by_lang, expected = defaultdict(list), {}
    for i, text, lang, *_ in documents:
        by_lang[lang or ""].append((i, text or ""))
    for lang, rows in by_lang.items():
        means = brute_surprises([t for _, t in rows])
        passed = {}
        for (_, t), m in zip(rows, means):
            n, _, _, _, repeated = perplexity.text_measures(t)
            if m is not None and n >= 50 and 100 * repeated <= 50 * n:
                passed[t] = m
        bins = sorted(math.floor(m / perplexity.BIN) for m in passed.values())
        middle = lambda x: sorted(x)[(len(x) - 1) // 2]
        centre = middle(bins)
        half = max(perplexity.LEAST_BAND, perplexity.BAND * 1.4826 * perplexity.BIN * middle([abs(b - centre) for b in bins]))
        low, high = (centre + 0.5) * perplexity.BIN - half, (centre + 0.5) * perplexity.BIN + half
        for (i, t), m in zip(rows, means):
            expected[i, lang, t] = m, t in passed and low <= m <= high
    got = perplexity.judge(docs, block=block).join(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).distinct().withColumn("t", F.coalesce("text", F.lit(""))), "doc_id").distinct().collect()
    assert len(got) >= len(documents) - 3
    for r in got:
        mean, kept = expected[r.doc_id, r.lang, r.t]
        assert r.kept == kept, r
        assert (mean is None) == (r.perplexity is None) and (mean is None or math.isclose(math.log(r.perplexity), mean, rel_tol=1e-5))


def test_hash_arrays():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 60, 5000))
    arrays = perplexity.HashArrays(perplexity._hashes(7, keys[::2]), np.arange(len(keys[::2])))
    value, known = arrays.find(perplexity._hashes(7, keys))
    assert known[::2].all() and not known[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all()
    assert not perplexity.HashArrays(np.zeros(0, np.uint64), np.zeros(0)).find(perplexity._hashes(7, keys))[1].any()


def test_symbols_of_scripts_stay_apart():
    for text in ("abcxyzéß", "абвгдежз", "αβγδεζ", "אבגדה", "ابتثج", "日本語"):
        assert len(set((perplexity.gram_keys(text) & ((1 << perplexity.SYMBOL_BITS) - 1)).tolist())) == len(set(text))
