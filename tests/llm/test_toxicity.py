"""The conditional random field against enumeration, its seeds, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from lexloom.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(6))
def test_marginals_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    model = toxicity.Field(start=float(rng.normal()), moves=rng.normal(0, 1.5, (2, 2)))
    sizes = np.array([3, 0, 7, 1, 5, 0])
    e = rng.normal(0, 2, sizes.sum())
    got, at = model.marginals(e, sizes), 0
    for n in sizes:
        own = e[at : at + n]
        weight, toxic = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(x for x, y in zip(own, tags) if y) + (model.start if n and tags[0] else 0) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:])))
            weight += w
            toxic += w * np.array(tags)
        assert np.allclose(got[at : at + n], toxic / weight)
        at += n


def make(rng, insults, n, copies=0):
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(insults)())
        texts.append(" ".join(words))
        toxic.append(bad)
    family = [rng.choice(vocab) + "q" for _ in range(60)] + [insults[0]()]
    for k in range(copies):  # words of near copies are no evidence by their number
        texts.append(" ".join([*family, vocab[k]]))
        toxic.append(True)
    return texts, np.array(toxic)


ENDS = random.Random(5)
INSULTS = [lambda: "zorbel", lambda: "Quixnak", lambda: "vequ" + ENDS.choice("aeiou") + ENDS.choice("nrstl") + ENDS.choice(["", "ung", "o"])]


def test_seeds_are_the_insults_only():
    texts, toxic = make(random.Random(1), INSULTS, 400, copies=60)
    found = [toxicity.words_of(t) for t in texts]
    chosen = toxicity.seeds(found, toxic)
    assert {w for words in found for w in words if toxicity.is_seed(w, chosen)} <= {w for words in found for w in words if w in ("zorbel", "Quixnak") or w.startswith("vequ")}
    assert {"zorbel", "quixnak", "vequ*"} <= chosen
    assert toxicity.seeds(found, np.zeros(len(found), bool)) == set()


def test_unseen_forms_and_spans(spark):
    texts, toxic = make(random.Random(2), INSULTS, 1200)
    rows = [(i, t, int(b)) for i, (t, b) in enumerate(zip(texts, toxic.tolist()))]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t, _ in rows], "doc_id long, text string, score string, spans string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    ask = ["a plain text of words", "you vequheit and zorbel there", "Zorbel zorbel, and more é", "", None, "filler " * 30000 + "zorbel"]
    df = spark.createDataFrame(list(enumerate(ask)) + [(None, "zorbel")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in toxicity.find_toxic(df, model).collect()}
    assert [got[i]["predicted"] for i in range(6)] == [0, 1, 1, 0, 0, 1] and got[None]["predicted"] == 1
    assert [list(map(tuple, got[i]["spans"])) for i in range(6)] == [[], [(4, 12), (17, 23)], [(0, 13)], [], [], [(210000, 210006)]]
    assert got[3]["score"] == got[4]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    report = toxicity.report(toxicity.find_toxic(docs, model)).collect()
    held = [r for r in report if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == rows[r["doc_id"]][2] for r in held]) >= 0.97


def test_empty_tables_and_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clean = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    for labels in (none, clean):
        got = toxicity.find_toxic(docs, toxicity.fit(docs, labels)).collect()
        assert len(got) == 20 and len({r["score"] for r in got}) == 1 and {r["predicted"] for r in got} == {0}
    empty = docs.limit(0)
    assert toxicity.find_toxic(empty, toxicity.fit(empty, none)).count() == 0


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.report(toxicity.find_toxic(docs, toxicity.fit(docs, labels))).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    bad = [r["predicted"] for r in got if r["toxic"] == 1]
    assert sum(clean) == 0 and len(bad) >= 10 and np.mean(bad) >= 0.75  # few labelled rows in other languages than English


def test_training_takes_bounded_blocks(monkeypatch):
    """Blocks follow one another, cut no sequence and are bounded; texts are gathered as each alone."""
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    sizes = np.random.default_rng(3).integers(1, toxicity.PIECE + 1, 300)
    found = list(toxicity._blocks(sizes))
    assert [i for i, _, _ in found] == [0, *[j for _, j, _ in found[:-1]]] and found[-1][1] == sizes.sum()
    assert np.array_equal(np.concatenate([own for _, _, own in found]), sizes)
    assert all(j - i == own.sum() <= 1000 + toxicity.PIECE for i, j, own in found)
    model = toxicity.Field(weights=np.random.default_rng(4).normal(0, 1, (3, toxicity.BUCKETS)).astype(np.float32))
    texts = ["one two three", "", "four"] * 60
    assert np.allclose(toxicity.gather(model, texts), np.concatenate([toxicity.gather(model, [t]) for t in texts]))
