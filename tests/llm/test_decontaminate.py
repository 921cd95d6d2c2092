"""Decontamination against plain Python: item lists, short items, hot prefixes, places stored in pieces, the two scans."""

import random
import re
import uuid
from collections import Counter

import pytest

from lexloom.llm import decontaminate

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    words, hit, of = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            window = w[k : k + width]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    of.add(str(item))
    return len(words), len(hit), tuple(sorted(of)), bool(hit)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 10])
def test_few_words_and_many_repeats(spark, width, monkeypatch):
    """Few different words, so that windows overlap, share prefixes, and every place has several candidates."""
    rng = random.Random(width)
    text = lambda k: " ".join(rng.choice(["a", "b", "B", "É", "é", "x9"]) for _ in range(k))
    texts = [text(rng.randint(0, 60)) for _ in range(40)] + [None, "", "a", "a b", " . "]
    items = [(i, rng.choice(texts[:40])[:50] if i % 2 else text(rng.randint(0, 14))) for i in range(25)] + [(3, "a b"), (90, None), (91, "a")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PLACES", 5)
    found = decontaminate.find_contamination(docs, bench, width=width, part=3, most_bits=128).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found}
    assert len(found) == len(texts) and got == {i: brute(t, items, width) for i, t in enumerate(texts)}


def test_hot_prefix(spark):
    """A passage in a third of all rows, and a window that hundreds of items share."""
    shared = "the passage that a third of all rows have in common word for word"
    texts = [f"{i} {shared} {i}" if i % 3 == 0 else f"text {i} of other words" for i in range(900)]
    items = [(i, shared if i < 300 else f"{shared} {i}") for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (decontaminate.PART, 20):
        got = Counter((r.contaminated, len(r["items"])) for r in decontaminate.find_contamination(docs, bench, part=part).collect())
        assert got == {(False, 0): 600, (True, 400): 300}
    assert decontaminate.decontaminate(docs, bench, part=20).count() == 600


def test_texts_are_read_twice(spark, tmp_path):
    """However many windows and parts there are."""
    folder = str(tmp_path)

    def noted(batches):
        for batch in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(batch.num_rows))
            yield batch

    docs = spark.createDataFrame([(i, f"a {i} b {i} c {i} d") for i in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{i} b {i} c {i} d") for i in range(0, 50, 5)], "item_id long, text string")
    found = decontaminate.find_contamination(docs.mapInArrow(noted, docs.schema), bench, width=3, part=1)
    assert found.filter("contaminated").count() == 10
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 2 * 50


def test_only_hit_texts_are_shuffled(spark):
    """Every text has a place of a prefix; those without a whole window must not travel."""
    words = [f"w{i}" for i in range(12)]
    pieces = [w for k in range(10) for w in [*words[k : k + 3], "and"]]  # every prefix, no window
    docs = [(i, " ".join([f"x{i}", *pieces, *(words if i % 50 == 0 else [])])) for i in range(400)]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(words[:10])), ("b", " ".join(words[2:]))], "item_id string, text string")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontaminate.decontaminate(made, items)
        assert {r.doc_id for r in found.collect()} == {i for i, _ in docs if i % 50}
        plan = found._jdf.queryExecution().executedPlan()
        assert 0 < _shuffled(plan) <= 2 * 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def _shuffled(plan) -> int:
    """Records that the exchanges of an executed plan wrote."""
    own = plan.metrics().get("shuffleRecordsWritten") if "Exchange" in plan.nodeName() else None
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    if plan.nodeName() == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif "QueryStage" in plan.nodeName():
        below = [plan.plan()]
    return (own.get().value() if own is not None and own.isDefined() else 0) + sum(map(_shuffled, below))
