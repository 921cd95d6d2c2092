"""Operators that compare or order documents, against plain Python."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexloom.llm import linededup, mixing, neardup, sharding


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def test_near_duplicates(docs, documents, no_docs):
    sets = [shingles(t) for _, t, *_ in documents]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(documents):
        least[find(k)].append(i)
    expected = Counter()
    for k, (i, *_) in enumerate(documents):
        ids = [x for x in least[find(k)] if x is not None]
        c = i if not sets[k] else min(ids, default=None)
        expected[i, len(sets[k]), c, i == c] += 1
    got = neardup.report(neardup.near_duplicates(docs)).collect()
    assert Counter(tuple(r) for r in got) == expected
    kept = neardup.keep_one(docs)
    roots = {find(k) for k in range(len(sets)) if sets[k]}
    left = kept.select("doc_id", "text").collect()
    assert kept.columns == docs.columns and len(left) == len(roots) + sum(not x for x in sets)
    assert {find(k) for k, (i, t, *_) in enumerate(documents) if (i, t) in set(left) and sets[k]} == roots
    for k in roots:  # the smallest id stays
        ids = [x for x in least[k] if x is not None]
        assert not ids or min(ids) in {r.doc_id for r in left}
    assert neardup.near_duplicates(no_docs).count() == 0


def test_family_of_variants(spark):
    """Variants that share bands without being similar enough, in bands of several blocks, against all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(1500):  # most pairs are near 0.6 to 0.7, some above 0.75
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(rows))}


def test_line_dedup(docs, documents, no_docs):
    found = linededup.find_repeats(docs)
    rows = {(r.doc_id, r.n_lines): r for r in linededup.report(found).collect()}
    texts = {i: t for i, t, *_ in documents}
    assert rows[209, 2].n_removed_lines == 0 and rows[210, 2].removed == "1-2"  # the shared passage stays once
    assert rows[0, len(texts[0].split("\n"))].n_removed_lines == 0  # a row repeated as a whole is one document
    assert found.count() == len(documents)
    cut = {r.doc_id: r.text for r in linededup.remove_repeats(docs).collect()}
    assert cut[210] == texts[210].split("\n")[0] and cut[209] == texts[209] and cut[203] is None
    assert linededup.find_repeats(no_docs).count() == 0


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"shared line number {k} of the passage" for k in range(90))
    rows = [(1, "intro\n" + passage), (2, "other\nlines\nbefore\n" + passage + "\nafter")]
    got = {r.doc_id: r for r in linededup.report(linededup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1].n_removed_lines == 0 and got[2].n_removed_lines >= 60


def test_mixing(docs, documents, no_docs):
    weights = {"lang": {"en": 2.0}, "domain": {"domain1": 3.0}}
    got = mixing.mix(docs, budget_share=0.5, max_epochs=2.0, weights=weights).collect()
    assert len(got) == len(documents)
    supply, taken, target, ids = Counter(), Counter(), {}, defaultdict(set)
    for r in got:
        leaf = r.domain, r.lang, r.source
        supply[leaf] += r.n_tokens
        taken[leaf] += r.copies * r.n_tokens
        target[leaf] = r.target
        ids[leaf].add((r.doc_id, r.n_tokens, r.copies))
    total = sum(supply.values())
    assert abs(sum(target.values()) - total // 2) <= len(target)
    for leaf in supply:
        assert taken[leaf] <= target[leaf] <= 2 * supply[leaf] + 1
        if supply[leaf]:  # the rest of the budget is smaller than some document that was not taken
            low = target[leaf] // supply[leaf]
            more = [n for _, n, c in ids[leaf] if c == low and n]
            assert not more or target[leaf] - taken[leaf] < max(more) * 2
    tree = mixing.take(docs, 0.5, 2.0, weights)
    assert tree.columns == docs.columns and tree.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0


def test_budget_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 100.0), ("d1", "en", "b", 10.0), ("d1", "fr", "c", 100.0), ("d2", "en", "d", 500.0)], "domain string, lang string, source string, cap double")
    langs = leaves.groupBy("domain", "lang").agg({"cap": "sum"}).withColumnRenamed("sum(cap)", "cap")
    domains = langs.groupBy("domain").agg({"cap": "sum"}).withColumnRenamed("sum(cap)", "cap")
    top = mixing.split_budget(domains, None, ["domain"], 200.0, {})
    middle = mixing.split_budget(langs, top, ["domain", "lang"], 0.0, {})
    got = {r.source: r.budget for r in mixing.split_budget(leaves, middle, mixing.LEVELS, 0.0, {}).collect()}
    assert got == {"a": 40.0, "b": 10.0, "c": 50.0, "d": 100.0}


def test_weight_of_zero_takes_nothing(spark):
    rows = [(i, "a b c d", lang, f"s{i % 2}") for i, lang in enumerate(["en", "fr", "de"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = F.lit("all")
    got = mixing.mix(docs, 0.5, 2.0, {"lang": {"fr": 0.0}}, domain=one).collect()
    assert {r.lang: sum(c.copies for c in got if c.lang == r.lang) for r in got} == {"en": 6, "fr": 0, "de": 6}
    assert sum(r.copies for r in mixing.mix(docs, 0.5, 2.0, {"lang": dict.fromkeys(["en", "fr", "de"], 0.0)}, domain=one).collect()) == 0


def brute_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c = (low + high) // 2
        used, fill = 1, 0
        for s in sizes:
            used, fill = (used + 1, s) if fill + s > c else (used, fill + s)
        low, high = (low, c) if used <= k else (c + 1, high)
    return low


def test_sharding(docs, documents, no_docs):
    import hashlib
    import zlib

    got = sharding.shard_documents(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in documents)
    groups = Counter()
    for _, t, *_ in documents:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += size(t)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load.values()) == brute_capacity([groups[g] for g in sorted(groups)], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(8))
    crc = defaultdict(set)
    for r in got:
        crc[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in crc.values())
    assert sharding.shard_documents(no_docs).count() == 0
