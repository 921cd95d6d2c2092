"""Operators that judge each row by itself, against plain Python."""

import os
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from lexloom.llm import decontaminate, licenses, perplexity, pii, quality, tokens
from lexloom.llm.license_rules import RULES, stem

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pairs(rows, documents):
    """Expected and found rows, as multisets."""
    return Counter(map(repr, rows)), Counter(map(repr, documents))


def test_license_base_and_labels(docs, documents, no_docs):
    got = licenses.report(licenses.scan_licenses(docs)).collect()
    expected = []
    for i, text, *_ in documents:
        words = WORD.findall(lowered(text))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        expected.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert Counter(expected) == Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    one = next(r for r in got if r.doc_id == 211)
    assert one.labels == "apache,apache-2.0,cc-by,cc-by-4.0,mit" and 0.9 < one.score <= 1
    assert licenses.report(licenses.scan_licenses(no_docs)).count() == 0


def written_out(pattern):
    """Texts that stand for all alternatives of a pattern; an open class gives two of its characters."""
    parser = re._parser

    def expand(items):
        texts = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                found = [chr(arg)]
            elif name == "NOT_LITERAL":
                found = ["x", "é"]
            elif name == "IN":
                found = ["x", "7"] if str(arg[0][0]) == "NEGATE" else [c for o, a in arg for c in ([chr(a)] if str(o) == "LITERAL" else [chr(a[0]), chr(a[1])])]
            elif name == "SUBPATTERN":
                found = expand(arg[-1])
            elif name == "BRANCH":
                found = [x for way in arg[1] for x in expand(way)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                once = expand(arg[2])
                low, high = arg[0], min(arg[1], arg[0] + 1)
                found = [x for n in range(low, high + 1) for x in ([""] if n == 0 else [y * n for y in once])]
            else:
                raise AssertionError(name)
            texts = [t + f for t in texts for f in found]
        return texts

    return expand(parser.parse(pattern))


def test_every_match_of_a_rule_holds_its_keyword_and_stem():
    assert sum(r.priority > 0 for r in RULES) >= 300
    for r in RULES:
        for text in written_out(r.pattern):
            assert re.fullmatch(r.pattern, text), (r, text)
            assert r.keyword in text and stem(r) in text, (r, text)


def test_no_match_is_lost_at_a_gate(spark):
    """Every alternative of every rule, as a text, has the labels that it has without keywords and stems."""
    texts = sorted({t for r in RULES for t in written_out(r.pattern)})
    asked = spark.createDataFrame(list(enumerate([f"x {t} y" for t in texts] + ["the BSD style license", "Tcl Tk License", "MirOS licence"])), "doc_id long, text string").repartition(8)
    ungated = [replace(r, keyword="") for r in RULES]
    got, full = ({r.doc_id: r.labels for r in licenses.report(licenses.scan_licenses(asked, rules)).collect()} for rules in (RULES, ungated))
    assert got == full and all(full[i] for i in range(len(texts)))
    assert [got[len(texts) + i] for i in range(3)] == ["bsd", "tcl", "miros"]


def test_license_suppression(spark):
    text = "Licensed under the GNU General Public License, version 3 or any later version"
    row = licenses.report(licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.labels == "gpl,gpl-3.0-or-later"  # the base label stays, the contained gpl-3.0 falls


def brute_licenses(text):
    """Detections of every rule on words, and those that no other suppresses."""
    words = WORD.findall(lowered(text))
    starts, joined = {}, ""
    for k, w in enumerate(words):
        starts[len(joined)] = k
        joined += w + " "
    found = []
    for r in RULES:
        at = 0
        while m := re.compile(r"(?<![^ ])(?:" + r.pattern + r")(?= )").search(joined, at):
            found.append((starts[m.start()], starts[m.start()] + len(m[0].split(" ")), r))
            at = m.end() + 1
    def suppressed(h):
        for g in found:
            over, under = g[0] <= h[0] and g[1] >= h[1], h[0] <= g[0] and h[1] >= g[1]
            if (over or under) and g[2].priority < h[2].priority:
                return True
            if over and g[2].priority == h[2].priority and (not under or g[2].number < h[2].number):
                return True
        return False

    return sorted((a, b, r.label) for a, b, r in found if not suppressed((a, b, r)))


def test_license_detections(spark):
    lines = ["Licensed under the Apache License, Version 2.0 (the license)", "GNU General Public License v3 or any later version", "released under the quite-long-" + "x" * 60 + " license", "SPDX-License-Identifier: MIT", "BSD 3-clause license and CC BY-NC-SA 4.0; CC BY 4.0", "all rights reserved copyright 2020 someone all rights reserved", "plain words without a meaning"]
    rng = np.random.default_rng(3)
    texts = ["\n".join(rng.choice(lines, 12)) for _ in range(30)] + ["MIT License " * 700]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert sorted((k.start, -k.minus_end, k.label) for k in r.kept) == brute_licenses(texts[r.doc_id])


def test_no_match_is_longer_than_stated():
    for r in RULES:
        assert not any(c in r.pattern.replace("[^ ]+", "").replace("[0-9]{4}", "") for c in "*+{")
        assert r.pattern.count(" ") + 1 <= licenses.most_words(RULES)


def test_long_text_of_license_lines(spark):
    import time

    text = "Licensed under the Apache License, Version 2.0, and the MIT License.\n" * 14_000
    began = time.perf_counter()
    row = licenses.report(licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    took = time.perf_counter() - began
    assert row.labels == "apache,apache-2.0,mit" and row.n_base == 28_000 and took < 30


def test_pii_base(docs, documents, no_docs):
    tagger = pii.train(*pii.labelled_set(40, 1), epochs=1)[0]
    got = pii.find_pii(docs, tagger).collect()
    assert Counter(repr((r.doc_id, [tuple(s) for s in r.base])) for r in got) == Counter(repr((i, brute_pii(t))) for i, t, *_ in documents)
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    assert pii.find_pii(no_docs, tagger).count() == 0


def brute_pii(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_pii_base_on_odd_texts(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(list("a@.-+1234567890 ()é@@..")) for _ in range(400))
    assert pii.base_spans(text) == brute_pii(text)


def test_tagger_learns():
    tagger, losses = pii.train(*pii.labelled_set(1000, 1))
    ids, tags = pii.labelled_set(80, 2)
    right = tagger.decode(tagger.emissions(ids)).T == tags
    assert losses[-1] < losses[0] / 5 and right.mean() > 0.93


def test_tagger_gradients():
    tagger = pii.Tagger.fresh(1)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    ids, tags = pii.labelled_set(2, 3)
    ids, tags = ids[:, :12], tags[:, :12]
    _, grad = tagger.gradients(ids, tags)
    for name in ("O", "T", "Uf", "Xb", "E"):
        at = tuple(0 if name != "E" else int(ids[0, 0]) for _ in range(1)) + (1,)
        value, e = tagger.p[name][at], 1e-3
        tagger.p[name][at] = value + e
        up = tagger.gradients(ids, tags)[0]
        tagger.p[name][at] = value - e
        down = tagger.gradients(ids, tags)[0]
        tagger.p[name][at] = value
        assert abs((up - down) / (2 * e) - grad[name][at]) < 2e-2, name


def test_reconcile_takes_the_best_set():
    found = [(5.0, ("ip", 0, 10)), (4.0, ("ip", 8, 14)), (4.0, ("card", 0, 7)), (4.0, ("card", 0, 7))]
    assert pii._reconcile(found) == [("card", 0, 7), ("ip", 8, 14)]


def test_quality(spark, docs, documents, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (61, None)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    rows = quality.score(docs, machine).collect()
    assert len(rows) == len(documents) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.score(no_docs, quality.fit(no_docs, labels)).count() == 0 and quality.accepted(no_docs, machine).columns == docs.columns
    empty = {r.score for r in rows if r.doc_id in (202, 203)}
    assert len(empty) == 1
    kept = quality.accepted(docs, machine)
    assert kept.columns == docs.columns and Counter(kept.select("doc_id", "text").collect()) == Counter((i, t) for (i, t, *_), ok in zip(documents, accepted_brute(documents, machine)) if ok)


def accepted_brute(documents, machine):
    """Verdict per document by the double sum over all pairs of features."""
    out = []
    for _, text, *_ in documents:
        places, values = quality.featurise(text, quality._Buckets())
        v, x = machine.v[places].astype(float), np.array(values)
        raw = machine.w[places] @ x + ((v @ v.T) * np.outer(x, x))[np.triu_indices(len(x), 1)].sum()
        out.append(1 / (1 + np.exp(-(machine.slope * raw + machine.offset))) >= quality.THRESHOLD)
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in found]
    assert len(right) > 50 and sum(right) / len(right) >= 0.95


def test_factorisation_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 3)))
    places, values = np.array([3, 9, 20]), np.array([0.5, 2.0, -1.0])
    pairs_sum = sum(fm.v[a] @ fm.v[b] * x * y for k, (a, x) in enumerate(zip(places, values)) for b, y in list(zip(places, values))[k + 1 :])
    assert np.isclose(fm.raw(places, values, np.array([0]))[0], fm.w[places] @ values + pairs_sum)


def test_quality_rules(docs, documents, no_docs):
    got = perplexity.judge(docs).collect()
    expected = Counter()
    for i, text, *_ in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = (text or "").split("\n")
        dup = sum(1 for k, x in enumerate(lines) if x in lines[:k] and re.search(r"[^\x20\x09-\x0D]", x))
        seen = Counter(zip(words, words[1:], words[2:]))
        covered = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for d in range(3)}
        expected[i, len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)] += 1
    assert expected == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert perplexity.judge(no_docs).count() == 0


def test_decontamination(spark, docs, documents, no_docs):
    texts = {i: t for i, t, *_ in documents if i is not None and t}
    long_words = WORD.findall(lowered(texts[208]))
    items = [(1, " ".join(long_words[50:75])), (2, "one"), (3, ""), (4, None), (None, texts[1]), (5, " ".join(WORD.findall(lowered(texts[2]))[:12]).upper()), (6, "never seen phrase of some words that do not occur here"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    # With bitmaps that let nearly everything pass, and places dealt in many parts.
    settings = ({}, {"most_bits": 64}, {"part": 2}, {"most_bits": 256, "part": 1})
    for setting in settings:
        got = decontaminate.report(decontaminate.find_contamination(docs, bench, **setting)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == Counter(brute_hits(i, t, items) for i, t, *_ in documents)
    for setting in settings[::3]:
        kept = decontaminate.decontaminate(docs, bench, **setting)
        assert kept.columns == docs.columns and kept.count() == sum(not brute_hits(i, t, items)[4] for i, t, *_ in documents)
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_contamination(no_docs, bench).count() == 0


def brute_hits(i, text, items):
    words, hit, of = WORD.findall(lowered(text)), set(), set()
    for item, body in items:
        w = WORD.findall(lowered(body))
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    of.add(item)
    return i, len(words), len(hit), len(of - {None}), bool(hit)


def test_token_counts(docs, documents, no_docs):
    vocab = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    reference = pytest.importorskip("tokenizers").Tokenizer.from_file(vocab)
    got = tokens.count_tokens(docs, vocab).collect()
    size = lambda t: len(reference.encode(t or "", add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((t or "").encode()), size(t), size(t) > 512) for i, t, *_ in documents)
    odd = ["<|endoftext|>a<|endoftext|>", "aaaa" * 50, "  \n\n x", "é日本語😀 it's 12", "\x1c \x85​"]
    counter = tokens.TokenCounter(tokens.MergeTable.load(vocab), cache_size=2)
    assert [int(counter.count([t])[0]) for t in odd] == [size(t) for t in odd]
    assert tokens.count_tokens(no_docs, vocab).count() == 0
