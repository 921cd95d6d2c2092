"""Fill-in-middle against plain Python and as an exact round trip."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexloom.llm import fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """The contract, step by step."""
    text, digest = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, sha(f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), sha(text)
    return n, "psm", a, b - a, sha(f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), sha(text)


def test_report_equals_the_contract(spark, documents):
    rows = [(r[0], r[1]) for r in documents]
    rows += [(900, "a<P>b"), (901, "<M>"), (902, "\U0001f600" * 7 + "é\r\n"), (903, "\0 and \x85"), (None, "no id")]
    rows += [(1000 + i, "word " * (i % 40)) for i in range(200)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    found = fim.report(fim.fill_in_middle(df)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, found), key=key) == sorted(((i, *plain(i, t)) for i, t in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert fim.report(fim.fill_in_middle(df)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.text(max_size=60).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_round_trip(doc_id, text):
    t = fim.Transform(plain=0, spm=50)
    n, form, prefix, middle = t.apply(t.compiled(), str(doc_id), text)
    assert n == len(text) and t.restored(t.written(text, form, prefix, middle), form) == text


@pytest.mark.parametrize("unit, text, n", [(r"\X", "éx\r\n", 3), (r"\w+\W*", "one two, three", 3), (r"\d", "12a", 0)])
def test_other_units(unit, text, n):
    t = fim.Transform(unit=unit, plain=0)
    for doc_id in range(30):
        found, form, prefix, middle = t.apply(t.compiled(), str(doc_id), text)
        assert found == n and (form == "plain") == (n == 0)
        if n:
            ends = {0} | {m.end() for m in __import__("regex").finditer(unit, text)}
            assert prefix in ends and prefix + middle in ends


def test_other_markers_and_shares():
    t = fim.Transform(markers=fim.Markers("[pre]", "[suf]", "[mid]"), plain=0, spm=100)
    n, form, prefix, middle = t.apply(t.compiled(), "7", "abc<P>def")
    out = t.written("abc<P>def", form, prefix, middle)
    assert form == "spm" and out.startswith("[suf]") and t.restored(out, form) == "abc<P>def"
