"""The whole report of line deduplication against plain Python on the awkward documents."""

import random
import re
from collections import Counter, defaultdict

from lexloom.llm import linededup

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def chunks_of(spark, texts):
    """Chunks as the operator cuts them, from one text at a time."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", linededup.chunks_of(F.col("text")).alias("chunks")).collect()
    return {texts[r.k]: [(c.start, c.n_lines, c.chunk) for c in r.chunks] for r in rows}


def brute(cut, documents):
    """Rows per (id, text): every chunk that stands at two places stays at the smallest place only."""
    rank = lambda place: (place[0] is not None, place[0] or 0, place[1], place[2])
    places = defaultdict(set)
    for (i, key, text) in documents:
        for start, n, chunk in cut[text]:
            places[chunk].add((i, key, start, n))
    gone = defaultdict(set)
    for held in places.values():
        if len({p[:3] for p in held}) > 1:
            first = min(held, key=rank)
            for p in held:
                if p[:3] != first[:3]:
                    gone[p[:2]].update(range(p[2], p[2] + p[3]))
    return gone


def test_against_plain_python(spark, docs, documents):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    block = [line(9) for _ in range(12)]
    extra = [(500 + k, "\n".join([*[line(7) for _ in range(rng.randint(0, 5))], *block[k % 4 : 12 - k % 3], *["same line again"] * rng.randint(0, 40), line(4)])) for k in range(12)]
    rows = [(i, t) for i, t, *_ in documents] + extra
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = {(r.doc_id, r.text): r.key for r in frame.selectExpr("doc_id", "text", "xxhash64(text) AS key").collect()}
    whole = sorted({t for _, t in rows if t is not None})
    cut = chunks_of(spark, whole)
    gone = brute(cut, {(i, keyed[i, t], t) for i, t in rows if t is not None})
    expected = Counter()
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        out = sorted(gone.get((i, keyed[i, t]), ()))
        expected[i, len(lines), len(out), sum(len(lines[k].encode()) for k in out)] += 1
    found = linededup.report(linededup.find_repeats(frame)).collect()
    ranges = lambda text: [tuple(map(int, x.split("-"))) for x in text.split(",") if x]
    # Bytes of the lines alone; the report also counts the line ends inside a range.
    got = Counter((r.doc_id, r.n_lines, r.n_removed_lines, r.removed_bytes - sum(b - a - 1 for a, b in ranges(r.removed))) for r in found)
    assert got == expected


def test_runs_of_one_line(spark):
    """Two texts with a long run of one line: the later one keeps nothing of it."""
    rows = [(1, "\n".join(["first text", *["the very same line"] * 200, "its end"])), (2, "\n".join(["other text", *["the very same line"] * 200, "another end"]))]
    got = {r.doc_id: r for r in linededup.report(linededup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[2].removed == "1-201" and got[1].n_removed_lines > 0


def test_positive_classes_are_the_same():
    from lexloom.llm.text import JAVA_WORD, WORD

    java = re.compile(JAVA_WORD.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
    for code in [*range(0x250), 0x2028, 0xD7FF, 0xFFFF, 0x10FFFF]:
        assert bool(java.fullmatch(chr(code))) == bool(re.fullmatch(WORD, chr(code).lower() if code < 128 else chr(code)))
