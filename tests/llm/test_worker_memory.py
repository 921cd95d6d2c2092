"""Python workers hold little between tasks: they live on, and what they keep counts beside their executor's heap."""

import re
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from lexloom.llm import quality
from lexloom.llm.membership import may_contain

ROOT = Path(__file__).resolve().parents[2]

HELD = """
import re
from lexloom.llm.storage import lean

def held():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

kept = []

def run(batches):
    for b in batches:
        texts = [b"x" * 2000 for _ in range(100_000)]
        kept.append(b"y" * 2000)  # nothing above it is free
        yield len(texts)

before = held()
assert list(lean(run)([1, 2])) == [100_000] * 2
print(held() - before)
"""


def _said(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip()


def test_freed_memory_goes_back_after_a_task():
    assert int(_said(HELD)) < 60  # MB; without that some 200


def test_stages_of_the_pipeline_do_not_load_pandas():
    assert _said("import sys, lexloom.llm.quality, lexloom.llm.neardup, lexloom.llm.decontaminate; print('pandas' in sys.modules)") == "False"


def test_verdicts_are_those_of_plain_python(spark):
    rows = [(i, " ".join(f"w{i * j % 7}" for j in range(i % 90)) if i % 9 else None) for i in range(150)]
    machine = quality.train([], [])
    machine.w[:] = [((i * 37) % 101 - 50) / 25 for i in range(quality.WIDTH)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, machine, 0.5).collect()}
    for i, text in rows:
        places, values = quality.featurise(text, quality._Buckets())
        score = machine.score(*quality._ragged([(places, values)]))[0]
        assert abs(got[i][0] - score) < 1e-4 and got[i][1] == (got[i][0] >= 0.5)
    assert {r.doc_id for r in quality.accepted(docs, machine, 0.5).collect()} == {i for i, (_, p) in got.items() if p}


def test_members_always_pass(spark):
    table = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k long, x string")
    asked = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (4, "zz")], "k long, x string")
    passed = asked.filter(may_contain(table, ["k", "x"], [F.col("k"), F.col("x")])).collect()
    assert {(r.k, r.x) for r in passed} >= {(1, "a"), (None, "b"), (3, None)} and not re.search("zz", str(passed))
