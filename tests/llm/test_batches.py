"""Whole texts go to Python in batches of bounded size, and once."""

import pyarrow as pa

from lexloom.llm import decontaminate
from lexloom.llm.storage import materialise

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_are_bounded_while_a_table_is_written(spark):
    before = spark.conf.get(KEY)
    sizes = spark.range(0, 100, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert [r.n for r in materialise(sizes, "sizes", 40).collect()] == [40, 40, 20]
    assert spark.conf.get(KEY) == before


def test_texts_travel_once(spark, monkeypatch):
    seen, real = [], decontaminate.stored_places
    monkeypatch.setattr(decontaminate, "stored_places", lambda rows, *more: seen.append(rows.columns) or real(rows, *more))
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "de", f"a {words} b"), (2, "de", "other words"), (3, "en", None)], "doc_id long, row string, `my.text` string")
    items = spark.createDataFrame([("x", words)], "item_id string, text string")
    found = decontaminate.decontaminate(docs, items, text_col="my.text")
    assert sorted(map(tuple, found.collect())) == [(2, "de", "other words"), (3, "en", None)]
    assert seen == [["row", "rid"]]
