"""The registry of consolidated triplets as keyed state of a stream.

One state for each folded (term, relation, target): which names and which
explanation came first, what was said last, and how often it came.  A triplet
that comes again changes its state and makes no second line.  State and
progress lie in the stream's checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexloom.functions.text import fold_accents, one_line

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "term string, relation string, target string, explanation string, how string, times long"
_OUT = f"kt string, kr string, ko string, {_STATE}, is_new boolean"
_CHANGE = Row("kt", "kr", "ko", "term", "relation", "target", "explanation", "how", "times", "is_new")


class Consolidations(StatefulProcessor):
    """Keeps one triplet; of the rows of a batch the earliest names it and the latest explains it, each held by itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.held.get() if self.held.exists() else None
        times, earliest, latest = (before[5] if before else 0), None, None
        for r in rows:
            times += 1
            mark = (r.at, r.term, r.target, r.explanation or "", r.how or "")
            earliest = min(earliest, (mark, r)) if earliest else (mark, r)
            latest = max(latest, (mark, r)) if latest else (mark, r)
        if latest is None:
            return
        named = before[:3] if before else (earliest[1].term, earliest[1].relation, earliest[1].target)
        state = (*named, (latest[1].explanation or "").strip(), (latest[1].how or "").strip(), times)
        self.held.update(state)
        yield _CHANGE(*key, *state, before is None)

    def close(self) -> None:
        pass


def registered(consolidations: DataFrame) -> DataFrame:
    """The stream of changes of the registry: per batch and triplet that came its state and whether it ``is_new``.

    ``consolidations`` is a stream of ``(at, term, relation, target,
    consolidation_explanation, consolidation_schema)``; ``at`` orders them.
    Rows with a null name are left out.
    """
    named = consolidations.dropna(subset=["at", "term", "relation", "target"])
    rows = named.select("at", "term", "relation", "target", F.col("consolidation_explanation").alias("explanation"), F.col("consolidation_schema").alias("how"))
    rows = rows.withColumns({"kt": fold_accents("term"), "kr": F.lower(F.trim("relation")), "ko": fold_accents("target")})
    return rows.groupBy("kt", "kr", "ko").transformWithState(statefulProcessor=Consolidations(), outputStructType=_OUT, outputMode="Update", timeMode="None")


def register_stream(consolidations: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the registry of ``consolidations`` and write each batch's changes as a folder of its own below ``out``; a batch that is run again overwrites its folder.

    Sets the session's state store to RocksDB, which such state needs.
    """
    consolidations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return registered(consolidations).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{_OUT}, batch long").parquet(out)


def registry_now(spark: SparkSession, out: str) -> DataFrame:
    """The registry that the changes below ``out`` lead to: ``(term, relation, target, explanation, how, times)``."""
    last = _changes(spark, out).groupBy("kt", "kr", "ko").agg(F.max_by(F.struct("term", "relation", "target", "explanation", "how", "times"), "batch").alias("x"))
    return last.select("x.*")


def registry_lines(spark: SparkSession, out: str) -> DataFrame:
    """``(batch, line)``: a line for each triplet, written when it was new."""
    line = F.concat("term", F.lit(" | "), "relation", F.lit(" | "), "target", F.lit(" |  < "), one_line("explanation"), F.lit(" >"))
    return _changes(spark, out).filter("is_new").select("batch", line.alias("line"))


def running_count(spark: SparkSession, out: str) -> DataFrame:
    """``(batch, n_new, n_so_far)``: triplets consolidated in each batch and up to it."""
    new = _changes(spark, out).groupBy("batch").agg(F.count_if("is_new").alias("n_new"))
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row a batch
    return new.withColumn("n_so_far", F.sum("n_new").over(upto))
