"""Claims that arrive as a stream, checked in micro-batches against a graph snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.inference import RuleGraph
from lexloom.operators.verify import verify


def verify_stream(claims: DataFrame, graph: DataFrame, out: str, checkpoint: str, effort: int = 1) -> StreamingQuery:
    """Append the verdicts of each micro-batch as a folder of its own below ``out``; a batch that is run again overwrites its folder."""
    rules = RuleGraph.stored(graph)  # every batch reads its views

    def check(batch: DataFrame, number: int) -> None:
        verify(rules, batch, effort).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return claims.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_consolidations(stream: DataFrame, at: str, keep: str = "1 day") -> DataFrame:
    """A stream of consolidations without repeats of (term, relation, target) that come within ``keep`` of each other.

    ``at`` is the event time; state is dropped once the watermark has passed, so
    it is bounded by what ``keep`` holds.
    """
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark(["term", "relation", "target"])
