"""A stored graph whose look-ups need no shuffle on its side.

Triplets are written as a table bucketed by source, and once more with one row
for each (source, relation, target name), bucketed by all three, so that a join
from terms or from whole triplets meets the buckets where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import norm

#: Buckets of a table; a power of two well above the cores serves graphs of any size.
BUCKETS = 64


@dataclass(frozen=True)
class BucketedGraph:
    """Names of the tables of one graph: ``edges`` (a, rel, tgt, m, ...) by source, partitioned by relation, and ``probe`` (a, rel, b, w) by its whole key."""

    edges: str
    probe: str
    buckets: int

    def drop(self, spark: SparkSession) -> None:
        for table in (self.edges, self.probe):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def write_buckets(graph: DataFrame, name: str, buckets: int = BUCKETS) -> BucketedGraph:
    """Store ``graph`` as bucketed tables ``name_edges`` and ``name_probe`` in the session's warehouse; a graph of that name is replaced."""
    rows = graph.select("id", norm("src").alias("a"), "src", "tgt", norm("tgt").alias("m"), norm("tgt_decoded").alias("m2"), F.col("tgt_decoded").alias("shown"), "w", "tgt_type", "rel")
    edges = rows.repartition(buckets, "a")
    edges.write.mode("overwrite").format("parquet").partitionBy("rel").bucketBy(buckets, "a").sortBy("a").saveAsTable(f"{name}_edges")
    keys = rows.select("a", "rel", F.explode(F.array_distinct(F.array("m", "m2"))).alias("b"), "id", "w")
    probe = keys.groupBy("a", "rel", "b").agg(F.min_by("w", "id").alias("w")).repartition(buckets, "a", "rel", "b")
    probe.write.mode("overwrite").format("parquet").bucketBy(buckets, "a", "rel", "b").sortBy("a", "rel", "b").saveAsTable(f"{name}_probe")
    return BucketedGraph(f"{name}_edges", f"{name}_probe", buckets)


def edges_of(spark: SparkSession, graph: BucketedGraph, terms: DataFrame, relations: list[str]) -> DataFrame:
    """Triplets ``(term, relation, target, w)`` of ``terms`` (a column ``term``) over ``relations``: only these relations' files are read, only the terms are shuffled."""
    asked = terms.select("term", norm("term").alias("a")).distinct().repartition(graph.buckets, "a")
    held = spark.table(graph.edges).filter(F.col("rel").isin(relations))
    return asked.join(held.hint("merge"), "a").select("term", F.col("rel").alias("relation"), F.col("shown").alias("target"), "w")


def two_hops(spark: SparkSession, graph: BucketedGraph, claims: DataFrame, first: str) -> DataFrame:
    """Claims ``(subject, relation, object)`` with each ``mid`` that their subject reaches by a positive triplet of ``first``, and ``w1``, ``w2``, the weights of that and of (mid, relation, object).

    The claims move twice, once to their subjects and once to the triplets
    asked for; the graph never moves.
    """
    asked = claims.select("subject", "relation", "object", norm("subject").alias("a"), norm("object").alias("o")).distinct().repartition(graph.buckets, "a")
    near = spark.table(graph.edges).filter(F.col("rel") == first).filter("w > 0").select("a", F.col("shown").alias("mid"), "m", F.col("w").alias("w1"))
    met = asked.join(near.hint("merge"), "a").drop("a").repartition(graph.buckets, "m", "relation", "o")
    probe = spark.table(graph.probe).select(F.col("a").alias("m"), F.col("rel").alias("relation"), F.col("b").alias("o"), F.col("w").alias("w2"))
    return met.join(probe.hint("merge"), ["m", "relation", "o"]).select("subject", "relation", "object", "mid", "w1", "w2")
