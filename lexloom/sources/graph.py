"""Readers of graph snapshots, and the triplet table that all operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import norm
from lexloom.operators.senses import decode_names


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and relation types of a Parquet snapshot, with explicit schemas."""
    kinds = [("nodes", schema.NODES), ("edges", schema.EDGES), ("relation_types", schema.RELATION_TYPES)]
    nodes, edges, types = (spark.read.schema(s).parquet(f"{path}/{n}.parquet") for n, s in kinds)
    return nodes, edges, types


def triplets(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with names: ``(id, src, rel, tgt, w, tgt_id, tgt_type, tgt_decoded)``. Edges with an unknown end are dropped."""
    named = nodes.select("id", "name", F.col("type").alias("kind")).join(decode_names(nodes).select("id", "decoded").hint("merge"), "id", "left")
    source = nodes.select(F.col("id").alias("node1"), F.col("name").alias("src"))
    target = named.select(F.col("id").alias("node2"), F.col("name").alias("tgt"), F.col("kind").alias("tgt_type"), F.coalesce("decoded", "name").alias("tgt_decoded"))
    rels = types.select(F.col("id").alias("type"), F.col("name").alias("known"))
    full = edges.join(source.hint("merge"), "node1").join(target.hint("merge"), "node2").join(rels, "type", "left")
    rel = F.coalesce("known", F.concat(F.lit("type_"), F.col("type").cast("string")))
    return full.select("id", "src", rel.alias("rel"), "tgt", "w", F.col("node2").alias("tgt_id"), "tgt_type", "tgt_decoded")


def plain_triplets(edges: DataFrame) -> DataFrame:
    """Triplets of a graph without senses: ``(id, src, rel, tgt, w)`` with the target as its own decoded name."""
    return edges.select("id", "src", "rel", "tgt", F.col("w").cast("double").alias("w"), F.lit(None).cast("long").alias("tgt_id"), F.lit(schema.TERM_TYPE).alias("tgt_type"), F.col("tgt").alias("tgt_decoded"))


def write_triplets(graph: DataFrame, path: str) -> None:
    """Store triplets by relation, sorted by source inside a file, so that lookups prune files and row groups."""
    keyed = graph.withColumn("src_norm", norm("src"))
    keyed.repartition("rel", F.pmod(F.xxhash64("src_norm"), F.lit(16))).sortWithinPartitions("rel", "src_norm").write.mode("overwrite").partitionBy("rel").parquet(path)
