"""Statistics of triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import whole


def by_relation(graph: DataFrame) -> DataFrame:
    w = F.col("w")
    return graph.groupBy(F.col("rel").alias("relation")).agg(F.count("*").alias("n_total"), F.count_if(w > 0).alias("n_pos"), F.count_if(w < 0).alias("n_neg"), F.max("w").alias("max_w"), F.min("w").alias("min_w"), F.round(F.avg("w"), 4).alias("mean_w"))


def by_target(graph: DataFrame, limit: int = 20) -> DataFrame:
    """The targets with the most edges: occurrences, distinct relations, total and largest weight."""
    found = graph.groupBy(F.col("tgt").alias("target")).agg(F.count("*").alias("occurrences"), F.countDistinct("rel").alias("relations"), F.round(F.sum("w"), 4).alias("total_w"), F.max("w").alias("max_w"))
    return found.orderBy(F.col("occurrences").desc(), F.col("total_w").desc(), "target").limit(limit)


def degree(graph: DataFrame) -> DataFrame:
    ends = graph.select(F.explode(F.array("src", "tgt")).alias("term"))
    return ends.groupBy("term").agg(F.count("*").alias("degree"))


def gaps(terms: DataFrame, graph: DataFrame, relations: list[str] | None = None, least: int = 3, seen: int = 50) -> DataFrame:
    """``(term, relation, gap_type, severity, n_pos, n_neg)`` of terms whose relation lacks positive triplets.

    Counts are over the ``seen`` strongest triplets of a term and relation.
    Terms meet relations by an exploded literal, not a join; without
    ``relations`` it is those of nouns and of verbs.
    """
    relations = relations if relations is not None else [*schema.NOUN_GAPS, *schema.VERB_GAPS]
    wanted = terms.select("term", F.explode(F.array(*[F.lit(r) for r in sorted(set(relations))])).alias("relation"))
    turn = F.row_number().over(Window.partitionBy("src", "rel").orderBy(F.abs("w").desc(), "id"))
    top = graph.filter(F.col("rel").isin(relations)).withColumn("turn", turn).filter(F.col("turn") <= seen)
    counts = top.groupBy(F.col("src").alias("term"), F.col("rel").alias("relation")).agg(F.count_if(F.col("w") > 0).alias("p"), F.count_if(F.col("w") < 0).alias("n"))
    n_pos, n_neg = F.coalesce("p", F.lit(0)), F.coalesce("n", F.lit(0))
    kind = F.when((n_pos == 0) & (n_neg > 0), "negative_filled").when(n_pos == 0, "missing").when(n_pos < least, "low_coverage")
    severity = F.when(kind == "negative_filled", 0.3).when(kind == "missing", 1.0).otherwise(0.6)
    return wanted.join(counts, ["term", "relation"], "left").select("term", "relation", kind.alias("gap_type"), severity.alias("severity"), n_pos.alias("n_pos"), n_neg.alias("n_neg")).filter(F.col("gap_type").isNotNull())


def gap_details(gaps: DataFrame, graph: DataFrame, network: str) -> DataFrame:
    """``gaps`` with ``detail``: the count in words, of a negative-filled one also its three most negative targets."""
    turn = F.row_number().over(Window.partitionBy("src", "rel").orderBy("w", "id"))
    asked = gaps.filter("gap_type = 'negative_filled'").select(F.col("term").alias("src"), F.col("relation").alias("rel")).distinct()
    worst = graph.filter("w < 0").join(asked, ["src", "rel"], "left_semi").withColumn("turn", turn).filter("turn <= 3")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tgt", "w"))), lambda x: F.concat(x.tgt, F.lit(" (w="), whole(x.w), F.lit(")"))), "; ")
    named = worst.groupBy(F.col("src").alias("term"), F.col("rel").alias("relation")).agg(shown.alias("worst"))
    texts = {k: v.format(network=network) for k, v in schema.GAP_TEXTS.items()}
    kind, pair = F.col("gap_type"), ["term", "relation"]
    detail = F.when(kind == "negative_filled", F.format_string(texts["negative_filled"], F.col("n_neg").cast("string"), *pair, "worst"))
    detail = detail.when(kind == "missing", F.format_string(texts["missing"], *pair)).otherwise(F.format_string(texts["low_coverage"], F.col("n_pos").cast("string"), *pair))
    return gaps.join(named, pair, "left").select(*gaps.columns, detail.alias("detail"))
