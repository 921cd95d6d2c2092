"""Annotations that the graph attaches to its own edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import norm, one_line, pipe_safe


def edge_annotations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(rel_id, annotations)``: kind, value and weight of the annotations of each edge, strongest first.

    Edge ``n`` is annotated by the edges of three types that leave the node
    named ``:rn`` for a term.
    """
    kinds = F.create_map(*[F.lit(x) for pair in schema.ANNOTATION_KINDS.items() for x in pair])
    anchor = nodes.filter(F.col("name").rlike("^:r[0-9]+$")).select(F.col("id").alias("node1"), F.expr("try_cast(substring(name, 3) as bigint)").alias("rel_id"))
    value = nodes.filter(F.col("type") == schema.TERM_TYPE).select(F.col("id").alias("node2"), F.col("name").alias("value"))
    found = edges.filter(F.col("type").isin(list(schema.ANNOTATION_KINDS))).join(anchor.hint("merge"), "node1").join(value.hint("merge"), "node2")
    entry = F.struct((-F.abs("w")).alias("order"), F.col("id").alias("edge"), kinds[F.col("type")].alias("kind"), "value", "w")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda a: F.struct(a.kind.alias("kind"), a.value.alias("value"), a.w.alias("w")))
    return found.groupBy("rel_id").agg(ordered.alias("annotations"))


def category(raw: Column | str) -> Column:
    """Canonical category of a spelling, null if it is none."""
    table = F.create_map(*[F.lit(x) for pair in schema.CATEGORIES.items() for x in pair])
    return table[F.lower(F.trim(raw))]


def annotable(graph: DataFrame, annotations: DataFrame, top_k: int = 8) -> DataFrame:
    """The strongest triplets of the annotated relations with their ``existing`` category (the first inside the taxonomy)."""
    turn = F.row_number().over(Window.partitionBy("src", "rel").orderBy(F.abs("w").desc(), "id"))
    top = graph.filter(F.col("rel").isin(schema.ANNOTATED)).withColumn("turn", turn).filter(F.col("turn") <= top_k)
    existing = F.get(F.filter(F.transform("annotations", lambda a: category(a.value)), lambda c: c.isNotNull()), F.lit(0))
    return top.join(annotations.withColumnRenamed("rel_id", "id"), "id", "left").select("id", F.col("src").alias("subject"), F.col("rel").alias("relation"), F.col("tgt_decoded").alias("target"), "w", existing.alias("existing"))


def disagreements(proposals: DataFrame) -> DataFrame:
    """``proposals`` with canonical ``category`` and whether it contradicts an existing one."""
    ours = category("category")
    differs = F.coalesce((F.coalesce("existing", F.lit("")) != "") & ours.isNotNull() & (F.lower("existing") != F.lower(ours)), F.lit(False))
    return proposals.withColumn("category", ours).withColumn("disagrees", differs)


def of_triplets(asked: DataFrame, graph: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per asked ``(subject, relation, target)`` its ``annotations`` (empty if none) and ``found``: whether the triplet exists.

    A target is met by its name or its readable one, stripped and lowered; the first edge in order counts.
    """
    keyed = asked.select("subject", "relation", "target").distinct().withColumn("o", norm("target"))
    edges = graph.select("id", F.col("src").alias("subject"), F.col("rel").alias("relation"), F.explode(F.array_distinct(F.array(norm("tgt"), norm("tgt_decoded")))).alias("o"))
    first = keyed.join(edges, ["subject", "relation", "o"]).groupBy("subject", "relation", "target").agg(F.min("id").alias("rel_id"))
    held = first.join(annotations, "rel_id", "left")
    out = keyed.drop("o").join(held, ["subject", "relation", "target"], "left")
    return out.select("subject", "relation", "target", F.coalesce("annotations", F.array().cast(annotations.schema["annotations"].dataType)).alias("annotations"), F.col("rel_id").isNotNull().alias("found"))


def by_index(triplets: DataFrame, raw: DataFrame, within: list[str] | None = None) -> DataFrame:
    """``triplets`` (with ``index``) with the raw proposals ``(at, index, category, justification)`` of their index.

    Indices count inside the list that was asked about, which the columns
    ``within`` name if there are several.  The last of several proposals
    counts, an index without a triplet is left out, and a triplet without a
    proposal keeps a null category.
    """
    key = [*(within or []), "index"]
    last = raw.groupBy(*key).agg(F.max_by(F.struct("category", "justification"), "at").alias("x"))
    said = triplets.join(last, key, "left")
    return said.select(*triplets.columns, category("x.category").alias("category"), F.trim(F.coalesce("x.justification", F.lit(""))).alias("justification"))


def annotation_file(proposals: DataFrame, network: str) -> DataFrame:
    """``(place, line)`` of the ``.annot`` file: head with the counts, annotated triplets, then those that differ from the graph, which is called ``network``.

    Lines of a part are ordered by triplet; ``proposals`` has subject, relation,
    target, category (null: not annotable), justification and existing.
    """
    safe = lambda c: F.trim(pipe_safe(F.coalesce(F.col(c), F.lit(""))))
    differs = F.coalesce((F.coalesce("existing", F.lit("")) != "") & (F.lower("existing") != F.lower("category")), F.lit(False))
    kind = F.when(F.col("category").isNull(), 0).when(differs, 2).otherwise(1)
    head = F.concat(safe("subject"), F.lit("|"), F.col("relation"), F.lit("|"), safe("target"))
    said = F.concat(F.lit(" < "), one_line(F.coalesce("justification", F.lit(""))), F.lit(" >"))
    line = F.when(kind == 1, F.concat(head, F.lit("|"), "category", said)).when(kind == 2, F.concat(head, F.lit(f"|{network}:"), F.trim("existing"), F.lit(f"|{schema.PROPOSED}:"), "category", said))
    rows = proposals.select(kind.alias("kind"), line.alias("line"))
    n = rows.agg(*[F.count_if(F.col("kind") == k).cast("string").alias(f"n{k}") for k in (0, 1, 2)])
    head_lines, differences = ([x.format(network=network) for x in part] for part in (schema.ANNOTATION_HEAD, schema.DIFFERENCES_HEAD))
    first = [F.format_string(head_lines[0], "n1", "n2", "n0"), *map(F.lit, head_lines[1:])]
    notes = n.select(F.explode(F.array(*[F.struct(F.lit(0).alias("part"), F.lit(i).alias("at"), x.alias("line")) for i, x in enumerate(first)])).alias("x"))
    more = n.filter("n2 <> '0'").select(F.explode(F.array(*[F.struct(F.lit(2).alias("part"), F.lit(i).alias("at"), F.lit(x).alias("line")) for i, x in enumerate(differences)])).alias("x"))
    heads = notes.unionByName(more).select(F.struct("x.part", "x.at", F.lit("").alias("key")).alias("place"), "x.line")
    body = rows.filter("kind > 0").select(F.struct((2 * F.col("kind") - 1).cast("int").alias("part"), F.lit(0).alias("at"), F.col("line").alias("key")).alias("place"), "line")
    return heads.unionByName(body)


def file_counts(proposals: DataFrame) -> DataFrame:
    """``(n_annotated, n_differing, n_skipped)`` of a file of proposals."""
    differs = F.coalesce((F.coalesce("existing", F.lit("")) != "") & (F.lower("existing") != F.lower("category")), F.lit(False))
    has = F.col("category").isNotNull()
    return proposals.agg(F.count_if(has & ~differs).alias("n_annotated"), F.count_if(has & differs).alias("n_differing"), F.count_if(~has).alias("n_skipped"))
