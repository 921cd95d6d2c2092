"""Candidate triplets: structural validation, consolidation by the rules, submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import fold_accents, norm, one_line
from lexloom.operators.inference import RuleGraph, answers, explanation, few, keyed
from lexloom.operators.stats import gaps
from lexloom.sources.storage import store


def _as_claims(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.col("term").alias("subject"), "relation", F.col("target").alias("object"))


def validate(candidates: DataFrame, graph: RuleGraph, exclusions: DataFrame | None = None) -> DataFrame:
    """``candidates`` (term, relation, target, confidence) with ``validation_status`` and the confidence it leaves.

    ``unknown_term``: no node has the target's name.  ``duplicate``: the target
    is among ``exclusions`` (term, relation, folded target), or a positive
    triplet has it.  ``inconsistent``: a triplet denies it.  Else ``ok``.
    """
    candidates = store(candidates, "candidates")
    nodes = graph.edges.select(F.col("a").alias("o")).union(graph.edges.select("b")).distinct()
    targets = candidates.select("target").dropna().distinct().select(norm("target").alias("o"))
    lost = few(store(targets.join(nodes.hint("merge"), "o", "left_anti").distinct(), "lost"))
    # The probe has one row per key, so candidates meet it as they are, each of them dealt out once.
    hits = graph.probe.select(F.col("a").alias("s"), F.col("rel").alias("relation"), F.col("b").alias("o"), F.col("w").alias("direct"))
    rows = candidates.withColumns({"s": norm("term"), "o": norm("target")}).join(hits.hint("merge"), ["s", "relation", "o"], "left")
    rows = rows.join(lost.withColumn("lost", F.lit(True)), "o", "left")
    if exclusions is not None:
        barred = exclusions.select("term", "relation", F.col("target").alias("_folded"), F.lit(True).alias("barred")).distinct()
        rows = rows.withColumn("_folded", fold_accents("target")).join(barred, ["term", "relation", "_folded"], "left")
    else:
        rows = rows.withColumn("barred", F.lit(None).cast("boolean"))
    unknown = F.col("lost").isNotNull() | F.col("o").isNull()
    status = F.when(unknown, "unknown_term").when(F.col("barred").isNotNull() | (F.col("direct") > 0), "duplicate").when(F.col("direct").isNotNull(), "inconsistent").otherwise("ok")
    left = F.when(status == "inconsistent", F.least("confidence", F.lit(0.1))).otherwise(F.col("confidence"))
    keep = [c for c in candidates.columns if c != "confidence"]
    return rows.select(*keep, left.alias("confidence"), status.alias("validation_status"))


def consolidate(candidates: DataFrame, graph: RuleGraph, effort: int = 1) -> DataFrame:
    """Valid ``candidates`` with ``consolidation_status``, its schema and explanation; invalid ones keep nulls."""
    candidates = store(candidates, "valid")
    found = answers(graph, store(keyed(_as_claims(candidates.filter("validation_status = 'ok'"))), "asked"), effort)
    said = found.select(F.col("subject").alias("term"), "relation", F.col("object").alias("target"), "weight", F.col("schema").alias("consolidation_schema"), explanation(found).alias("consolidation_explanation"))
    rows = candidates.join(said, ["term", "relation", "target"], "left")
    # The rules are silent about the others; one with a null part was not asked.
    silent = (F.col("validation_status") == "ok") & F.col("weight").isNull() & F.col("term").isNotNull() & F.col("relation").isNotNull() & F.col("target").isNotNull()
    rows = rows.withColumns({"weight": F.when(silent, 0.0).otherwise(F.col("weight")), "consolidation_explanation": F.when(silent, "").otherwise(F.col("consolidation_explanation"))})
    status = F.when(F.col("weight") > 0, "consolidated").when(F.col("weight") < 0, "rejected").when(F.col("weight") == 0, "not_consolidated")
    status = F.when(F.col("validation_status") == "ok", status)
    left = F.when(status == "rejected", F.least("confidence", F.lit(0.1))).otherwise(F.col("confidence"))
    keep = [c for c in candidates.columns if c != "confidence"]
    valid = F.col("validation_status") == "ok"
    return rows.select(*keep, left.alias("confidence"), status.alias("consolidation_status"), F.when(valid, F.col("consolidation_schema")).alias("consolidation_schema"), F.when(valid, F.col("consolidation_explanation")).alias("consolidation_explanation"))


def fill_gaps(terms: DataFrame, proposals: DataFrame, graph: RuleGraph, relations: list[str] | None = None, effort: int = 1) -> DataFrame:
    """The ``proposals`` that meet a gap of ``terms``, with its ``gap_type``, validated and consolidated."""
    found = gaps(terms, graph.graph, relations).select("term", "relation", "gap_type")
    wanted = proposals.join(found, ["term", "relation"])
    return consolidate(validate(wanted, graph), graph, effort)


def submission_lines(candidates: DataFrame) -> DataFrame:
    """``term | relation | target | annotation < explanation >`` of consolidated, valid candidates."""
    good = candidates.filter("consolidation_status = 'consolidated' and validation_status = 'ok'")
    annotation = F.coalesce("annotation", F.lit("")) if "annotation" in candidates.columns else F.lit("")
    line = F.concat(F.col("term"), F.lit(" | "), "relation", F.lit(" | "), "target", F.lit(" | "), annotation, F.lit(" < "), one_line("consolidation_explanation"), F.lit(" >"))
    return good.select("term", "relation", "target", line.alias("line"))


def proven(triplets: DataFrame, consolidations: DataFrame) -> DataFrame:
    """The triplets with a registered consolidation, matched on folded names."""
    key = [fold_accents("term").alias("kt"), F.lower(F.trim("relation")).alias("kr"), fold_accents("target").alias("ko")]
    have = consolidations.select(*key).distinct()
    return triplets.select("*", *key).join(have, ["kt", "kr", "ko"], "left_semi").drop("kt", "kr", "ko")


def status_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("validation_status", "consolidation_status").agg(F.count("*").alias("n"))


def ready(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``ready_for_submission``: valid and consolidated."""
    return candidates.withColumn("ready_for_submission", F.coalesce((F.col("validation_status") == "ok") & (F.col("consolidation_status") == "consolidated"), F.lit(False)))


def submission_file(candidates: DataFrame, network: str, senses: DataFrame | None = None) -> DataFrame:
    """``(place, line)`` of the ``.enrich`` file: a head with the count, then the lines, with names of ``senses`` (name, decoded) made readable."""
    rows = candidates
    if senses is not None:
        for end in ("term", "target"):
            rows = rows.join(senses.select(F.col("name").alias(end), F.col("decoded").alias(f"{end}_shown")), end, "left")
            rows = rows.withColumn(end, F.coalesce(f"{end}_shown", end)).drop(f"{end}_shown")
    body = store(submission_lines(rows), "lines")  # written and counted
    body = body.select(F.struct(F.lit(1).alias("part"), F.lit(0).alias("at"), F.col("line").alias("key")).alias("place"), "line")
    head = [x.format(network=network) for x in schema.SUBMISSION_HEAD]
    n = body.agg(F.count("*").cast("string").alias("n"))
    lines = [F.format_string(head[0], "n"), *map(F.lit, head[1:])]
    top = n.select(F.explode(F.array(*[F.struct(F.lit(0).alias("part"), F.lit(i).alias("at"), x.alias("line")) for i, x in enumerate(lines)])).alias("x"))
    return top.select(F.struct("x.part", "x.at", F.lit("").alias("key")).alias("place"), "x.line").unionByName(body)


def registry(consolidated: DataFrame) -> DataFrame:
    """One row per folded (term, relation, target) of consolidated candidates, with the first explanation in order and its names as given."""
    key = [fold_accents("term").alias("kt"), F.lower(F.trim("relation")).alias("kr"), fold_accents("target").alias("ko")]
    good = consolidated.filter("consolidation_status = 'consolidated'")
    first = good.select(*key, F.struct("term", "relation", "target", "consolidation_explanation", "consolidation_schema").alias("x")).groupBy("kt", "kr", "ko").agg(F.min("x").alias("x"))
    return first.select("x.*")


def merge_registries(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and those of ``new`` whose folded key ``old`` has not."""
    key = lambda df: df.select("*", fold_accents("term").alias("kt"), F.lower(F.trim("relation")).alias("kr"), fold_accents("target").alias("ko"))
    fresh = key(new).join(key(old).select("kt", "kr", "ko"), ["kt", "kr", "ko"], "left_anti").drop("kt", "kr", "ko")
    return old.unionByName(fresh.select(*old.columns))
