"""Fact checking: claims against direct triplets, then against the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import norm, whole
from lexloom.operators.budget import infer_within
from lexloom.operators.inference import CLAIM, STEP, RuleGraph, answers, explanation, few, keyed
from lexloom.operators.senses import resolve_senses
from lexloom.sources.storage import store

STATUSES = ["supported", "contradicted", "unknown"]


def direct_hits(graph: RuleGraph, claims: DataFrame) -> DataFrame:
    """Claims with a triplet of their own, matched by name or decoded name: ``direct`` is its weight, ``edge`` its id, ``hit`` its target as shown."""
    return _direct(graph, keyed(claims))


def _direct(graph: RuleGraph, asked: DataFrame) -> DataFrame:
    """As :func:`direct_hits`, of claims that are :func:`keyed`."""
    probe = graph.probe.select(F.col("a").alias("s"), F.col("rel").alias("relation"), F.col("b").alias("o"), F.col("w").alias("direct"), "edge", F.col("shown").alias("hit"))
    return asked.join(probe.hint("merge"), ["s", "relation", "o"]).select(*CLAIM, "direct", "edge", "hit")


def resolve_claims(claims: DataFrame, senses: DataFrame) -> DataFrame:
    """``claims`` with soft references to a sense, as subject or object, replaced by the sense's name; one that fits no sense stays."""
    asked = claims.select(F.explode(F.array("subject", "object")).alias("soft")).filter(F.contains("soft", F.lit(">"))).distinct()
    names = resolve_senses(asked, senses).filter("name is not null")
    out = claims
    for end in ("subject", "object"):
        out = out.join(names.select(F.col("soft").alias(end), F.col("name").alias(f"{end}_name")).hint("merge"), end, "left")
    resolved = {c: F.coalesce(f"{c}_name", c).alias(c) for c in ("subject", "object")}
    return out.select(*[resolved.get(c, F.col(c)) for c in claims.columns])


def indicative(graph: RuleGraph, claims: DataFrame, limit: int = 5) -> DataFrame:
    """The strongest triplets of (subject, relation) where there are ``limit`` or more."""
    return _evidence(graph, keyed(claims), limit)


def _evidence(graph: RuleGraph, asked: DataFrame, limit: int = 5) -> DataFrame:
    """As :func:`indicative`, of claims that are :func:`keyed`: most terms have fewer triplets, so the claims look among those that are left."""
    turn = F.row_number().over(Window.partitionBy("a", "rel").orderBy(F.abs("w").desc(), "id"))
    top = graph.edges.withColumn("turn", turn).filter(F.col("turn") <= limit)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("turn", "shown", "w"))), lambda x: F.struct(x.shown.alias("target"), x.w.alias("w")))
    many = top.groupBy(F.col("a").alias("s"), F.col("rel").alias("relation")).agg(F.count("*").alias("n"), shown.alias("evidence")).filter(F.col("n") >= limit).drop("n")
    return many.join(asked.select("s", "relation").distinct().hint("merge"), ["s", "relation"], "left_semi")


def verify(graph: RuleGraph, claims: DataFrame, effort: int = 0, bypass: bool = False, relations: list[str] | None = None, annotations: DataFrame | None = None, senses: DataFrame | None = None, network: str = "Le réseau", budget: int | None = None) -> DataFrame:
    """``claims`` with ``status``, ``confidence``, ``schema``, ``weight``, ``proof``, ``evidence`` and ``explanation``.

    ``claims`` has subject, relation, object and a boolean ``polarity`` (null:
    true).  A weight of zero counts as a denial here.  ``bypass`` lets the
    rules speak before the direct triplet.  ``relations`` are the known ones.
    With ``senses`` soft references are resolved first; with ``annotations``
    (rel_id, annotations) a direct triplet's are named.  Explanations call the
    graph ``network``.  With a ``budget`` the rules are silent about a claim
    that needs more look-ups.  Claims and what is found for them meet by
    shuffle: as files they are far smaller than in a driver that would have to
    send them to all tasks.
    """
    if senses is not None:
        claims = resolve_claims(claims, senses)
    claims = store(claims, "claims")
    asked = store(keyed(claims), "asked")  # direct triplets, rules and evidence all read them
    says = F.coalesce("polarity", F.lit(True))
    known = F.col("relation").isin(relations) if relations is not None else F.lit(True)
    rows = claims.join(_direct(graph, asked).hint("merge"), CLAIM, "left")
    if annotations is not None:
        rows = rows.join(annotations.withColumnRenamed("rel_id", "edge").hint("merge"), "edge", "left")
    else:
        rows = rows.withColumn("annotations", F.lit(None).cast("array<struct<kind:string,value:string,w:double>>"))
    if effort >= 1:
        found = answers(graph, asked, effort) if budget is None else infer_within(graph, claims.select(*CLAIM).distinct(), budget, effort, relations)
        found = found.select(*CLAIM, "schema", F.col("weight").alias("inferred"), F.col("confidence").alias("sure"), "proof", explanation(found).alias("said"))
        rows = rows.join(found.hint("merge"), CLAIM, "left")
    else:
        rows = rows.select("*", F.lit(None).cast("string").alias("schema"), F.lit(0.0).alias("inferred"), F.lit(0.0).alias("sure"), F.array().cast(f"array<{STEP}>").alias("proof"), F.lit("").alias("said"))
    evidence = few(store(_evidence(graph, asked), "evidence"))
    rows = rows.withColumn("_s", norm("subject")).join(evidence.withColumnRenamed("s", "_s"), ["_s", "relation"], "left")
    by_rule = (F.col("inferred") != 0) & (F.col("direct").isNull() | F.lit(bypass))
    how = F.when(~known, "unknown").when(by_rule, "rule").when(F.col("direct").isNotNull(), "direct").when(F.col("evidence").isNotNull(), "hint").otherwise("unknown")
    rows = rows.withColumn("how", how)
    weight = F.when(F.col("how") == "rule", F.col("inferred")).when(F.col("how") == "direct", F.col("direct"))
    agrees = (weight > 0) == says
    status = F.when(weight.isNull(), "unknown").when(agrees, "supported").otherwise("contradicted")
    sure = F.when(F.col("how") == "rule", F.col("sure")).when(F.col("how") == "direct", F.bround(F.tanh(F.abs("direct") / schema.STRONG_WEIGHT), 3)).when(F.col("how") == "hint", 0.3).otherwise(0.0)
    ruled = F.col("how") == "rule"
    return rows.select(*claims.columns, status.alias("status"), sure.alias("confidence"), F.when(ruled, F.col("schema")).alias("schema"), weight.alias("weight"), F.when(ruled, F.col("proof")).otherwise(F.array().cast(f"array<{STEP}>")).alias("proof"), F.when(F.col("how") == "hint", F.col("evidence")).alias("evidence"), _text(known, network).alias("explanation"))


def _text(known: Column, network: str) -> Column:
    """A verdict in words."""
    texts = {k: v.format(network=network) for k, v in schema.VERDICT_TEXTS.items()}
    claim = ["subject", "relation", "object"]
    shown = F.array_join(F.transform(F.slice("annotations", 1, 3), lambda a: F.concat(a.value, F.lit(" (w="), whole(a.w), F.lit(")"))), ", ")
    exceptions = F.slice(F.filter("annotations", lambda a: a.kind == "exception"), 1, 3)
    named = F.array_join(F.transform(exceptions, lambda a: a.value), ", ")
    direct = F.concat(
        F.format_string(texts["direct"], "subject", "relation", "hit", whole("direct"), F.when(F.col("direct") > 0, "affirmation").otherwise("négation")),
        F.when(F.size("annotations") > 0, F.format_string(texts["annotations"], shown)).otherwise(""),
        F.when(F.size(exceptions) > 0, F.format_string(texts["exceptions"], named)).otherwise(""),
    )
    inferred = F.concat(F.when(F.col("direct").isNotNull(), texts["forced"]).otherwise(texts["inferred"]), "said")
    out = F.when(~known, F.format_string(texts["unknown_relation"], "relation")).when(F.col("how") == "rule", inferred).when(F.col("how") == "direct", direct)
    return out.when(F.col("how") == "hint", F.format_string(texts["hint"], *claim, "subject", "relation")).otherwise(F.format_string(texts["unknown"], *claim))


def summary(verdicts: DataFrame) -> DataFrame:
    """Count per status, also of those without a claim, and the total."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return verdicts.agg(*counts, F.count("*").alias("total"))
