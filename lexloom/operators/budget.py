"""Inference within a budget of look-ups.

A look-up asks the graph for all triplets of one (term, relation); a second one
of the same key is free, and so is one of a relation that the graph does not
know.  Every schema of the cascade tells, as rows, which look-ups it makes for a
claim and in what order.  The trace of a claim ends with the look-up that lets a
schema answer, so its cost is the number of distinct keys up to there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.operators.inference import CASCADE, CASCADE_2, CLAIM, STEP, RuleGraph, asked_of, infer, inverse_of, keyed
from lexloom.sources.storage import store

#: Look-ups that an inference may make by effort if no other budget is given; with the usual lists no claim needs more.
USUAL = {1: 70, 2: 150}


def _asks(rows: DataFrame, name: str, part: int, turn: Column | str | int, term: str, relation: Column | str, ends: int = 0) -> DataFrame:
    """Look-ups of schema ``name``; ``ends`` is the sign of a triplet to the claim's object that ends it there (0: it goes on)."""
    number = F.lit(turn) if isinstance(turn, int) else F.col(turn) if isinstance(turn, str) else turn
    rel = F.col(relation) if isinstance(relation, str) else relation
    return rows.select(*CLAIM, "o", F.lit(CASCADE_2.index(name)).alias("rank"), F.struct(F.lit(part).alias("part"), number.cast("int").alias("turn")).alias("place"), F.col(term).alias("term"), rel.alias("asked"), F.lit(ends).alias("ends"))


def lookups(graph: RuleGraph, claims: DataFrame, effort: int = 1) -> DataFrame:
    """Every look-up that the cascade would make if no schema answered: claim, ``rank`` of the schema, ``place`` in it, ``term``, ``asked`` relation, ``ends``."""
    c = store(keyed(claims), "asked")
    other = "m <> s and m <> o"
    inverse = c.withColumn("inv", inverse_of(F.col("relation"))).filter("inv is not null")
    by = F.create_map(*[x for k, v in schema.IMPLIED_BY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    implied = c.filter(F.col("relation").isin(list(schema.IMPLIED_BY))).select("*", F.posexplode(by[F.col("relation")]).alias("pos", "by"))
    isa, carac, placed = c.filter("relation = 'r_isa'"), c.filter(F.col("relation").isin("r_carac", "r_has_prop")), c.filter("relation = 'r_lieu'")
    above = store(graph.hop(c, "r_isa", schema.REFUTATION_SCAN), "above")
    own = store(graph.hop(c, F.col("relation")), "own")
    transitive = F.col("relation").isin(schema.TRANSITIVE)
    lit = F.lit
    parts = [
        _asks(inverse, "inverse", 0, 0, "o", "inv"),
        _asks(implied, "implication", 0, "pos", "s", "by", 1),
        _asks(isa, "isa_incompatible", 0, 0, "s", lit("r_isa")),
        _asks(above.filter("relation = 'r_isa'").filter(~F.contains("mid", lit(">"))), "isa_incompatible", 1, "turn", "m", lit("r_isa-incompatible"), 1),
        _asks(c, "class_elimination", 0, 0, "s", lit("r_isa")),
        _asks(above.filter("m <> o"), "class_elimination", 1, "turn", "m", "relation", -1),
        _asks(inverse, "class_elimination", 2, 0, "o", "inv"),
        _asks(carac, "antonym_contrast", 0, 0, "s", "relation"),
        _asks(own.filter("turn = 1").filter(F.col("relation").isin("r_carac", "r_has_prop")), "antonym_contrast", 1, 0, "o", lit("r_anto")),
        _asks(c, "deduction_isa", 0, 0, "s", lit("r_isa")),
        _asks(graph.generics(c).filter("m <> o"), "deduction_isa", 1, "turn", "m", "relation"),
        _asks(c.filter(transitive), "transitivity", 0, 0, "s", "relation"),
        _asks(own.filter(transitive).filter(other), "transitivity", 1, "turn", "m", "relation"),
        _asks(placed, "geo_propagation", 0, 0, "s", "relation"),
        _asks(own.filter("relation = 'r_lieu'").filter(other), "geo_propagation", 1, "turn", "m", lit("r_holo"), 1),
        _asks(c, "hyponym_propagation", 0, 0, "s", "relation"),
        _asks(own.filter(other), "hyponym_propagation", 1, "turn", "m", lit("r_isa"), 1),
        _asks(isa, "cohyponym", 0, 0, "s", lit("r_isa")),
        _asks(isa, "cohyponym", 0, 1, "o", lit("r_isa")),
    ]
    if effort >= 2:
        for first, rows in _chains(c):
            part = F.col("chain.part")
            at = _asks(rows, "composition", 0, 0, "s", "chain.first")
            hop = graph.hop(rows, F.col("chain.first")).filter(other)
            then = _asks(hop, "composition", 0, "turn", "m", "chain.second", 1)
            # A chain's first look-up comes before its own second ones and after those of the chain before.
            parts += [x.withColumn("place", F.struct(F.lit(first).alias("part"), F.col("place.turn").alias("turn"))) for x in (at, then)]
    return reduce(DataFrame.unionByName, parts)


def _chains(c: DataFrame) -> list[tuple[int, DataFrame]]:
    """Claims with the n-th chain of their relation, for every n."""
    longest = max(len(v) for v in schema.COMPOSED_OF.values())
    out = []
    for n in range(longest):
        of = {k: v[n] for k, v in schema.COMPOSED_OF.items() if len(v) > n}
        table = F.create_map(*[x for k, (a, b) in of.items() for x in (F.lit(k), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")))])
        out.append((n, c.filter(F.col("relation").isin(list(of))).withColumn("chain", table[F.col("relation")])))
    return out


def costs(graph: RuleGraph, claims: DataFrame, answers: DataFrame, effort: int = 1, relations: list[str] | None = None) -> DataFrame:
    """``(subject, relation, object, needed)``: distinct look-ups up to each claim's answer, or of the whole cascade if it has none.

    ``answers`` are those of :func:`infer` at the same effort; ``relations`` are
    the relations that the graph knows (None: all).
    """
    ranks = F.create_map(*[x for i, n in enumerate(CASCADE_2) for x in (F.lit(n), F.lit(i))])
    until = answers.select(*CLAIM, F.coalesce(ranks[F.col("schema")], F.lit(len(CASCADE_2))).alias("until")).distinct()
    asked = lookups(graph, claims, effort)
    if relations is not None:
        asked = asked.filter(F.col("asked").isin(relations))
    made = store(asked.join(until, CLAIM).filter(F.col("rank") <= F.col("until")), "made")
    # In the schema that answers, what comes after the look-up that ends it was never asked.
    probe = graph.probe.select(F.col("a").alias("term"), F.col("rel").alias("asked"), F.col("b").alias("o"), "w")
    last = made.filter("ends <> 0 and rank = until")
    ending = last.join(asked_of(last, ["term", "asked", "o"], probe), ["term", "asked", "o"]).filter("w * ends > 0").groupBy(*CLAIM).agg(F.min("place").alias("end"))
    kept = made.join(ending, CLAIM, "left").filter("rank < until or end is null or place <= end")
    return kept.groupBy(*CLAIM).agg(F.count_distinct("term", "asked").alias("needed"))


def infer_with_costs(graph: RuleGraph, claims: DataFrame, effort: int = 1, relations: list[str] | None = None) -> DataFrame:
    """The answers of :func:`infer` with ``needed``, the look-ups that each costs."""
    claims = store(claims, "claims")
    answers = store(infer(graph, claims, effort), "answers")
    needed = costs(graph, claims, answers, effort, relations)
    return answers.join(needed, CLAIM, "left").withColumn("needed", F.coalesce("needed", F.lit(0)))


def within(answers: DataFrame, budget: int) -> DataFrame:
    """``answers`` with ``needed`` look-ups as they are within ``budget``: ``needed`` gives way to ``lookups_used``.

    A claim that needs more is silent, and has used one look-up more than the
    budget, the one that was refused.  A budget below 1 counts as 1.
    """
    limit = max(1, budget)
    over = F.col("needed") > limit
    none = {"schema": F.lit(None).cast("string"), "weight": F.lit(0.0), "confidence": F.lit(0.0), "consensus": F.lit(0), "proof": F.array().cast(f"array<{STEP}>")}
    kept = [F.when(over, none[c]).otherwise(F.col(c)).alias(c) if c in none else F.col(c) for c in answers.columns if c != "needed"]
    return answers.select(*kept, F.least("needed", F.lit(limit + 1)).cast("long").alias("lookups_used"))


def infer_within(graph: RuleGraph, claims: DataFrame, budget: int | None = None, effort: int = 1, relations: list[str] | None = None) -> DataFrame:
    """:func:`infer` with ``lookups_used``, silent where ``budget`` (None: the usual one of the effort) is passed.

    A claim with a null part is silent and uses none.
    """
    return within(infer_with_costs(graph, claims, effort, relations), USUAL[2 if effort >= 2 else 1] if budget is None else budget)
