"""The rule cascade over a table of claims.

Every schema is a small relational plan from ``claims (subject, relation,
object)`` to at most one row per claim with its signed weight, proof and the
number of agreeing paths.  Schemas probe the graph from the claims' side: the
first hop is a top-k list cut before any join, the second a lookup in a table
with one row per (source, relation, target name).  The first schema of the
cascade that fires answers a claim; a claim's own triplet is never consulted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import norm
from lexloom.sources.keyed import KEPT
from lexloom.sources.storage import store

STEP = "struct<source:string,relation:string,target:string,w:double,note:string>"
CLAIM = ["subject", "relation", "object"]
KEY = [*CLAIM, "s", "o"]


def step(source: Column | str, relation: Column | str, target: Column | str, w: Column | str, note: str | Column = "") -> Column:
    note = F.lit(note) if isinstance(note, str) else note
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(col(source).alias("source"), col(relation).alias("relation"), col(target).alias("target"), col(w).cast("double").alias("w"), note.alias("note"))


#: Rows up to which a table goes to all tasks; beyond, both sides of its join are shuffled.
FEW = 20_000


def few(df: DataFrame) -> DataFrame:
    """A stored table, to be sent to all tasks if it has few rows. Its size as a file does not tell what a driver would hold."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def asked_of(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """The rows of ``table`` that ``rows`` ask for by ``keys``, to be joined with them.

    Many claims ask for the same keys: those of a hop meet in a few generic
    terms.  So distinct keys look into the table, and what they find goes to
    the claims; no claim is dealt by a key that all share.
    """
    wanted = few(store(rows.select(*keys).distinct(), "wanted"))
    return few(store(table.join(wanted, keys), "hits"))


def inverse_of(relation: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in schema.INVERSE.items() for x in pair])[relation]


@dataclass
class RuleGraph:
    """A triplet table with the views that schemas share."""

    graph: DataFrame
    top_k: int = schema.TOP_K

    @classmethod
    def stored(cls, graph: DataFrame, top_k: int = schema.TOP_K) -> RuleGraph:
        """With the shared views written once for all who ask for those of the same graph; what a cascade, which reads them in every schema, should use."""
        keep = KEPT.of
        out = cls(keep(graph, "graph"), top_k)
        out.edges = keep(out.edges, "edges")
        out.probe = keep(out.probe, "probe")
        out.best = keep(out.best, "best")
        out.generic = keep(out.generic, "generic")
        return out

    def release(self) -> int:
        """Delete the stored views; how many there were."""
        return sum(KEPT.release(view) for view in (self.generic, self.best, self.probe, self.edges, self.graph))

    @cached_property
    def edges(self) -> DataFrame:
        return self.graph.select("id", norm("src").alias("a"), "rel", norm("tgt").alias("b"), norm("tgt_decoded").alias("b2"), "tgt", F.col("tgt_decoded").alias("shown"), "w")

    @cached_property
    def probe(self) -> DataFrame:
        """``(a, rel, b, w, edge, shown)`` of the first edge whose target's name or decoded name is ``b``."""
        keys = self.edges.select("a", "rel", F.explode(F.array_distinct(F.array("b", "b2"))).alias("b"), "id", "w", "shown")
        return keys.groupBy("a", "rel", "b").agg(F.min(F.struct("id", "w", "shown")).alias("x")).select("a", "rel", "b", "x.w", F.col("x.id").alias("edge"), "x.shown")

    @cached_property
    def best(self) -> DataFrame:
        """``(a, rel, turn, mid, m, shown, w1)``: the strongest positive targets of every (source, relation), as many as any schema reads."""
        turn = F.row_number().over(Window.partitionBy("a", "rel").orderBy(F.col("w").desc(), "id"))
        top = self.edges.filter("w > 0").withColumn("turn", turn).filter(F.col("turn") <= max(self.top_k, schema.REFUTATION_SCAN))
        return top.select("a", "rel", "turn", F.col("tgt").alias("mid"), F.col("b").alias("m"), "shown", F.col("w").alias("w1"))

    @cached_property
    def generic(self) -> DataFrame:
        """As :attr:`best` over ``r_isa``, targets of one name once and the term itself left out before the cut."""
        once = self.edges.filter("w > 0 and rel = 'r_isa' and a <> b").groupBy("a", "b").agg(F.min(F.struct((-F.col("w")).alias("minus"), "id", "tgt", "shown")).alias("x"))
        turn = F.row_number().over(Window.partitionBy("a").orderBy("x.minus", "x.id"))
        top = once.withColumn("turn", turn).filter(F.col("turn") <= max(1, self.top_k))
        return top.select("a", "turn", F.col("x.tgt").alias("mid"), F.col("b").alias("m"), F.col("x.shown").alias("shown"), (-F.col("x.minus")).alias("w1"))

    def hop(self, claims: DataFrame, first: Column | str, take: int | None = None, end: str = "s") -> DataFrame:
        """Claims with the top positive targets of (their subject, ``first``): ``turn``, ``mid``, ``m``, ``shown``, ``w1``."""
        wanted = claims.withColumn("r1", F.lit(first) if isinstance(first, str) else first)
        best = self.best.filter(F.col("turn") <= max(1, take or self.top_k)).withColumnsRenamed({"a": end, "rel": "r1"})
        if isinstance(first, str):
            best = best.filter(F.col("r1") == first)
        return wanted.join(best, [end, "r1"])

    def generics(self, claims: DataFrame, end: str = "s", take: int | None = None) -> DataFrame:
        """As :meth:`hop` over :attr:`generic`."""
        return claims.join(self.generic.filter(F.col("turn") <= max(1, take or self.top_k)).withColumnRenamed("a", end), end)

    def meet(self, rows: DataFrame, source: str, relation: Column | str, target: str, name: str = "w2") -> DataFrame:
        """``rows`` joined with the probe of (``source``, ``relation``, ``target``)."""
        wanted = rows.withColumn("r2", F.lit(relation) if isinstance(relation, str) else relation)
        probe = self.probe.select(F.col("a").alias(source), F.col("rel").alias("r2"), F.col("b").alias(target), F.col("w").alias(name))
        return wanted.join(probe, [source, "r2", target])


def _answer(rows: DataFrame, weight: Column, proof: list[Column], order: list[Column] | None = None, consensus: Column | None = None) -> DataFrame:
    """One row per claim: the first by ``order``."""
    steps = F.array(*proof) if proof else F.array().cast(f"array<{STEP}>")
    out = rows.select(*CLAIM, weight.cast("double").alias("weight"), steps.alias("proof"), (consensus if consensus is not None else F.lit(1)).cast("int").alias("consensus"), *([F.struct(*order).alias("order")] if order else []))
    if not order:
        return out
    best = out.groupBy(*CLAIM).agg(F.min_by(F.struct("weight", "proof", "consensus"), "order").alias("x"))
    return best.select(*CLAIM, "x.*")


def tautology(g: RuleGraph, c: DataFrame) -> DataFrame:
    return _answer(c.filter((F.col("s") == F.col("o")) & F.col("relation").isin(schema.REFLEXIVE)), F.lit(schema.STRONG_WEIGHT), [])


def contradiction(g: RuleGraph, c: DataFrame) -> DataFrame:
    return _answer(c.filter((F.col("s") == F.col("o")) & (F.col("relation") == "r_anto")), F.lit(-schema.STRONG_WEIGHT), [])


def prefix(g: RuleGraph, c: DataFrame) -> DataFrame:
    starts = F.startswith(F.concat("s", F.lit(" ")), F.concat("o", F.lit(" ")))
    return _answer(c.filter(F.col("relation").isin("r_isa", "r_associated") & (F.col("s") != F.col("o")) & (F.col("o") != "") & starts), F.lit(30.0), [])


def inverse(g: RuleGraph, c: DataFrame) -> DataFrame:
    rows = g.meet(c.withColumn("inv", inverse_of(F.col("relation"))).filter("inv is not null"), "o", F.col("inv"), "s").filter("w2 <> 0")
    return _answer(rows, F.col("w2"), [step("object", "inv", "subject", "w2", F.concat(F.lit("inverse de "), "relation"))])


def implication(g: RuleGraph, c: DataFrame) -> DataFrame:
    table = F.create_map(*[x for k, v in schema.IMPLIED_BY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = c.filter(F.col("relation").isin(list(schema.IMPLIED_BY))).select(*KEY, F.posexplode(table[F.col("relation")]).alias("pos", "by"))
    rows = g.meet(rows, "s", F.col("by"), "o").filter("w2 > 0")
    return _answer(rows, F.col("w2"), [step("subject", "by", "object", "w2", F.concat(F.lit("implique "), "relation"))], [F.col("pos")])


def isa_incompatible(g: RuleGraph, c: DataFrame) -> DataFrame:
    rows = g.hop(c.filter("relation = 'r_isa'"), "r_isa", schema.REFUTATION_SCAN).filter(~F.contains("mid", F.lit(">")))
    rows = g.meet(rows, "m", "r_isa-incompatible", "o").filter("w2 > 0")
    return _answer(rows, -F.abs("w2"), [step("subject", F.lit("r_isa"), "shown", "w1"), step("shown", F.lit("r_isa-incompatible"), "object", "w2")], [F.col("turn")])


def _denied_inverse(g: RuleGraph, above: DataFrame) -> DataFrame:
    """Claims whose object denies the inverse of one of the hypernyms ``above``, with all ways in ``order``."""
    back = above.filter("m <> o").withColumn("inv", inverse_of(F.col("relation"))).filter("inv is not null")
    edges = g.edges.filter("w < 0").select(F.col("a").alias("o"), F.col("rel").alias("inv"), F.col("b").alias("m"), "id", F.col("shown").alias("target"), F.col("w").alias("w2"))
    edges = asked_of(back, ["o", "inv", "m"], edges)
    # Several of the hypernyms may share a name: the last one listed gives the weight.
    back = back.join(edges, ["o", "inv", "m"], "left_semi").groupBy(*KEY, "inv", "m").agg(F.max_by(F.struct("shown", "w1"), "turn").alias("h"))
    back = back.join(edges, ["o", "inv", "m"])
    proof = F.array(step("subject", F.lit("r_isa"), "target", "h.w1"), step("object", "inv", "target", "w2", "négation (inverse)"))
    return back.select(*CLAIM, F.col("w2").alias("weight"), proof.alias("proof"), F.struct(F.lit(1).alias("way"), F.col("id").alias("at")).alias("order"))


def class_elimination(g: RuleGraph, c: DataFrame) -> DataFrame:
    """A hypernym of the subject is denied the claim; or else the object denies the inverse of a hypernym."""
    above = g.hop(c, "r_isa", schema.REFUTATION_SCAN).filter("m <> o")
    direct = g.meet(above, "m", F.col("relation"), "o").filter("w2 < 0")
    first = step("subject", F.lit("r_isa"), "shown", "w1")
    denied = F.struct(F.lit(0).alias("way"), F.col("turn").cast("long").alias("at"))
    one = direct.select(*CLAIM, F.col("w2").alias("weight"), F.array(first, step("shown", "relation", "object", "w2", "négation")).alias("proof"), denied.alias("order"))
    best = one.unionByName(_denied_inverse(g, above)).groupBy(*CLAIM).agg(F.min_by(F.struct("weight", "proof"), "order").alias("x"))
    return best.select(*CLAIM, "x.*", F.lit(1).alias("consensus"))


def antonym_contrast(g: RuleGraph, c: DataFrame) -> DataFrame:
    return _contrasted(g, g.hop(c.filter(F.col("relation").isin(schema.CONTRASTED)), F.col("relation")))


def _contrasted(g: RuleGraph, own: DataFrame) -> DataFrame:
    """Claims whose object is the antonym of one of the subject's ``own`` targets."""
    rows = own.filter("m <> o")
    against = g.edges.filter("rel = 'r_anto' and w > 0").select(F.col("a").alias("o"), F.col("b").alias("m"), "id", F.col("w").alias("w2"))
    against = asked_of(rows, ["o", "m"], against)
    rows = rows.join(against, ["o", "m"], "left_semi").groupBy(*KEY, "m").agg(F.max_by(F.struct("shown", "w1"), "turn").alias("x"))
    rows = rows.join(against, ["o", "m"])
    return _answer(rows, -F.least("x.w1", "w2"), [step("subject", "relation", "x.shown", "x.w1"), step("object", F.lit("r_anto"), "x.shown", "w2", "antonyme")], [F.col("id")])


def deduction_isa(g: RuleGraph, c: DataFrame) -> DataFrame:
    """What a generic has, or is denied, holds for the subject; denials win as a pool, then the largest weight."""
    rows = g.meet(g.generics(c).filter("m <> o"), "m", F.col("relation"), "o").filter("w2 <> 0")
    claim = Window.partitionBy(*CLAIM)
    rows = rows.withColumn("n_neg", F.count_if(F.col("w2") < 0).over(claim)).filter("n_neg = 0 or w2 < 0").withColumn("pool", F.count("*").over(claim))
    return _answer(rows, F.col("w2"), [step("subject", F.lit("r_isa"), "shown", "w1"), step("shown", "relation", "object", "w2")], [-F.abs("w2"), F.col("turn")], F.col("pool"))


def transitivity(g: RuleGraph, c: DataFrame) -> DataFrame:
    rows = g.hop(c.filter(F.col("relation").isin(schema.TRANSITIVE)), F.col("relation")).filter("m <> s and m <> o")
    rows = g.meet(rows, "m", F.col("relation"), "o").filter("w2 > 0").withColumn("pool", F.count("*").over(Window.partitionBy(*CLAIM)))
    return _answer(rows, F.col("w2"), [step("subject", "relation", "shown", "w1"), step("shown", "relation", "object", "w2")], [-F.col("w2"), F.col("turn")], F.col("pool"))


def geo_propagation(g: RuleGraph, c: DataFrame) -> DataFrame:
    rows = g.hop(c.filter("relation = 'r_lieu'"), "r_lieu").filter("m <> s and m <> o")
    rows = g.meet(rows, "m", "r_holo", "o").filter("w2 > 0")
    return _answer(rows, F.col("w2"), [step("subject", F.lit("r_lieu"), "shown", "w1"), step("shown", F.lit("r_holo"), "object", "w2", "contenu géographiquement")], [F.col("turn")])


def hyponym_propagation(g: RuleGraph, c: DataFrame) -> DataFrame:
    rows = g.hop(c, F.col("relation")).filter("m <> s and m <> o")
    rows = g.meet(rows, "m", "r_isa", "o").filter("w2 > 0")
    return _answer(rows, F.least("w1", "w2"), [step("subject", "relation", "shown", "w1"), step("shown", F.lit("r_isa"), "object", "w2", "cas particulier de la cible")], [F.col("turn")])


def cohyponym(g: RuleGraph, c: DataFrame) -> DataFrame:
    asked = c.filter("relation = 'r_isa'").select(*KEY)
    return _siblings(g, asked, g.hop(asked, "r_isa"))


def _siblings(g: RuleGraph, asked: DataFrame, above: DataFrame) -> DataFrame:
    """Claims of ``asked`` whose ends share a hypernym (the subject's ``above``, the object's by its name) and are none of each other."""
    last = F.max_by(F.struct("shown", "w1"), "turn")
    lists = g.best.filter("rel = 'r_isa'").filter(F.col("turn") <= max(1, g.top_k)).select(F.col("a").alias("o"), "m", "shown", "w1", "turn")
    down = few(store(asked_of(asked, ["o"], lists).groupBy("o", "m").agg(last.alias("y")), "beside"))
    up = above.join(down, ["o", "m"], "left_semi").groupBy(*KEY, "m").agg(last.alias("x"))
    related = above.filter("m = o").select(*CLAIM).unionByName(asked.join(down.withColumnRenamed("m", "s"), ["o", "s"], "left_semi").select(*CLAIM)).distinct()
    rows = up.join(down, ["o", "m"]).join(related, CLAIM, "left_anti")
    return _answer(rows, F.lit(-30.0), [step("subject", F.lit("r_isa"), "x.shown", "x.w1"), step("object", F.lit("r_isa"), "x.shown", "y.w1", "hyperonyme commun — A et B sont frères")], [F.col("m")])


def composition(g: RuleGraph, c: DataFrame) -> DataFrame:
    table = F.create_map(*[x for k, v in schema.COMPOSED_OF.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in v]))])
    rows = c.filter(F.col("relation").isin(list(schema.COMPOSED_OF))).select(*KEY, F.posexplode(table[F.col("relation")]).alias("pos", "chain"))
    rows = g.hop(rows, F.col("chain.first")).filter("m <> s and m <> o")
    rows = g.meet(rows, "m", F.col("chain.second"), "o").filter("w2 > 0")
    return _answer(rows, F.col("w2"), [step("subject", "chain.first", "shown", "w1"), step("shown", "chain.second", "object", "w2")], [F.col("pos"), F.col("turn")])


def synonym_equiv(g: RuleGraph, c: DataFrame) -> DataFrame:
    """Through a synonym of the object. Not part of a cascade: synonyms are often disguised hypernyms."""
    rows = g.meet(g.hop(c, "r_syn", end="o").filter("m <> s and m <> o"), "s", F.col("relation"), "m").filter("w2 <> 0")
    return _answer(rows, F.col("w2"), [step("object", F.lit("r_syn"), "shown", "w1", "synonyme"), step("subject", "relation", "shown", "w2")], [F.col("turn")])


def target_generic(g: RuleGraph, c: DataFrame) -> DataFrame:
    """Through a generic of the object. Unsound, not part of a cascade."""
    rows = g.meet(g.generics(c, end="o").filter("m <> s"), "s", F.col("relation"), "m").filter("w2 <> 0")
    return _answer(rows, F.col("w2"), [step("subject", "relation", "shown", "w2"), step("object", F.lit("r_isa"), "shown", "w1", "généralisation")], [F.col("turn")])


def double_isa(g: RuleGraph, c: DataFrame) -> DataFrame:
    """Through generics of both ends. Unsound, not part of a cascade."""
    five = min(g.top_k, 5)
    left = g.generics(c.select(*KEY), take=five).select(*KEY, F.struct("turn", "shown", "w1").alias("x"), F.col("m").alias("ms"))
    rows = g.generics(left, end="o", take=five).filter("m <> ms")
    rows = g.meet(rows, "ms", F.col("relation"), "m").filter("w2 <> 0")
    proof = [step("subject", F.lit("r_isa"), "x.shown", "x.w1"), step("x.shown", "relation", "shown", "w2"), step("object", F.lit("r_isa"), "shown", "w1", "généralisation")]
    return _answer(rows, F.col("w2"), proof, [F.col("x.turn"), F.col("turn")])


Schema = Callable[[RuleGraph, DataFrame], DataFrame]
SCHEMAS: dict[str, Schema] = {f.__name__: f for f in [contradiction, tautology, prefix, inverse, implication, isa_incompatible, class_elimination, antonym_contrast, deduction_isa, transitivity, geo_propagation, hyponym_propagation, cohyponym, composition, synonym_equiv, target_generic, double_isa]}
#: The order in which schemas are tried; the last one from effort 2 on.
CASCADE = ["contradiction", "tautology", "prefix", "inverse", "implication", "isa_incompatible", "class_elimination", "antonym_contrast", "deduction_isa", "transitivity", "geo_propagation", "hyponym_propagation", "cohyponym"]
CASCADE_2 = [*CASCADE, "composition"]
#: Schemas of the cascade that look at no hop beyond the claim's own ends.
GUARDS = 5


def keyed(claims: DataFrame) -> DataFrame:
    """Distinct claims with the normalised names of their ends; a claim with a null part cannot be answered."""
    return claims.select(*CLAIM).dropna().distinct().select(*CLAIM, norm("subject").alias("s"), norm("object").alias("o"))


def confidence(weight: Column, steps: Column, factor: Column, consensus: Column) -> Column:
    """Weight squashed to 0..1, less for each further step, times soundness, more for agreeing paths; three decimals."""
    bonus = F.least(F.lit(1.30), 1.0 + 0.12 * F.greatest(F.lit(0), consensus - 1))
    decay = F.pow(F.lit(0.9), F.greatest(F.lit(0), steps - 1).cast("double"))
    return F.bround(F.least(F.lit(1.0), F.tanh(F.abs(weight) / schema.STRONG_WEIGHT) * decay * factor * bonus), 3)


def run_schema(graph: RuleGraph, claims: DataFrame, name: str) -> DataFrame:
    """What one schema says: ``(subject, relation, object, schema, weight, confidence, consensus, proof)``."""
    fired = SCHEMAS[name](graph, keyed(claims)).filter("weight <> 0")
    sure = confidence(F.col("weight"), F.size("proof"), F.lit(schema.SOUNDNESS[name]), F.col("consensus"))
    return fired.select(*CLAIM, F.lit(name).alias("schema"), "weight", sure.alias("confidence"), "consensus", "proof")


#: Pseudo relation under which a claim's first hop meets :attr:`RuleGraph.generic`.
_GENERIC = "#generic"


def _ways(g: RuleGraph, effort: int) -> tuple[Column, Column, Column, list[tuple[Column, int, str]]]:
    """For what a hop of :func:`_first_hops` serves: the hypernyms above the subject, its own targets, its generics, and chains with their place and second relation."""
    relation, r1, near = F.col("relation"), F.col("r1"), F.col("turn") <= max(1, g.top_k)
    chains = [((relation == composed) & (r1 == a) & near, i, b) for composed, pairs in schema.COMPOSED_OF.items() for i, (a, b) in enumerate(pairs)] if effort >= 2 else []
    return (r1 == "r_isa") & (F.col("turn") <= schema.REFUTATION_SCAN), (r1 == relation) & near, (r1 == _GENERIC) & near, chains


def _first_hops(g: RuleGraph, c: DataFrame, effort: int) -> DataFrame:
    """The first hops of all two-hop schemas by one join on the subject: a claim is shuffled and sorted once, and a hop that serves several ways is one row."""
    above, own, generic, chains = _ways(g, effort)
    lists = g.best.unionByName(g.generic.withColumn("rel", F.lit(_GENERIC)).select(*g.best.columns)).withColumnsRenamed({"a": "s", "rel": "r1"})
    return c.select(*KEY).join(lists, "s").filter(reduce(Column.__or__, [above, own, generic, *[when for when, _, _ in chains]]))


def _second_hops(g: RuleGraph, hops: DataFrame, effort: int = 1) -> DataFrame:
    """All paths by which the schemas that ask (mid, relation, object) answer, by one join with the probe; of a schema's paths the first by ``order`` counts."""
    lit, off = F.lit, (F.col("m") != F.col("s")) & (F.col("m") != F.col("o"))
    relation, elsewhere = F.col("relation"), F.col("m") != F.col("o")
    above, own, generic, chains = _ways(g, effort)

    def asks(name: str, when: Column, second: Column, sign: int, note: str = "", pos: int = 0) -> Column:
        return F.when(when, F.struct(lit(name).alias("schema"), second.alias("r2"), lit(sign).alias("sign"), lit(note).alias("note"), lit(pos).alias("pos")))

    wanted = [
        asks("isa_incompatible", above & (relation == "r_isa") & ~F.contains("mid", lit(">")), lit("r_isa-incompatible"), 1),
        asks("class_elimination", above & elsewhere, relation, -1, "négation"),
        asks("deduction_isa", generic & elsewhere, relation, 0),
        asks("transitivity", own & off & relation.isin(schema.TRANSITIVE), relation, 1),
        asks("geo_propagation", own & off & (relation == "r_lieu"), lit("r_holo"), 1, "contenu géographiquement"),
        asks("hyponym_propagation", own & off, lit("r_isa"), 1, "cas particulier de la cible"),
        *[asks("composition", when & off, lit(second), 1, "", pos) for when, pos, second in chains],
    ]
    probe = g.probe.filter("w <> 0").select(F.col("a").alias("m"), F.col("rel").alias("there"), F.col("b").alias("o"), F.col("w").alias("w2"))
    # What is asked is told only for the hops with any edge between middle and object.
    meets = hops.join(asked_of(hops, ["m", "o"], probe), ["m", "o"])
    keys = meets.select(*KEY, "r1", "turn", "m", "shown", "w1", "there", "w2", F.explode(F.array(*wanted)).alias("x")).filter("x.r2 = there")
    rows = keys.select("*", "x.*").drop("x").filter("sign = 0 or w2 * sign > 0")
    name = F.col("schema")
    weight = F.when(name == "isa_incompatible", -F.abs("w2")).when(name == "hyponym_propagation", F.least("w1", "w2")).otherwise(F.col("w2"))
    by = F.when(F.col("r1") == _GENERIC, "r_isa").otherwise(F.col("r1"))
    proof = F.array(step("subject", by, "shown", "w1"), step("shown", "r2", "object", "w2", F.col("note")))
    # Among agreeing paths the strongest counts, a denial before any; elsewhere the first one.
    strongest = name.isin("deduction_isa", "transitivity")
    order = F.struct(F.when(name == "deduction_isa", (F.col("w2") > 0).cast("int")).otherwise(0).alias("a"), F.when(strongest, -F.abs("w2")).otherwise(0.0).alias("b"), F.col("pos").alias("c"), F.col("turn").alias("d"))
    return rows.select(*CLAIM, "schema", weight.alias("weight"), proof.alias("proof"), order.alias("order"))


def _two_hop_answers(g: RuleGraph, c: DataFrame, order: list[str], effort: int) -> DataFrame:
    """The first answer among the two-hop schemas of each claim of ``c``: all of them from one join for the first hops and one for the second."""
    hops = store(_first_hops(g, c, effort), "hops")
    number = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, 2 * i)])
    second = _second_hops(g, hops, effort).withColumn("rank", number[F.col("schema")])
    alone = F.lit(None).cast(second.schema["order"].dataType)  # one row of a claim
    ranked = lambda df, name, later=0: df.select(*CLAIM, F.lit(name).alias("schema"), "weight", "proof", alone.alias("order"), F.lit(2 * order.index(name) + later).alias("rank"))
    above, own = map(hops.filter, _ways(g, effort)[:2])
    back = _denied_inverse(g, above).groupBy(*CLAIM).agg(F.min_by(F.struct("weight", "proof"), "order").alias("x")).select(*CLAIM, "x.*")
    contrast = _contrasted(g, own.filter(F.col("relation").isin(schema.CONTRASTED)))
    isa = c.filter("relation = 'r_isa'").select(*KEY)
    brothers = _siblings(g, isa, above.filter("relation = 'r_isa'").filter(F.col("turn") <= max(1, g.top_k)))
    every = [second, ranked(back, "class_elimination", 1), ranked(contrast, "antonym_contrast"), ranked(brothers, "cohyponym")]
    # Most claims have few paths: they are dealt out as they are, not sorted before and after. A proof that nobody reads is never built.
    rows = reduce(DataFrame.unionByName, every).filter("weight <> 0").repartition(*CLAIM)
    name, first = F.col("schema"), F.struct("rank", "order")
    deduced, passed = name == "deduction_isa", name == "transitivity"
    agree = [F.count_if(deduced).alias("deduced"), F.count_if(deduced & (F.col("weight") < 0)).alias("denied"), F.count_if(passed).alias("passed")]
    best = rows.groupBy(*CLAIM).agg(F.min_by(F.struct("schema", "weight"), first).alias("x"), F.min_by("proof", first).alias("proof"), *agree).select(*CLAIM, "x.*", "proof", "deduced", "denied", "passed")
    consensus = F.when(deduced & (F.col("denied") > 0), F.col("denied")).when(deduced, F.col("deduced")).when(passed, F.col("passed")).otherwise(1)
    return best.select(*CLAIM, "schema", "weight", "proof", consensus.cast("int").alias("consensus"))


def infer(graph: RuleGraph, claims: DataFrame, effort: int = 1) -> DataFrame:
    """Every claim with the answer of the first schema that fires; a silent claim has weight 0 and no schema."""
    claims = store(claims, "claims")
    found = answers(graph, store(keyed(claims), "asked"), effort)
    none = F.array().cast(f"array<{STEP}>")
    out = claims.join(found, CLAIM, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(*claims.columns, "schema", zero("weight"), zero("confidence"), F.coalesce("consensus", F.lit(0)).alias("consensus"), F.coalesce("proof", none).alias("proof"))


def answers(graph: RuleGraph, asked: DataFrame, effort: int = 1) -> DataFrame:
    """The answers of the first schema that fires; silent claims have no row. ``asked`` is a stored table of :func:`keyed`."""
    order = CASCADE_2 if effort >= 2 else CASCADE
    # The guards and single look-ups first; only claims without an answer go on to the two-hop schemas.
    guards = [SCHEMAS[name](graph, asked).filter("weight <> 0").select(*CLAIM, F.lit(name).alias("schema"), "weight", "proof", "consensus", F.lit(i).alias("rank")) for i, name in enumerate(order[:GUARDS])]
    first = reduce(DataFrame.unionByName, guards).groupBy(*CLAIM).agg(F.min_by(F.struct("schema", "weight", "proof", "consensus"), "rank").alias("x")).select(*CLAIM, "x.*")
    first = store(first, "answers")
    left = store(asked.join(first.select(*CLAIM), CLAIM, "left_anti"), "claims")
    found = first.unionByName(_two_hop_answers(graph, left, order, effort))
    factors = F.create_map(*[F.lit(x) for pair in schema.SOUNDNESS.items() for x in pair])
    sure = confidence(F.col("weight"), F.size("proof"), factors[F.col("schema")], F.col("consensus"))
    return found.select(*CLAIM, "schema", "weight", sure.alias("confidence"), "consensus", "proof")


def proof_text(proof: Column | str = "proof") -> Column:
    """The proof as ``source relation target; ...``."""
    return F.array_join(F.transform(proof, lambda s: F.concat_ws(" ", s.source, s.relation, s.target)), "; ")


def explanation(row: DataFrame) -> Column:
    """The answer in words: verdict, schema and the chain of the proof."""
    lookup = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    phrases, heads, names = lookup(schema.PHRASES), lookup(schema.NEGATED_FIRST), lookup(schema.SCHEMA_NAMES)

    def phrase(s: Column) -> Column:
        plain = F.coalesce(phrases[s.relation], F.concat(F.lit("est en relation ("), s.relation, F.lit(") avec")))
        head, rest = F.substring_index(plain, " ", 1), F.regexp_replace(plain, r"^\S+ ?", "")
        denied = F.trim(F.concat_ws(" ", F.coalesce(heads[head], F.concat(F.lit("ne "), head)), F.lit("pas"), rest))
        return F.concat(F.lit("« "), s.source, F.lit(" » "), F.when(s.w < 0, denied).otherwise(plain), F.lit(" « "), s.target, F.lit(" »"))

    chain = F.array_join(F.transform("proof", phrase), ", et ")
    paths = F.when(F.col("consensus") > 1, F.concat(F.lit(", "), F.col("consensus").cast("string"), F.lit(" chemins concordants"))).otherwise("")
    verdict = F.when(F.col("weight") > 0, "Oui, déductible").otherwise("Non, réfuté")
    said = F.concat(verdict, F.lit(" ("), names[F.col("schema")], paths, F.lit(") : "), chain, F.lit("."))
    special = (
        F.when(F.col("schema") == "contradiction", "Non — un terme n'est pas l'antonyme de lui-même.")
        .when(F.col("schema") == "tautology", F.concat(F.lit("Oui — trivialement, « "), "subject", F.lit(" » entretient "), "relation", F.lit(" avec lui-même.")))
        .when(F.col("schema") == "prefix", F.concat(F.lit("Oui — « "), "subject", F.lit(" » est un composé lexical préfixé par « "), "object", F.lit(" ».")))
    )
    return F.when(F.col("schema").isNull(), "").otherwise(F.coalesce(special, said))
