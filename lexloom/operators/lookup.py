"""Edge lookups over many terms at once.

Ordering always comes before a limit; ties go by edge id.  Weight bounds are
inclusive.  An unknown relation is an error, never "all relations".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import fold_accents, polarity, whole

#: Relation and default limit of each named lookup.
NAMED = {
    "synonyms": ("r_syn", 20),
    "antonyms": ("r_anto", 20),
    "hypernyms": ("r_isa", 20),
    "hyponyms": ("r_hypo", 30),
    "parts": ("r_has_part", 30),
    "characteristics": ("r_carac", 30),
    "agents": ("r_agent", 20),
    "patients": ("r_patient", 20),
    "instruments": ("r_instr", 20),
    "locations": ("r_lieu", 20),
    "consequences": ("r_has_conseq", 20),
    "manner": ("r_manner", 20),
    "telic_role": ("r_telic_role", 20),
    "process_agents": ("r_processus>agent", 20),
    "process_patients": ("r_processus>patient", 20),
    "process_instruments": ("r_processus>instr", 20),
    "actions_of": ("r_agent-1", 20),
    "actions_on": ("r_patient-1", 20),
    "uses_with": ("r_instr-1", 20),
    "domain_members": ("r_domain-1", 20),
}


class UnknownRelation(ValueError):
    """A relation that the graph's type table does not have."""


def check_relations(asked: list[str], types: DataFrame) -> None:
    known = {r.name for r in types.filter(F.col("name").isin(asked)).select("name").collect()}
    if missing := sorted(set(asked) - known):
        raise UnknownRelation(", ".join(missing))


def select_edges(graph: DataFrame, relations: list[str] | None = None, without: list[str] | None = None, least: float | None = None, most: float | None = None, terms: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """Edges by relation, weight and source ``terms`` (a column ``term``); every filter is optional.

    With the graph's type table ``types`` a relation that it does not have is an error.
    """
    out = graph
    if types is not None:
        check_relations([*(relations or []), *(without or [])], types)
    if relations is not None:
        out = out.filter(F.col("rel").isin(relations))
    if without:
        out = out.filter(~F.col("rel").isin(without))
    if least is not None:
        out = out.filter(F.col("w") >= least)
    if most is not None:
        out = out.filter(F.col("w") <= most)
    if terms is not None:
        out = out.join(terms.select(F.col("term").alias("src")).distinct(), "src", "left_semi")
    return out


def page(edges: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of edges by absolute weight, then id."""
    return edges.orderBy(F.abs("w").desc(), "id").offset(offset).limit(limit)


def top_edges(edges: DataFrame, limit: int, by: str = "src", signed: bool = False) -> DataFrame:
    """The ``limit`` strongest edges per end ``by`` and relation, chunks left out, as public triplets with their ``turn``."""
    strength = F.col("w").desc() if signed else F.abs("w").desc()
    turn = F.row_number().over(Window.partitionBy(by, "rel").orderBy(strength, "id"))
    kept = edges.filter(F.col("tgt_type") != schema.CHUNK_TYPE).withColumn("turn", turn).filter(F.col("turn") <= limit)
    return kept.select(F.col("src").alias("source"), F.col("rel").alias("relation"), F.col("tgt_decoded").alias("target"), "w", polarity("w").alias("polarity"), F.when(F.col("tgt") != F.col("tgt_decoded"), F.col("tgt_id")).alias("target_id"), "turn")


def named_lookup(graph: DataFrame, name: str, terms: DataFrame | None = None, least: float | None = None, limit: int | None = None) -> DataFrame:
    """One of the :data:`NAMED` lookups for all ``terms``."""
    relation, usual = NAMED[name]
    return top_edges(select_edges(graph, [relation], least=least, terms=terms), limit or usual)


def incoming(graph: DataFrame, relation: str, limit: int, least: float | None = None) -> DataFrame:
    """The strongest edges that arrive at each target."""
    return top_edges(select_edges(graph, [relation], least=least), limit, by="tgt")


def between(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """All edges from ``a`` to ``b`` for each row of ``pairs``, with their turn by signed weight; an unknown end gives no row."""
    found = graph.join(pairs.select(F.col("a").alias("src"), F.col("b").alias("tgt")).distinct(), ["src", "tgt"])
    turn = F.row_number().over(Window.partitionBy("src", "tgt").orderBy(F.col("w").desc(), "id"))
    return found.select(F.col("src").alias("source"), F.col("rel").alias("relation"), F.col("tgt_decoded").alias("target"), "w", turn.alias("turn"))


def known_names(terms: DataFrame, graph: DataFrame) -> DataFrame:
    """The distinct ``term`` of ``terms`` that name an end of some edge; the graph is only probed for the names asked."""
    asked = terms.select("term").distinct()
    ends = [asked.join(graph.select(F.col(end).alias("term")), "term", "left_semi") for end in ("src", "tgt")]
    return ends[0].union(ends[1]).distinct()


def between_or_missing(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """As :func:`between`, and for a pair with an unknown end one row that names it (``missing``; the first end first) and nothing else."""
    asked = pairs.select("a", "b").distinct()
    known = known_names(asked.select(F.explode(F.array("a", "b")).alias("term")), graph).withColumn("known", F.lit(True))
    ends = asked.join(known.withColumnsRenamed({"term": "a", "known": "known_a"}), "a", "left").join(known.withColumnsRenamed({"term": "b", "known": "known_b"}), "b", "left")
    missing = F.when(F.col("known_a").isNull(), F.col("a")).when(F.col("known_b").isNull(), F.col("b"))
    lost = ends.withColumn("missing", missing).filter("missing is not null")
    rows = between(graph, ends.filter("known_a and known_b"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("source", "target", "turn")]
    error = lost.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(1).alias("turn"), *empty, "missing")
    return rows.withColumn("missing", F.lit(None).cast("string")).unionByName(error)


def synonyms_by_node_weight(graph: DataFrame, nodes: DataFrame, least: float = 25.0, limit: int = 30) -> DataFrame:
    """``(source, target, node_w, turn)``: the first ``limit`` synonyms of ``least`` or more in edge order, then by the weight of their node."""
    return _nodes_of(graph, nodes, "r_syn", least, limit, F.col("node_w").desc())


def hypernyms_in_order(graph: DataFrame, nodes: DataFrame, least: float = 25.0, limit: int = 30) -> DataFrame:
    """As :func:`synonyms_by_node_weight` over ``r_isa``, in edge order."""
    return _nodes_of(graph, nodes, "r_isa", least, limit, F.col("place"))


def _nodes_of(graph: DataFrame, nodes: DataFrame, relation: str, least: float, limit: int, order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("src").orderBy("id"))
    first = select_edges(graph, [relation], least=least).withColumn("place", place).filter(F.col("place") <= limit)
    named = first.join(nodes.select(F.col("name").alias("tgt"), F.col("w").alias("node_w")), "tgt")
    turn = F.row_number().over(Window.partitionBy("src").orderBy(order, "place"))
    return named.select(F.col("src").alias("source"), F.col("tgt").alias("target"), "node_w", turn.alias("turn"))


def existing_for_enrichment(graph: DataFrame, pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Every triplet of each asked ``(term, relation)``, negative ones too, strongest first (all, or ``limit`` of them), with the folded name to avoid."""
    asked = pairs.select(F.col("term").alias("src"), F.col("relation").alias("rel")).distinct()
    turn = F.row_number().over(Window.partitionBy("src", "rel").orderBy(F.abs("w").desc(), "id"))
    kept = graph.join(asked, ["src", "rel"], "left_semi").filter(F.col("tgt_type") != schema.CHUNK_TYPE).withColumn("turn", turn)
    if limit is not None:
        kept = kept.filter(F.col("turn") <= limit)
    return kept.select(F.col("src").alias("term"), F.col("rel").alias("relation"), F.col("tgt_decoded").alias("target"), "w", polarity("w").alias("polarity"), fold_accents("tgt_decoded").alias("excluded"), "turn")


def explore(graph: DataFrame, relation: str, least: float | None, limit: int, annotations: DataFrame | None = None) -> DataFrame:
    """Edges by signed weight, chunks kept, weights to one decimal; with ``annotations`` (rel_id, annotations) also their text."""
    turn = F.row_number().over(Window.partitionBy("src").orderBy(F.col("w").desc(), "id"))
    kept = select_edges(graph, [relation], least=least).withColumn("turn", turn).filter(F.col("turn") <= limit)
    public = [F.col("src").alias("source"), F.col("tgt_decoded").alias("target"), F.round("w", 1).alias("w"), "turn"]
    if annotations is None:
        return kept.select(*public)
    said = F.array_join(F.transform("annotations", lambda a: F.concat(a.value, F.lit(" (w="), whole(a.w), F.lit(")"))), " ; ")
    raw = F.when(F.col("tgt") != F.col("tgt_decoded"), F.col("tgt")).otherwise("")
    return kept.join(annotations, kept["id"] == annotations["rel_id"], "left").select(*public, F.coalesce(said, F.lit("")).alias("annotations"), raw.alias("target_id"))


def relation_list(types: DataFrame, prefix: str = "") -> DataFrame:
    """Relation types whose name starts with ``prefix``, help cut at 120 characters."""
    return types.filter(F.col("name").startswith(prefix)).select("id", "name", F.substring("help", 1, 120).alias("help"))


def existing_terms(terms: DataFrame, graph: DataFrame) -> DataFrame:
    """``(term, known)``: whether the graph has a node of that name."""
    return terms.join(known_names(terms, graph).withColumn("known", F.lit(True)), "term", "left").select("term", F.coalesce("known", F.lit(False)).alias("known"))


def distinct_targets(graph: DataFrame, relation: str) -> DataFrame:
    """Accent-free distinct targets of each source: the set that new candidates must avoid."""
    return graph.filter(F.col("rel") == relation).select(F.col("src").alias("term"), fold_accents("tgt_decoded").alias("target")).distinct()


def not_excluded(candidates: DataFrame, graph: DataFrame) -> DataFrame:
    """Candidates ``(term, relation, target)`` without an existing target of the same folded name."""
    have = graph.select(F.col("src").alias("term"), F.col("rel").alias("relation"), fold_accents("tgt_decoded").alias("folded")).distinct()
    return candidates.withColumn("folded", fold_accents("target")).join(have, ["term", "relation", "folded"], "left_anti").drop("folded")
