"""The graph queries by name, and the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.operators import annotations, budget, enrich, inference, lookup, senses, stats, subgraph, verify
from lexloom.operators.inference import RuleGraph
from lexloom.plans import budget_oracle, more_oracles, oracles
from lexloom.sources import derived, relation_docs, text_files
from lexloom.sources.graph import triplets
from lexloom.sources.keyed import KEPT
from lexloom.sources.storage import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _types(spark, sf_dir) -> DataFrame:
    """The relation types that the derived graph uses, numbered by name."""
    used = derived.graph(spark, sf_dir).groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n"))
    number = F.row_number().over(Window.orderBy("name"))  # as many rows as there are relations
    return used.select(number.cast("int").alias("id"), "name", F.concat(F.lit("used "), F.col("n").cast("string"), F.lit(" times")).alias("help"))


def _public(df: DataFrame) -> DataFrame:
    return df.withColumn("turn", F.col("turn").cast("long"))


@query
def lookup_out_topk(spark, sf_dir):
    """The three strongest triplets of every source and relation."""
    return _public(lookup.top_edges(derived.graph(spark, sf_dir), 3)).drop("target_id")


@query
def lookup_in_topk(spark, sf_dir):
    return _public(lookup.incoming(derived.graph(spark, sf_dir), "r_isa", 5)).drop("target_id")


@query
def lookup_between(spark, sf_dir):
    pairs = derived.claims(spark, sf_dir).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return _public(lookup.between(derived.graph(spark, sf_dir), pairs))


@query
def lookup_by_type(spark, sf_dir):
    return lookup.select_edges(derived.graph(spark, sf_dir), ["r_make"]).select("id", "src", "rel", "tgt", "w")


@query
def filter_weight_range(spark, sf_dir):
    return lookup.select_edges(derived.graph(spark, sf_dir), least=-20.0, most=20.0).select("id", "src", "rel", "tgt", "w")


@query
def filter_types_in(spark, sf_dir):
    return lookup.select_edges(derived.graph(spark, sf_dir), ["r_lieu", "r_holo"]).select("id", "src", "rel", "tgt", "w")


@query
def filter_types_not_in(spark, sf_dir):
    return lookup.select_edges(derived.graph(spark, sf_dir), without=["r_carac", "r_make"]).select("id", "src", "rel", "tgt", "w")


@query
def lookup_page(spark, sf_dir):
    """A page of edges: offset 40, limit 25, strongest first."""
    return lookup.page(derived.graph(spark, sf_dir), 40, 25).select("id", "src", "rel", "tgt", "w")


@query
def named_hypernyms(spark, sf_dir):
    return _public(lookup.named_lookup(derived.graph(spark, sf_dir), "hypernyms")).drop("target_id")


@query
def named_characteristics(spark, sf_dir):
    return _public(lookup.named_lookup(derived.graph(spark, sf_dir), "characteristics", least=10.0)).drop("target_id")


@query
def explore_by_signed_weight(spark, sf_dir):
    return _public(lookup.explore(derived.graph(spark, sf_dir), "r_carac", None, 2))


@query
def polarity_split(spark, sf_dir):
    g = derived.graph(spark, sf_dir)
    return g.select("rel", lookup.polarity("w").alias("polarity")).groupBy("rel", "polarity").agg(F.count("*").alias("n"))


@query
def relation_prefix(spark, sf_dir):
    return lookup.relation_list(_types(spark, sf_dir), "r_has")


@query
def term_exists(spark, sf_dir):
    return lookup.existing_terms(derived.claims(spark, sf_dir).select(F.col("object").alias("term")).distinct(), derived.graph(spark, sf_dir))


@query
def exclusion_anti_join(spark, sf_dir):
    candidates = derived.claims(spark, sf_dir).select(F.col("subject").alias("term"), "relation", F.upper("object").alias("target")).distinct()
    return lookup.not_excluded(candidates, derived.graph(spark, sf_dir))


@query
def distinct_targets(spark, sf_dir):
    return lookup.distinct_targets(derived.graph(spark, sf_dir), "r_lieu")


@query
def stats_by_relation(spark, sf_dir):
    return stats.by_relation(derived.graph(spark, sf_dir))


@query
def stats_by_target_top20(spark, sf_dir):
    return stats.by_target(derived.graph(spark, sf_dir))


@query
def degree(spark, sf_dir):
    return stats.degree(derived.graph(spark, sf_dir))


@query
def gaps_classify(spark, sf_dir):
    g = derived.graph(spark, sf_dir)
    return stats.gaps(g.select(F.col("src").alias("term")).distinct(), g, ["r_carac", "r_lieu", "r_make"])


@query
def gap_counts(spark, sf_dir):
    return gaps_classify(spark, sf_dir).groupBy("gap_type").agg(F.count("*").alias("n"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("subject", "relation", "object", "schema", "weight", "confidence", F.col("consensus").cast("long").alias("consensus"), inference.proof_text().alias("proof"))


def _schema_query(name: str) -> Query:
    def run(spark, sf_dir):
        return _flat(inference.run_schema(RuleGraph(derived.graph(spark, sf_dir)), derived.claims(spark, sf_dir), name))

    run.__doc__ = f"What the schema ``{name}`` says about all claims."
    return run


for _name in inference.SCHEMAS:
    QUERIES[_name] = _schema_query(_name)


@query
def cascade_effort1(spark, sf_dir):
    return _flat(inference.infer(RuleGraph.stored(derived.graph(spark, sf_dir)), derived.claims(spark, sf_dir), 1))


@query
def cascade_effort2(spark, sf_dir):
    return _flat(inference.infer(RuleGraph.stored(derived.graph(spark, sf_dir)), derived.claims(spark, sf_dir), 2))


@query
def budgeted_inference(spark, sf_dir):
    """The cascade within budgets of 1, 5 and 20 look-ups."""
    found = store(budget.infer_with_costs(RuleGraph.stored(derived.graph(spark, sf_dir)), derived.claims(spark, sf_dir), 2, oracles.RELATIONS), "costs")
    parts = [budget.within(found, b).withColumn("budget", F.lit(b).cast("long")) for b in budget_oracle.BUDGETS]
    return reduce(DataFrame.unionByName, parts).select("subject", "relation", "object", "budget", "schema", "weight", "lookups_used")


@query
def explanations(spark, sf_dir):
    """The answers in words."""
    found = inference.infer(RuleGraph.stored(derived.graph(spark, sf_dir)), derived.claims(spark, sf_dir), 2)
    return found.select("subject", "relation", "object", inference.explanation(found).alias("explanation"))


def _verified(spark, sf_dir, effort: int, bypass: bool = False) -> DataFrame:
    claims = derived.claims(spark, sf_dir).withColumn("polarity", F.length("subject") % 2 == 0)
    return verify.verify(RuleGraph.stored(derived.graph(spark, sf_dir)), claims, effort, bypass, oracles.RELATIONS)


def _verdicts(found: DataFrame) -> DataFrame:
    return found.select("subject", "relation", "object", "polarity", "status", "confidence", "schema", "weight")


@query
def verify_effort0(spark, sf_dir):
    return _verdicts(_verified(spark, sf_dir, 0))


@query
def verify_effort1(spark, sf_dir):
    return _verdicts(_verified(spark, sf_dir, 1))


@query
def verify_bypass(spark, sf_dir):
    return _verdicts(_verified(spark, sf_dir, 1, True))


@query
def verdict_summary(spark, sf_dir):
    return verify.summary(_verified(spark, sf_dir, 1))


def _candidates(spark, sf_dir) -> DataFrame:
    claims = derived.claims(spark, sf_dir)
    return claims.select(F.col("subject").alias("term"), "relation", F.col("object").alias("target"), F.lit(0.8).alias("confidence"))


@query
def validate_candidates(spark, sf_dir):
    return enrich.validate(_candidates(spark, sf_dir), RuleGraph.stored(derived.graph(spark, sf_dir)))


def _consolidated(spark, sf_dir) -> DataFrame:
    g = RuleGraph.stored(derived.graph(spark, sf_dir))
    return enrich.consolidate(enrich.validate(_candidates(spark, sf_dir), g), g)


@query
def consolidate_candidates(spark, sf_dir):
    return _consolidated(spark, sf_dir).drop("consolidation_explanation")


@query
def candidate_counts(spark, sf_dir):
    return enrich.status_counts(_consolidated(spark, sf_dir))


@query
def submission_lines(spark, sf_dir):
    return enrich.submission_lines(_consolidated(spark, sf_dir))


def _senses(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and triplets of the graph with senses."""
    nodes, edges, types = derived.sense_graph(spark, sf_dir)
    nodes, edges = KEPT.of(nodes, "nodes"), KEPT.of(edges, "edges")
    return nodes, edges, KEPT.of(triplets(nodes, edges, types), "triplets")


@query
def decode_names(spark, sf_dir):
    found = senses.decode_names(_senses(spark, sf_dir)[0])
    return found.select("id", "name", "decoded", F.array_join("path", "/").alias("path"))


@query
def disambiguate(spark, sf_dir):
    """All senses of all terms, strongest first."""
    nodes, _, g = _senses(spark, sf_dir)
    return senses.list_senses(nodes, g).select("term", "sense_id", "decoded", "weight", F.col("turn").cast("long").alias("turn"))


@query
def resolve_soft_sense(spark, sf_dir):
    nodes, _, g = _senses(spark, sf_dir)
    return senses.resolve_senses(derived.soft_names(spark, sf_dir), store(senses.list_senses(nodes, g), "senses"))


@query
def annotations_for_edges(spark, sf_dir):
    nodes, edges, _ = _senses(spark, sf_dir)
    shown = F.transform("annotations", lambda a: F.concat_ws(":", a.kind, a.value, F.bround(a.w, 0).cast("long").cast("string")))
    return annotations.edge_annotations(nodes, edges).select("rel_id", F.array_join(shown, ",").alias("annotations"))


@query
def annotation_disagreement(spark, sf_dir):
    nodes, edges, g = _senses(spark, sf_dir)
    top = annotations.annotable(g, annotations.edge_annotations(nodes, edges))
    proposed = top.withColumn("category", F.when(F.col("w") > 20, F.lit("Non specifique")).otherwise(F.lit("exception")))
    return annotations.disagreements(proposed).select("id", "subject", "relation", "target", "existing", "category", "disagrees")


@query
def sense_contamination(spark, sf_dir):
    nodes, _, g = _senses(spark, sf_dir)
    return senses.contaminated_senses(senses.list_senses(nodes, g), g)


@query
def duplicate_sense_signal(spark, sf_dir):
    nodes, _, g = _senses(spark, sf_dir)
    return senses.shared_by_senses(senses.list_senses(nodes, g), g)


def _subgraphs(spark, sf_dir, depth: int):
    g = store(derived.graph(spark, sf_dir), "graph")
    roots = g.filter("rel in ('r_hypo', 'r_make', 'r_lieu')").select(F.col("src").alias("root")).distinct()
    return subgraph.extract(g, roots, depth)


@query
def subgraph_depth1(spark, sf_dir):
    return _subgraphs(spark, sf_dir, 1)[1].select("root", "source", "target", "relation", "w", "label", "place")


@query
def subgraph_depth2(spark, sf_dir):
    return _subgraphs(spark, sf_dir, 2)[1].select("root", "source", "target", "relation", "w", "label", "place", "from_negation")


@query
def subgraph_nodes(spark, sf_dir):
    nodes = _subgraphs(spark, sf_dir, 2)[0]
    return nodes.select("root", "label", F.col("depth").cast("long").alias("depth"), "kind", "negated")


@query
def subgraph_stats(spark, sf_dir):
    return subgraph.counts(*_subgraphs(spark, sf_dir, 2))


def _numbered(spark, sf_dir, depth: int, expand_refined: bool) -> DataFrame:
    g = _senses(spark, sf_dir)[2]
    roots = g.filter("rel in ('r_isa', 'r_raff_sem', 'r_carac')").select(F.col("src").alias("root")).distinct()
    _, edges = subgraph.numbered(*subgraph.extract(g, roots, depth, expand_refined=expand_refined))
    return edges.select("root", "source", "target", "relation", "w", F.col("depth").cast("long").alias("depth"), "from_node", "to_node")


@query
def subgraph_numbered_depth3(spark, sf_dir):
    """Edges of the subgraphs of all terms by the numbers of their nodes; senses end a branch."""
    return _numbered(spark, sf_dir, 3, False)


@query
def subgraph_numbered_depth4(spark, sf_dir):
    return _numbered(spark, sf_dir, 4, False)


@query
def subgraph_refined_depth3(spark, sf_dir):
    """As above, senses expanded by their own names."""
    return _numbered(spark, sf_dir, 3, True)


@query
def subgraph_refined_depth4(spark, sf_dir):
    return _numbered(spark, sf_dir, 4, True)


@query
def subgraph_visible(spark, sf_dir):
    nodes, edges = _subgraphs(spark, sf_dir, 2)
    return subgraph.visible(nodes, edges).select("root", "label")


@query
def relation_docs_parsed(spark, sf_dir):
    """Documents about all relations, written from the graph and parsed again."""
    g = derived.graph(spark, sf_dir)
    top = g.withColumn("turn", F.row_number().over(Window.partitionBy("rel").orderBy(F.abs("w").desc(), "id"))).filter("turn <= 5")
    examples = top.groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(" | ", F.concat(F.lit("* "), "src"), "rel", "tgt").alias("line")))).alias("shown"))
    text = g.groupBy("rel").agg(F.count("*").alias("n")).join(examples, "rel")
    head = [F.lit("before"), F.concat(F.lit("### About "), "rel", F.lit(" (`"), "rel", F.lit("`)")), F.concat(F.lit("It has "), F.col("n").cast("string"), F.lit(" triplets.")), F.lit("")]
    lines = F.concat(F.array(*head), F.transform("shown", lambda x: x.line), F.array(F.lit("# Other"), F.lit("* a | r_x | b")))
    return relation_docs.doc_text(relation_docs.parse_relation_docs(text.select(F.col("rel").alias("doc"), F.posexplode(lines).alias("pos", "line"))))


@query
def claim_lines(spark, sf_dir):
    """Claim lines of text, with the rejected ones."""
    g = derived.claims(spark, sf_dir)
    lines = g.select(F.concat_ws(" ", F.split_part("subject", F.lit(" "), F.lit(1)), "relation", F.lit("|"), "object").alias("line")).distinct()
    return text_files.parse_claim_lines(lines).select("line", "subject", "relation", "object")


@query
def named_lookups(spark, sf_dir):
    """Every named lookup for all terms, with its usual limit."""
    g = derived.graph(spark, sf_dir)
    return reduce(DataFrame.unionByName, [_public(lookup.named_lookup(g, name)).withColumn("lookup", F.lit(name)) for name in lookup.NAMED]).drop("target_id")


@query
def lookup_between_missing(spark, sf_dir):
    """All edges between the ends of each claim, or the end that the graph does not know."""
    pairs = derived.claims(spark, sf_dir).select(F.col("subject").alias("a"), F.upper("object").alias("b"))
    return _public(lookup.between_or_missing(derived.graph(spark, sf_dir), pairs))


@query
def existing_for_enrichment(spark, sf_dir):
    pairs = derived.claims(spark, sf_dir).select(F.col("subject").alias("term"), "relation")
    return _public(lookup.existing_for_enrichment(derived.graph(spark, sf_dir), pairs))


def _named_nodes(g: DataFrame) -> DataFrame:
    return stats.degree(g).select(F.col("term").alias("name"), F.col("degree").alias("w"))


@query
def synonyms_by_node_weight(spark, sf_dir):
    g = derived.graph(spark, sf_dir)
    return _public(lookup.synonyms_by_node_weight(g, _named_nodes(g)))


@query
def hypernyms_in_order(spark, sf_dir):
    g = derived.graph(spark, sf_dir)
    return _public(lookup.hypernyms_in_order(g, _named_nodes(g), 0.0, 2))


@query
def gap_details(spark, sf_dir):
    g = derived.graph(spark, sf_dir)
    found = stats.gaps(g.select(F.col("src").alias("term")).distinct(), g, ["r_carac", "r_lieu", "r_make"])
    return stats.gap_details(found, g, "le graphe").select("term", "relation", "gap_type", "detail")


@query
def indicative_evidence(spark, sf_dir):
    """The strongest triplets of the subject and relation of all claims."""
    found = verify.indicative(RuleGraph(derived.graph(spark, sf_dir)), derived.claims(spark, sf_dir))
    shown = F.transform("evidence", lambda x: F.concat_ws(":", x.target, F.bround(x.w, 0).cast("long").cast("string")))
    return found.select("s", "relation", F.array_join(shown, ",").alias("evidence"))


@query
def verdict_texts(spark, sf_dir):
    """Verdicts without inference, in words."""
    return _verified(spark, sf_dir, 0).select("subject", "relation", "object", "explanation")


@query
def verdict_texts_inferred(spark, sf_dir):
    """Verdicts of the rules before direct triplets, in words."""
    return _verified(spark, sf_dir, 1, True).select("subject", "relation", "object", "explanation")


@query
def ready_candidates(spark, sf_dir):
    return enrich.ready(_consolidated(spark, sf_dir)).select("term", "relation", "target", "ready_for_submission")


@query
def proven_triplets(spark, sf_dir):
    """Candidates in upper case that a registered consolidation proves."""
    made = store(_consolidated(spark, sf_dir), "candidates")
    asked = made.select(F.upper("term").alias("term"), "relation", F.upper("target").alias("target")).distinct()
    return enrich.proven(asked, enrich.registry(made))


@query
def registry_merge(spark, sf_dir):
    """Consolidated places and others, merged on folded names; the count per relation."""
    made = store(enrich.registry(_consolidated(spark, sf_dir)), "registry")
    old = made.filter("relation = 'r_lieu'").withColumn("term", F.upper("term"))
    return enrich.merge_registries(old, made).groupBy("relation").agg(F.count("*").alias("n"))


@query
def submission_file(spark, sf_dir):
    """Lines of the submission file by part."""
    found = enrich.submission_file(_consolidated(spark, sf_dir), "du graphe")
    return found.select(F.col("place.part").cast("long").alias("part"), F.col("place.at").cast("long").alias("spot"), "line")


@query
def submission_file_size(spark, sf_dir):
    """Lines of the submission file by part, counted."""
    return submission_file(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"))


@query
def enrich_chain(spark, sf_dir):
    """Gaps of all terms, and the candidates that meet one, validated and consolidated."""
    g = RuleGraph.stored(derived.graph(spark, sf_dir))
    terms = g.graph.select(F.col("src").alias("term")).distinct()
    found = enrich.fill_gaps(terms, _candidates(spark, sf_dir), g, ["r_carac", "r_lieu", "r_make"])
    return found.select("term", "relation", "target", "gap_type", "confidence", "validation_status", "consolidation_status")


@query
def gaps_of_usual_relations(spark, sf_dir):
    """Gaps over the relations of nouns and verbs, counted."""
    g = derived.graph(spark, sf_dir)
    found = stats.gaps(g.select(F.col("src").alias("term")).distinct(), g)
    return found.groupBy("relation", "gap_type").agg(F.count("*").alias("n"))


@query
def lookup_term(spark, sf_dir):
    """All nodes by their names, and a name without a node for each customer."""
    nodes = _senses(spark, sf_dir)[0]
    asked = nodes.select(F.col("name").alias("term")).union(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("no "), "c_name")))
    return senses.lookup_terms(asked, nodes).select("term", "id", "decoded", F.col("type").cast("long").alias("type"), "weight", F.col("error").isNotNull().alias("unknown"))


@query
def node_by_id(spark, sf_dir):
    """The nodes at either end of all refinements."""
    nodes, _, g = _senses(spark, sf_dir)
    return senses.nodes_by_id(g.filter("rel = 'r_raff_sem'").select(F.col("tgt_id").alias("id")), nodes).select("id", "name", "w")


@query
def lookup_target_id(spark, sf_dir):
    """The strongest triplets of a graph with senses and chunks, with the ids of targets that are senses."""
    return _public(lookup.top_edges(_senses(spark, sf_dir)[2], 3))


@query
def triplet_annotations(spark, sf_dir):
    """Annotations of all triplets, asked by their readable names in capitals, and of some that do not exist."""
    nodes, edges, g = _senses(spark, sf_dir)
    asked = g.select(F.col("src").alias("subject"), F.col("rel").alias("relation"), F.upper("tgt_decoded").alias("target"))
    asked = asked.union(g.filter("rel = 'r_isa'").select("src", F.lit("r_isa"), F.lit("rien")))
    found = annotations.of_triplets(asked, g, annotations.edge_annotations(nodes, edges))
    shown = F.transform("annotations", lambda a: F.concat_ws(":", a.kind, a.value, F.bround(a.w, 0).cast("long").cast("string")))
    return found.select("subject", "relation", "target", F.array_join(shown, ",").alias("annotations"), "found")


@query
def explore_annotated(spark, sf_dir):
    nodes, edges, g = _senses(spark, sf_dir)
    return _public(lookup.explore(g, "r_isa", None, 5, annotations.edge_annotations(nodes, edges)))


def _proposals(spark, sf_dir) -> DataFrame:
    """Proposals for the annotable triplets of every subject, as they come from a list of its own."""
    nodes, edges, g = _senses(spark, sf_dir)
    top = annotations.annotable(g, annotations.edge_annotations(nodes, edges))
    listed = store(top.withColumn("index", F.row_number().over(Window.partitionBy("subject").orderBy("id"))), "listed")
    return annotations.by_index(listed, spark.sql(more_oracles.RAW_PROPOSALS.format(listed="{listed}"), listed=listed), ["subject"])


@query
def proposals_by_index(spark, sf_dir):
    return _proposals(spark, sf_dir).select("id", "subject", "relation", "target", "existing", "category", "justification")


@query
def annotation_file(spark, sf_dir):
    found = annotations.annotation_file(_proposals(spark, sf_dir), "graphe")
    return found.select(F.col("place.part").cast("long").alias("part"), F.col("place.at").cast("long").alias("spot"), "line")


@query
def annotation_file_counts(spark, sf_dir):
    return annotations.file_counts(_proposals(spark, sf_dir))


@query
def verify_soft_senses(spark, sf_dir):
    """Claims about senses by their readable names."""
    nodes, edges, g = _senses(spark, sf_dir)
    claims = derived.soft_claims(spark, sf_dir).withColumn("polarity", F.lit(True))
    found = verify.verify(RuleGraph.stored(g), claims, 0, senses=store(senses.list_senses(nodes, g), "senses"), annotations=annotations.edge_annotations(nodes, edges), network="Le graphe")
    return found.select("subject", "relation", "object", "status", "weight", "explanation")


ORACLES = oracles.build() | more_oracles.build() | budget_oracle.build()
