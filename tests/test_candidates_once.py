"""Candidates and claims are dealt out once for a step, and proofs that nobody reads are not carried."""

import pytest

from lexloom.operators import enrich, inference
from lexloom.operators.inference import RuleGraph
from lexloom.sources.graph import plain_triplets

EDGES = [(1, "chat", "r_isa", "félin", 50.0), (2, "félin", "r_carac", "agile", 40.0), (3, "chat", "r_lieu", "toit", -5.0), (4, "rive", "r_holo", "fleuve", 80.0), (5, "fleuve", "r_lieu", "vallée", 70.0)]
ROWS = [("chat", "r_isa", "Félin ", 0.8), ("chat", "r_isa", "Félin ", 0.8), ("chat", "r_lieu", "toit", 0.8), ("chat", "r_carac", "agile", 0.8), ("chat", "r_carac", "rien", 0.8), ("x", "r_carac", None, 0.8), (None, "r_isa", "félin", 0.8), (None, "r_isa", "Rien", 0.8)]
STATUS = ["duplicate", "duplicate", "inconsistent", "ok", "unknown_term", "unknown_term", "ok", "unknown_term"]


@pytest.fixture
def graph(spark):
    return RuleGraph.stored(plain_triplets(spark.createDataFrame(EDGES, "id long, src string, rel string, tgt string, w double")))


def leaves(df, column):
    """How often the plan reads a table with the column."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(any(a.name() == column for a in _all(found.apply(i).output())) for i in range(found.size()))


def _all(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.mark.parametrize("few", [0, inference.FEW])
def test_validation_reads_candidates_once(spark, graph, monkeypatch, few):
    monkeypatch.setattr(inference, "FEW", few)
    made = enrich.validate(spark.createDataFrame(ROWS, "term string, relation string, target string, confidence double"), graph)
    key = lambda r: tuple(map(str, r))
    got = sorted([(r.term, r.relation, r.target, r.confidence, r.validation_status) for r in made.collect()], key=key)
    assert got == sorted([(*row[:3], 0.1 if s == "inconsistent" else 0.8, s) for row, s in zip(ROWS, STATUS, strict=True)], key=key)
    assert leaves(made, "term") == 1


def test_a_hop_that_serves_several_ways_is_one_row(spark, graph):
    asked = inference.keyed(spark.createDataFrame([("chat", "r_isa", "bête")], "subject string, relation string, object string"))
    hops = inference._first_hops(graph, asked, 2)
    assert sorted((r.r1, r.turn, r.m) for r in hops.collect()) == [("#generic", 1, "félin"), ("r_isa", 1, "félin")]


def test_chains_from_effort_2_on(spark, graph):
    claim = spark.createDataFrame([("rive", "r_lieu", "vallée")], "subject string, relation string, object string")
    assert [(r.schema, r.weight, r.consensus, len(r.proof)) for e in (1, 2) for r in inference.infer(graph, claim, e).collect()] == [(None, 0.0, 0, 0), ("composition", 70.0, 1, 2)]


def test_no_proof_without_an_explanation(spark, graph):
    made = enrich.consolidate(enrich.validate(spark.createDataFrame(ROWS, "term string, relation string, target string, confidence double"), graph), graph)
    proofs = lambda df: [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and "min_by(proof" in x]
    assert proofs(made) and not proofs(made.drop("consolidation_explanation"))
    assert not proofs(enrich.ready(made).select("term", "relation", "target", "ready_for_submission"))
    assert [(r.target, r.consolidation_schema) for r in enrich.ready(made).filter("ready_for_submission").collect()] == [("agile", "deduction_isa")]
