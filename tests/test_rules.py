"""Rule goldens: one small graph per schema, all claims answered in one run each."""

import math

import pytest

from lexloom.operators import inference, verify
from lexloom.operators.inference import RuleGraph
from lexloom.sources.graph import plain_triplets
from lexloom.sources.storage import store

# edges, claim, schema, weight, confidence
GOLDENS = [
    ([], ("chat", "r_syn", "chat"), "tautology", 100, 0.762),
    ([], ("chaud", "r_anto", "chaud"), "contradiction", -100, 0.762),
    ([], ("saucisse de toulouse", "r_isa", "saucisse"), "prefix", 30, 0.248),
    ([("graine", "r_can_eat-1", "moineau", 50)], ("moineau", "r_can_eat", "graine"), "inverse", 50, 0.462),
    ([("chat", "r_has_part", "patte", 80)], ("chat", "r_lieu-1", "patte"), "implication", 80, 0.631),
    ([("oiseau", "r_isa", "animal2", 200), ("animal2", "r_can_eat", "ver", 40)], ("oiseau", "r_can_eat", "ver"), "deduction_isa", 40, 0.308),
    ([("voiture", "r_has_part", "moteur", 100), ("moteur", "r_has_part", "piston", 80)], ("voiture", "r_has_part", "piston"), "transitivity", 80, 0.538),
    ([("baleine", "r_isa", "mammifère", 300), ("mammifère", "r_isa-incompatible", "poisson", 50)], ("baleine", "r_isa", "poisson"), "isa_incompatible", -50, 0.395),
    ([("orque", "r_isa", "cétacé", 300), ("cétacé", "r_carac", "écaille", -60)], ("orque", "r_carac", "écaille"), "class_elimination", -60, 0.435),
    ([("poule", "r_can_eat", "blé", 100), ("blé", "r_isa", "nourriture", 200)], ("poule", "r_can_eat", "nourriture"), "hyponym_propagation", 100, 0.583),
    ([("feu", "r_carac", "brûlant", 300), ("froid", "r_anto", "brûlant", 90)], ("feu", "r_carac", "froid"), "antonym_contrast", -90, 0.567),
    ([("lion", "r_isa", "fauve", 500), ("tigre", "r_isa", "fauve", 500)], ("lion", "r_isa", "tigre"), "cohyponym", -30, 0.223),
    ([("tour eiffel", "r_lieu", "Paris", 200), ("Paris", "r_holo", "France", 300)], ("tour eiffel", "r_lieu", "France"), "geo_propagation", 300, 0.788),
    ([("pie", "r_isa", "corvidé", 200), ("pie", "r_isa", "bête", 100), ("corvidé", "r_carac", "petit", 50), ("bête", "r_carac", "petit", 50)], ("pie", "r_carac", "petit"), "deduction_isa", 50, 0.419),
    ([], ("xyzzy", "r_carac", "truc"), None, 0, 0.0),
    ([("rive", "r_holo", "fleuve", 80), ("fleuve", "r_lieu", "vallée", 70)], ("rive", "r_lieu", "vallée"), "composition", 70, None),
    # A denial wins over an affirmation; a triplet of weight 0 says nothing.
    ([("ours", "r_isa", "plantigrade", 90), ("ours", "r_isa", "peluche", 80), ("plantigrade", "r_carac", "doux", 60), ("peluche", "r_carac", "doux", -20)], ("ours", "r_carac", "doux"), "class_elimination", -20, None),
    ([("caillou", "r_isa", "minéral", 90), ("minéral", "r_carac", "vivant", 0)], ("caillou", "r_carac", "vivant"), None, 0, 0.0),
]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [e for edges, *_ in GOLDENS for e in edges]
    edges = spark.createDataFrame([(i, s, r, t, float(w)) for i, (s, r, t, w) in enumerate(rows)], "id long, src string, rel string, tgt string, w double")
    graph = RuleGraph.stored(plain_triplets(edges))
    claims = spark.createDataFrame([c for _, c, *_ in GOLDENS], "subject string, relation string, object string")
    found = inference.infer(graph, claims, 2)
    said = found.withColumn("text", inference.explanation(found)).collect()
    return graph, claims, {(r.subject, r.relation, r.object): r for r in said}


def test_goldens(answers):
    for _, claim, schema, weight, sure in GOLDENS:
        row = answers[2][claim]
        assert (row.schema, row.weight) == (schema, weight), claim
        if sure is not None:
            assert math.isclose(row.confidence, sure, abs_tol=1e-9), claim


def test_words(answers):
    assert answers[2]["chat", "r_lieu-1", "patte"].text == "Oui, déductible (par implication) : « chat » a pour partie « patte »."
    assert "n'est" not in answers[2]["voiture", "r_has_part", "piston"].text
    assert answers[2]["xyzzy", "r_carac", "truc"].text == ""


def test_verify(answers, spark):
    graph, _, _ = answers
    claims = spark.createDataFrame(
        [("orque", "r_isa", "cétacé", True), ("cétacé", "r_carac", "écaille", True), ("cétacé", "r_carac", "écaille", False), ("orque", "r_carac", "écaille", True), ("orque", "r_odd", "x", True), ("caillou", "r_lieu", "x", None)],
        "subject string, relation string, object string, polarity boolean",
    )
    got = {(r.subject, r.relation, r.polarity): r for r in verify.verify(graph, claims, 1, relations=["r_isa", "r_carac", "r_lieu"]).collect()}
    assert got["orque", "r_isa", True].status == "supported" and got["orque", "r_isa", True].confidence == 0.995
    assert got["cétacé", "r_carac", True].status == "contradicted" and got["cétacé", "r_carac", False].status == "supported"
    assert got["orque", "r_carac", True].schema == "class_elimination"
    assert got["orque", "r_odd", True].status == "unknown" and got["caillou", "r_lieu", None].confidence == 0.0


def test_no_claim_is_dealt_by_a_hop_that_all_share(spark, monkeypatch):
    """Distinct hops look into the graph; with many of them both sides are shuffled, to the same answers."""
    edges = [(i, f"c{i}", "r_isa", "seg", 40.0) for i in range(50)] + [(100, "seg", "r_isa", "top", 90.0), (101, "seg", "r_carac", "heavy", -30.0), (102, "low", "r_isa", "seg", 10.0)]
    g = inference.RuleGraph.stored(plain_triplets(spark.createDataFrame(edges, "id long, src string, rel string, tgt string, w double")))
    claims = spark.createDataFrame([(f"c{i}", r, o) for i in range(50) for r, o in [("r_isa", "top"), ("r_carac", "heavy"), ("r_isa", "low")]], "subject string, relation string, object string")
    asked = inference.keyed(claims)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hops = store(inference._first_hops(g, asked, 1), "hops")
        assert "SortMergeJoin" not in inference._second_hops(g, hops)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    seen = [{(r.subject, r.relation, r.object): (r.schema, r.weight) for r in inference.infer(g, claims).collect()}]
    monkeypatch.setattr(inference, "FEW", 0)
    seen.append({(r.subject, r.relation, r.object): (r.schema, r.weight) for r in inference.infer(g, claims).collect()})
    assert seen[0] == seen[1] and len(seen[0]) == 150
    assert [seen[0]["c7", *x] for x in (("r_isa", "top"), ("r_carac", "heavy"), ("r_isa", "low"))] == [("deduction_isa", 90.0), ("class_elimination", -30.0), ("cohyponym", -30.0)]
