"""Steps that verdicts and consolidations share are worked out once, and names are folded without Python where they can be."""

import unicodedata

import pytest

from lexloom.functions.text import fold_accents, norm
from lexloom.operators import enrich, inference, verify
from lexloom.operators.inference import RuleGraph
from lexloom.sources.graph import plain_triplets

EDGES = [(1, "chat", "r_isa", "félin", 50.0), (2, "félin", "r_carac", "agile", 40.0), (3, "chat", "r_lieu", "toit", -5.0), *[(10 + i, "chat", "r_has_part", f"p{i}", float(i)) for i in range(6)]]


@pytest.fixture
def graph(spark):
    return RuleGraph(plain_triplets(spark.createDataFrame(EDGES, "id long, src string, rel string, tgt string, w double")))


@pytest.fixture
def stored(monkeypatch):
    """Labels of the tables stored."""
    seen, real = [], inference.store
    for module in (inference, verify, enrich):
        monkeypatch.setattr(module, "store", lambda df, label: seen.append(label) or real(df, label))
    return seen


def test_names(spark):
    white = [chr(c) for c in range(0x3001) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cf")]
    names = [None, "", " ", "Été", " ÉTÉ\xa0", "İ", "a b", "ﬁn", "Á", *[f"{c}A{c}b{c}" for c in white]]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    fold = lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip()
    assert [r[0] for r in df.select(fold_accents("x")).collect()] == [fold(x) for x in names]
    assert df.select(norm("x").alias("n"), "x").where(r"not n <=> lower(regexp_replace(x, '(?U)^\\s+|\\s+$', ''))").count() == 0
    assert "regexp" not in df.select(norm("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_verify_keys_its_claims_once(spark, graph, stored):
    rows = [("chat", "r_carac", "agile", True), ("chat", "r_carac", "agile", True), ("chat", "r_lieu", "toit", True), ("Chat", "r_has_part", "x", None), (None, "r_isa", "x", True)]
    claims = spark.createDataFrame(rows, "subject string, relation string, object string, polarity boolean")
    found = verify.verify(graph, claims, 1)
    got = sorted((str(r.subject), r.relation, r.status, r.schema, r.evidence and len(r.evidence)) for r in found.collect())
    assert got == [("Chat", "r_has_part", "unknown", None, 5), ("None", "r_isa", "unknown", None, None), *2 * [("chat", "r_carac", "supported", "deduction_isa", None)], ("chat", "r_lieu", "contradicted", None, None)]
    assert stored.count("asked") == 1 and stored.count("claims") == 2  # all of them, and those that the guards leave


def test_candidates_are_validated_and_lines_made_once(spark, graph, stored):
    rows = [("chat", "r_carac", "agile", 0.8), ("chat", "r_carac", "félin", 0.8), ("chat", None, "agile", 0.8), ("chat", "r_isa", "félin", 0.8), ("chat", "r_carac", "rien", 0.8)]
    made = enrich.consolidate(enrich.validate(spark.createDataFrame(rows, "term string, relation string, target string, confidence double"), graph), graph)
    got = {(r.relation, r.target): (r.validation_status, r.consolidation_status, (r.consolidation_explanation or "")[:3]) for r in made.collect()}
    assert got == {("r_carac", "agile"): ("ok", "consolidated", "Oui"), ("r_carac", "félin"): ("ok", "not_consolidated", ""), (None, "agile"): ("ok", None, ""), ("r_isa", "félin"): ("duplicate", None, ""), ("r_carac", "rien"): ("unknown_term", None, "")}
    assert enrich.submission_file(made, "du graphe").where("place.part = 1").count() == 1
    assert [stored.count(x) for x in ("candidates", "valid", "asked", "lines")] == [1, 1, 1, 1]
