"""Names and choice of word senses on literal graphs, and soft references against all senses."""

import random

from pyspark.sql import functions as F

from lexloom.operators import annotations, senses, verify
from lexloom.operators.inference import RuleGraph
from lexloom.sources.graph import triplets
from lexloom.sources.storage import store

NODES = [
    (1, "avocat", 1, 50.0), (2, "avocat>116477>66699", 1, 30.0), (3, "avocat>87286", 1, 20.0), (4, "avocat>robe", 1, 5.0), (5, "avocat>999", 1, 4.0),
    (116477, "personne", 1, 90.0), (66699, "juriste", 1, 60.0), (87286, "fruit", 1, 80.0), (10, "robe", 1, 40.0), (30, ":r106", 3, 0.0), (31, ":rue", 3, 0.0), (33, "non spécifique", 1, 5.0), (36, "_chunk", 8, 0.0),
]
EDGES = [(101, 1, 2, 1, 60.0), (102, 1, 3, 1, 80.0), (105, 1, 10, 9, 25.0), (106, 1, 36, 9, 70.0), (108, 2, 10, 9, 90.0), (120, 30, 33, 998, 200.0), (121, 30, 36, 998, 300.0), (122, 31, 33, 998, 1.0), (123, 1, 777, 9, 1.0)]


def graph(spark, nodes=NODES, edges=EDGES):
    n = spark.createDataFrame(nodes, "id long, name string, type int, w double")
    e = spark.createDataFrame(edges, "id long, node1 long, node2 long, type int, w double")
    return n, e, triplets(n, e, spark.createDataFrame([(1, "r_raff_sem", ""), (9, "r_has_part", "")], "id int, name string, help string"))


def test_decoding_and_order(spark):
    n, e, g = graph(spark)
    assert {r.name: r.decoded for r in senses.decode_names(n).collect()} == {"avocat>116477>66699": "avocat (personne, juriste)", "avocat>87286": "avocat (fruit)", "avocat>robe": "avocat>robe", "avocat>999": "avocat (<id:999>)"}
    listed = senses.list_senses(n, g).orderBy("turn").collect()
    assert [(r.sense_id, r.weight) for r in listed] == [(3, 80.0), (2, 60.0), (4, 5.0), (5, 4.0)]
    assert senses.list_senses(n, g, 2).count() == 2
    noted = annotations.edge_annotations(n, e).collect()
    assert [(r.rel_id, [(a.kind, a.value, a.w) for a in r.annotations]) for r in noted] == [(106, [("annotation", "non spécifique", 200.0)])]
    assert 123 not in {r.id for r in g.collect()}


def test_a_term_may_have_hundreds_of_senses(spark):
    nodes = [(i, f"mot>hint {i}", 1, float(i)) for i in range(1, 501)] + [(1000, "mot", 1, 1.0)]
    n, _, g = graph(spark, nodes, [])
    listed = senses.list_senses(n, g)
    assert listed.count() == 500
    asked = spark.createDataFrame([("mot>hint 1",), ("mot>hint 77x",), ("mot>HINT 499>nothing",)], "soft string")
    assert {r.soft: r.name for r in senses.resolve_senses(asked, listed).collect()} == {"mot>hint 1": "mot>hint 199", "mot>hint 77x": "mot>hint 77", "mot>HINT 499>nothing": "mot>hint 499"}


def resolved(soft, listed):
    head, *hints = soft.split(">")
    hints = [h.strip().lower() for h in hints if h.strip()]
    if not hints:
        return head.strip()
    if all(h.isdigit() for h in hints):
        return soft
    tried = []
    for s in listed:
        if s.term == head.strip():
            path = [p.lower() for p in s.path]
            score = sum(any(h in p or p in h for p in path) or h in s.decoded.lower() for h in hints)
            tried.append((-score, s.turn, s.sense))
    best = min(tried, default=(0,))
    return best[2] if best[0] < 0 else None


def test_soft_references_against_all_senses(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abé (") for _ in range(rng.randint(1, 6))).strip() or "a"
    nodes = {(i, f"{rng.choice(['t', 'uu', 'long'])}>{text()}>{text()}") for i in range(300)}
    n, _, g = graph(spark, [(i, name, 1, float(i % 50)) for i, name in nodes], [])
    listed = senses.list_senses(n, g)
    soft = sorted({f"{rng.choice(['t', 'uu', 'long', 'none'])}>{'>'.join(rng.choice([text(), text().upper(), '12', ' ', text() + text()]) for _ in range(rng.randint(0, 3)))}" for _ in range(300)})
    got = {r.soft: r.name for r in senses.resolve_senses(spark.createDataFrame([(s,) for s in soft], "soft string"), listed).collect()}
    rows = listed.collect()
    assert got == {s: resolved(s, rows) for s in soft}


def test_hints_that_many_senses_match(spark):
    """Neither small files nor a common hint make tables that a driver holds, or a row per reference and sense."""
    nodes = [(i, f"mot>nom {i}>commun", 1, float(i)) for i in range(1, 61)] + [(1000, "mot", 1, 1.0)]
    n, _, g = graph(spark, nodes, [])
    listed = store(senses.list_senses(n, g), "senses")
    soft = [f"mot>NOM {i}>commun" for i in range(1, 61)] + ["mot>commun>commun>nom 7", "mot>commun>rien", "mot>nom>commun>nom 3 x"]
    found = senses.resolve_senses(spark.createDataFrame([(s,) for s in soft], "soft string"), listed)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    rows = listed.collect()
    assert {r.soft: r.name for r in found.collect()} == {s: resolved(s, rows) for s in soft}
    met = spark.createDataFrame([("mot", "commun", f"s{i}", i, i) for i in range(60)] + [("mot", f"nom {i}", f"s{i}", i, i) for i in range(60)], "group string, hint string, sense string, turn int, sense_id long")
    hinted = spark.createDataFrame([(f"r{i}", "mot", h) for i in range(60) for h in ("commun", f"nom {i}")], "soft string, group string, hint string")
    best = senses._best_met(hinted, met)
    assert {r.soft: r.name for r in best.collect()} == {f"r{i}": f"s{i}" for i in range(60)}


def test_claims_about_senses_send_no_table_to_the_driver(spark):
    """Stored nodes, triplets and claims are small as files; what a driver would hold of them is not."""
    n, e, g = graph(spark)
    n, e = store(n, "nodes"), store(e, "edges")
    g = triplets(n, e, spark.createDataFrame([(1, "r_raff_sem", ""), (9, "r_has_part", "")], "id int, name string, help string"))
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    assert joins(g) == 0
    g = store(g, "triplets")
    listed = senses.list_senses(n, g)
    noted = annotations.edge_annotations(n, e)
    claims = store(spark.createDataFrame([("avocat>personne", "r_has_part", "robe", True), ("avocat", "r_has_part", "robe", False)], "subject string, relation string, object string, polarity boolean"), "claims")
    found = verify.verify(RuleGraph.stored(g), claims, senses=store(listed, "senses"), annotations=noted)
    assert [joins(df) for df in (listed, noted, found)] == [0, 0, 1]  # the evidence, counted
    assert {r.subject: r.status for r in found.collect()} == {"avocat>116477>66699": "supported", "avocat": "contradicted"}


def test_contained_pairs(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(120)})
    df = spark.createDataFrame([(g, w) for g in "xy" for w in words], "group string, needle string")
    got = {tuple(r) for r in senses.contained_pairs(df, df.withColumnRenamed("needle", "hay")).collect()}
    assert got == {(g, a, b) for g in "xy" for a in words for b in words if a in b}
    assert senses.contained_pairs(df, df.limit(0).withColumn("hay", F.col("needle"))).count() == 0
