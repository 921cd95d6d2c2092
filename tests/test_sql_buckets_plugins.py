"""SQL functions against the Python calls, bucketed tables on their plans, callables that fail, subgraph numbers."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import annotations, lookup, plugins, subgraph, verify
from lexloom.operators.sql import SqlGraph
from lexloom.sources import buckets
from lexloom.sources.graph import plain_triplets


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    terms = ["Chat", "chien", "félin", "l'os", "animal", "queue", "rouge", "gros"]
    relations = ["r_isa", "r_carac", "r_has_part", "r_lieu", "r_syn"]
    rows = sorted({(rng.choice(terms), rng.choice(relations), rng.choice(terms)) for _ in range(120)})
    return plain_triplets(spark.createDataFrame([(i, *r, float(rng.randint(-50, 99))) for i, r in enumerate(rows)], "id long, src string, rel string, tgt string, w double"))


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_lookups_by_sql(spark, graph):
    SqlGraph(spark, graph, "t1")
    terms = graph.select(F.col("src").alias("term")).distinct()
    terms.createOrReplaceTempView("t1_terms")
    got = spark.sql("SELECT x.* FROM t1_terms t, LATERAL t1_edges(t.term, 'r_isa', 2) x")
    assert got.count() > 4 and same(got, lookup.top_edges(lookup.select_edges(graph, ["r_isa"]), 2).drop("target_id"))
    got = spark.sql("SELECT x.* FROM t1_terms t, LATERAL t1_incoming(t.term, 'r_carac', 3) x")
    assert same(got, lookup.incoming(graph, "r_carac", 3).drop("target_id"))
    for name in lookup.NAMED:
        assert same(spark.sql(f"SELECT x.* FROM t1_terms t, LATERAL t1_{name}(t.term) x"), lookup.named_lookup(graph, name, terms).drop("target_id")), name
    assert spark.sql("SELECT * FROM t1_hypernyms('Chat', 1)").count() == 1 and spark.sql("SELECT * FROM t1_hypernyms('nobody')").count() == 0
    pairs = terms.select(F.col("term").alias("a")).crossJoin(terms.select(F.col("term").alias("b")))
    pairs.createOrReplaceTempView("t1_pairs")
    assert same(spark.sql("SELECT x.* FROM t1_pairs p, LATERAL t1_between(p.a, p.b) x"), lookup.between(graph, pairs).drop("turn"))
    row = graph.filter("src = 'Chat'").first()
    assert spark.sql(f"SELECT w FROM t1_weight(' CHAT ', '{row.rel}', '{row.tgt.upper().replace("'", "''")}')").first().w == row.w


def test_verdicts_subgraphs_and_gaps_by_sql(spark, graph):
    sql = SqlGraph(spark, graph, "t2", ["r_isa", "r_carac"])
    claims = graph.select(F.col("src").alias("subject"), "rel", F.col("tgt").alias("object")).withColumn("relation", F.lit("r_carac")).drop("rel").distinct()
    claims.createOrReplaceTempView("t2_claims")
    sql.verdicts("t2_claims", "t2_verdicts")
    want = verify.verify(sql.rules, claims.withColumn("polarity", F.lit(True)), 1, relations=["r_isa", "r_carac"])
    assert same(spark.sql("SELECT * FROM t2_verdicts"), want)
    assert spark.sql("SELECT status, count(*) AS n FROM t2_verdicts GROUP BY status").agg(F.sum("n").alias("n")).first().n == claims.count()
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW t2_roots AS SELECT DISTINCT source AS root FROM t2_triplets")
    sql.subgraphs("t2_roots", "t2_nodes", "t2_edges", 2)
    nodes, edges = subgraph.numbered(*subgraph.extract(graph, spark.table("t2_roots"), 2))
    assert same(spark.table("t2_nodes"), nodes) and same(spark.table("t2_edges"), edges)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW t2_terms AS SELECT DISTINCT source AS term FROM t2_triplets")
    assert sql.gaps("t2_terms", "t2_gaps", ["r_syn"]).count() == spark.table("t2_gaps").count() > 0


def test_numbers_follow_discovery(spark):
    rows = [("r", "r_isa", "b", 9.0), ("r", "r_isa", "a", 9.5), ("r", "r_carac", "c", -50.0), ("b", "r_isa", "d", 1.0), ("a", "r_isa", "e", 1.0), ("a", "r_carac", "b", 3.0), ("c", "r_isa", "r", 2.0)]
    g = plain_triplets(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, src string, rel string, tgt string, w double"))
    nodes, edges = subgraph.numbered(*subgraph.extract(g, spark.createDataFrame([("r",)], "root string"), 2))
    assert {r.label: r.node for r in nodes.collect()} == {"r": "ROOT", "a": "N1", "b": "N2", "c": "N3", "e": "N4", "d": "N5"}
    assert {(r.from_node, r.to_node) for r in edges.collect()} == {("ROOT", "N1"), ("ROOT", "N2"), ("ROOT", "N3"), ("N1", "N4"), ("N1", "N2"), ("N2", "N5"), ("N3", "ROOT")}


def test_bucketed_graph_is_never_shuffled(spark, graph, tmp_path):
    stored = buckets.write_buckets(graph, "bucketed_test", 8)
    try:
        before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        terms = graph.select(F.col("src").alias("term")).distinct()
        found = buckets.edges_of(spark, stored, terms, ["r_isa", "r_syn"])
        assert same(found, lookup.select_edges(graph, ["r_isa", "r_syn"]).select(F.col("src").alias("term"), F.col("rel").alias("relation"), F.col("tgt").alias("target"), "w"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "bucketed_test_edges" in line]
        assert len(scans) == 1 and "PartitionFilters: [rel" in scans[0] and "Bucketed: true" in scans[0]
        assert below_scans(found, "bucketed_test") == []
        claims = graph.select(F.col("src").alias("subject"), F.when(F.length("tgt") > 4, "r_carac").otherwise("r_syn").alias("relation"), F.col("tgt").alias("object"))
        hops = buckets.two_hops(spark, stored, claims, "r_isa")
        one = graph.filter("rel = 'r_isa' and w > 0").select(F.lower("src").alias("a"), F.lower("tgt").alias("m"), F.col("tgt").alias("mid"), F.col("w").alias("w1"))
        two = graph.select(F.lower("src").alias("m"), F.col("rel").alias("relation"), F.lower("tgt").alias("o"), F.col("w").alias("w2"))
        want = claims.distinct().withColumns({"a": F.lower("subject"), "o": F.lower("object")}).join(one, "a").join(two, ["m", "relation", "o"]).select(*hops.columns)
        assert hops.count() > 5 and same(hops, want)
        assert below_scans(hops, "bucketed_test") == []
    finally:
        stored.drop(spark)
        for k, v in before.items():
            spark.conf.set(k, v)


def below_scans(df, table):
    """Exchanges of the plan with a scan of ``table`` right below, no join between."""
    bad = []

    def walk(node):
        """Tables scanned below without a join."""
        held = set()
        children = node.children()
        for i in range(children.length()):
            held |= walk(children.apply(i))
        text, name = node.toString().splitlines()[0], node.nodeName()
        if table in text and "FileScan" in text:
            held.add(text)
        if "Exchange" in name and held:
            bad.append(text)
        return set() if "Join" in name else held

    walk(df._jdf.queryExecution().executedPlan())
    return bad


def test_a_failing_item_costs_itself_only(spark):
    def maker():
        made = []

        def answer(item):
            made.append(item)
            if "bad" in item["text"]:
                raise ValueError(f"no: {item['id']}")
            return [{"subject": "s", "relation": "r_isa", "object": str(len(item["text"])), "polarity": None}, {"subject": None, "relation": "r", "object": "x"}, "odd"]

        return answer

    texts = spark.createDataFrame([(i, "bad" if i % 7 == 3 else "x" * i) for i in range(40)], "id long, text string").repartition(3)
    claims, failed = plugins.extract_claims(texts, maker)
    assert {(r.id, r.object, r.polarity) for r in claims.collect()} == {(i, str(i), True) for i in range(40) if i % 7 != 3}
    assert {(r.id, r.error) for r in failed.collect()} == {(i, f"ValueError: no: {i}") for i in range(40) if i % 7 == 3}
    assert plugins.extract_claims(texts.limit(0), maker)[0].count() == 0


def test_at_most_ten_candidates(spark):
    def maker():
        def answer(gap):
            if gap["term"] == "none":
                return None
            return [{"target": f"{gap['term']} {i}", "confidence": "0.5" if i else "much", "extra": 1} for i in range(25)]

        return answer

    found = plugins.propose(spark.createDataFrame([("a", "r_isa"), ("none", "r_isa")], "term string, relation string"), maker).collect()
    assert [(r.target, r.confidence) for r in sorted(found, key=lambda r: int(r.target[2:]))] == [(f"a {i}", 0.5 if i else None) for i in range(10)]


def test_failed_lists_keep_their_triplets_without_category(spark):
    lists = spark.createDataFrame([("a", [("r_isa", "x"), ("r_isa", "y")]), ("b", [("r_isa", "z")])], "subject string, triplets array<struct<relation:string,target:string>>")

    def maker():
        def answer(item):
            if item["subject"] == "b":
                raise RuntimeError("quota")
            return [{"index": 1, "category": "Constitutif", "justification": " j "}, {"index": 7, "category": "x"}, {"index": 1, "category": "exception", "justification": "last"}]

        return answer

    triplets = lists.select("subject", F.posexplode("triplets").alias("index", "t")).select("subject", "index", "t.*")
    got = annotations.by_index(triplets, plugins.annotate(lists, maker), ["subject"]).collect()
    assert {(r.subject, r["index"], r.category, r.justification) for r in got} == {("a", 0, None, ""), ("a", 1, "exception", "last"), ("b", 0, None, "")}
