"""Readers, sinks, streams and storage."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.operators import enrich, lookup, subgraph
from lexloom.operators.inference import RuleGraph
from lexloom.sources import graph, relation_docs, sinks, storage, text_files
from lexloom.sources.graph import plain_triplets
from lexloom.streaming import claims as claim_stream


def edges(spark, rows):
    return plain_triplets(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, src string, rel string, tgt string, w double"))


def test_snapshot_round_trip(spark, tmp_path):
    spark.createDataFrame([(1, "chat", 1, 50.0), (2, "animal", 1, 90.0)], "id long, name string, type int, w double").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(7, 1, 2, 6, 40.0), (8, 1, 2, 99, 1.0)], "id long, node1 long, node2 long, type int, w double").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(6, "r_isa", "is a")], "id int, name string, help string").write.parquet(f"{tmp_path}/relation_types.parquet")
    nodes, edge_rows, types = graph.read_snapshot(spark, str(tmp_path))
    found = graph.triplets(nodes, edge_rows, types)
    assert {(r.id, r.src, r.rel, r.tgt) for r in found.collect()} == {(7, "chat", "r_isa", "animal"), (8, "chat", "type_99", "animal")}
    graph.write_triplets(found, f"{tmp_path}/stored")
    again = spark.read.parquet(f"{tmp_path}/stored")
    assert again.filter("rel = 'r_isa'").count() == 1 and "rel" in again.columns
    with pytest.raises(lookup.UnknownRelation):
        lookup.select_edges(found, ["r_none"], types=types)
    assert lookup.select_edges(found, ["r_isa"], types=types).count() == 1


def test_line_files(spark, tmp_path):
    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    sinks.write_lines(lines, f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="exists"):
        sinks.write_lines(lines, f"{tmp_path}/out")
    sinks.write_csv(spark.createDataFrame([("t", "r_isa", "x", 0.5)], "term string, relation string, target string, confidence double"), f"{tmp_path}/csv")
    row = spark.read.option("header", True).csv(f"{tmp_path}/csv").first()
    assert (row.term, row.confidence) == ("t", "0.50")
    terms = text_files.parse_term_lines(spark.createDataFrame([(" chat ",), ("# no",), ("",)], "line string"))
    assert [r.term for r in terms.collect()] == ["chat"]
    long = " ".join(["mot"] * 1500)
    assert text_files.parse_claim_lines(spark.createDataFrame([(f"chat r_isa {long}",)], "line string")).first().object == long


def test_names(spark):
    at = spark.createDataFrame([(datetime.datetime(2024, 5, 6, 7, 8),)], "at timestamp")
    row = at.select(sinks.submission_name(F.col("at"), F.lit("some one")).alias("n"), subgraph.file_name(F.lit("le chat")).alias("f")).first()
    assert row.n == "07h08_06-05-24_automatic_submission_from_some_one.enrich" and row.f == "le_chat_subgraph.html"


def test_relation_docs_from_files(spark, tmp_path):
    (tmp_path / "docs.md").write_bytes("### Partie (`r_has_part`)\r\nUne pièce de l’œuvre.\r\n* chat | r_has_part | tête\r\n".encode("cp1252"))
    row = relation_docs.read_relation_docs(spark, f"{tmp_path}/docs.md").first()
    assert (row.code, row.display_name, row.description) == ("r_has_part", "Partie", "Une pièce de l’œuvre.") and row.examples[0].b == "tête"


def test_submission_file_decodes_names(spark):
    rows = [("avocat>1", "r_isa", "x", 0.9, "ok", "consolidated", "parce  que")]
    made = spark.createDataFrame(rows, "term string, relation string, target string, confidence double, validation_status string, consolidation_status string, consolidation_explanation string")
    names = spark.createDataFrame([("avocat>1", "avocat (fruit)")], "name string, decoded string")
    lines = [r.line for r in enrich.submission_file(made, "du graphe", names).orderBy("place").collect()]
    assert lines[0].endswith("1 triplet(s) consolidé(s) par inférence dans le réseau.") and lines[1].startswith("# Format") and lines[-1] == "avocat (fruit) | r_isa | x |  < parce que >"


def test_exclusions_mark_duplicates(spark):
    g = RuleGraph.stored(edges(spark, [("chat", "r_isa", "félin", 50.0), ("chien", "r_isa", "canidé", 20.0)]))
    asked = spark.createDataFrame([("chien", "r_isa", "félin", 0.8)], "term string, relation string, target string, confidence double")
    barred = spark.createDataFrame([("chien", "r_isa", "felin")], "term string, relation string, target string")
    assert enrich.validate(asked, g).first().validation_status == "ok"
    assert enrich.validate(asked, g, barred).first().validation_status == "duplicate"


def test_deeper_subgraph_and_visibility(spark):
    rows = [("a", "r_isa", "b", 9.0), ("b", "r_isa", "c", 8.0), ("c", "r_isa", "d", 7.0), ("d", "r_isa", "e", 6.0), ("a", "r_carac", "x", -5.0), ("x", "r_isa", "y", 4.0)]
    nodes, found = subgraph.extract(edges(spark, rows), spark.createDataFrame([("a",)], "root string"), depth=4)
    assert {(r.label, r.depth) for r in nodes.collect()} == {("a", 0), ("b", 1), ("x", 1), ("c", 2), ("y", 2), ("d", 3), ("e", 4)}
    assert {r.label for r in subgraph.visible(nodes, found).collect()} == set("abcdex")
    assert {r.label for r in subgraph.visible(nodes, found, least_degree=2).collect()} == set("abcdx")
    assert {r.label for r in subgraph.visible(nodes, found, show_negated=True).collect()} == set("abcdexy")


def test_claims_stream(spark, tmp_path):
    spark.createDataFrame([("chat", "r_isa", "félin", True), ("chat", "r_isa", "chien", True)], "subject string, relation string, object string, polarity boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("subject string, relation string, object string, polarity boolean").parquet(f"{tmp_path}/in")
    query = claim_stream.verify_stream(stream, edges(spark, [("chat", "r_isa", "félin", 50.0)]), f"{tmp_path}/out", f"{tmp_path}/check", effort=0)
    assert query.awaitTermination(120)
    assert {(r.object, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("félin", "supported"), ("chien", "unknown")}


def test_first_consolidations(spark, tmp_path):
    rows = [("a", "r", "b", datetime.datetime(2024, 1, 1)), ("a", "r", "b", datetime.datetime(2024, 1, 1, 1)), ("c", "r", "d", datetime.datetime(2024, 1, 1))]
    form = "term string, relation string, target string, at timestamp"
    spark.createDataFrame(rows, form).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = claim_stream.first_consolidations(spark.readStream.schema(form).parquet(f"{tmp_path}/in"), "at")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r.term for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "c"]


def test_storage_needs_a_shared_folder_off_one_machine(spark):
    class Context:
        master = "spark://somewhere:7077"
        applicationId = "app"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            @staticmethod
                            def isDefined():
                                return False

                        return O

                return S

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    assert storage.shared_dir(spark)
