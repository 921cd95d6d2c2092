"""The stateful registry, the submission files, keyed and versioned tables."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from lexloom.operators.inference import RuleGraph
from lexloom.sources import keyed, submissions, versions
from lexloom.sources.graph import plain_triplets
from lexloom.sources.places import Place
from lexloom.streaming import registry

FORM = "at timestamp, term string, relation string, target string, consolidation_explanation string, consolidation_schema string"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_registry_survives_a_restart(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))

    def run(rows):
        spark.createDataFrame(rows, FORM).coalesce(1).write.mode("append").parquet(source)
        query = registry.register_stream(spark.readStream.schema(FORM).parquet(source), out, check)
        assert query.awaitTermination(180)

    run([(at(1), "Été", "r_isa", "saison", "première", "inverse"), (at(2), "ete", "r_isa ", "SAISON", " deuxième ", "prefix"), (at(3), "chat", "r_isa", "félin", None, None), (at(4), None, "r_isa", "x", "", "")])
    run([(at(9), "ETE", "R_ISA", "saison", "troisième", "inverse"), (at(8), "chien", "r_isa", "canidé", "un  mot", "inverse"), (at(7), "chien", "r_isa", "canide", "avant", "inverse")])
    now = {r.term: tuple(r)[1:] for r in registry.registry_now(spark, out).collect()}
    assert now == {"Été": ("r_isa", "saison", "troisième", "inverse", 3), "chat": ("r_isa", "félin", "", "", 1), "chien": ("r_isa", "canide", "un  mot", "inverse", 2)}
    counts = [tuple(r) for r in registry.running_count(spark, out).orderBy("batch").collect()]
    assert counts == [(0, 2, 2), (1, 1, 3)]
    lines = {(r.batch, r.line) for r in registry.registry_lines(spark, out).collect()}
    assert lines == {(0, "Été | r_isa | saison |  < deuxième >"), (0, "chat | r_isa | félin |  <  >"), (1, "chien | r_isa | canide |  < un mot >")}


def texts(spark, path):
    """The lines of a file, part after part."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("n")).collect()
    return [r.value for r in sorted(rows, key=lambda r: (r.part.rsplit("/", 1)[1], r.n))]


ITEM = "pos long, line string, term string, relation string, target string, annotation string, explanation string"


def test_raw_lines_keep_their_order_and_nothing_is_overwritten(spark, tmp_path):
    lines = [f"=== {i % 7} ===" for i in range(300)] + ["", "  spaces | kept "]
    items = spark.createDataFrame([(i, x, None, None, None, None, None) for i, x in enumerate(lines)] + [(0, None, "a", "r", "b", None, None), (0, None, "a", "", "b", None, None)], ITEM).repartition(5)
    path = f"{tmp_path}/deep/report.audit"
    first = submissions.write_submission(items, path)
    assert first == submissions.Written(path, "raw", 302, ignored_triplets=1, invalid=1) and texts(spark, path) == lines
    second = submissions.write_submission(items.limit(0).unionByName(spark.createDataFrame([(0, "x", None, None, None, None, None)], ITEM)), path)
    assert second.path == f"{tmp_path}/deep/report_2.audit" and texts(spark, path) == lines and texts(spark, second.path) == ["x"]
    assert submissions.write_submission(items, path).path == f"{tmp_path}/deep/report_3.audit"


def test_triplets_need_a_proof_in_an_enrich_file(spark, tmp_path):
    items = spark.createDataFrame([("Chat>1", "r_isa", "félin", "note", "mine"), ("chien", "r_isa", "canidé", None, "own words"), ("x", None, "y", None, None)], "term string, relation string, target string, annotation string, explanation string")
    proofs = spark.createDataFrame([("chat>1", "r_isa", "FELIN", "prouvé  par\nrègle"), ("chien", "r_isa", "loup", "other"), ("chien", "r_isa", "canide", "")], "term string, relation string, target string, consolidation_explanation string")
    names = spark.createDataFrame([("Chat>1", "Chat (animal)")], "name string, decoded string")
    path = f"{tmp_path}/a.enrich"
    got = submissions.write_submission(items, path, proofs, names)
    assert got == submissions.Written(path, "triplets", 1, invalid=1, unproven=1)
    assert texts(spark, path)[0].endswith("1 triplet(s) consolidé(s) par inférence dans le réseau.") and texts(spark, path)[-1] == "Chat (animal) | r_isa | félin | note < prouvé par règle >"
    assert submissions.write_submission(items, f"{tmp_path}/b.enrich") == submissions.Written(None, "triplets", 0, invalid=1, unproven=2)
    other = submissions.write_submission(items, f"{tmp_path}/c.stat", proofs)
    assert other.count == 2 and texts(spark, other.path)[-1] == "chien | r_isa | canidé |  < own words >"
    assert not (tmp_path / "b.enrich").exists()


def test_append_and_empty(spark, tmp_path):
    path = f"{tmp_path}/list.stat"
    rows = lambda *xs: spark.createDataFrame([(x, "r", "o") for x in xs], "term string, relation string, target string")
    nothing = submissions.write_submission(rows("a").limit(0), path)
    assert nothing == submissions.Written(None, "nothing", 0) and not (tmp_path / "list.stat").exists()
    assert [submissions.write_submission(rows(*x), path, append=True).path for x in (["a"], ["c", "b"], ["d"])] == [path] * 3
    assert [x for x in texts(spark, path) if x.endswith(">") and x[0] != "#"] == [f"{x} | r | o |  <  >" for x in "abcd"]
    assert sum(x.startswith("# Soumission") for x in texts(spark, path)) == 1
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []


def test_two_writers_get_two_files(spark, tmp_path):
    got = []
    run = lambda x: got.append(submissions.write_submission(spark.createDataFrame([(x,)], "line string"), f"{tmp_path}/same.err"))
    threads = [threading.Thread(target=run, args=(x,)) for x in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len({w.path for w in got}) == 3 and sorted(texts(spark, w.path)[0] for w in got) == ["a", "b", "c"]


def test_tables_are_written_once_and_expire(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/t")
    asked = lambda: spark.read.parquet(f"{tmp_path}/t").filter("id % 2 = 0")
    kept = keyed.Kept()
    one, two = kept.of(asked(), "x"), kept.of(asked(), "x")
    assert kept.writes == 1 and one.count() == two.count() == 25
    assert kept.of(asked().filter("id > 3"), "x").count() == 23 and kept.writes == 2
    assert kept.release(asked()) and not kept.release(asked())
    assert kept.of(asked(), "x", lifetime=0).count() == 25 and kept.writes == 3
    assert kept.of(asked(), "x").count() == 25 and kept.writes == 4  # the one before had expired
    [Place(spark, k.path).delete() for found in kept.tables.values() for k in found]
    assert kept.of(asked(), "x").count() == 25 and kept.writes == 5  # deleted by others


def test_rule_graphs_share_their_views(spark):
    edges = spark.createDataFrame([(1, "a", "r_isa", "b", 5.0)], "id long, src string, rel string, tgt string, w double")
    graph = plain_triplets(edges)
    before = keyed.KEPT.writes
    first = RuleGraph.stored(graph)
    assert keyed.KEPT.writes == before + 5
    again = RuleGraph.stored(graph)
    assert keyed.KEPT.writes == before + 5 and again.probe.sameSemantics(first.probe)
    assert first.release() == 5 and RuleGraph.stored(graph).edges.count() == 1 and keyed.KEPT.writes == before + 10


def test_keyed_tables_across_sessions(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    parts = {"method": "from", "term": "été", "limit": 3}
    base = str(tmp_path)
    assert keyed.key_of(parts) == keyed.key_of(dict(reversed(parts.items()))) != keyed.key_of(parts | {"limit": 4})
    assert [keyed.cached(spark, parts, build, base=base).count() for _ in range(3)] == [3, 3, 3] and len(built) == 1
    assert keyed.cached(spark, parts, build, lifetime=0, base=base).count() == 3 and len(built) == 2
    assert keyed.forget(spark, parts, base) and keyed.cached(spark, parts, build, base=base).count() == 3 and len(built) == 3


def test_a_rewrite_is_seen_whole_or_not(spark, tmp_path):
    path = f"{tmp_path}/registry"
    assert versions.rewrite(spark.range(10).withColumn("v", F.lit(1)), path, expected=0) == 1
    old = versions.read(spark, path)
    stop, seen = threading.Event(), set()

    def reader():
        while not stop.is_set():
            seen.add(tuple(sorted((r["v"], r["count"]) for r in versions.read(spark, path).groupBy("v").count().collect())))

    t = threading.Thread(target=reader)
    t.start()
    for v in (2, 3):
        grown = versions.read(spark, path).withColumn("v", F.lit(v)).unionByName(spark.range(10).withColumn("v", F.lit(v)))
        assert versions.rewrite(grown, path, keep=9) == v
    stop.set()
    t.join()
    assert seen <= {((1, 10),), ((2, 20),), ((3, 30),)}
    assert old.count() == 10 and versions.read(spark, path, 2).count() == 20 and versions.read(spark, path).count() == 30
    with pytest.raises(versions.Stale):
        versions.rewrite(spark.range(1).withColumn("v", F.lit(9)), path, expected=2)
    versions.rewrite(spark.range(1).withColumn("v", F.lit(4)), path, keep=1)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, 1)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"{tmp_path}/none")
