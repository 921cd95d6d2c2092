"""Graph queries against DuckDB on the smallest test tables, and text inputs."""

import os

import duckdb
import pytest

from lexloom.plans import budget_oracle, catalog, more_oracles
from lexloom.sources import sinks, text_files

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "events", "labels"]
CHOSEN = [*more_oracles.build(), *budget_oracle.build(), "subgraph_numbered_depth4", "subgraph_refined_depth4", "relation_docs_parsed", "relation_prefix", "synonym_equiv", "term_exists", "lookup_out_topk", "gaps_classify", "geo_propagation", "cohyponym", "decode_names", "disambiguate", "resolve_soft_sense", "annotations_for_edges", "annotation_disagreement", "sense_contamination", "duplicate_sense_signal"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    expected = con.sql(catalog.ORACLES[name])
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), expected.columns)


def test_claim_lines(spark):
    lines = spark.createDataFrame([("chat | r_isa | petit animal",), ("chat isa",), ("",)], "line string")
    got = [(r.subject, r.relation, r.object, r.error is None) for r in text_files.parse_claim_lines(lines).collect()]
    assert got == [("chat", "r_isa", "petit animal", True), (None, None, None, False), (None, None, None, False)]


def test_csv_rows(spark):
    df = spark.createDataFrame([("a", "r_isa", "b", 0.756)], "term string, relation string, target string, confidence double")
    row = sinks.csv_rows(df).first()
    assert row.confidence == "0.76" and row.rationale == ""
