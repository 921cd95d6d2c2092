"""A triplet graph, claims, and a graph with word senses and annotations, derived from the test tables.

The statements run on Spark and on DuckDB alike, so that a query and its
counterpart start from the same rows.  Table names are in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.graph import plain_triplets

TABLES = ["region", "nation", "customer", "supplier", "part", "events", "labels"]

_RAW = """
SELECT p_name AS src, 'r_isa' AS rel, split_part(p_name, ' ', 2) AS tgt, CAST(count(*) AS DOUBLE) AS w FROM {part} GROUP BY p_name
UNION ALL SELECT c_name, 'r_isa', c_mktsegment, CAST(40 AS DOUBLE) FROM {customer}
UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), 'r_isa', CASE WHEN split_part(p_name, ' ', 2) IN ('bolt', 'gear', 'rod', 'plate') THEN 'component' ELSE 'article' END, CAST(80 AS DOUBLE) FROM {part}
UNION ALL SELECT DISTINCT c_mktsegment, 'r_isa', 'segment', CAST(90 AS DOUBLE) FROM {customer}
UNION ALL SELECT p_name, 'r_carac', split_part(p_name, ' ', 1), CAST(count(*) AS DOUBLE) FROM {part} GROUP BY p_name
UNION ALL SELECT c_name, 'r_carac', 'solvent', c_acctbal / 100 FROM {customer}
UNION ALL SELECT s_name, 'r_carac', 'solvent', s_acctbal / 100 FROM {supplier}
UNION ALL SELECT c_mktsegment, 'r_carac', 'solvent', round(avg(c_acctbal) / 100, 4) FROM {customer} GROUP BY c_mktsegment
UNION ALL SELECT 'doc' || CAST(doc_id AS STRING), 'r_carac', 'toxic', CAST(CASE WHEN toxic = 1 THEN 50 ELSE -50 END AS DOUBLE) FROM {labels}
UNION ALL SELECT p_brand, 'r_make', p_name, CAST(count(*) AS DOUBLE) FROM {part} GROUP BY p_brand, p_name
UNION ALL SELECT c_name, 'r_lieu', n_name, CAST(50 AS DOUBLE) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'r_lieu', n_name, CAST(50 AS DOUBLE) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'r_holo', r_name, CAST(100 AS DOUBLE) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'r_has_part', n_name, CAST(100 AS DOUBLE) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'r_lieu', 'earth', CAST(60 AS DOUBLE) FROM {region}
UNION ALL SELECT c_mktsegment, 'r_hypo', c_name, CAST(40 AS DOUBLE) FROM {customer}
UNION ALL SELECT 'user' || CAST(user_id AS STRING), 'r_agent-1', event_type, CAST(count(*) AS DOUBLE) FROM {events} GROUP BY user_id, event_type
UNION ALL SELECT event_type, 'r_agent', 'user' || CAST(user_id AS STRING), CAST(count(*) AS DOUBLE) FROM {events} GROUP BY user_id, event_type
UNION ALL SELECT 'supply', r, s_name, s_acctbal / 100 FROM {supplier}, (VALUES ('r_agent'), ('r_processus>agent')) AS t(r)
UNION ALL SELECT 'supply', r, p_name, CAST(count(*) AS DOUBLE) FROM {part}, (VALUES ('r_patient'), ('r_processus>patient')) AS t(r) GROUP BY r, p_name
UNION ALL SELECT 'supply', r, p_brand, CAST(count(*) AS DOUBLE) FROM {part}, (VALUES ('r_instr'), ('r_processus>instr')) AS t(r) GROUP BY r, p_brand
UNION ALL SELECT 'supply', 'r_manner', p_type, CAST(count(*) AS DOUBLE) FROM {part} GROUP BY p_type
UNION ALL SELECT p_name, 'r_patient-1', 'supply', CAST(count(*) AS DOUBLE) FROM {part} GROUP BY p_name
UNION ALL SELECT p_brand, 'r_instr-1', 'supply', CAST(count(*) AS DOUBLE) FROM {part} GROUP BY p_brand
UNION ALL SELECT p_name, 'r_telic_role', p_type, CAST(count(*) AS DOUBLE) FROM {part} GROUP BY p_name, p_type
UNION ALL SELECT p_type, 'r_domain-1', p_name, CAST(count(*) AS DOUBLE) FROM {part} GROUP BY p_name, p_type
UNION ALL SELECT c_mktsegment, 'r_has_conseq', n_name, CAST(count(*) AS DOUBLE) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name
UNION ALL SELECT src, rel, tgt, CAST(w AS DOUBLE) FROM (VALUES
  ('component', 'r_carac', 'edible', -60), ('article', 'r_carac', 'portable', 70), ('component', 'r_carac', 'shiny', 0),
  ('cold', 'r_anto', 'hot', 90), ('hot', 'r_anto', 'cold', 90), ('small', 'r_anto', 'large', 90), ('large', 'r_anto', 'small', 90),
  ('new', 'r_anto', 'old', 90), ('old', 'r_anto', 'new', 90), ('MACHINERY', 'r_isa-incompatible', 'HOUSEHOLD', 55),
  ('luxury', 'r_carac-1', 'BUILDING', -45), ('MACHINERY', 'r_carac', 'heavy', 30), ('segment', 'r_carac', 'heavy', 20),
  ('bolt', 'r_syn', 'screw', 70), ('screw', 'r_syn', 'bolt', 60), ('gear', 'r_isa', 'article', 80), ('AFRICA', 'r_carac', 'warm', 0)) AS t(src, rel, tgt, w)
"""

_ID = {"spark": "CAST(conv(substring(md5(src || '|' || rel || '|' || tgt), 1, 15), 16, 10) AS BIGINT)", "duckdb": "CAST('0x' || substr(md5(src || '|' || rel || '|' || tgt), 1, 15) AS BIGINT)"}

_CLAIMS = """
SELECT c_name AS subject, 'r_lieu' AS relation, r_name AS object FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION SELECT c_name, 'r_lieu', r_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON (n_regionkey + 1) % 5 = r_regionkey
UNION SELECT s_name, 'r_lieu', r_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION SELECT n_name, 'r_lieu', 'earth' FROM {nation}
UNION SELECT r_name, 'r_lieu-1', n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION SELECT c_mktsegment, 'r_hypo', c_name FROM {customer}
UNION SELECT c_name, 'r_isa', x FROM {customer}, (VALUES ('HOUSEHOLD'), ('segment'), ('article')) AS t(x)
UNION SELECT c_name, 'r_carac', x FROM {customer}, (VALUES ('solvent'), ('luxury'), ('heavy')) AS t(x)
UNION SELECT p_name, 'r_isa', x FROM {part}, (VALUES ('component'), ('article'), ('bolt'), ('screw'), ('hot'), ('large')) AS t(x)
UNION SELECT p_name, 'r_carac', x FROM {part}, (VALUES ('cold'), ('hot'), ('small'), ('large'), ('new'), ('old'), ('edible'), ('portable'), ('shiny')) AS t(x)
UNION SELECT p_name, 'r_isa', p_name FROM {part}
UNION SELECT p_name, 'r_anto', p_name FROM {part}
UNION SELECT p_brand, 'r_make', split_part(p_name, ' ', 2) FROM {part}
UNION SELECT split_part(p_name, ' ', 2), 'r_isa', x FROM {part}, (VALUES ('bolt'), ('gear'), ('rod'), ('widget'), ('article')) AS t(x)
"""


#: Ids of the relation types that the graph with senses uses.
SENSE_TYPES = {"r_raff_sem": 1, "r_isa": 6, "r_has_part": 9, "r_agent": 13, "r_lieu": 15, "r_carac": 17, "r_annotation_context": 996, "r_annotation_exception": 997, "r_annotation": 998}


def _number(text: str, dialect: str) -> str:
    """A positive number that stands for a text."""
    digest = f"substr(md5({text}), 1, 15)"
    return f"CAST(conv({digest}, 16, 10) AS BIGINT)" if dialect == "spark" else f"CAST('0x' || {digest} AS BIGINT)"


def _sense(dialect: str) -> str:
    """The sense of a market segment that a customer is, with two numeric parts."""
    part = lambda x: f"CAST({_number(x, dialect)} AS STRING)"
    return f"c_mktsegment || '>' || {part('c_name')} || '>' || {part('n_name')}"


def _told(dialect: str) -> str:
    """Named edges of the graph with senses, without its annotations."""
    sense, at_home = _sense(dialect), "{customer} JOIN {nation} ON c_nationkey = n_nationkey"
    noun, adjective, user = "split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 1)", "'user' || CAST(user_id AS STRING)"
    return f"""
SELECT c_mktsegment AS src, 'r_raff_sem' AS rel, {sense} AS tgt, c_acctbal / 100 AS w FROM {at_home}
UNION ALL SELECT {sense}, 'r_lieu', n_name, CAST(50 AS DOUBLE) FROM {at_home}
UNION ALL SELECT {sense}, 'r_carac', 'solvent', c_acctbal / 100 FROM {at_home}
UNION ALL SELECT c_name, 'r_isa', {sense}, CAST(40 AS DOUBLE) FROM {at_home}
UNION ALL SELECT c_mktsegment, 'r_lieu', n_name, CAST(count(*) AS DOUBLE) FROM {at_home} GROUP BY c_mktsegment, n_name
UNION ALL SELECT {noun}, 'r_raff_sem', {noun} || '>' || p_brand, CAST(count(*) AS DOUBLE) FROM {{part}} GROUP BY {noun}, p_brand
UNION ALL SELECT {noun} || '>' || p_brand, 'r_carac', {adjective}, CAST(count(*) AS DOUBLE) FROM {{part}} GROUP BY {noun}, p_brand, {adjective}
UNION ALL SELECT {noun} || '>' || p_brand, 'r_has_part', p_type, CAST(count(*) AS DOUBLE) FROM {{part}} GROUP BY {noun}, p_brand, p_type
UNION ALL SELECT {noun}, 'r_carac', {adjective}, CAST(count(*) AS DOUBLE) FROM {{part}} GROUP BY {noun}, {adjective}
UNION ALL SELECT {noun}, 'r_has_part', p_type, CAST(count(*) AS DOUBLE) FROM {{part}} GROUP BY {noun}, p_type
UNION ALL SELECT {noun}, 'r_carac', '_chunk ' || p_type, CAST(5 AS DOUBLE) FROM {{part}} GROUP BY {noun}, p_type
UNION ALL SELECT event_type, 'r_raff_sem', event_type || '>' || CAST({_number(user, dialect)} AS STRING), CAST(count(*) AS DOUBLE) FROM {{events}} GROUP BY event_type, user_id
UNION ALL SELECT event_type || '>' || CAST({_number(user, dialect)} AS STRING), 'r_agent', {user}, CAST(count(*) AS DOUBLE) FROM {{events}} GROUP BY event_type, user_id
UNION ALL SELECT event_type, 'r_agent', {user}, CAST(count(*) AS DOUBLE) FROM {{events}} GROUP BY event_type, user_id"""


def _notes(dialect: str) -> str:
    """Annotations of the customers' generic terms and of the parts' characters, and of edges that the graph has not."""
    of_edge = lambda src, rel, tgt: f"':r' || CAST({_number(f"{src} || '|' || {rel} || '|' || {tgt}", dialect)} AS STRING)"
    customer, noun = of_edge("c_name", "'r_isa'", _sense(dialect)), of_edge("src", "rel", "tgt")
    at_home = "{customer} JOIN {nation} ON c_nationkey = n_nationkey"
    return f"""
SELECT {customer} AS src, 'r_annotation' AS rel, CASE WHEN c_acctbal > 5000 THEN 'constitutif' WHEN c_acctbal < 1000 THEN 'Contrastif ' ELSE 'usual' END AS tgt, c_acctbal AS w FROM {at_home}
UNION ALL SELECT {customer}, 'r_annotation_context', n_name, CAST(5000 AS DOUBLE) FROM {at_home}
UNION ALL SELECT {customer}, 'r_annotation', '_chunk note', CAST(9000 AS DOUBLE) FROM {at_home}
UNION ALL SELECT {customer}, 'r_annotation_exception', 'exception', -c_acctbal FROM {at_home} WHERE c_acctbal < 0 OR c_acctbal > 9000
UNION ALL SELECT {noun}, 'r_annotation', 'non spécifique', w FROM ({_told(dialect)}) WHERE rel = 'r_carac' AND w > 3
UNION ALL SELECT ':r' || CAST(doc_id AS STRING), 'r_annotation', CASE WHEN quality = 1 THEN 'constitutif' ELSE 'contrastif' END, CAST(1 AS DOUBLE) FROM {{labels}}"""


def sense_sql(dialect: str) -> dict[str, str]:
    """Statements of the graph with senses: ``types``, ``edges``, ``nodes``."""
    rows = f"({_told(dialect)} UNION ALL {_notes(dialect)})"
    kinds = " ".join(f"WHEN '{name}' THEN {number}" for name, number in SENSE_TYPES.items())
    number = _number("src || '|' || rel || '|' || tgt", dialect)
    names = f"SELECT src AS name FROM {rows} UNION ALL SELECT tgt FROM {rows} UNION ALL SELECT n_name FROM {{nation}} UNION ALL SELECT DISTINCT event_type || '>999' FROM {{events}}"
    return {
        "types": "SELECT id, name, name AS help FROM (VALUES " + ", ".join(f"({number}, '{name}')" for name, number in SENSE_TYPES.items()) + ") AS t(id, name)",
        "edges": f"SELECT {number} AS id, {_number('src', dialect)} AS node1, {_number('tgt', dialect)} AS node2, CAST(CASE rel {kinds} END AS INT) AS type, CAST(w AS DOUBLE) AS w FROM {rows}",
        "nodes": f"SELECT {_number('name', dialect)} AS id, name, CAST(CASE WHEN name LIKE '!_chunk%' ESCAPE '!' THEN 8 WHEN name LIKE ':r%' THEN 3 ELSE 1 END AS INT) AS type, CAST(count(*) AS DOUBLE) AS w FROM ({names}) GROUP BY name",
    }


#: Soft references to senses as people write them, some of none.
SOFT = """
SELECT DISTINCT c_mktsegment || '>' || n_name AS soft FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION SELECT c_mktsegment || '>' || upper(c_name) || '>' || n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION SELECT c_mktsegment || '> the ' || lower(c_name) || ' of old' FROM {customer}
UNION SELECT c_mktsegment FROM {customer}
UNION SELECT c_mktsegment || '>87286' FROM {customer}
UNION SELECT c_mktsegment || '>nothing' FROM {customer}
UNION SELECT split_part(p_name, ' ', 2) || '>' || lower(p_brand) FROM {part}
UNION SELECT split_part(p_name, ' ', 2) || '>#1' FROM {part}
UNION SELECT event_type || '>user' || CAST(user_id AS STRING) FROM {events}
UNION SELECT n_name || '>x' FROM {nation}
"""

#: Claims about senses by soft references; some are wrong.
SOFT_CLAIMS = """
SELECT c_mktsegment || '>' || c_name AS subject, 'r_lieu' AS relation, n_name AS object FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION SELECT c_mktsegment || '>' || c_name, 'r_lieu', n_name FROM {customer} JOIN {nation} ON (c_nationkey + 1) % 25 = n_nationkey
UNION SELECT c_mktsegment || '>' || c_name, 'r_carac', 'solvent' FROM {customer}
UNION SELECT c_name, 'r_isa', c_mktsegment || '>' || c_name FROM {customer}
UNION SELECT split_part(p_name, ' ', 2) || '>' || lower(p_brand), 'r_carac', split_part(p_name, ' ', 1) FROM {part}
"""


def edges_sql(dialect: str) -> str:
    return f"SELECT {_ID[dialect]} AS id, src, rel, tgt, w FROM ({_RAW})"


def claims_sql() -> str:
    return _CLAIMS


def duckdb(statement: str) -> str:
    """The statement with DuckDB's own table names."""
    return statement.format(**{t: t for t in TABLES})


def _run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **frames)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived graph as triplets."""
    return plain_triplets(_run(spark, sf_dir, edges_sql("spark")))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that every schema of the cascade has something to say about."""
    return _run(spark, sf_dir, _CLAIMS)


def sense_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and relation types of the graph with word senses and annotations."""
    statements = sense_sql("spark")
    return tuple(_run(spark, sf_dir, statements[name]) for name in ("nodes", "edges", "types"))


def soft_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(soft)``: references to senses by hints."""
    return _run(spark, sf_dir, SOFT)


def soft_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose ends are soft references."""
    return _run(spark, sf_dir, SOFT_CLAIMS)
