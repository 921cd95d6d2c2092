"""DuckDB SQL of the graph queries."""

from __future__ import annotations

from lexloom import schema
from lexloom.operators.inference import CASCADE, CASCADE_2
from lexloom.sources import derived

RELATIONS = sorted({*schema.INVERSE, *schema.TRANSITIVE, *schema.PHRASES, "r_make", "r_isa-incompatible"})


def _graph() -> str:
    return f"e AS ({derived.duckdb(derived.edges_sql('duckdb'))})"


def _claims() -> str:
    inverse = ", ".join(f"('{a}', '{b}')" for a, b in schema.INVERSE.items())
    return f"""{_graph()},
claims AS ({derived.duckdb(derived.claims_sql())}),
n AS (SELECT id, lower(src) AS a, rel, lower(tgt) AS b, tgt, w FROM e),
probe AS (SELECT a, rel, b, arg_min(w, id) AS w FROM n GROUP BY a, rel, b),
pos AS (SELECT a, rel, b, tgt, w, row_number() OVER (PARTITION BY a, rel ORDER BY w DESC, id) AS turn FROM n WHERE w > 0),
gen AS (SELECT a, b, tgt, w, row_number() OVER (PARTITION BY a ORDER BY w DESC, id) AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY w DESC, id) AS k FROM n WHERE rel = 'r_isa' AND w > 0 AND a <> b) WHERE k = 1),
c AS (SELECT DISTINCT subject, relation, object, lower(subject) AS s, lower(object) AS o FROM claims),
inv(rel, r) AS (VALUES {inverse})"""


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _pairs(table: dict) -> str:
    return ", ".join(f"('{k}', {i}, '{x}')" if isinstance(x, str) else f"('{k}', {i}, '{x[0]}', '{x[1]}')" for k, v in table.items() for i, x in enumerate(v))


#: Per schema: select list and source of ``weight``, ``proof``, ``steps``, ``consensus`` and an order.
def _schemas() -> dict[str, str]:
    hop = "FROM c JOIN pos p ON p.a = c.s AND p.rel = {rel} AND p.turn <= {k} JOIN probe q ON q.a = p.b AND q.rel = {rel2} AND q.b = c.o WHERE {where}"
    two = "c.subject || ' ' || {r1} || ' ' || p.tgt || '; ' || p.tgt || ' ' || {r2} || ' ' || c.object"
    head = "SELECT subject, relation, object, "
    first = " QUALIFY row_number() OVER (PARTITION BY subject, relation, object ORDER BY {}) = 1"
    mids = "p.b <> c.s AND p.b <> c.o"
    return {
        "tautology": head + f"100.0 AS weight, '' AS proof, 0 AS steps, 1 AS consensus FROM c WHERE s = o AND relation IN ({_list(schema.REFLEXIVE)})",
        "contradiction": head + "-100.0 AS weight, '' AS proof, 0 AS steps, 1 AS consensus FROM c WHERE s = o AND relation = 'r_anto'",
        "prefix": head + "30.0 AS weight, '' AS proof, 0 AS steps, 1 AS consensus FROM c WHERE s <> o AND o <> '' AND relation IN ('r_isa', 'r_associated') AND starts_with(s || ' ', o || ' ')",
        "inverse": head + "q.w AS weight, c.object || ' ' || inv.r || ' ' || c.subject AS proof, 1 AS steps, 1 AS consensus FROM c JOIN inv ON inv.rel = c.relation JOIN probe q ON q.a = c.o AND q.rel = inv.r AND q.b = c.s WHERE q.w <> 0",
        "implication": head + f"q.w AS weight, c.subject || ' ' || m.r || ' ' || c.object AS proof, 1 AS steps, 1 AS consensus FROM c JOIN (VALUES {_pairs(schema.IMPLIED_BY)}) AS m(rel, i, r) ON m.rel = c.relation JOIN probe q ON q.a = c.s AND q.rel = m.r AND q.b = c.o WHERE q.w > 0" + first.format("m.i"),
        "isa_incompatible": head + "-abs(q.w) AS weight, " + two.format(r1="'r_isa'", r2="'r_isa-incompatible'") + " AS proof, 2 AS steps, 1 AS consensus " + hop.format(rel="'r_isa'", k=25, rel2="'r_isa-incompatible'", where="c.relation = 'r_isa' AND NOT contains(p.tgt, '>') AND q.w > 0") + first.format("p.turn"),
        "class_elimination": "SELECT subject, relation, object, weight, proof, steps, consensus FROM ("
        + head
        + "q.w AS weight, "
        + two.format(r1="'r_isa'", r2="c.relation")
        + " AS proof, 2 AS steps, 1 AS consensus, 0 AS way, p.turn AS spot "
        + hop.format(rel="'r_isa'", k=25, rel2="c.relation", where="p.b <> c.o AND q.w < 0")
        + " UNION ALL "
        + head
        + "x.w AS weight, c.subject || ' r_isa ' || x.tgt || '; ' || c.object || ' ' || inv.r || ' ' || x.tgt AS proof, 2 AS steps, 1 AS consensus, 1 AS way, x.id AS spot FROM c JOIN inv ON inv.rel = c.relation JOIN n x ON x.a = c.o AND x.rel = inv.r AND x.w < 0 JOIN pos p ON p.a = c.s AND p.rel = 'r_isa' AND p.turn <= 25 AND p.b = x.b WHERE p.b <> c.o)"
        + first.format("way, spot"),
        "antonym_contrast": head + "-least(p.w, x.w) AS weight, c.subject || ' ' || c.relation || ' ' || p.tgt || '; ' || c.object || ' r_anto ' || p.tgt AS proof, 2 AS steps, 1 AS consensus FROM c JOIN pos p ON p.a = c.s AND p.rel = c.relation AND p.turn <= 8 JOIN n x ON x.a = c.o AND x.rel = 'r_anto' AND x.w > 0 AND x.b = p.b WHERE c.relation IN ('r_carac', 'r_has_prop') AND p.b <> c.o" + first.format("x.id"),
        "deduction_isa": "SELECT subject, relation, object, weight, proof, steps, pool AS consensus FROM (SELECT *, count(*) OVER (PARTITION BY subject, relation, object) AS pool FROM ("
        + head
        + "q.w AS weight, "
        + two.format(r1="'r_isa'", r2="c.relation")
        + " AS proof, 2 AS steps, p.turn, count(*) FILTER (WHERE q.w < 0) OVER (PARTITION BY subject, relation, object) AS neg FROM c JOIN gen p ON p.a = c.s AND p.turn <= 8 JOIN probe q ON q.a = p.b AND q.rel = c.relation AND q.b = c.o WHERE p.b <> c.o AND q.w <> 0) WHERE neg = 0 OR weight < 0)"
        + first.format("abs(weight) DESC, turn"),
        "transitivity": head + "q.w AS weight, " + two.format(r1="c.relation", r2="c.relation") + " AS proof, 2 AS steps, count(*) OVER (PARTITION BY subject, relation, object) AS consensus " + hop.format(rel="c.relation", k=8, rel2="c.relation", where=f"c.relation IN ({_list(schema.TRANSITIVE)}) AND {mids} AND q.w > 0") + first.format("q.w DESC, p.turn"),
        "geo_propagation": head + "q.w AS weight, " + two.format(r1="'r_lieu'", r2="'r_holo'") + " AS proof, 2 AS steps, 1 AS consensus " + hop.format(rel="'r_lieu'", k=8, rel2="'r_holo'", where=f"c.relation = 'r_lieu' AND {mids} AND q.w > 0") + first.format("p.turn"),
        "hyponym_propagation": head + "least(p.w, q.w) AS weight, " + two.format(r1="c.relation", r2="'r_isa'") + " AS proof, 2 AS steps, 1 AS consensus " + hop.format(rel="c.relation", k=8, rel2="'r_isa'", where=f"{mids} AND q.w > 0") + first.format("p.turn"),
        "cohyponym": head + "-30.0 AS weight, c.subject || ' r_isa ' || p.tgt || '; ' || c.object || ' r_isa ' || p.tgt AS proof, 2 AS steps, 1 AS consensus FROM c JOIN pos p ON p.a = c.s AND p.rel = 'r_isa' AND p.turn <= 8 JOIN pos q ON q.a = c.o AND q.rel = 'r_isa' AND q.turn <= 8 AND q.b = p.b WHERE c.relation = 'r_isa' AND NOT EXISTS (SELECT 1 FROM pos z WHERE z.rel = 'r_isa' AND z.turn <= 8 AND ((z.a = c.s AND z.b = c.o) OR (z.a = c.o AND z.b = c.s)))" + first.format("p.b"),
        "composition": head + "q.w AS weight, " + two.format(r1="m.r1", r2="m.r2") + f" AS proof, 2 AS steps, 1 AS consensus FROM c JOIN (VALUES {_pairs(schema.COMPOSED_OF)}) AS m(rel, i, r1, r2) ON m.rel = c.relation JOIN pos p ON p.a = c.s AND p.rel = m.r1 AND p.turn <= 8 JOIN probe q ON q.a = p.b AND q.rel = m.r2 AND q.b = c.o WHERE {mids} AND q.w > 0" + first.format("m.i, p.turn"),
        "synonym_equiv": head + f"q.w AS weight, c.object || ' r_syn ' || p.tgt || '; ' || c.subject || ' ' || c.relation || ' ' || p.tgt AS proof, 2 AS steps, 1 AS consensus FROM c JOIN pos p ON p.a = c.o AND p.rel = 'r_syn' AND p.turn <= 8 JOIN probe q ON q.a = c.s AND q.rel = c.relation AND q.b = p.b WHERE {mids} AND q.w <> 0" + first.format("p.turn"),
        "target_generic": head + "q.w AS weight, c.subject || ' ' || c.relation || ' ' || p.tgt || '; ' || c.object || ' r_isa ' || p.tgt AS proof, 2 AS steps, 1 AS consensus FROM c JOIN gen p ON p.a = c.o AND p.turn <= 8 JOIN probe q ON q.a = c.s AND q.rel = c.relation AND q.b = p.b WHERE p.b <> c.s AND q.w <> 0" + first.format("p.turn"),
        "double_isa": head + "q.w AS weight, c.subject || ' r_isa ' || x.tgt || '; ' || x.tgt || ' ' || c.relation || ' ' || y.tgt || '; ' || c.object || ' r_isa ' || y.tgt AS proof, 3 AS steps, 1 AS consensus FROM c JOIN gen x ON x.a = c.s AND x.turn <= 5 JOIN gen y ON y.a = c.o AND y.turn <= 5 JOIN probe q ON q.a = x.b AND q.rel = c.relation AND q.b = y.b WHERE x.b <> y.b AND q.w <> 0" + first.format("x.turn, y.turn"),
    }


def _scored(name: str, body: str) -> str:
    factor = schema.SOUNDNESS[name]
    return f"SELECT subject, relation, object, '{name}' AS schema, CAST(weight AS DOUBLE) AS weight, round(least(1.0, tanh(abs(weight) / 100) * pow(0.9, greatest(0, steps - 1)) * {factor} * least(1.30, 1.0 + 0.12 * greatest(0, consensus - 1))), 3) AS confidence, CAST(consensus AS BIGINT) AS consensus, proof FROM ({body})"


def _answers(order: list[str]) -> str:
    bodies = _schemas()
    parts = " UNION ALL ".join(f"SELECT *, {i} AS rank FROM ({_scored(n, bodies[n])})" for i, n in enumerate(order))
    return f"answers AS (SELECT * FROM ({parts}) QUALIFY row_number() OVER (PARTITION BY subject, relation, object ORDER BY rank) = 1)"


_CASCADE = "SELECT k.subject, k.relation, k.object, a.schema, coalesce(a.weight, 0.0) AS weight, coalesce(a.confidence, 0.0) AS confidence, CAST(coalesce(a.consensus, 0) AS BIGINT) AS consensus, coalesce(a.proof, '') AS proof FROM claims k LEFT JOIN answers a USING (subject, relation, object)"


def _verify(order: list[str], effort: int, bypass: bool) -> str:
    by_rule = "a.weight IS NOT NULL" + ("" if bypass else " AND d.w IS NULL") if effort else "false"
    return f"""v AS (
  SELECT k.subject, k.relation, k.object, length(k.subject) % 2 = 0 AS polarity, d.w AS direct, a.weight AS inferred, a.confidence AS sure, a.schema AS how, h.n,
    CASE WHEN k.relation NOT IN ({_list(RELATIONS)}) THEN 'unknown' WHEN {by_rule} THEN 'rule' WHEN d.w IS NOT NULL THEN 'direct' WHEN h.n >= 5 THEN 'hint' ELSE 'unknown' END AS way
  FROM claims k JOIN c USING (subject, relation, object) LEFT JOIN probe d ON d.a = c.s AND d.rel = c.relation AND d.b = c.o
  LEFT JOIN answers a USING (subject, relation, object) LEFT JOIN (SELECT a, rel, count(*) AS n FROM n GROUP BY a, rel) h ON h.a = c.s AND h.rel = c.relation),
verdicts AS (
  SELECT subject, relation, object, polarity, CASE WHEN w IS NULL THEN 'unknown' WHEN (w > 0) = polarity THEN 'supported' ELSE 'contradicted' END AS status,
    CASE way WHEN 'rule' THEN sure WHEN 'direct' THEN round(tanh(abs(direct) / 100), 3) WHEN 'hint' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence,
    CASE WHEN way = 'rule' THEN how END AS schema, w AS weight
  FROM (SELECT *, CASE way WHEN 'rule' THEN inferred WHEN 'direct' THEN direct END AS w FROM v))"""


_VALID = """valid AS (
  SELECT k.subject AS term, k.relation, k.object AS target,
    CASE WHEN x.b IS NULL THEN 'unknown_term' WHEN d.w > 0 THEN 'duplicate' WHEN d.w IS NOT NULL THEN 'inconsistent' ELSE 'ok' END AS validation_status,
    CAST(CASE WHEN x.b IS NOT NULL AND d.w <= 0 THEN 0.1 ELSE 0.8 END AS DOUBLE) AS confidence
  FROM claims k JOIN c USING (subject, relation, object) LEFT JOIN (SELECT a AS b FROM n UNION SELECT b FROM n) x ON x.b = c.o
  LEFT JOIN probe d ON d.a = c.s AND d.rel = c.relation AND d.b = c.o)"""

_CONSOLIDATED = """cons AS (
  SELECT v.term, v.relation, v.target, v.validation_status,
    CASE WHEN validation_status <> 'ok' THEN NULL WHEN a.weight > 0 THEN 'consolidated' WHEN a.weight < 0 THEN 'rejected' ELSE 'not_consolidated' END AS consolidation_status,
    CASE WHEN validation_status = 'ok' THEN a.schema END AS consolidation_schema,
    CASE WHEN validation_status = 'ok' AND a.weight < 0 THEN least(v.confidence, 0.1) ELSE v.confidence END AS confidence, a.weight, a.consensus, a.proof, a.schema
  FROM valid v LEFT JOIN answers a ON a.subject = v.term AND a.relation = v.relation AND a.object = v.target)"""


def _subgraph(depth: int) -> str:
    def level(d: int) -> str:
        names = schema.SUBGRAPH_RELATIONS[d]
        position = "CASE rel " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(names, 1)) + " END"
        return f"SELECT src, rel, tgt, w, {position} AS pos, row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) AS turn FROM e WHERE rel IN ({_list(names)})"

    def hits(d: int) -> str:
        layer = f"l{d - 1}"
        return f"""h{d} AS (SELECT l.root, t.src AS source, t.tgt AS target, t.rel AS relation, t.w, {d} AS depth, l.negated AS from_negation, l.place || printf('%02d.%09d/', CAST(t.pos AS INT), CAST(t.turn AS INT)) AS place
  FROM {layer} l JOIN ({level(d)}) t ON t.src = l.label AND t.turn <= 3 WHERE t.tgt = l.root OR t.tgt <> t.src),
l{d} AS (SELECT root, target AS label, {d} AS depth, relation AS kind, place, w < 0 AS negated FROM (
  SELECT h.*, row_number() OVER (PARTITION BY root, target ORDER BY place) AS k FROM h{d} h WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT root, label FROM l{i}' for i in range(d))}) x WHERE x.root = h.root AND x.label = h.target)) WHERE k = 1)"""

    roots = "l0 AS (SELECT DISTINCT src AS root, src AS label, 0 AS depth, 'root' AS kind, '' AS place, false AS negated FROM e WHERE rel IN ('r_hypo', 'r_make', 'r_lieu'))"
    edges = " UNION ALL ".join(f"SELECT * FROM h{d}" for d in range(1, depth + 1))
    nodes = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1))
    return f"{_graph()}, {roots}, {', '.join(hits(d) for d in range(1, depth + 1))}, sg_edges AS ({edges}), sg_nodes AS ({nodes})"


def _numbered_subgraph(depth: int, expand_refined: bool) -> str:
    """Numbered edges over the graph with senses."""
    asked = "name" if expand_refined else "label"

    def hits(d: int) -> str:
        names = schema.SUBGRAPH_RELATIONS[d]
        position = "CASE rel " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(names, 1)) + " END"
        near = f"SELECT *, {position} AS pos, row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) AS turn FROM wide WHERE rel IN ({_list(names)}) AND tgt_type <> 8"
        return f"""h{d} AS (SELECT * FROM (SELECT l.root, l.label AS source, CASE WHEN t.tgt = l.root THEN l.root ELSE t.tgt_decoded END AS target, t.rel AS relation, t.w, {d} AS depth, l.place || printf('%02d.%09d/', CAST(t.pos AS INT), CAST(t.turn AS INT)) AS place, t.tgt AS name
  FROM l{d - 1} l JOIN ({near}) t ON t.src = l.{asked} AND t.turn <= 3) WHERE target = root OR target <> source),
l{d} AS (SELECT root, target AS label, {d} AS depth, place, name FROM (
  SELECT h.*, row_number() OVER (PARTITION BY root, target ORDER BY place) AS k FROM h{d} h WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT root, label FROM l{i}' for i in range(d))}) x WHERE x.root = h.root AND x.label = h.target)) WHERE k = 1)"""

    layers = ", ".join(hits(d) for d in range(1, depth + 1))
    nodes = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1))
    edges = " UNION ALL ".join(f"SELECT * FROM h{d}" for d in range(1, depth + 1))
    return f"""WITH {_senses()}, wide AS (SELECT g.*, k.type AS tgt_type FROM g JOIN edges e ON e.id = g.id JOIN nodes k ON k.id = e.node2),
l0 AS (SELECT DISTINCT src AS root, src AS label, 0 AS depth, '' AS place, src AS name FROM g WHERE rel IN ('r_isa', 'r_raff_sem', 'r_carac')), {layers},
ids AS (SELECT root, label, CASE WHEN depth = 0 THEN 'ROOT' ELSE 'N' || CAST(row_number() OVER (PARTITION BY root ORDER BY depth, place) - 1 AS VARCHAR) END AS node FROM ({nodes}))
SELECT e.root, e.source, e.target, e.relation, CAST(e.w AS DOUBLE) AS w, CAST(e.depth AS BIGINT) AS depth, a.node AS from_node, b.node AS to_node
FROM ({edges}) e JOIN ids a ON a.root = e.root AND a.label = e.source JOIN ids b ON b.root = e.root AND b.label = e.target"""


_LABEL = "CASE WHEN w < 0 THEN 'NON ' ELSE '' END || relation || ' ' || CAST(CAST(round_even(w, 0) AS BIGINT) AS VARCHAR) AS label"
_SIGN = "CASE WHEN w < 0 THEN 'négation' ELSE 'affirmation' END AS polarity"


def _top(where: str, k: int, by: str = "src") -> str:
    return f"SELECT src AS source, rel AS relation, tgt AS target, w, {_SIGN}, turn FROM (SELECT *, row_number() OVER (PARTITION BY {by}, rel ORDER BY abs(w) DESC, id) AS turn FROM e WHERE {where}) WHERE turn <= {k}"


def _senses() -> str:
    """The graph with senses, from the tables as :mod:`lexloom.sources.derived` has it, and what is read off it."""
    made = {name: derived.duckdb(sql) for name, sql in derived.sense_sql("duckdb").items()}
    return f"""types AS ({made["types"]}), nodes AS ({made["nodes"]}), edges AS ({made["edges"]}),
parts AS (SELECT n.id, n.name, i, string_split(n.name, '>')[i] AS tok FROM nodes n, unnest(range(2, len(string_split(n.name, '>')) + 1)) AS t(i) WHERE contains(n.name, '>')),
labelled AS (SELECT p.id, p.name, i, CASE WHEN try_cast(tok AS BIGINT) IS NULL THEN tok ELSE coalesce(m.name, '<id:' || tok || '>') END AS txt, try_cast(tok AS BIGINT) IS NOT NULL AS num FROM parts p LEFT JOIN nodes m ON m.id = try_cast(tok AS BIGINT)),
dec AS (SELECT id, name, string_split(name, '>')[1] AS term, string_split(name, '>')[1] || ' (' || string_agg(txt, ', ' ORDER BY i) || ')' AS full_name, bool_or(num) AS any_num, list(txt ORDER BY i) AS path FROM labelled GROUP BY id, name),
shown AS (SELECT n.id, n.name, n.type, coalesce(CASE WHEN d.any_num THEN d.full_name END, n.name) AS label FROM nodes n LEFT JOIN dec d ON d.id = n.id),
g AS (SELECT e.id, s.name AS src, t.name AS rel, o.name AS tgt, o.label AS tgt_decoded, e.w FROM edges e JOIN shown s ON s.id = e.node1 JOIN shown o ON o.id = e.node2 JOIN types t ON t.id = e.type),
senses AS (SELECT d.term, d.id AS sense_id, d.name AS sense, d.full_name AS decoded, d.path, CAST(coalesce(l.w, n.w) AS DOUBLE) AS weight,
  row_number() OVER (PARTITION BY d.term ORDER BY coalesce(l.w, n.w) DESC, d.id) AS turn
  FROM dec d JOIN nodes n ON n.id = d.id LEFT JOIN (SELECT src, tgt, max(w) AS w FROM g WHERE rel = 'r_raff_sem' GROUP BY src, tgt) l ON l.src = d.term AND l.tgt = d.name),
notes AS (SELECT CAST(substr(a.name, 3) AS BIGINT) AS rel_id, CASE e.type WHEN 996 THEN 'context' WHEN 997 THEN 'exception' ELSE 'annotation' END AS kind, v.name AS value, e.w, e.id
  FROM edges e JOIN nodes a ON a.id = e.node1 AND regexp_full_match(a.name, ':r[0-9]+') JOIN nodes v ON v.id = e.node2 AND v.type = 1 WHERE e.type IN (996, 997, 998))"""


#: The sense of every ``asked`` soft reference, each tried with all senses of its term.
RESOLVED = """hinted AS (SELECT soft, trim(string_split(soft, '>')[1]) AS term, list_filter(list_transform(string_split(soft, '>')[2:], lambda x: lower(trim(x))), lambda x: x <> '') AS hints FROM asked),
tried AS (SELECT soft, sense, turn, len(list_filter(hints, lambda h: len(list_filter(path, lambda p: contains(lower(p), h) OR contains(h, lower(p)))) > 0 OR contains(lower(decoded), h))) AS score FROM hinted JOIN senses USING (term)),
resolved AS (SELECT h.soft, CASE WHEN len(hints) = 0 THEN h.term WHEN len(list_filter(hints, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 THEN h.soft ELSE b.sense END AS name
  FROM hinted h LEFT JOIN (SELECT soft, sense FROM tried WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY soft ORDER BY score DESC, turn) = 1) b ON b.soft = h.soft)"""


def build() -> dict[str, str]:
    g, c = f"WITH {_graph()} ", f"WITH {_claims()}"
    plain = "SELECT id, src, rel, tgt, w FROM e"
    gaps = "gaps AS (SELECT term, relation, CASE WHEN p = 0 AND n > 0 THEN 'negative_filled' WHEN p = 0 THEN 'missing' ELSE 'low_coverage' END AS gap_type, CAST(CASE WHEN p = 0 AND n > 0 THEN 0.3 WHEN p = 0 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS severity, p AS n_pos, n AS n_neg FROM (SELECT t.term, r.relation, count(*) FILTER (WHERE k.w > 0) AS p, count(*) FILTER (WHERE k.w < 0) AS n FROM (SELECT DISTINCT src AS term FROM e) t, (VALUES ('r_carac'), ('r_lieu'), ('r_make')) AS r(relation) LEFT JOIN (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) <= 50) k ON k.src = t.term AND k.rel = r.relation GROUP BY t.term, r.relation) WHERE p < 3)"
    fx = f"WITH {_senses()} "
    out = {
        "lookup_out_topk": g + _top("true", 3),
        "lookup_in_topk": g + _top("rel = 'r_isa'", 5, "tgt"),
        "lookup_between": c + "SELECT src AS source, rel AS relation, tgt AS target, w, row_number() OVER (PARTITION BY src, tgt ORDER BY w DESC, id) AS turn FROM e SEMI JOIN claims ON src = subject AND tgt = object",
        "lookup_by_type": g + plain + " WHERE rel = 'r_make'",
        "filter_weight_range": g + plain + " WHERE w BETWEEN -20 AND 20",
        "filter_types_in": g + plain + " WHERE rel IN ('r_lieu', 'r_holo')",
        "filter_types_not_in": g + plain + " WHERE rel NOT IN ('r_carac', 'r_make')",
        "lookup_page": g + plain + " ORDER BY abs(w) DESC, id LIMIT 25 OFFSET 40",
        "named_hypernyms": g + _top("rel = 'r_isa'", 20),
        "named_characteristics": g + _top("rel = 'r_carac' AND w >= 10", 30),
        "explore_by_signed_weight": g + "SELECT src AS source, tgt AS target, round(w, 1) AS w, turn FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, id) AS turn FROM e WHERE rel = 'r_carac') WHERE turn <= 2",
        "polarity_split": g + f"SELECT rel, {_SIGN}, count(*) AS n FROM e GROUP BY ALL",
        "relation_prefix": g + "SELECT CAST(row_number() OVER (ORDER BY rel) AS INT) AS id, rel AS name, 'used ' || CAST(n AS VARCHAR) || ' times' AS help FROM (SELECT rel, count(*) AS n FROM e GROUP BY rel) QUALIFY starts_with(rel, 'r_has')",
        "relation_docs_parsed": g
        + """, top AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY abs(w) DESC, id) AS turn FROM e)
SELECT rel AS code, 'About ' || rel || ' : It has ' || count(*) || ' triplets.' AS summary, string_agg(src || ' ' || rel || ' ' || tgt, ' ; ' ORDER BY turn) FILTER (WHERE turn <= 3) AS examples FROM top GROUP BY rel""",
        "term_exists": c + "SELECT term, term IN (SELECT src FROM e UNION SELECT tgt FROM e) AS known FROM (SELECT DISTINCT object AS term FROM claims)",
        "exclusion_anti_join": c + "SELECT * FROM (SELECT DISTINCT subject AS term, relation, upper(object) AS target FROM claims) k WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = term AND rel = relation AND lower(tgt) = lower(target))",
        "distinct_targets": g + "SELECT DISTINCT src AS term, lower(trim(tgt)) AS target FROM e WHERE rel = 'r_lieu'",
        "stats_by_relation": g + "SELECT rel AS relation, count(*) AS n_total, count(*) FILTER (WHERE w > 0) AS n_pos, count(*) FILTER (WHERE w < 0) AS n_neg, max(w) AS max_w, min(w) AS min_w, round(avg(w), 4) AS mean_w FROM e GROUP BY rel",
        "stats_by_target_top20": g + "SELECT tgt AS target, count(*) AS occurrences, count(DISTINCT rel) AS relations, round(sum(w), 4) AS total_w, max(w) AS max_w FROM e GROUP BY tgt ORDER BY occurrences DESC, total_w DESC, target LIMIT 20",
        "degree": g + "SELECT term, count(*) AS degree FROM (SELECT src AS term FROM e UNION ALL SELECT tgt FROM e) GROUP BY term",
        "gaps_classify": f"WITH {_graph()}, {gaps} SELECT * FROM gaps",
        "gap_counts": f"WITH {_graph()}, {gaps} SELECT gap_type, count(*) AS n FROM gaps GROUP BY gap_type",
    }
    for name, body in _schemas().items():
        out[name] = f"{c} {_scored(name, body)}"
    out["cascade_effort1"] = f"{c}, {_answers(CASCADE)} {_CASCADE}"
    out["cascade_effort2"] = f"{c}, {_answers(CASCADE_2)} {_CASCADE}"
    verdicts = "SELECT * FROM verdicts"
    out["verify_effort0"] = f"{c}, {_answers(CASCADE[:1])}, {_verify(CASCADE, 0, False)} {verdicts}"
    out["verify_effort1"] = f"{c}, {_answers(CASCADE)}, {_verify(CASCADE, 1, False)} {verdicts}"
    out["verify_bypass"] = f"{c}, {_answers(CASCADE)}, {_verify(CASCADE, 1, True)} {verdicts}"
    out["verdict_summary"] = f"{c}, {_answers(CASCADE)}, {_verify(CASCADE, 1, False)} SELECT count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'contradicted') AS contradicted, count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) AS total FROM verdicts"
    out["validate_candidates"] = f"{c}, {_VALID} SELECT * FROM valid"
    both = f"{c}, {_answers(CASCADE)}, {_VALID}, {_CONSOLIDATED}"
    out["consolidate_candidates"] = f"{both} SELECT term, relation, target, confidence, validation_status, consolidation_status, consolidation_schema FROM cons"
    out["candidate_counts"] = f"{both} SELECT validation_status, consolidation_status, count(*) AS n FROM cons GROUP BY ALL"
    out["decode_names"] = fx + "SELECT id, name, CASE WHEN any_num THEN full_name ELSE name END AS decoded, array_to_string(path, '/') AS path FROM dec"
    out["disambiguate"] = fx + "SELECT term, sense_id, decoded, weight, turn FROM senses"
    out["resolve_soft_sense"] = f"WITH {_senses()}, asked AS ({derived.duckdb(derived.SOFT)}), {RESOLVED} SELECT soft, name FROM resolved"
    out["annotations_for_edges"] = fx + "SELECT rel_id, string_agg(kind || ':' || value || ':' || CAST(CAST(round_even(w, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY abs(w) DESC, id) AS annotations FROM notes GROUP BY rel_id"
    known = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in schema.CATEGORIES.items()) + ") AS k(spelling, canon)"
    out["annotation_disagreement"] = (
        fx
        + f"SELECT id, subject, relation, target, existing, category, coalesce(existing <> '' AND existing <> category, false) AS disagrees FROM (SELECT g.id, g.src AS subject, g.rel AS relation, g.tgt_decoded AS target, x.canon AS existing, CASE WHEN g.w > 20 THEN 'non spécifique' ELSE 'exception' END AS category FROM (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) AS turn FROM g WHERE rel IN ({_list(schema.ANNOTATED)})) g LEFT JOIN (SELECT rel_id, canon FROM notes JOIN {known} ON lower(trim(value)) = spelling QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY abs(w) DESC, id) = 1) x ON x.rel_id = g.id WHERE g.turn <= 8)"
    )
    held = "held AS (SELECT DISTINCT s.term, s.sense, s.turn, g.rel, g.tgt FROM senses s JOIN g ON g.src = s.sense)"
    out["sense_contamination"] = f"WITH {_senses()}, {held} SELECT DISTINCT h.term, h.rel, h.tgt, h.sense FROM held h JOIN g ON g.src = h.term AND g.rel = h.rel AND g.tgt = h.tgt WHERE h.turn > 1 AND NOT EXISTS (SELECT 1 FROM held f WHERE f.turn = 1 AND f.term = h.term AND f.rel = h.rel AND f.tgt = h.tgt)"
    out["duplicate_sense_signal"] = f"WITH {_senses()}, {held} SELECT term, rel, tgt, count(*) AS n_senses FROM held GROUP BY ALL HAVING count(*) > 1"
    for depth in (3, 4):
        out[f"subgraph_numbered_depth{depth}"] = _numbered_subgraph(depth, False)
        out[f"subgraph_refined_depth{depth}"] = _numbered_subgraph(depth, True)
    out["subgraph_depth1"] = f"WITH {_subgraph(1)} SELECT root, source, target, relation, w, {_LABEL}, place FROM sg_edges"
    out["subgraph_depth2"] = f"WITH {_subgraph(2)} SELECT root, source, target, relation, w, {_LABEL}, place, from_negation FROM sg_edges"
    out["subgraph_nodes"] = f"WITH {_subgraph(2)} SELECT root, label, CAST(depth AS BIGINT) AS depth, kind, negated FROM sg_nodes"
    out["subgraph_stats"] = f"WITH {_subgraph(2)} SELECT n.root, n.n AS n_nodes, coalesce(e.n, 0) AS n_edges, coalesce(e.neg, 0) AS n_negative, coalesce(e.dark, 0) AS n_from_negation FROM (SELECT root, count(*) AS n FROM sg_nodes GROUP BY root) n LEFT JOIN (SELECT root, count(*) AS n, count(*) FILTER (WHERE w < 0) AS neg, count(*) FILTER (WHERE from_negation) AS dark FROM sg_edges GROUP BY root) e USING (root)"
    return out
