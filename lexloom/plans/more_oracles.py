"""DuckDB SQL of the queries on single terms, files, registries and verdict texts."""

from __future__ import annotations

from lexloom import schema
from lexloom.operators.inference import CASCADE, CASCADE_2
from lexloom.operators.lookup import NAMED
from lexloom.plans import oracles as o
from lexloom.sources import derived

#: Proposals as they arrive for the listed triplets of each subject: order, index, category, justification. Some indices do not exist.
RAW_PROPOSALS = """
SELECT subject, 1 AS at, index, CASE WHEN w > 45 THEN 'constitutif' WHEN w > 10 THEN 'non_specifique' WHEN w > 5 THEN 'nonsense' ELSE 'exception' END AS category, 'une  partie | de ' || target AS justification FROM {listed}
UNION ALL SELECT subject, 2, index, 'Contrastif', ' plutôt  ceci ' FROM {listed} WHERE index % 3 = 0
UNION ALL SELECT subject, 3, index + 100, 'exception', 'none' FROM {listed}
"""


_LINES = "lines AS (SELECT term, cons.relation, target, term || ' | ' || cons.relation || ' | ' || target || ' |  < ' || trim(regexp_replace(explanation, '\\s+', ' ', 'g')) || ' >' AS line FROM cons JOIN said ON subject = term AND said.relation = cons.relation AND object = target WHERE consolidation_status = 'consolidated')"


def _whole(w: str) -> str:
    return f"CAST(CAST(round_even({w}, 0) AS BIGINT) AS VARCHAR)"


def _gaps(relations: list[str]) -> str:
    """Gaps over ``k``, the 50 strongest triplets of every source and relation."""
    names = ", ".join(f"('{r}')" for r in relations)
    counts = f"SELECT t.term, r.relation, count(*) FILTER (WHERE k.w > 0) AS p, count(*) FILTER (WHERE k.w < 0) AS n FROM (SELECT DISTINCT src AS term FROM e) t CROSS JOIN (VALUES {names}) AS r(relation) LEFT JOIN k ON k.src = t.term AND k.rel = r.relation GROUP BY ALL"
    return f"gaps AS (SELECT term, relation, CASE WHEN p = 0 AND n > 0 THEN 'negative_filled' WHEN p = 0 THEN 'missing' ELSE 'low_coverage' END AS gap_type FROM ({counts}) WHERE p < 3)"


def _text(name: str) -> str:
    return schema.VERDICT_TEXTS[name].format(network="Le réseau").replace("'", "''")


def _pairs(table: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in table.items())


def _said(order: list[str]) -> str:
    """``said (subject, relation, object, explanation)``: the answers of a cascade in words, from the text of their proofs and the weights on the way."""
    steps = []
    for name, body in o._schemas().items():
        if name in order:
            steps.append(f"SELECT *, {order.index(name)} AS rank, '{name}' AS schema FROM ({_WAYS[name]})")
    chained = " UNION ALL ".join(steps)
    special = """WHEN a.schema = 'contradiction' THEN 'Non — un terme n''est pas l''antonyme de lui-même.'
    WHEN a.schema = 'tautology' THEN 'Oui — trivialement, « ' || subject || ' » entretient ' || relation || ' avec lui-même.'
    WHEN a.schema = 'prefix' THEN 'Oui — « ' || subject || ' » est un composé lexical préfixé par « ' || object || ' ».'"""
    return f"""{o._answers(order)},
phrases(rel, text) AS (VALUES {_pairs(schema.PHRASES)}), heads(head, denied) AS (VALUES {_pairs(schema.NEGATED_FIRST)}), names(schema, shown) AS (VALUES {_pairs(schema.SCHEMA_NAMES)}),
ways AS ({chained}),
way AS (SELECT w.subject, w.relation, w.object, i, source, rel, target, w.w FROM ways w JOIN answers a ON a.subject = w.subject AND a.relation = w.relation AND a.object = w.object AND a.schema = w.schema),
spoken AS (SELECT y.*, coalesce(p.text, 'est en relation (' || y.rel || ') avec') AS text FROM way y LEFT JOIN phrases p ON p.rel = y.rel),
chains AS (SELECT subject, relation, object, string_agg('« ' || source || ' » ' || CASE WHEN w < 0 THEN trim(coalesce(h.denied, 'ne ' || split_part(text, ' ', 1)) || ' pas ' || CASE WHEN contains(text, ' ') THEN substr(text, strpos(text, ' ') + 1) ELSE '' END) ELSE text END || ' « ' || target || ' »', ', et ' ORDER BY i) AS chain
  FROM spoken LEFT JOIN heads h ON h.head = split_part(text, ' ', 1) GROUP BY ALL),
said AS (SELECT a.subject, a.relation, a.object, CASE {special}
    ELSE CASE WHEN a.weight > 0 THEN 'Oui, déductible' ELSE 'Non, réfuté' END || ' (' || n.shown || CASE WHEN a.consensus > 1 THEN ', ' || a.consensus || ' chemins concordants' ELSE '' END || ') : ' || chain || '.' END AS explanation
  FROM answers a LEFT JOIN chains c USING (subject, relation, object) LEFT JOIN names n ON n.schema = a.schema)"""


def _ways() -> dict[str, str]:
    """Per schema the steps of each claim's proof: subject, relation, object, i, source, rel, target, w."""
    claim = "subject, relation, object"
    first = " QUALIFY row_number() OVER (PARTITION BY subject, relation, object ORDER BY {}) = 1"

    def steps(rows: str, *parts: tuple[str, str, str, str]) -> str:
        each = ", ".join(f"{{'i': {i}, 'source': {a}, 'rel': {r}, 'target': {b}, 'w': {w}}}" for i, (a, r, b, w) in enumerate(parts))
        return f"SELECT {claim}, step.i, step.source, step.rel, step.target, step.w FROM (SELECT {claim}, unnest([{each}]) AS step FROM ({rows}))"

    def hop(rel: str, k: int, rel2: str, where: str, order: str, more: str = "") -> str:
        return f"SELECT c.subject, c.relation, c.object, p.tgt, p.w AS w1, q.w AS w2{more} FROM c JOIN pos p ON p.a = c.s AND p.rel = {rel} AND p.turn <= {k} JOIN probe q ON q.a = p.b AND q.rel = {rel2} AND q.b = c.o WHERE {where}" + first.format(order)

    mids = "p.b <> c.s AND p.b <> c.o"
    none = f"SELECT {claim}, 0 AS i, '' AS source, '' AS rel, '' AS target, 0.0 AS w FROM c WHERE false"
    elim = f"""SELECT * FROM (SELECT c.subject, c.relation, c.object, p.tgt, p.w AS w1, q.w AS w2, 0 AS way, p.turn AS spot, '' AS inv FROM c JOIN pos p ON p.a = c.s AND p.rel = 'r_isa' AND p.turn <= 25 JOIN probe q ON q.a = p.b AND q.rel = c.relation AND q.b = c.o WHERE p.b <> c.o AND q.w < 0
      UNION ALL SELECT c.subject, c.relation, c.object, x.tgt, p.w, x.w, 1, x.id, inv.r FROM c JOIN inv ON inv.rel = c.relation JOIN n x ON x.a = c.o AND x.rel = inv.r AND x.w < 0 JOIN pos p ON p.a = c.s AND p.rel = 'r_isa' AND p.turn <= 25 AND p.b = x.b WHERE p.b <> c.o)""" + first.format("way, spot")
    ded = "SELECT * FROM (SELECT c.subject, c.relation, c.object, p.tgt, p.w AS w1, q.w AS w2, p.turn, count(*) FILTER (WHERE q.w < 0) OVER (PARTITION BY subject, relation, object) AS neg FROM c JOIN gen p ON p.a = c.s AND p.turn <= 8 JOIN probe q ON q.a = p.b AND q.rel = c.relation AND q.b = c.o WHERE p.b <> c.o AND q.w <> 0) WHERE neg = 0 OR w2 < 0" + first.format("abs(w2) DESC, turn")
    return {
        "contradiction": none, "tautology": none, "prefix": none,
        "inverse": steps("SELECT c.*, inv.r, q.w FROM c JOIN inv ON inv.rel = c.relation JOIN probe q ON q.a = c.o AND q.rel = inv.r AND q.b = c.s WHERE q.w <> 0", ("object", "r", "subject", "w")),
        "implication": steps(f"SELECT c.*, m.r, q.w FROM c JOIN (VALUES {o._pairs(schema.IMPLIED_BY)}) AS m(rel, i, r) ON m.rel = c.relation JOIN probe q ON q.a = c.s AND q.rel = m.r AND q.b = c.o WHERE q.w > 0" + first.format("m.i"), ("subject", "r", "object", "w")),
        "isa_incompatible": steps(hop("'r_isa'", 25, "'r_isa-incompatible'", "c.relation = 'r_isa' AND NOT contains(p.tgt, '>') AND q.w > 0", "p.turn"), ("subject", "'r_isa'", "tgt", "w1"), ("tgt", "'r_isa-incompatible'", "object", "w2")),
        "class_elimination": steps(elim, ("subject", "'r_isa'", "tgt", "w1"), ("CASE way WHEN 0 THEN tgt ELSE object END", "CASE way WHEN 0 THEN relation ELSE inv END", "CASE way WHEN 0 THEN object ELSE tgt END", "w2")),
        "antonym_contrast": steps("SELECT c.subject, c.relation, c.object, p.tgt, p.w AS w1, x.w AS w2 FROM c JOIN pos p ON p.a = c.s AND p.rel = c.relation AND p.turn <= 8 JOIN n x ON x.a = c.o AND x.rel = 'r_anto' AND x.w > 0 AND x.b = p.b WHERE c.relation IN ('r_carac', 'r_has_prop') AND p.b <> c.o" + first.format("x.id"), ("subject", "relation", "tgt", "w1"), ("object", "'r_anto'", "tgt", "w2")),
        "deduction_isa": steps(ded, ("subject", "'r_isa'", "tgt", "w1"), ("tgt", "relation", "object", "w2")),
        "transitivity": steps(hop("c.relation", 8, "c.relation", f"c.relation IN ({o._list(schema.TRANSITIVE)}) AND {mids} AND q.w > 0", "q.w DESC, p.turn"), ("subject", "relation", "tgt", "w1"), ("tgt", "relation", "object", "w2")),
        "geo_propagation": steps(hop("'r_lieu'", 8, "'r_holo'", f"c.relation = 'r_lieu' AND {mids} AND q.w > 0", "p.turn"), ("subject", "'r_lieu'", "tgt", "w1"), ("tgt", "'r_holo'", "object", "w2")),
        "hyponym_propagation": steps(hop("c.relation", 8, "'r_isa'", f"{mids} AND q.w > 0", "p.turn"), ("subject", "relation", "tgt", "w1"), ("tgt", "'r_isa'", "object", "w2")),
        "cohyponym": steps("SELECT c.subject, c.relation, c.object, p.tgt, p.w AS w1, q.w AS w2 FROM c JOIN pos p ON p.a = c.s AND p.rel = 'r_isa' AND p.turn <= 8 JOIN pos q ON q.a = c.o AND q.rel = 'r_isa' AND q.turn <= 8 AND q.b = p.b WHERE c.relation = 'r_isa'" + first.format("p.b"), ("subject", "'r_isa'", "tgt", "w1"), ("object", "'r_isa'", "tgt", "w2")),
        "composition": steps(f"SELECT c.subject, c.relation, c.object, m.r1, m.r2, p.tgt, p.w AS w1, q.w AS w2 FROM c JOIN (VALUES {o._pairs(schema.COMPOSED_OF)}) AS m(rel, i, r1, r2) ON m.rel = c.relation JOIN pos p ON p.a = c.s AND p.rel = m.r1 AND p.turn <= 8 JOIN probe q ON q.a = p.b AND q.rel = m.r2 AND q.b = c.o WHERE {mids} AND q.w > 0" + first.format("m.i, p.turn"), ("subject", "r1", "tgt", "w1"), ("tgt", "r2", "object", "w2")),
    }


_WAYS = _ways()


def on_derived_graph() -> dict[str, str]:
    g, c = f"WITH {o._graph()} ", f"WITH {o._claims()}"
    both = f"{c}, {o._answers(CASCADE)}, {o._VALID}, {o._CONSOLIDATED}"
    known = "(SELECT src FROM e UNION SELECT tgt FROM e)"
    named = [f"SELECT *, '{name}' AS lookup FROM ({o._top(f"rel = '{rel}'", k)})" for name, (rel, k) in NAMED.items()]
    degrees = "nodes AS (SELECT name, count(*) AS w FROM (SELECT src AS name FROM e UNION ALL SELECT tgt FROM e) GROUP BY name)"

    def by_node(order: str, rel: str, least: int, limit: int) -> str:
        first = f"SELECT *, row_number() OVER (PARTITION BY src ORDER BY id) AS place FROM e WHERE rel = '{rel}' AND w >= {least}"
        return f"WITH {o._graph()}, {degrees} SELECT src AS source, tgt AS target, node_w, row_number() OVER (PARTITION BY src ORDER BY {order}) AS turn FROM (SELECT k.src, k.tgt, k.place, m.w AS node_w FROM ({first}) k JOIN nodes m ON m.name = k.tgt WHERE k.place <= {limit})"

    return {
        "subgraph_visible": f"""WITH {o._subgraph(2)},
deg AS (SELECT root, label, count(*) AS n FROM (SELECT root, source AS label FROM sg_edges UNION ALL SELECT root, target FROM sg_edges) GROUP BY ALL),
able AS (SELECT s.root, s.label, s.depth FROM sg_nodes s LEFT JOIN deg d USING (root, label) WHERE s.depth = 0 OR coalesce(d.n, 0) >= 1),
ends AS (SELECT root, source AS label, target AS other FROM sg_edges WHERE NOT from_negation UNION SELECT root, target, source FROM sg_edges WHERE NOT from_negation),
linked AS (SELECT DISTINCT x.root, x.label FROM ends x JOIN able b ON b.root = x.root AND b.label = x.other)
SELECT a.root, a.label FROM able a LEFT JOIN linked l USING (root, label) WHERE a.depth = 0 OR l.label IS NOT NULL""",
        "named_lookups": g + " UNION ALL ".join(named),
        "lookup_between_missing": f"""{c}, asked AS (SELECT DISTINCT subject AS a, upper(object) AS b FROM claims),
ends AS (SELECT a, b, CASE WHEN a NOT IN {known} THEN a WHEN b NOT IN {known} THEN b END AS missing FROM asked)
SELECT src AS source, rel AS relation, tgt AS target, w, row_number() OVER (PARTITION BY src, tgt ORDER BY w DESC, id) AS turn, CAST(NULL AS VARCHAR) AS missing FROM e SEMI JOIN ends ON src = a AND tgt = b AND missing IS NULL
UNION ALL SELECT a, NULL, b, NULL, 1, missing FROM ends WHERE missing IS NOT NULL""",
        "existing_for_enrichment": f"{c}, asked AS (SELECT DISTINCT subject, relation FROM claims) SELECT src AS term, rel AS relation, tgt AS target, w, {o._SIGN}, lower(trim(tgt)) AS excluded, turn FROM (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) AS turn FROM e) SEMI JOIN asked ON src = subject AND rel = relation",
        "gap_details": f"""WITH {o._graph()}, k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) <= 50),
found AS (SELECT t.term, r.relation, count(*) FILTER (WHERE k.w > 0) AS p, count(*) FILTER (WHERE k.w < 0) AS n FROM (SELECT DISTINCT src AS term FROM e) t CROSS JOIN (VALUES ('r_carac'), ('r_lieu'), ('r_make')) AS r(relation) LEFT JOIN k ON k.src = t.term AND k.rel = r.relation GROUP BY ALL),
worst AS (SELECT src, rel, string_agg(tgt || ' (w=' || {_whole("w")} || ')', '; ' ORDER BY turn) AS line FROM (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY w, id) AS turn FROM e WHERE w < 0) WHERE turn <= 3 GROUP BY ALL)
SELECT term, relation, CASE WHEN p = 0 AND n > 0 THEN 'negative_filled' WHEN p = 0 THEN 'missing' ELSE 'low_coverage' END AS gap_type,
  CASE WHEN p = 0 AND n > 0 THEN 'le graphe contient ' || n || ' triplet(s) NÉGATIFS pour `' || term || ' | ' || relation || ' | ?` : ' || line || '. Pas un gap au sens strict — déjà rempli avec des assertions négatives.'
    WHEN p = 0 THEN 'Aucun triplet positif `' || term || ' | ' || relation || ' | ?` dans le graphe.'
    ELSE 'Seulement ' || p || ' triplet(s) positif(s) `' || term || ' | ' || relation || ' | ?`.' END AS detail
FROM found LEFT JOIN worst ON src = term AND rel = relation WHERE p < 3""",
        "indicative_evidence": f"{c}, asked AS (SELECT DISTINCT s, relation FROM c) SELECT a AS s, rel AS relation, string_agg(tgt || ':' || {_whole('w')}, ',' ORDER BY turn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY a, rel ORDER BY abs(w) DESC, id) AS turn FROM n SEMI JOIN asked ON a = s AND rel = relation) WHERE turn <= 5 GROUP BY ALL HAVING count(*) >= 5",
        "verdict_texts": f"""{c} SELECT subject, relation, object, CASE
  WHEN relation NOT IN ({o._list(o.RELATIONS)}) THEN 'Relation inconnue dans Le réseau : ''' || relation || '''.'
  WHEN d.w IS NOT NULL THEN 'Le réseau contient directement le triplet `' || subject || ' | ' || relation || ' | ' || d.tgt || '` avec poids ' || {_whole("d.w")} || ' (' || CASE WHEN d.w > 0 THEN 'affirmation' ELSE 'négation' END || ' consensuelle).'
  WHEN h.n >= 5 THEN 'Le réseau ne contient pas le triplet `' || subject || ' | ' || relation || ' | ' || object || '`. Les valeurs connues pour `' || subject || ' | ' || relation || ' | ?` sont listées dans `evidence_against` à titre indicatif (ne constituent pas une contradiction stricte).'
  ELSE 'Le réseau ne contient pas d''information vérifiable pour `' || subject || ' | ' || relation || ' | ' || object || '`.' END AS explanation
FROM claims JOIN c USING (subject, relation, object) LEFT JOIN (SELECT a, rel, b, arg_min(w, id) AS w, arg_min(tgt, id) AS tgt FROM n GROUP BY ALL) d ON d.a = c.s AND d.rel = relation AND d.b = c.o
LEFT JOIN (SELECT a, rel, count(*) AS n FROM n GROUP BY ALL) h ON h.a = c.s AND h.rel = relation""",
        "verdict_texts_inferred": f"""{c}, {_said(CASCADE)} SELECT c.subject, c.relation, c.object, CASE
  WHEN c.relation NOT IN ({o._list(o.RELATIONS)}) THEN 'Relation inconnue dans Le réseau : ''' || c.relation || '''.'
  WHEN a.weight IS NOT NULL THEN CASE WHEN d.w IS NOT NULL THEN '{_text("forced")}' ELSE '{_text("inferred")}' END || s.explanation
  WHEN d.w IS NOT NULL THEN 'Le réseau contient directement le triplet `' || c.subject || ' | ' || c.relation || ' | ' || d.tgt || '` avec poids ' || {_whole("d.w")} || ' (' || CASE WHEN d.w > 0 THEN 'affirmation' ELSE 'négation' END || ' consensuelle).'
  WHEN h.n >= 5 THEN 'Le réseau ne contient pas le triplet `' || c.subject || ' | ' || c.relation || ' | ' || c.object || '`. Les valeurs connues pour `' || c.subject || ' | ' || c.relation || ' | ?` sont listées dans `evidence_against` à titre indicatif (ne constituent pas une contradiction stricte).'
  ELSE 'Le réseau ne contient pas d''information vérifiable pour `' || c.subject || ' | ' || c.relation || ' | ' || c.object || '`.' END AS explanation
FROM c LEFT JOIN answers a USING (subject, relation, object) LEFT JOIN said s USING (subject, relation, object)
LEFT JOIN (SELECT a, rel, b, arg_min(w, id) AS w, arg_min(tgt, id) AS tgt FROM n GROUP BY ALL) d ON d.a = c.s AND d.rel = c.relation AND d.b = c.o
LEFT JOIN (SELECT a, rel, count(*) AS n FROM n GROUP BY ALL) h ON h.a = c.s AND h.rel = c.relation""",
        "ready_candidates": f"{both} SELECT term, relation, target, coalesce(validation_status = 'ok' AND consolidation_status = 'consolidated', false) AS ready_for_submission FROM cons",
        "proven_triplets": f"{both}, good AS (SELECT DISTINCT lower(term) AS kt, relation AS kr, lower(target) AS ko FROM cons WHERE consolidation_status = 'consolidated') SELECT DISTINCT upper(term) AS term, relation, upper(target) AS target FROM cons SEMI JOIN good ON kt = lower(term) AND kr = relation AND ko = lower(target)",
        "registry_merge": f"{both} SELECT relation, count(*) AS n FROM (SELECT DISTINCT lower(term), relation, lower(target) FROM cons WHERE consolidation_status = 'consolidated') GROUP BY relation",
        "explanations": f"{c}, {_said(CASCADE_2)} SELECT k.subject, k.relation, k.object, coalesce(explanation, '') AS explanation FROM claims k LEFT JOIN said USING (subject, relation, object)",
        "submission_lines": f"{c}, {_said(CASCADE)}, {o._VALID}, {o._CONSOLIDATED}, {_LINES} SELECT term, relation, target, line FROM lines",
        "submission_file": f"""{c}, {_said(CASCADE)}, {o._VALID}, {o._CONSOLIDATED}, {_LINES}
SELECT CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS spot, '# Soumission du graphe — ' || count(*) || ' triplet(s) consolidé(s) par inférence dans le réseau.' AS line FROM lines
UNION ALL SELECT 0, 1, '# Format : terme | relation | cible | annotation < explication >' UNION ALL SELECT 0, 2, ''
UNION ALL SELECT 1, 0, line FROM lines""",
        "submission_file_size": f"{both} SELECT part, count(*) AS n FROM (SELECT CAST(0 AS BIGINT) AS part FROM range(3) UNION ALL SELECT 1 FROM cons WHERE consolidation_status = 'consolidated') GROUP BY part",
        "enrich_chain": f"{both}, k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) <= 50), {_gaps(['r_carac', 'r_lieu', 'r_make'])} SELECT c.term, c.relation, c.target, g.gap_type, c.confidence, c.validation_status, c.consolidation_status FROM cons c JOIN gaps g ON g.term = c.term AND g.relation = c.relation",
        "gaps_of_usual_relations": f"{g}, k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) <= 50), {_gaps(sorted({*schema.NOUN_GAPS, *schema.VERB_GAPS}))} SELECT relation, gap_type, count(*) AS n FROM gaps GROUP BY ALL",
        "claim_lines": f"{c} SELECT DISTINCT string_split(subject, ' ')[1] || ' ' || relation || ' | ' || object AS line, string_split(subject, ' ')[1] AS subject, relation, object FROM claims",
        "synonyms_by_node_weight": by_node("node_w DESC, place", "r_syn", 25, 30),
        "hypernyms_in_order": by_node("place", "r_isa", 0, 2),
    }


def on_senses() -> dict[str, str]:
    fx = f"WITH {o._senses()}"
    value = "value || ' (w=' || CAST(CAST(round_even(w, 0) AS BIGINT) AS VARCHAR) || ')'"
    said = f"said AS (SELECT rel_id, string_agg(kind || ':' || value || ':' || CAST(CAST(round_even(w, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY abs(w) DESC, id) AS line, string_agg({value}, ' ; ' ORDER BY abs(w) DESC, id) AS shown FROM notes GROUP BY rel_id)"
    spelled = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in schema.CATEGORIES.items()) + ") AS k(spelling, canon)"
    props = f"""existing AS (SELECT rel_id, canon FROM notes JOIN {spelled} ON lower(trim(value)) = spelling QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY abs(w) DESC, id) = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) AS turn FROM g WHERE rel IN ({o._list(schema.ANNOTATED)})) WHERE turn <= 8),
listed AS (SELECT t.id, t.src AS subject, t.rel AS relation, t.tgt_decoded AS target, t.w, x.canon AS existing, row_number() OVER (PARTITION BY t.src ORDER BY t.id) AS index FROM top t LEFT JOIN existing x ON x.rel_id = t.id),
last AS (SELECT * FROM ({RAW_PROPOSALS.format(listed="listed")}) QUALIFY row_number() OVER (PARTITION BY subject, index ORDER BY "at" DESC) = 1),
props AS (SELECT l.id, subject, relation, target, existing, canon AS category, trim(coalesce(r.justification, '')) AS justification, coalesce(existing <> '' AND existing <> canon, false) AS differs
  FROM listed l LEFT JOIN last r USING (subject, index) LEFT JOIN {spelled} ON lower(trim(r.category)) = spelling)"""
    counts = "count(*) FILTER (WHERE category IS NOT NULL AND NOT differs) AS n_annotated, count(*) FILTER (WHERE category IS NOT NULL AND differs) AS n_differing, count(*) FILTER (WHERE category IS NULL) AS n_skipped"
    return {
        "lookup_term": f"{fx} SELECT n.name AS term, n.id, s.label AS decoded, CAST(n.type AS BIGINT) AS type, CAST(n.w AS DOUBLE) AS weight, false AS unknown FROM nodes n JOIN shown s ON s.id = n.id UNION ALL SELECT 'no ' || c_name, NULL, NULL, NULL, NULL, true FROM customer",
        "node_by_id": f"{fx} SELECT id, name, CAST(w AS DOUBLE) AS w FROM nodes WHERE id IN (SELECT node2 FROM edges WHERE type = 1)",
        "lookup_target_id": f"""{fx}, wide AS (SELECT g.*, k.type AS tgt_type, e.node2 AS tgt_id FROM g JOIN edges e ON e.id = g.id JOIN nodes k ON k.id = e.node2)
SELECT src AS source, rel AS relation, tgt_decoded AS target, CAST(w AS DOUBLE) AS w, {o._SIGN}, CASE WHEN tgt <> tgt_decoded THEN tgt_id END AS target_id, turn
FROM (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY abs(w) DESC, id) AS turn FROM wide WHERE tgt_type <> 8) WHERE turn <= 3""",
        "triplet_annotations": f"""{fx}, {said}, asked AS (SELECT DISTINCT src AS subject, rel AS relation, upper(tgt_decoded) AS target FROM g UNION SELECT src, rel, 'rien' FROM g WHERE rel = 'r_isa'),
hit AS (SELECT subject, relation, target, min(g.id) AS id FROM asked JOIN g ON g.src = subject AND g.rel = relation AND (lower(g.tgt) = lower(target) OR lower(g.tgt_decoded) = lower(target)) GROUP BY ALL)
SELECT a.subject, a.relation, a.target, coalesce(line, '') AS annotations, h.id IS NOT NULL AS found FROM asked a LEFT JOIN hit h USING (subject, relation, target) LEFT JOIN said ON rel_id = h.id""",
        "explore_annotated": f"{fx}, {said} SELECT src AS source, tgt_decoded AS target, round(w, 1) AS w, turn, coalesce(shown, '') AS annotations, CASE WHEN tgt <> tgt_decoded THEN tgt ELSE '' END AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, id) AS turn FROM g WHERE rel = 'r_isa') LEFT JOIN said ON rel_id = id WHERE turn <= 5",
        "proposals_by_index": f"{fx}, {props} SELECT id, subject, relation, target, existing, category, justification FROM props",
        "annotation_file_counts": f"{fx}, {props} SELECT {counts} FROM props",
        "annotation_file": f"""{fx}, {props}, n AS (SELECT {counts} FROM props)
SELECT CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS spot, '# Annotation graphe — ' || n_annotated || ' triplet(s) annoté(s) + ' || n_differing || ' signalement(s) (' || n_skipped || ' triplet(s) non annotable(s) — ignoré(s)).' AS line FROM n
UNION ALL SELECT 0, i, x FROM (VALUES (1, '# Section principale — format : sujet|relation|objet|annotation < justification >'), (2, '# Section SIGNALEMENT — format : sujet|relation|objet|graphe:<existant>|LLM:<proposé> < argument contre >'), (3, '')) AS t(i, x)
UNION ALL SELECT 2, i, x FROM n, (VALUES (0, ''), (1, '=====SIGNALEMENT====='), (2, '# Triplets dont l''annotation LLM diffère de celle déjà présente dans graphe.')) AS t(i, x) WHERE n_differing > 0
UNION ALL SELECT CASE WHEN differs THEN 3 ELSE 1 END, 0, replace(subject, '|', '/') || '|' || relation || '|' || replace(target, '|', '/') || CASE WHEN differs THEN '|graphe:' || existing || '|LLM:' ELSE '|' END || category || ' < ' || regexp_replace(justification, '\\s+', ' ', 'g') || ' >' FROM props WHERE category IS NOT NULL""",
        "verify_soft_senses": f"""{fx}, k AS ({derived.duckdb(derived.SOFT_CLAIMS)}), asked AS (SELECT soft FROM (SELECT subject AS soft FROM k UNION SELECT object FROM k) WHERE contains(soft, '>')), {o.RESOLVED},
top3 AS (SELECT rel_id, string_agg({value}, ', ' ORDER BY abs(w) DESC, id) AS line FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY abs(w) DESC, id) AS turn FROM notes) WHERE turn <= 3 GROUP BY rel_id),
exc AS (SELECT rel_id, string_agg(value, ', ' ORDER BY abs(w) DESC, id) AS line FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY abs(w) DESC, id) AS turn FROM notes WHERE kind = 'exception') WHERE turn <= 3 GROUP BY rel_id),
r AS (SELECT coalesce(x.name, subject) AS subject, relation, coalesce(y.name, object) AS object FROM k LEFT JOIN resolved x ON x.soft = subject LEFT JOIN resolved y ON y.soft = object),
hit AS (SELECT r.*, g.id, g.w, g.tgt_decoded FROM r LEFT JOIN g ON lower(g.src) = lower(r.subject) AND g.rel = r.relation AND lower(g.tgt) = lower(r.object))
SELECT subject, relation, object, CASE WHEN w IS NULL THEN 'unknown' WHEN w > 0 THEN 'supported' ELSE 'contradicted' END AS status, CAST(w AS DOUBLE) AS weight,
  CASE WHEN w IS NULL AND few.n >= 5 THEN 'Le graphe ne contient pas le triplet `' || subject || ' | ' || relation || ' | ' || object || '`. Les valeurs connues pour `' || subject || ' | ' || relation || ' | ?` sont listées dans `evidence_against` à titre indicatif (ne constituent pas une contradiction stricte).'
  WHEN w IS NULL THEN 'Le graphe ne contient pas d''information vérifiable pour `' || subject || ' | ' || relation || ' | ' || object || '`.' ELSE
  'Le graphe contient directement le triplet `' || subject || ' | ' || relation || ' | ' || tgt_decoded || '` avec poids ' || CAST(CAST(round_even(w, 0) AS BIGINT) AS VARCHAR) || ' (' || CASE WHEN w > 0 THEN 'affirmation' ELSE 'négation' END || ' consensuelle).'
  || coalesce(' Annotations Le graphe : ' || top3.line || '.', '') || coalesce(' Exception(s) annotée(s) : ' || exc.line || '.', '') END AS explanation
FROM hit LEFT JOIN top3 ON top3.rel_id = hit.id LEFT JOIN exc ON exc.rel_id = hit.id LEFT JOIN (SELECT lower(src) AS a, rel, count(*) AS n FROM g GROUP BY ALL) few ON few.a = lower(subject) AND few.rel = relation""",
    }


def build() -> dict[str, str]:
    return on_derived_graph() | on_senses()
