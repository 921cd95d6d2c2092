"""DuckDB SQL of inference within a budget of look-ups."""

from __future__ import annotations

from lexloom import schema
from lexloom.operators.inference import CASCADE_2
from lexloom.plans import oracles as o

BUDGETS = [1, 5, 20]


def _asks() -> str:
    """All look-ups of all schemas: claim, rank, place, term, relation, sign that ends it."""
    carac, lieu, trans = "c.relation IN ('r_carac', 'r_has_prop')", "c.relation = 'r_lieu'", f"c.relation IN ({o._list(schema.TRANSITIVE)})"
    own = "c JOIN pos p ON p.a = c.s AND p.rel = c.relation AND p.turn <= 8"
    above = "c JOIN pos p ON p.a = c.s AND p.rel = 'r_isa' AND p.turn <= 25"
    mids = "p.b <> c.s AND p.b <> c.o"

    def ask(name: str, source: str, part: str, turn: str, term: str, rel: str, ends: int = 0, where: str = "true") -> str:
        return f"SELECT c.subject, c.relation, c.object, c.o, {CASCADE_2.index(name)} AS rank, ({part}) * 1000 + {turn} AS place, {term} AS term, {rel} AS asked, {ends} AS ends FROM {source} WHERE {where}"

    composed = f"c JOIN (VALUES {o._pairs(schema.COMPOSED_OF)}) AS m(rel, i, r1, r2) ON m.rel = c.relation"
    return " UNION ALL ".join(
        [
            ask("inverse", "c JOIN inv ON inv.rel = c.relation", "0", "0", "c.o", "inv.r"),
            ask("implication", f"c JOIN (VALUES {o._pairs(schema.IMPLIED_BY)}) AS m(rel, i, r) ON m.rel = c.relation", "0", "m.i", "c.s", "m.r", 1),
            ask("isa_incompatible", "c", "0", "0", "c.s", "'r_isa'", 0, "c.relation = 'r_isa'"),
            ask("isa_incompatible", above, "1", "p.turn", "p.b", "'r_isa-incompatible'", 1, "c.relation = 'r_isa' AND NOT contains(p.tgt, '>')"),
            ask("class_elimination", "c", "0", "0", "c.s", "'r_isa'"),
            ask("class_elimination", above, "1", "p.turn", "p.b", "c.relation", -1, "p.b <> c.o"),
            ask("class_elimination", "c JOIN inv ON inv.rel = c.relation", "2", "0", "c.o", "inv.r"),
            ask("antonym_contrast", "c", "0", "0", "c.s", "c.relation", 0, carac),
            ask("antonym_contrast", own, "1", "0", "c.o", "'r_anto'", 0, f"{carac} AND p.turn = 1"),
            ask("deduction_isa", "c", "0", "0", "c.s", "'r_isa'"),
            ask("deduction_isa", "c JOIN gen p ON p.a = c.s AND p.turn <= 8", "1", "p.turn", "p.b", "c.relation", 0, "p.b <> c.o"),
            ask("transitivity", "c", "0", "0", "c.s", "c.relation", 0, trans),
            ask("transitivity", own, "1", "p.turn", "p.b", "c.relation", 0, f"{trans} AND {mids}"),
            ask("geo_propagation", "c", "0", "0", "c.s", "c.relation", 0, lieu),
            ask("geo_propagation", own, "1", "p.turn", "p.b", "'r_holo'", 1, f"{lieu} AND {mids}"),
            ask("hyponym_propagation", "c", "0", "0", "c.s", "c.relation"),
            ask("hyponym_propagation", own, "1", "p.turn", "p.b", "'r_isa'", 1, mids),
            ask("cohyponym", "c", "0", "0", "c.s", "'r_isa'", 0, "c.relation = 'r_isa'"),
            ask("cohyponym", "c", "0", "1", "c.o", "'r_isa'", 0, "c.relation = 'r_isa'"),
            ask("composition", composed, "m.i", "0", "c.s", "m.r1"),
            ask("composition", f"{composed} JOIN pos p ON p.a = c.s AND p.rel = m.r1 AND p.turn <= 8", "m.i", "p.turn", "p.b", "m.r2", 1, mids),
        ]
    )


def build() -> dict[str, str]:
    ranks = ", ".join(f"('{n}', {i})" for i, n in enumerate(CASCADE_2))
    budgets = ", ".join(f"({b})" for b in BUDGETS)
    sql = f"""{"WITH " + o._claims()}, {o._answers(CASCADE_2)},
asks AS ({_asks()}),
made AS (SELECT k.*, coalesce(r.i, {len(CASCADE_2)}) AS until_rank FROM asks k LEFT JOIN answers a USING (subject, relation, object) LEFT JOIN (VALUES {ranks}) AS r(n, i) ON r.n = a.schema
  WHERE k.rank <= coalesce(r.i, {len(CASCADE_2)}) AND asked IN ({o._list(o.RELATIONS)})),
ending AS (SELECT subject, relation, object, min(place) AS stop FROM made m JOIN probe q ON q.a = m.term AND q.rel = m.asked AND q.b = m.o WHERE rank = until_rank AND ends <> 0 AND q.w * ends > 0 GROUP BY ALL),
cost AS (SELECT subject, relation, object, count(DISTINCT term || chr(0) || asked) AS needed FROM made LEFT JOIN ending USING (subject, relation, object) WHERE rank < until_rank OR stop IS NULL OR place <= stop GROUP BY ALL)
SELECT k.subject, k.relation, k.object, CAST(b.budget AS BIGINT) AS budget, CASE WHEN coalesce(needed, 0) <= budget THEN a.schema END AS schema,
  CASE WHEN coalesce(needed, 0) <= budget THEN coalesce(a.weight, 0.0) ELSE 0.0 END AS weight, CAST(least(coalesce(needed, 0), budget + 1) AS BIGINT) AS lookups_used
FROM claims k LEFT JOIN answers a USING (subject, relation, object) LEFT JOIN cost USING (subject, relation, object), (VALUES {budgets}) AS b(budget)"""
    return {"budgeted_inference": sql}
