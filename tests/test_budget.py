"""Look-up budgets against a plain cascade that counts its look-ups."""

import random

import pytest

from lexloom import schema
from lexloom.operators import budget, verify
from lexloom.operators.inference import RuleGraph
from lexloom.sources.graph import plain_triplets


class Spent(Exception):
    pass


class Counter:
    """A graph that refuses the first look-up beyond its limit."""

    def __init__(self, edges, relations, limit):
        self.edges, self.relations, self.limit, self.seen = edges, relations, max(1, limit), {}
        self.used = 0

    def ask(self, term, relation):
        if relation not in self.relations:
            return []
        if (term, relation) not in self.seen:
            self.used += 1
            if self.used > self.limit:
                raise Spent
            self.seen[term, relation] = [(t, w) for s, r, t, w in self.edges if (s, r) == (term, relation)]
        return self.seen[term, relation]

    def weight(self, term, relation, target):
        return next((w for t, w in self.ask(term, relation) if t == target), 0)

    def best(self, term, relation, k=8):
        return sorted((x for x in self.ask(term, relation) if x[1] > 0), key=lambda x: -x[1])[:k]


def answer(g, s, r, o):
    """Name of the schema that answers, by the rules in words."""
    if s == o and r == "r_anto":
        return "contradiction"
    if s == o and r in schema.REFLEXIVE:
        return "tautology"
    inv = schema.INVERSE.get(r)
    if inv and g.weight(o, inv, s):
        return "inverse"
    for by in schema.IMPLIED_BY.get(r, []):
        if g.weight(s, by, o) > 0:
            return "implication"
    if r == "r_isa":
        for t, _ in g.best(s, "r_isa", 25):
            if g.weight(t, "r_isa-incompatible", o) > 0:
                return "isa_incompatible"
    above = g.best(s, "r_isa", 25)
    for t, _ in above:
        if t != o and g.weight(t, r, o) < 0:
            return "class_elimination"
    if inv:
        for t, w in g.ask(o, inv):
            if w < 0 and t != o and t in dict(above):
                return "class_elimination"
    if r in ("r_carac", "r_has_prop") and (have := dict(g.best(s, r))):
        if any(w > 0 and t in have and t != o for t, w in g.ask(o, "r_anto")):
            return "antonym_contrast"
    generics, seen = [], {s}
    for t, _ in g.best(s, "r_isa", 10**6):
        if t not in seen:
            seen.add(t)
            generics.append(t)
    if any([g.weight(t, r, o) for t in generics[:8] if t != o]):
        return "deduction_isa"
    mids = lambda: [t for t, _ in g.best(s, r) if t not in (s, o)]
    if r in schema.TRANSITIVE and any([g.weight(t, r, o) > 0 for t in mids()]):
        return "transitivity"
    if r == "r_lieu":
        for t in mids():
            if g.weight(t, "r_holo", o) > 0:
                return "geo_propagation"
    for t in mids():
        if g.weight(t, "r_isa", o) > 0:
            return "hyponym_propagation"
    if r == "r_isa":
        mine, other = dict(g.best(s, "r_isa")), dict(g.best(o, "r_isa"))
        if o not in mine and s not in other and set(mine) & set(other):
            return "cohyponym"
    for first, second in schema.COMPOSED_OF.get(r, []):
        for t, _ in g.best(s, first):
            if t not in (s, o) and g.weight(t, second, o) > 0:
                return "composition"
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_budgets_against_plain_python(spark, seed):
    rng = random.Random(seed)
    terms = [f"t{i}" for i in range(14)]
    relations = ["r_isa", "r_isa-incompatible", "r_carac", "r_anto", "r_lieu", "r_holo", "r_has_part", "r_agent-1", "r_make_use_of", "r_instr-1", "r_hypo", "r_odd"]
    known = [r for r in relations if r != "r_odd"]
    edges, weights = {}, iter(rng.sample(range(1, 5000), 700))
    for _ in range(220):
        key = (rng.choice(terms), rng.choice(known), rng.choice(terms))
        edges[key] = next(weights) * rng.choice([1, 1, 1, -1]) / 10  # no ties
    edges = [(*k, w) for k, w in edges.items()]
    graph = RuleGraph.stored(plain_triplets(spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "id long, src string, rel string, tgt string, w double")))
    asked = sorted({(rng.choice(terms), rng.choice([*relations, "r_never"]), rng.choice(terms)) for _ in range(160)})
    claims = spark.createDataFrame([*asked, ("t0", "r_isa", None)], "subject string, relation string, object string")
    from lexloom.sources.storage import store

    found = store(budget.infer_with_costs(graph, claims, 2, known), "costs")
    fired = set()
    for limit in (0, 1, 2, 3, 5, 8, 13, 20, 150):
        got = {(r.subject, r.relation, r.object): (r.schema, r.lookups_used) for r in budget.within(found, limit).collect()}
        assert got.pop(("t0", "r_isa", None)) == (None, 0)
        for claim in asked:
            g = Counter(edges, known, limit)
            try:
                said = answer(g, *claim)
            except Spent:
                said = None
            assert got[claim] == (said, g.used), (limit, claim)
            fired.add(said)
    assert len(fired) >= 8


def test_small_budget_is_silent_and_verdicts_follow(spark):
    edges = spark.createDataFrame([(1, "a", "r_isa", "b", 100.0), (2, "b", "r_carac", "z", 90.0)], "id long, src string, rel string, tgt string, w double")
    graph = RuleGraph.stored(plain_triplets(edges))
    claims = spark.createDataFrame([("a", "r_carac", "z", True)], "subject string, relation string, object string, polarity boolean")
    row = budget.infer_within(graph, claims, 1).first()
    assert row.schema is None and row.weight == 0 and row.lookups_used == 2
    assert budget.infer_within(graph, claims).first().schema == "deduction_isa"
    assert verify.verify(graph, claims, 1, budget=1).first().status == "unknown"
    assert verify.verify(graph, claims, 1, budget=70).first().status == "supported"
    none = claims.limit(0)
    assert budget.infer_within(graph, none, 5).count() == 0
