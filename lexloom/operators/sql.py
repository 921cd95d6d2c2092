"""The operators from SQL: table functions over a graph, and views over tables that the user names.

``register`` makes the functions below in a session.  The look-ups take any
expression, so they can be joined laterally to a table of terms::

    SELECT t.term, x.* FROM terms t, LATERAL lex_hypernyms(t.term, 5) x
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import polarity
from lexloom.operators import subgraph, verify
from lexloom.operators.inference import RuleGraph
from lexloom.operators.lookup import NAMED
from lexloom.operators.stats import gaps
from lexloom.sources.storage import store

_ROW = "source STRING, relation STRING, target STRING, w DOUBLE, polarity STRING, turn INT"
_COLUMNS = "source, relation, target, w, polarity, turn"


class SqlGraph:
    """A graph whose operators are to be had by SQL; ``prefix`` begins the names of all that is registered."""

    def __init__(self, spark: SparkSession, graph: DataFrame, prefix: str = "lex", relations: list[str] | None = None) -> None:
        self.spark, self.prefix, self.relations = spark, prefix, relations
        self.rules = RuleGraph.stored(graph)
        self._views()
        self._functions()

    def _views(self) -> None:
        """Triplets with their turns among those of their source, and of their target, by relation."""
        out = self.rules.graph.filter(F.col("tgt_type") != schema.CHUNK_TYPE)
        shown = out.select(F.col("src").alias("source"), F.col("rel").alias("relation"), F.col("tgt_decoded").alias("target"), "w", polarity("w").alias("polarity"), "tgt", "id")
        view = f"{self.prefix}_triplets"
        shown.createOrReplaceTempView(view)
        for name, by in (("out", "source"), ("in", "tgt")):
            ranked = f"SELECT *, row_number() OVER (PARTITION BY {by}, relation ORDER BY abs(w) DESC, id) AS turn FROM {view}"
            store(self.spark.sql(ranked), f"sql-{name}").createOrReplaceTempView(f"{self.prefix}_ranked_{name}")

    def _function(self, name: str, arguments: str, returns: str, body: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.prefix}_{name}({arguments}) RETURNS TABLE ({returns}) RETURN {body}")

    def _functions(self) -> None:
        p = self.prefix
        self._function("edges", "term STRING, rel STRING, most INT", _ROW, f"SELECT {_COLUMNS} FROM {p}_ranked_out r WHERE r.source = term AND r.relation = rel AND r.turn <= most")
        self._function("incoming", "term STRING, rel STRING, most INT", _ROW, f"SELECT {_COLUMNS} FROM {p}_ranked_in r WHERE r.tgt = term AND r.relation = rel AND r.turn <= most")
        self._function("between", "one STRING, two STRING", "source STRING, relation STRING, target STRING, w DOUBLE", f"SELECT t.source, t.relation, t.target, t.w FROM {p}_triplets t WHERE t.source = one AND t.tgt = two")
        for name, (relation, most) in NAMED.items():
            self._function(name, f"term STRING, most INT DEFAULT {most}", _ROW, f"SELECT {_COLUMNS} FROM {p}_ranked_out r WHERE r.source = term AND r.relation = '{relation}' AND r.turn <= most")
        # Not by name, as a name may have any letters: the graph's own probe with normalised ends.
        self.rules.probe.createOrReplaceTempView(f"{p}_probe")
        key = lambda x: f"lower(regexp_replace({x}, '(?U)^\\\\s+|\\\\s+$', ''))"
        self._function("weight", "subject STRING, rel STRING, object STRING", "w DOUBLE", f"SELECT q.w FROM {p}_probe q WHERE q.a = {key('subject')} AND q.rel = weight.rel AND q.b = {key('object')}".replace("weight.rel", f"{p}_weight.rel"))

    def verdicts(self, claims: str, view: str, effort: int = 1, bypass: bool = False) -> DataFrame:
        """Register ``view``: the verdicts on the claims of the table or view ``claims`` (subject, relation, object and, if it has it, polarity)."""
        rows = self.spark.table(claims)
        rows = rows if "polarity" in rows.columns else rows.withColumn("polarity", F.lit(True))
        return self._named(verify.verify(self.rules, rows, effort, bypass, self.relations), view)

    def subgraphs(self, roots: str, nodes: str, edges: str, depth: int = 1, expand_refined: bool = False) -> tuple[DataFrame, DataFrame]:
        """Register the views ``nodes`` and ``edges``: the numbered subgraphs around the terms (a column ``root``) of ``roots``."""
        found = subgraph.numbered(*subgraph.extract(self.rules.graph, self.spark.table(roots).select("root").distinct(), depth, expand_refined=expand_refined))
        return self._named(found[0], nodes), self._named(found[1], edges)

    def gaps(self, terms: str, view: str, relations: list[str] | None = None) -> DataFrame:
        """Register ``view``: the gaps of the terms (a column ``term``) of ``terms``."""
        return self._named(gaps(self.spark.table(terms), self.rules.graph, relations), view)

    @staticmethod
    def _named(df: DataFrame, view: str) -> DataFrame:
        df.createOrReplaceTempView(view)
        return df
