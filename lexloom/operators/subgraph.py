"""Layered neighbourhoods of many roots at once, and their visible part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import slug, whole
from lexloom.sources.storage import store


def extract(graph: DataFrame, roots: DataFrame, depth: int = 1, top_k: int | dict[int, int] = 3, relations: dict[int, list[str]] | None = None, least: float | None = None, expand_refined: bool = False) -> tuple[DataFrame, DataFrame]:
    """``nodes (root, label, depth, kind, place, negated, name)`` and ``edges (root, source, target, relation, w, depth, from_negation, place, label)``.

    Each of at most four layers follows its relations, the ``top_k`` strongest
    triplets of a parent and relation, from the labels found first in the layer
    before.  A node is its label: it keeps its first discovery, in the order of
    parents, relations and weights.  An edge to the root adds no node; self
    loops elsewhere are dropped.  ``from_negation`` marks edges that leave a
    node first reached through a negative edge.  An edge's order is a path of
    numbers, so no task sees more than one root's layer.

    The next layer asks for triplets by a node's label, under which a word
    sense has none; with ``expand_refined`` by its own name, ``name``.  Every
    layer is stored, so a deeper one does not repeat those above.
    """
    depth = min(max(depth, 1), 4)
    relations = relations or schema.SUBGRAPH_RELATIONS
    known = roots.select("root", F.col("root").alias("label"), F.lit(0).alias("depth"), F.lit("root").alias("kind"), F.lit("").alias("place"), F.lit(False).alias("negated"), F.col("root").alias("name"))
    layer, all_edges = known, None
    for d in range(1, depth + 1):
        names, k = relations[d], max(1, top_k if isinstance(top_k, int) else top_k[d])
        near = graph.filter(F.col("rel").isin(names) & (F.col("tgt_type") != schema.CHUNK_TYPE))
        if least is not None:
            near = near.filter(F.abs("w") >= least)
        asked = F.col("name" if expand_refined else "label").alias("src")
        near = near.join(layer.select(asked).distinct(), "src", "left_semi")
        turn = F.row_number().over(Window.partitionBy("src", "rel").orderBy(F.abs("w").desc(), "id"))
        near = near.withColumn("turn", turn).filter(F.col("turn") <= k)
        position = F.array_position(F.array(*map(F.lit, names)), F.col("rel"))
        parents = layer.select("root", asked, F.col("label").alias("source"), F.col("place").alias("above"), F.col("negated").alias("from_negation"))
        place = F.concat("above", F.format_string("%02d.%09d/", position, "turn"))
        target = F.when(F.col("tgt") == F.col("root"), F.col("root")).otherwise(F.col("tgt_decoded"))  # a root is met by its raw name too
        hits = near.join(parents, "src").select("root", "source", target.alias("target"), F.col("rel").alias("relation"), "w", F.lit(d).alias("depth"), "from_negation", place.alias("place"), F.col("tgt").alias("name"))
        hits = store(hits.filter((F.col("target") == F.col("root")) | (F.col("target") != F.col("source"))), "subgraph-edges")
        edges = hits.drop("name")
        all_edges = edges if all_edges is None else all_edges.unionByName(edges)
        fresh = hits.join(known.select("root", F.col("label").alias("target")), ["root", "target"], "left_anti")
        first = fresh.groupBy("root", "target").agg(F.min_by(F.struct("relation", "w", "place", "name"), "place").alias("x"))
        layer = store(first.select("root", F.col("target").alias("label"), F.lit(d).alias("depth"), F.col("x.relation").alias("kind"), "x.place", (F.col("x.w") < 0).alias("negated"), "x.name"), "subgraph-layer")
        known = known.unionByName(layer)
    label = F.concat(F.when(F.col("w") < 0, "NON ").otherwise(""), "relation", F.lit(" "), whole("w"))
    return known, all_edges.withColumn("label", label)


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``node`` and ``edges`` with ``from_node`` and ``to_node``: ROOT, then N1, N2, ... of each root in the order of discovery.

    Numbers are the count of nodes found before: those of earlier branches (the
    first step of a node's place, by depth) from a sum over the branches of a
    root, of which there are few, and those before it in its own branch.
    """
    branch = ["root", "depth", "branch"]
    rows = nodes.withColumn("branch", F.substring_index("place", "/", 1))
    sizes = rows.filter("depth > 0").groupBy(*branch).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("root").orderBy("depth", "branch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*branch, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*branch).orderBy("place"))
    placed = rows.withColumn("inside", inside).join(starts, branch, "left")
    name = F.when(F.col("depth") == 0, "ROOT").otherwise(F.concat(F.lit("N"), (F.col("before") + F.col("inside")).cast("string")))
    out = placed.select(*nodes.columns, name.alias("node"))
    ends = lambda end, to: out.select("root", F.col("label").alias(end), F.col("node").alias(to))
    return out, edges.join(ends("source", "from_node"), ["root", "source"]).join(ends("target", "to_node"), ["root", "target"]).select(*edges.columns, "from_node", "to_node")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per root: nodes, edges, negative edges and edges from negated nodes."""
    n = nodes.groupBy("root").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("root").agg(F.count("*").alias("n_edges"), F.count_if(F.col("w") < 0).alias("n_negative"), F.count_if("from_negation").alias("n_from_negation"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_edges", "n_negative", "n_from_negation")]
    return n.join(e, "root", "left").select("root", "n_nodes", *zero)


def visible(nodes: DataFrame, edges: DataFrame, least_degree: int = 1, show_negated: bool = False) -> DataFrame:
    """Nodes that stay: the root, and those of ``least_degree`` or more edges that keep a shown edge to a node of such degree.

    Degrees count all edges.  Edges from negated nodes are not shown unless
    ``show_negated``.  A node that is dropped as an orphan has no shown
    neighbour left, so dropping it makes no other orphan: one round is enough.
    """
    ends = edges.select("root", F.explode(F.array("source", "target")).alias("label"))
    degrees = ends.groupBy("root", "label").agg(F.count("*").alias("n"))
    rows = nodes.join(degrees, ["root", "label"], "left")
    able = rows.filter((F.col("depth") == 0) | (F.coalesce("n", F.lit(0)) >= least_degree)).drop("n")
    shown = edges if show_negated else edges.filter(~F.col("from_negation"))
    both = shown.select("root", F.col("source").alias("label"), F.col("target").alias("other")).unionByName(shown.select("root", F.col("target").alias("label"), F.col("source").alias("other")))
    linked = both.distinct().join(able.select("root", F.col("label").alias("other")), ["root", "other"], "left_semi").select("root", "label").distinct().withColumn("linked", F.lit(True))
    return able.join(linked, ["root", "label"], "left").filter((F.col("depth") == 0) | F.col("linked")).drop("linked")


def file_name(root):
    return F.concat(slug(root), F.lit("_subgraph.html"))
