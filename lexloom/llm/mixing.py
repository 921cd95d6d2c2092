"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources.  A node
splits its budget among its children by weight, a child takes no more than its
subtree can supply (``max_epochs`` passes over each leaf), and what it leaves
goes to its siblings by their weights.  As a node's own limit is the sum of
its children's, a shortage reaches the ancestors only when no sibling can
cover it.  A leaf then takes whole epochs of its documents and, of the next
epoch's seeded order, the longest prefix that fits the rest.

Prefixes are cut through two levels of running totals (hash buckets, then the
one bucket in which the cut falls), so a leaf may hold any share of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import materialise, packed, unpacked

LEVELS = ["domain", "lang", "source"]
HASH_BITS = 60
#: Rows of a hash bucket, about.
BUCKET = 2_000


def domain_of(source: Column) -> Column:
    """The domain of a source where none is given: one of four, by CRC-32 of its name."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 4).cast("string"))


def words_in(text: Column) -> Column:
    """Words between ASCII white space; the unit of budgets."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out: Column = F.lit(1.0)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def split_budget(children: DataFrame, parents: DataFrame | None, keys: list[str], budget: float, weights: dict[str, dict[str, float]]) -> DataFrame:
    """Share each parent's ``budget`` among its children (``keys``, ``cap``): by weight, no more than ``cap``, shortages to siblings."""
    above, level = keys[:-1], keys[-1]
    rows = children.withColumn("budget", F.lit(budget)) if parents is None else children.join(parents, above)
    rows = rows.withColumn("w", _weight(level, weights))
    family = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    # A child of weight 0 gets nothing and comes last.
    order = family.orderBy((F.col("cap") / F.nullif(F.col("w"), F.lit(0.0))).asc_nulls_last(), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("rate", F.coalesce(left / F.nullif(weight_left, F.lit(0.0)), F.lit(0.0))).withColumn("turn", F.row_number().over(order))
    rows = rows.withColumn("full", (F.col("w") > 0) & (F.col("cap") <= F.col("w") * F.col("rate")))
    rows = rows.withColumn("open", F.min(F.when(~F.col("full"), F.struct("turn", "rate"))).over(family))
    share = F.when(F.col("open").isNull() | (F.col("turn") < F.col("open.turn")), F.col("cap")).otherwise(F.col("w") * F.col("open.rate"))
    return rows.select(*keys, share.alias("budget"))


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: float, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``(domain, lang, source, supply, target, epochs, rest)``: each leaf's tokens to take, as whole epochs and a rest."""
    leaves = leaves.withColumn("cap", F.col("supply") * F.lit(float(max_epochs)))
    langs = leaves.groupBy(*LEVELS[:2]).agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy(LEVELS[0]).agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    by_domain = split_budget(domains, None, LEVELS[:1], float(math.floor(total * budget_share)), weights)
    by_lang = split_budget(langs, by_domain, LEVELS[:2], 0.0, weights)
    by_source = split_budget(leaves.select(*LEVELS, "cap"), by_lang, LEVELS, 0.0, weights)
    target = F.floor(F.round("budget", 3)).cast("long")
    out = leaves.select(*LEVELS, "supply").join(by_source, LEVELS).withColumn("target", target)
    some = F.col("supply") > 0
    return out.select(*LEVELS, "supply", "target", F.when(some, F.expr("target div supply")).otherwise(0).cast("long").alias("epochs"), F.when(some, F.col("target") % F.col("supply")).otherwise(0).alias("rest"))


def draw(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the seeded order of an epoch, below 2 to the :data:`HASH_BITS`."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _leaf_columns(docs: DataFrame, domain: Column | None) -> list[Column]:
    """The tree's columns; a null name is the empty one."""
    given = domain if domain is not None else domain_of(F.col("source"))
    return [F.coalesce(c.cast("string"), F.lit("")).alias(level) for c, level in zip([given, F.col("lang"), F.col("source")], LEVELS)]


def plan_mix(rows: DataFrame, budget_share: float, max_epochs: float, weights: dict[str, dict[str, float]], seed: int) -> DataFrame:
    """Per leaf its budget and ``cut``: documents whose place in epoch ``epochs`` is at most ``cut`` are taken once more."""
    leaves = materialise(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n")), "leaves")
    n_rows = leaves.agg(F.sum("n")).first()[0] or 0
    budgets = materialise(leaf_budgets(leaves.drop("n"), budget_share, max_epochs, weights), "leaf-budgets")
    shift = HASH_BITS - max(0, math.ceil(math.log2(max(1, n_rows / BUCKET))))
    placed = rows.join(budgets.filter("rest > 0").select(*LEVELS, "epochs", "rest"), LEVELS).withColumn("place", draw(seed, F.col("epochs"), F.col("doc_id"))).withColumn("bucket", F.shiftright("place", shift))
    sums = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    edge = sums.withColumn("upto", upto).filter("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("edge"))
    edge = materialise(edge.select(*LEVELS, "edge.bucket", "edge.before"), "leaf-edges")
    inside = placed.select(*LEVELS, "bucket", "rest", "place", "n_tokens").join(edge, [*LEVELS, "bucket"])
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("running", F.col("before") + running).filter("running <= rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    cut = F.coalesce("last", F.shiftleft("bucket", shift) - 1, F.lit(-1))
    return materialise(budgets.join(edge, LEVELS, "left").join(last, LEVELS, "left").select(*LEVELS, "supply", "target", "epochs", "rest", cut.alias("cut")), "mix-plan")


def _copies(seed: int) -> Column:
    return (F.col("epochs") + F.when(draw(seed, F.col("epochs"), F.col("doc_id")) <= F.col("cut"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, budget_share: float = 0.6, max_epochs: float = 2.0, weights: dict[str, dict[str, float]] | None = None, seed: int = 17, domain: Column | None = None) -> DataFrame:
    """Per row ``doc_id``, the leaf, ``n_tokens``, the leaf's ``target`` and ``copies``, the times the mix takes it.

    ``docs`` has doc_id, text, lang and source.  ``weights`` names weights by
    level and value, 1 for others; a weight of 0 takes nothing, even where
    that leaves some of the budget unspent.  The budget is ``budget_share`` of all
    tokens.  Null names make a leaf of the empty name, null texts have no
    tokens, rows of one id share a place in the order and are taken together;
    a leaf without tokens takes nothing.  Other columns are ignored.
    """
    rows = materialise(docs.select("doc_id", *_leaf_columns(docs, domain), words_in(F.col("text")).alias("n_tokens")), "mix-rows")
    plan = plan_mix(rows, budget_share, max_epochs, weights or {}, seed)
    return rows.join(plan, LEVELS).select("doc_id", *LEVELS, "n_tokens", "target", _copies(seed).alias("copies"))


def take(docs: DataFrame, budget_share: float, max_epochs: float, weights: dict[str, dict[str, float]], seed: int = 17, domain: Column | None = None) -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, columns as they were, whatever their names.

    Nulls, ties, repeated rows and empty texts count as in :func:`mix`: rows of
    one id share a place in the order and come together, a leaf without tokens
    gives no row.  An empty table gives an empty one.
    """
    leaf = _leaf_columns(docs, domain)
    rows = materialise(docs.select("doc_id", *leaf, words_in(F.col("text")).alias("n_tokens")), "mix-rows")
    plan = plan_mix(rows, budget_share, max_epochs, weights, seed).select(*LEVELS, "epochs", "cut")
    placed = packed(docs, doc_id=docs["doc_id"], **dict(zip(LEVELS, leaf))).join(plan, LEVELS)
    return unpacked(placed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), _copies(seed)))), docs.columns)


#: Weights of the registered query: English is held to half, the rest shared.
WEIGHTS = {"domain": {"domain0": 3.0, "domain1": 2.0}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
