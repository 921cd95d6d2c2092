"""Prefix trie of conversations, screened by a count-min sketch of prefix digests.

Every prefix of every conversation gets a digest that is a running sum of
hashes of (position, turn), so that it can be summed piece by piece: a
conversation of any length is dealt over as many tasks as its rows need.  A
count-min sketch of all digests proves most prefixes to be of one conversation
only (an estimate of one is never too low); those and all that follow them make
their nodes where they are.  Only prefixes that several conversations may share
are shuffled and grouped exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import materialise

#: Counters of one row of the sketch, and rows.  A counter says none, one or more, so a sketch has ``WIDTH * ROWS`` bits at most.
WIDTH, ROWS = 1 << 25, 2
#: A key with at least this part of a table's rows is joined by broadcast; there are at most so many such keys.
HOT = 1000

_SUMS = ["a", "b", "c", "d"]
_EMPTY = "array<struct<ordinal:bigint,turn:binary,bytes:bigint>>"


@dataclass(frozen=True)
class Graft:
    """Begin conversation c with the first h turns of conversation ``c - c % group``, h being the CRC-32 of c modulo ``lengths``; its own turns follow from number h on."""

    group: int = 5
    lengths: int = 9

    def taken(self, conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % self.lengths


def placed_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns by digest, in order, with their place: the piece that they lie in (its high bits) and the number there."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    turn = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("at"), turn.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv", "at", "turn"]
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "bytes", F.monotonically_increasing_id().alias("place")), "trie-turns")


def sequences(placed: DataFrame, graft: Graft | None) -> DataFrame:
    """Every turn of the rebuilt conversations at its ``depth``, by ``piece``; depth 0 stands for the empty beginning."""
    placed = placed.withColumn("piece", F.shiftright("place", 33))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    pieces = placed.groupBy("conv", "piece").agg(F.count("*").alias("n"), F.min("place").alias("first")).withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0)))
    convs = pieces.groupBy("conv").agg(F.sum("n").alias("own"))
    if graft is None:
        plan = convs.withColumn("taken", F.lit(0).cast("long")).withColumn("head", F.expr(f"CAST(array() AS {_EMPTY})"))
    else:
        near = placed.join(pieces.filter(F.col("skipped") < graft.lengths - 1), ["conv", "piece"]).withColumn("ordinal", F.col("place") - F.col("first") + F.col("skipped"))
        heads = near.filter(F.col("ordinal") < graft.lengths - 1).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "turn", "bytes"))).alias("turns"))  # fewer than ``lengths`` turns each
        plan = convs.withColumn("taken", graft.taken(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % graft.group).join(heads, "base", "left")
        plan = plan.withColumn("head", F.expr(f"coalesce(slice(turns, 1, CAST(taken AS INT)), CAST(array() AS {_EMPTY}))"))
    plan = plan.withColumn("k", F.size("head").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("own") - F.col("taken"), F.lit(0)))
    start = plan.select("conv", F.lit(-2).cast("long").alias("piece"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("bytes"), "length")
    head = plan.select("conv", "length", F.explode("head").alias("t")).select("conv", F.lit(-1).cast("long").alias("piece"), (F.col("t.ordinal") + 1).alias("depth"), "t.turn", "t.bytes", "length")
    rest = placed.join(pieces.join(plan.select("conv", "taken", "k", "length"), "conv"), ["conv", "piece"]).withColumn("ordinal", F.col("place") - F.col("first") + F.col("skipped"))
    rest = rest.filter(F.col("ordinal") >= F.col("taken")).select("conv", "piece", (F.col("k") + F.col("ordinal") - F.col("taken") + 1).alias("depth"), "turn", "bytes", "length")
    return materialise(start.unionByName(head).unionByName(rest), "trie-sequences")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per prefix: ``conv``, ``depth``, ``node`` and ``parent`` (digests), bytes ``before`` and ``after`` its last turn, whether it is the ``last``."""
    one, two = (F.when(F.col("turn").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "depth", "turn")) for seed in (1, 2))
    low = F.lit((1 << 32) - 1)
    # Sums of 32-bit parts cannot overflow; together they are 128 bits of digest and more.
    turns = turns.select("conv", "piece", "depth", "bytes", "length", one.bitwiseAND(low).alias("a"), F.shiftrightunsigned(one, 32).alias("b"), two.bitwiseAND(low).alias("c"), F.shiftrightunsigned(two, 32).alias("d"))
    summed = [*_SUMS, "bytes"]
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv", "piece").agg(*[F.sum(c).alias(f"total_{c}") for c in summed])
    offsets = totals.select("conv", "piece", *[F.coalesce(F.sum(f"total_{c}").over(earlier), F.lit(0)).alias(f"off_{c}") for c in summed])
    along = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.join(offsets, ["conv", "piece"]).select("conv", "depth", "length", *summed, *[(F.sum(c).over(along) + F.col(f"off_{c}")).alias(f"run_{c}") for c in summed])
    node = F.struct("depth", *[F.col(f"run_{c}").alias(c) for c in _SUMS])
    parent = F.struct((F.col("depth") - 1).alias("depth"), *[(F.col(f"run_{c}") - F.col(c)).alias(c) for c in _SUMS])
    out = run.select("conv", "depth", node.alias("node"), F.when(F.col("depth") > 0, parent).alias("parent"), (F.col("run_bytes") - F.col("bytes")).alias("before"), F.col("run_bytes").alias("after"), (F.col("depth") == F.col("length")).alias("last"))
    return materialise(out, "trie-prefixes")


def _cells(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(100 + i), key), F.lit(WIDTH)) + i * WIDTH for i in range(ROWS)]


def screened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``state``: 2 may be shared, 1 is the first that is not, 0 comes after such a one.

    The sketch is counted by Spark; what comes to the driver and goes to the
    executors is one bit a counter (more than one), 8 MB whatever the input.
    Where more prefixes than counters are there, more of them are grouped.
    """
    counts = rows.select(F.explode(F.array(*_cells("node"))).alias("cell")).groupBy("cell").count().filter("count > 1")
    words = counts.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell % 64 AS INT))")).alias("bits")).toPandas()
    bits = np.zeros(WIDTH * ROWS // 64, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sketch = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.pandas_udf("boolean")
    def several(a: pd.Series, b: pd.Series) -> pd.Series:
        """Whether the estimate, the smaller of two counters, is above one."""
        found = np.ones(len(a), bool)
        for cells in (a.to_numpy(np.int64), b.to_numpy(np.int64)):
            found &= (sketch.value[cells >> 6] >> (cells & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    parent, node = several(*_cells("parent")), several(*_cells("node"))
    state = F.when(F.col("parent").isNotNull() & ~F.col("parent_several"), 0).when(~F.col("node_several"), 1).otherwise(2)
    return materialise(rows.withColumn("parent_several", parent).withColumn("node_several", node).withColumn("state", state).drop("parent_several", "node_several"), "trie-screened")


def attach(rows: DataFrame, key: str, table: DataFrame, weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``table``, whose ``weight`` says how many of the ``total`` rows have its ``key``.

    Keys with a thousandth of all rows or more are at most :data:`HOT`; only
    they are broadcast, so no task of the shuffled rest gets more than such a
    part by one key.
    """
    hot = F.col(weight) * HOT >= total
    loud, quiet = table.filter(hot).drop(weight), table.filter(~hot).drop(weight)
    names = [c for c in table.columns if c not in (key, weight)]
    columns = [*rows.columns, *names]
    by_broadcast = rows.join(F.broadcast(loud), key).select(columns)
    return by_broadcast.unionByName(rows.join(F.broadcast(loud.select(key)), key, "left_anti").join(quiet, key, "left").select(columns))


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node.  The ids of a node pass in order through one digest, a batch at a time: its memory is fixed, whatever their number."""
    flat = rows.select("node.*", "conv").repartition("depth", *_SUMS).sortWithinPartitions("depth", *_SUMS, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in range(6)]
            change = np.zeros(batch.num_rows, bool)
            for c in columns[:5]:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist()] if batch.num_rows else []
            for at, to in zip(starts, [*starts[1:], batch.num_rows]):
                ids = ",".join(map(str, columns[5][at:to].tolist())).encode()
                now = tuple(int(c[at]) for c in columns[:5])
                if now == key:
                    digest.update(b"," + ids)
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids)
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["depth", *_SUMS, "ends_sha256"])
                done = []
        if key is not None:
            done.append((*key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["depth", *_SUMS, "ends_sha256"])

    return flat.mapInArrow(run, "depth long, a long, b long, c long, d long, ends_sha256 string").select(F.struct("depth", *_SUMS).alias("node"), "ends_sha256")


def prefix_trie(conversations: DataFrame, graft: Graft | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per trie node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Turns go by ``turn``, nulls first; turns of one number (repeated rows too)
    by the digest of role and text.  A null role or text is an empty one.
    Rows without ``conv_id`` belong to no conversation and are left out; an
    empty table has no node, not even a root.  Texts are read whole, and only
    their digests are shuffled.  Other columns are ignored, whatever their
    names.  Nodes are told apart by 128 bits of digest.
    """
    rows = screened(prefixes(sequences(placed_turns(conversations, id_col, turn_col, role_col, text_col), graft)))
    shared, single = rows.filter("state = 2"), rows.filter("state < 2")
    n_shared = shared.count()
    nodes = materialise(shared.groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv").alias("rep"), F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("ending")), "trie-nodes")

    # What each conversation saves and whether it stands for a leaf: up to the prefix where it becomes the smallest member.
    known = attach(shared, "node", nodes.select("node", "rep", "n", "ending", F.col("n").alias("weight")), "weight", n_shared)
    of_conv = known.select("conv", F.when(F.col("rep") < F.col("conv"), F.col("after")).otherwise(0).alias("upto"), (F.col("last") & (F.col("rep") == F.col("conv")) & (F.col("n") == F.col("ending"))).cast("long").alias("leaf"), F.lit(1).alias("one"))
    of_conv = of_conv.unionByName(single.filter("last").select("conv", F.lit(0).alias("upto"), F.lit(1).alias("leaf"), F.lit(0).alias("one")))
    by_conv = materialise(of_conv.groupBy("conv").agg(F.max("upto").alias("upto"), F.max("leaf").alias("leaf"), F.sum("one").alias("weight")), "trie-conversations")
    gains = attach(shared, "conv", by_conv, "weight", n_shared).groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("upto") - F.col("before"), F.lit(0))).alias("saved_tokens"))

    first = single.filter("state = 1")
    children = nodes.select("parent").unionByName(first.select("parent")).filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    none = F.sha2(F.lit(""), 256)
    full = nodes.join(gains, "node", "left").join(children, "node", "left").join(_ends(shared.filter("last")), "node", "left")
    full = materialise(full.select("node", "parent", F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")), "trie-full")

    alone = F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(none)
    tails = single.select("node", "parent", F.col("conv").alias("conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), alone.alias("ends_sha256"), "state")
    beside = full.unionByName(tails.filter("state = 1").drop("state"))  # their parents may be shared
    tops = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"), F.col("n_children").alias("weight"))
    upper = attach(beside, "parent", tops, "weight", nodes.count() + first.count())
    # A parent that is not among the shared ones has the same single member.
    upper = upper.withColumn("parent_conv_id", F.when(F.col("parent").isNotNull(), F.coalesce("above", "conv_id"))).drop("above")
    lower = tails.filter("state = 0").drop("state").withColumn("parent_conv_id", F.col("conv_id"))
    return upper.unionByName(lower).select("conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# The CRC-32 of a short decimal, a bit at a time.
_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({id}, ''), lambda x: ascii(x)::BIGINT)), lambda c, o: list_reduce(list_concat([xor(c, o)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))"

SQL = f"""
WITH own AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ordinal, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL
), listed AS (
  SELECT conv, list(said ORDER BY ordinal) AS turns FROM own GROUP BY conv
), taken AS (
  SELECT conv, turns, xor({_CRC.format(id="CAST(conv AS VARCHAR)")}, 4294967295) % 9 AS h FROM listed
), built AS (
  SELECT c.conv, list_concat(CASE WHEN c.h = 0 OR b.turns IS NULL THEN c.turns[1:0] ELSE b.turns[1:c.h] END, c.turns[c.h + 1:]) AS turns FROM taken c LEFT JOIN listed b ON b.conv = c.conv - c.conv % 5
), prefix AS (
  SELECT conv, d, turns[1:d] AS path, d = len(turns) AS at_end FROM (SELECT conv, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)
), node AS (
  SELECT path, min(d) AS depth, min(conv) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE at_end), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN min(d) = 0 THEN 0 ELSE octet_length(encode(path[-1].t)) END AS saved FROM prefix GROUP BY path
), linked AS (
  SELECT n.*, CASE WHEN n.depth > 0 THEN n.path[1:n.depth - 1] END AS parent FROM node n
), children AS (
  SELECT parent, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent
), counted AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.parent = l.path
), spread AS (
  SELECT path[1:d] AS above, saved, leaf FROM (SELECT path, saved, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, unnest(range(0, depth + 1)) AS d FROM counted)
), sums AS (
  SELECT above, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM spread GROUP BY above
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(c.n_convs AS BIGINT) AS n_convs, CAST(c.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.above = c.path LEFT JOIN node p ON p.path = c.parent
"""
