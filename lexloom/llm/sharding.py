"""Minimax contiguous partition of atomic groups into shards.

Documents with equal texts are one atomic group.  Groups stand in the order of
their text's MD5; a shard is a run of groups.  The smallest capacity that some
cut into ``n_shards`` runs keeps to is found by binary search (several
capacities per job): a capacity is feasible if filling shards greedily reaches
the end.  Then the groups are cut there.

Running totals come from two levels: buckets of the order (a few thousand
groups each) and the groups inside them, so no task sees all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import materialise

#: Groups in a bucket of the order, and rows in a part of one group, about.
BUCKET, PART = 10_000, 4_000
#: Capacities that one job tries.
TRIES = 31


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, size, text_crc32, group)`` per row; a null text counts as an empty one."""
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("group"))


def place_units(rows: DataFrame, n_rows: int) -> DataFrame:
    """Parts of groups with ``upto`` (bytes up to the group's end), ``weight`` (the group's bytes) and ``before`` (rows before the part)."""
    n_buckets = max(1, n_rows // BUCKET)
    first = F.conv(F.substring("group", 1, 8), 16, 10).cast("long")
    units = rows.groupBy("group", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    units = units.withColumn("bucket", F.floor(first * n_buckets / 2**32))
    inside, whole = Window.partitionBy("bucket").orderBy("group"), Window.partitionBy("bucket", "group")
    each = Window.partitionBy("bucket").orderBy("group", "part").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select("*", F.sum("bytes").over(inside).alias("upto"), F.coalesce(F.sum("n").over(each), F.lit(0)).alias("before"), F.sum("bytes").over(whole).alias("weight"))
    units = materialise(units, "shard-units")
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    totals = units.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("n").alias("c"))
    offsets = totals.select("bucket", F.coalesce(F.sum("b").over(order), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias("c0"))
    placed = units.join(offsets, "bucket").select("group", "part", "n", "weight", (F.col("upto") + F.col("b0")).alias("upto"), (F.col("before") + F.col("c0")).alias("before"))
    return materialise(placed, "shard-units")


def fill(units: DataFrame, capacities: list[int], n_shards: int) -> list[list[int]]:
    """For each capacity the ends (in bytes) of ``n_shards`` shards filled greedily; one job per shard."""
    ends: list[list[int]] = [[] for _ in capacities]
    for _ in range(n_shards):
        limits = [(e[-1] if e else 0) + c for e, c in zip(ends, capacities)]
        best = units.agg(*[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"m{i}") for i, x in enumerate(limits)]).first()
        for i, e in enumerate(ends):
            e.append(max(best[i] or 0, e[-1] if e else 0))
    return ends


def smallest_capacity(units: DataFrame, n_shards: int, tries: int = TRIES) -> tuple[int, list[int]]:
    """The least feasible capacity and the shard ends at it."""
    total, largest = units.agg(F.max("upto"), F.max("weight")).first()
    if not total:
        return 0, [0] * n_shards
    low = max(largest, -(-total // n_shards))
    high = -(-total // n_shards) + largest  # always feasible: a shard closed early holds more than a fair share
    best: list[int] | None = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // tries))
        capacities = [*range(low, high, step), high]
        for capacity, ends in zip(capacities, fill(units, capacities, n_shards)):
            if ends[-1] >= total:
                high, best = capacity, ends
                break
            low = capacity + 1
    return high, best


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``size``, ``text_crc32``, ``law`` (``bytes``), ``shard``, ``slot`` and a null ``grown_shard``.

    Shards are 0 to ``n_shards - 1``; slots count from 0 in each shard without
    gaps.  Sizes are UTF-8 bytes plus 1; a null text is one with an empty text.
    Equal texts share a shard, also when one group outweighs a fair share.
    Repeated rows get slots of their own; null ids come first in their group;
    an empty table gives no rows.  Other columns are ignored.
    """
    rows = materialise(text_rows(docs, id_col, text_col), "shard-rows")
    n_rows = rows.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_rows // PART)))
    rows = rows.withColumn("part", part)
    units = place_units(rows, n_rows)
    _, ends = smallest_capacity(units, n_shards)
    shard = sum((F.when(F.col("upto") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    units = units.withColumn("shard", shard)
    starts = {r.shard: r.first for r in units.groupBy("shard").agg(F.min("before").alias("first")).collect()}  # one row per shard
    start: Column = F.lit(0)
    for s, first in starts.items():
        start = F.when(F.col("shard") == s, F.lit(first)).otherwise(start)
    units = materialise(units.select("group", "part", "shard", (F.col("before") - start).alias("start")), "shard-units")
    turn = F.row_number().over(Window.partitionBy("group", "part").orderBy("doc_id"))
    numbered = rows.withColumn("turn", turn)
    out = numbered.join(units, ["group", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("turn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
