"""A membership filter of fixed size, to keep rows that cannot match out of a shuffle.

The filter is a bitmap of :data:`BITS` bits, so what travels to the driver and
the executors is bounded whatever the table.  A row that is in the table always
passes; other rows mostly do not, and if the bitmap is full every row passes
and the join that follows does all the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 25
HASHES = 2


def _places(keys: list[Column]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(BITS)) for i in range(HASHES)]


def may_contain(table: DataFrame, keys: list[str], of: list[Column]) -> Column:
    """Condition on another table: its columns ``of`` may be the ``keys`` of some row of ``table`` (nulls match nulls)."""
    place = table.select(F.explode(F.array(*_places([F.col(k) for k in keys]))).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = table.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.arrow_udf(T.BooleanType())
    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        found = np.ones(len(a), bool)
        for p in (a, b):
            p = p.to_numpy()
            found &= (shared.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pa.array(found)

    return test(*_places(of))
