"""Stored tables that are found again: by what they hold in a session, by a key across sessions.

A table that is asked for again within its lifetime is read, not written anew.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.places import Place
from lexloom.sources.storage import shared_dir

#: Seconds for which a table counts as fresh.
LIFETIME = 7 * 24 * 3600.0


@dataclass
class _Kept:
    asked: DataFrame
    path: str
    until: float
    table: DataFrame


@dataclass
class Kept:
    """The tables that this session has stored by :meth:`of`; ``writes`` counts how many were really written."""

    tables: dict[tuple[str, int], list[_Kept]] = field(default_factory=dict)
    writes: int = 0

    def of(self, df: DataFrame, label: str, lifetime: float = LIFETIME) -> DataFrame:
        """``df`` as a stored table: the one already there if it was asked with the same plan over the same files, else a new one.

        Plans are met by their semantic hash and then compared, so two that
        only share a hash are two tables.  Files that were written anew under
        the same names make another plan; the lifetime bounds what remains.  A
        table that someone else has deleted is written again.
        """
        found = self.tables.setdefault((df.sparkSession.sparkContext.applicationId, df.semanticHash()), [])
        for kept in [k for k in found if k.until <= time.time()]:
            self._drop(kept, df.sparkSession)
            found.remove(kept)
        spark = df.sparkSession
        for kept in found:
            if kept.asked.sameSemantics(df) and Place(spark, kept.path).exists():
                return kept.table
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.writes += 1
        place = Place(spark, path)
        place.fs.deleteOnExit(place.path)
        kept = _Kept(df, path, time.time() + lifetime, spark.read.schema(df.schema).parquet(path))
        found.append(kept)
        return kept.table

    def release(self, df: DataFrame) -> bool:
        """Delete the table stored for ``df``, or that ``df`` is; False if there is none."""
        for found in self.tables.values():
            for kept in found:
                if kept.asked.sparkSession is df.sparkSession and (kept.asked.sameSemantics(df) or kept.table.sameSemantics(df)):
                    self._drop(kept, df.sparkSession)
                    found.remove(kept)
                    return True
        return False

    @staticmethod
    def _drop(kept: _Kept, spark: SparkSession) -> None:
        Place(spark, kept.path).delete()


#: The tables of this process.
KEPT = Kept()


def key_of(parts: Mapping[str, object]) -> str:
    """SHA-1 of the parts, in whatever order they are given."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def cached(spark: SparkSession, parts: Mapping[str, object], build: Callable[[], DataFrame], lifetime: float = LIFETIME, base: str | None = None) -> DataFrame:
    """The table of the key ``parts``, built and stored if it is not there or older than ``lifetime`` seconds.

    It outlives the session, in ``base`` or the shared folder.  It is written
    beside its place and moved there in one step; of two writers the first one
    wins and the other reads its table.  An expired table is replaced.
    """
    place = Place(spark, f"{base or shared_dir(spark)}/keyed/{key_of(parts)}")
    age = place.age()
    if age is not None and age >= lifetime:
        place.delete()
        age = None
    if age is None:
        fresh = place.beside(f".{place.path.getName()}-{uuid.uuid4().hex}")
        build().write.parquet(fresh.text)
        if not fresh.move(place):
            fresh.delete()
    return spark.read.parquet(place.text)


def forget(spark: SparkSession, parts: Mapping[str, object], base: str | None = None) -> bool:
    """Delete the table of the key ``parts``."""
    return Place(spark, f"{base or shared_dir(spark)}/keyed/{key_of(parts)}").delete()
