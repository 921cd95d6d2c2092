"""Tables that are rewritten while others read them.

A table is a folder of versions and of numbered manifests, each of which names
the folder of its version.  A rewrite writes its rows beside the old ones and
then puts the next manifest there, in one step and only if no one else has: a
reader has the old table or the new one and never a mix, and of two writers
from the same version one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.places import Place

_MANIFEST = "manifest-"


class Stale(RuntimeError):
    """Another writer replaced the table meanwhile."""


def _manifest(spark: SparkSession, path: str, version: int) -> Place:
    return Place(spark, f"{path}/{_MANIFEST}{version:012d}.json")


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the table at ``path``: ``version``, ``folder``, ``schema`` and the ``earlier`` ones that are kept; None if there is none."""
    names = [n for n in Place(spark, path).names() if n.startswith(_MANIFEST)]
    return json.loads(Place(spark, f"{path}/{max(names)}").read_text()) if names else None


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current table at ``path``, or one of the versions that are kept. A frame stays on the version that it was made from."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    entry = found if version is None else next((e for e in found["earlier"] if e["version"] == version), found if found["version"] == version else None)
    if entry is None:
        raise FileNotFoundError(f"version {version} of {path}")
    return spark.read.schema(found["schema"]).parquet(f"{path}/{entry['folder']}")


def rewrite(df: DataFrame, path: str, keep: int = 2, expected: int | None = None) -> int:
    """Replace the table at ``path`` by ``df`` and return its version number; ``df`` may read the table itself.

    The ``keep`` versions before stay for readers that have begun; older ones
    are deleted.  ``expected`` is the version that ``df`` was made from (0:
    none); if another has come since, :class:`Stale` is raised and nothing has
    changed.  Without it the rows replace whatever is there.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    while True:
        before = current(spark, path)
        version = before["version"] if before else 0
        chain = [{"version": before["version"], "folder": before["folder"]}, *before["earlier"]] if before else []
        manifest = {"version": version + 1, "folder": folder, "schema": df._jdf.schema().toDDL(), "earlier": chain[:keep]}
        done = expected in (None, version) and _manifest(spark, path, version + 1).write_text(json.dumps(manifest))
        if done:
            break
        if expected is not None:
            Place(spark, f"{path}/{folder}").delete()
            raise Stale(f"version {expected} of {path} has been replaced")
    for old in chain[keep:]:
        Place(spark, f"{path}/{old['folder']}").delete()
        _manifest(spark, path, old["version"]).delete()
    return version + 1
