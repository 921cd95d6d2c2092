"""The generic file of lines or triplets, counted while it is written.

A file is a folder of text parts in order.  It is written under a hidden name
and then moved to the first free one, so nothing is ever overwritten, not even
by two writers at once, and a job that fails leaves no file.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexloom import schema
from lexloom.functions.text import fold_accents, one_line
from lexloom.sources.places import Place

#: Names that are tried before giving up.
MOST_NAMES = 999
#: Extension of files that hold proven triplets only.
PROVEN = ".enrich"
FIELDS = ["line", "term", "relation", "target", "annotation", "explanation"]


@dataclass(frozen=True)
class Written:
    """What was written: ``mode`` is raw, triplets or nothing; ``path`` is None if no file was made."""

    path: str | None
    mode: str
    count: int
    #: Triplets beside lines in raw mode, rows that are neither, triplets without a proof.
    ignored_triplets: int = 0
    invalid: int = 0
    unproven: int = 0


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _kinds(items: DataFrame) -> DataFrame:
    """``items`` with all of :data:`FIELDS`, ``pos`` and ``kind``: line, triplet or neither."""
    fields = [F.col(c).cast("string") if c in items.columns else F.lit(None).cast("string").alias(c) for c in FIELDS]
    pos = F.col("pos").cast("long") if "pos" in items.columns else F.lit(0).cast("long").alias("pos")
    rows = items.select(pos, *fields)
    whole = (_said("term") != "") & (_said("relation") != "") & (_said("target") != "")
    return rows.withColumn("kind", F.when(F.col("line").isNotNull(), "line").when(whole, "triplet").otherwise("neither"))


def _proven(rows: DataFrame, registry: DataFrame, only: bool) -> DataFrame:
    """Triplets with ``proof``, the registered explanation by folded names; without one they keep their own unless ``only`` proven ones count."""
    key = {"kt": fold_accents("term"), "kr": F.lower(F.trim("relation")), "ko": fold_accents("target")}
    have = registry.filter("coalesce(consolidation_explanation, '') <> ''").withColumns(key).groupBy("kt", "kr", "ko").agg(F.min("consolidation_explanation").alias("proof"))
    joined = rows.withColumns(key).join(have, ["kt", "kr", "ko"], "left").drop("kt", "kr", "ko")
    said = F.col("proof") if only else F.coalesce("proof", _said("explanation"))
    return joined.withColumn("explanation", said)


def _readable(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``term`` and ``target`` of word senses by their readable names (``name``, ``decoded``)."""
    for end in ("term", "target"):
        rows = rows.join(names.select(F.col("name").alias(end), F.col("decoded").alias("_shown")), end, "left").withColumn(end, F.coalesce("_shown", end)).drop("_shown")
    return rows


def write_submission(items: DataFrame, path: str, registry: DataFrame | None = None, names: DataFrame | None = None, append: bool = False, network: str = "du réseau") -> Written:
    """Write ``items`` to ``path``, or to ``path`` with ``_2``, ``_3``, ... before its extension if that is taken.

    A row with a ``line`` is written as it stands, in the order of ``pos``
    (rows without ``pos`` by the line); a row with ``term``, ``relation`` and
    ``target`` as ``term | relation | target | annotation < explanation >``.
    One line among the rows makes the file a raw one, and triplets are counted
    and left out.  With ``registry`` (term, relation, target,
    consolidation_explanation) the registered explanation counts; a file that
    ends in ``.enrich`` takes no triplet without one.  With ``append`` the
    parts go behind those of an existing file and the head is not written
    again.  If there is nothing to write, no file is made or changed.
    """
    spark = items.sparkSession
    rows = _kinds(items)
    only = path.lower().endswith(PROVEN)
    n = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    raw, triplets = n.get("line", 0), n.get("triplet", 0)
    counted = {"invalid": n.get("neither", 0)}
    if raw:
        body, mode = rows.filter("kind = 'line'").select("pos", "line"), "raw"
        counted["ignored_triplets"] = triplets
    elif triplets:
        body, mode = rows.filter("kind = 'triplet'"), "triplets"
        if registry is not None:
            body = _proven(body, registry, only)
        elif only:
            body = body.withColumn("explanation", F.lit(None).cast("string"))
        if only:
            body = body.filter("explanation is not null")
        body = _readable(body, names) if names is not None else body
        line = F.concat("term", F.lit(" | "), "relation", F.lit(" | "), "target", F.lit(" | "), _said("annotation"), F.lit(" < "), one_line(_said("explanation")), F.lit(" >"))
        body = body.select("pos", line.alias("line"))
    else:
        return Written(None, "nothing", 0, **counted)
    seen = Observation()
    hidden = Place(spark, path).beside(f".writing-{uuid.uuid4().hex}")
    body.repartitionByRange("pos", "line").sortWithinPartitions("pos", "line").select("line").observe(seen, F.count("*").alias("n")).write.text(hidden.text)
    count = seen.get["n"]
    if mode == "triplets":
        counted["unproven"] = triplets - count if only else 0
    if not count:
        hidden.delete()
        return Written(None, mode, 0, **counted)
    target = Place(spark, path)
    fresh = not (append and target.exists())
    if mode == "triplets" and fresh:
        _head(hidden, count, network)
    if not fresh:
        _behind(hidden, target)
        return Written(path, mode, count, **counted)
    return Written(_placed(hidden, target), mode, count, **counted)


def _head(folder: Place, count: int, network: str) -> None:
    """The lines before triplets, as a part that sorts before the others."""
    head = "\n".join(x.format(network=network) for x in schema.SUBMISSION_HEAD) % count
    Place(folder.spark, f"{folder.text}/part-0-head.txt").write_text(head.rstrip("\n") + "\n\n")


def _behind(folder: Place, target: Place) -> None:
    """Move the parts of ``folder`` into ``target`` under names that sort behind all that are there."""
    turn = 1 + max((int(name.split("-")[1][1:]) for name in target.names() if name.startswith("part-a")), default=0)
    for name in sorted(x for x in folder.names() if x.startswith("part-")):
        Place(folder.spark, f"{folder.text}/{name}").move(Place(folder.spark, f"{target.text}/part-a{turn:06d}-{name[5:]}"))
    folder.delete()


def _placed(folder: Place, target: Place) -> str:
    """Move ``folder`` to the first free name of ``target``."""
    name = target.path.getName()
    stem, dot, extension = name.rpartition(".") if "." in name[1:] else (name, "", "")
    for i in range(1, MOST_NAMES + 1):
        place = target if i == 1 else target.beside(f"{stem}_{i}{dot}{extension}")
        if folder.move(place):
            return target.text if i == 1 else f"{target.text.removesuffix(name)}{stem}_{i}{dot}{extension}"
    folder.delete()
    raise FileExistsError(f"{target.text} and {MOST_NAMES - 1} more names are taken")
