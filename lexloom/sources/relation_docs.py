"""Relation documentation in Markdown: a heading names the relation, lines below describe it or give examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_relation_docs(lines: DataFrame) -> DataFrame:
    """``(code, display_name, description, examples)`` of ``(doc, pos, line)`` rows.

    A section starts at ``### Title (`r_x`)`` and ends at the next line that
    starts with ``#``; an example is ``* a | rel | b``.  One document is one
    window partition, as sections depend on the lines above.
    """
    above = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("line").rlike("^#")
    code = F.regexp_extract("line", r"^### .*\(`(r_[^`]+)`\)", 1)
    title = F.regexp_extract("line", r"^### (.*?) *\(`r_[^`]+`\)", 1)
    marked = lines.withColumn("section", F.last(F.when(heading, F.struct(code.alias("code"), title.alias("title"), F.col("pos").alias("at"))), ignorenulls=True).over(above))
    body = marked.filter("section.code <> ''").withColumn("parts", F.split(F.regexp_replace("line", r"^\s*\*\s*", ""), r"\s*\|\s*"))
    example = F.col("line").rlike(r"^\s*\*") & (F.size("parts") == 3)
    part = F.col("parts")
    found = body.groupBy("doc", "section.code", "section.title", "section.at").agg(
        F.array_sort(F.collect_list(F.when(example, F.struct("pos", F.trim(part[0]).alias("a"), F.trim(part[1]).alias("rel"), F.trim(part[2]).alias("b"))))).alias("examples"),
        F.array_sort(F.collect_list(F.when(~example & ~heading & (F.trim("line") != ""), F.struct("pos", F.trim("line").alias("text"))))).alias("texts"),
    )
    return found.select("code", F.col("title").alias("display_name"), F.array_join(F.transform("texts", lambda t: t.text), " ").alias("description"), F.transform("examples", lambda e: F.struct(e.a.alias("a"), e.rel.alias("rel"), e.b.alias("b"))).alias("examples"))


def _from_cp1252(content: str) -> Column:
    """Text of bytes in cp1252, which Spark reads as Latin-1 but for the 32 codes from 0x80 on."""
    codes = bytes(range(0x80, 0xA0))
    return F.translate(F.decode(content, "iso-8859-1"), codes.decode("latin-1"), codes.decode("cp1252", "replace"))


def read_relation_docs(spark: SparkSession, path: str) -> DataFrame:
    """Parse the Markdown files (cp1252) at ``path``, each read whole."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), _from_cp1252("content").alias("body"))
    return parse_relation_docs(files.select("doc", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line")))


def doc_text(docs: DataFrame) -> DataFrame:
    """Title, description and the first three examples as text."""
    shown = F.transform(F.slice("examples", 1, 3), lambda e: F.concat_ws(" ", e.a, e.rel, e.b))
    return docs.select("code", F.concat_ws(" : ", "display_name", "description").alias("summary"), F.array_join(shown, " ; ").alias("examples"))
