"""Line-oriented inputs: claims and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_claim_lines(lines: DataFrame) -> DataFrame:
    """``(line, subject, relation, object, error)`` of ``subject r_x object ...`` lines; a bar stands for a blank."""
    words = F.split(F.trim(F.regexp_replace("line", r"[|\s]+", " ")), " ")
    good = (F.size(words) >= 3) & F.get(words, F.lit(1)).startswith("r_")
    return lines.select("line", F.when(good, words[0]).alias("subject"), F.when(good, F.get(words, F.lit(1))).alias("relation"), F.when(good, F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), " ")).alias("object"), F.when(~good, F.lit("expected: subject r_relation object")).alias("error"))


def parse_term_lines(lines: DataFrame) -> DataFrame:
    """One term per line; blank lines and lines that start with # are skipped."""
    term = F.trim("line")
    return lines.select(term.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))
