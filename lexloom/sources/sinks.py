"""Files that other tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import slug

CSV_COLUMNS = ["term", "relation", "target", "confidence", "rationale", "source", "annotation", "validation_status", "validation_note", "consolidation_status", "consolidation_schema"]


def csv_rows(candidates: DataFrame) -> DataFrame:
    """The fixed columns as text: confidence with two decimals, nulls empty, missing columns empty."""

    def text(c: str) -> Column:
        if c not in candidates.columns:
            return F.lit("").alias(c)
        value = F.format_number(c, 2) if c == "confidence" else F.col(c).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return candidates.select(*map(text, CSV_COLUMNS))


def write_csv(candidates: DataFrame, path: str) -> None:
    csv_rows(candidates).write.mode("errorifexists").option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A column ``line`` as text files; an existing path is an error."""
    lines.select("line").write.mode("errorifexists").text(path)


def submission_name(at: Column, author: Column, extension: str = ".enrich") -> Column:
    return F.concat(F.date_format(at, "HH'h'mm_dd-MM-yy"), F.lit("_automatic_submission_from_"), slug(author), F.lit(extension))
