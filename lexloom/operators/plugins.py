"""Callables of the user's own that extract claims, propose targets or annotate triplets.

A callable gets one item and returns a list of dictionaries.  It is called on
the executors, in Arrow batches, once made there by a factory; when it fails on
an item, that item alone gets no results and an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Proposals for one gap at most.
MOST_CANDIDATES = 10

Answer = list[dict[str, Any]]
Maker = Callable[[], Callable[[dict[str, Any]], Answer]]


def call(items: DataFrame, make: Maker, fields: str, most: int | None = None) -> DataFrame:
    """``items`` with ``results``, an array of structs of ``fields``, and ``error``.

    ``make`` is called once a task and returns the callable, so that it may
    hold a connection or a model.  Of the results the first ``most`` count;
    fields that are missing or of the wrong type are null, others are dropped,
    and what is no dictionary is left out.  An item that raises has an empty
    list and the exception's text as ``error``; no result is no error.
    """
    kind = T._parse_datatype_string(fields)
    schema = T.StructType([*items.schema.fields, T.StructField("results", T.ArrayType(kind)), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)
    casts = {f.name: a.type for f, a in zip(kind.fields, to_arrow_schema(kind))}

    def typed(value: Any, to: pa.DataType) -> Any:
        if value is None:
            return None
        try:
            return pa.scalar(value).cast(to).as_py()
        except (pa.ArrowException, TypeError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = make()
        for batch in batches:
            results, errors = [], []
            for item in batch.to_pylist():
                try:
                    found = [x for x in answer(item) or [] if isinstance(x, dict)][:most]
                    results.append([{name: typed(x.get(name), to) for name, to in casts.items()} for x in found])
                    errors.append(None)
                except Exception as e:  # the callable is not ours: whatever it raises is this item's result
                    results.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [*batch.columns, pa.array(results, arrow.field("results").type), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return items.mapInArrow(run, schema)


def extract_claims(texts: DataFrame, make: Maker) -> tuple[DataFrame, DataFrame]:
    """``claims`` (all columns of ``texts``, subject, relation, object, polarity) that the callable finds in each row, and the rows that failed with their ``error``.

    Claims without one of their three parts are left out; a null polarity is true.
    """
    found = call(texts, make, "subject string, relation string, object string, polarity boolean")
    claims = found.select(*texts.columns, F.inline("results")).dropna(subset=["subject", "relation", "object"])
    return claims.withColumn("polarity", F.coalesce("polarity", F.lit(True))), found.filter("error is not null").select(*texts.columns, "error")


def propose(gaps: DataFrame, make: Maker, most: int = MOST_CANDIDATES) -> DataFrame:
    """Candidates ``(term, relation, target, confidence, rationale, source)`` for each gap (term, relation, ...), at most ``most``; a gap that fails has none."""
    found = call(gaps, make, "target string, confidence double, rationale string", most)
    rows = found.select("term", "relation", F.inline("results")).filter("coalesce(target, '') <> ''")
    return rows.select("term", "relation", "target", "confidence", "rationale", F.lit("plug-in").alias("source"))


def annotate(lists: DataFrame, make: Maker) -> DataFrame:
    """Raw proposals ``(subject, at, index, category, justification)`` for lists of triplets.

    A row is a ``subject`` with its ``triplets``, an array whose places the
    callable's ``index`` counts from 0, and is asked about at once; a list that
    fails has no proposal, so that :func:`annotations.by_index` gives all its
    triplets a null category.  Indices outside the list are left out.
    """
    found = call(lists, make, "index int, category string, justification string")
    rows = found.select("subject", F.size("triplets").alias("n"), F.posexplode("results").alias("at", "x"))
    return rows.filter("x.index >= 0 and x.index < n").select("subject", "at", "x.index", "x.category", "x.justification")
