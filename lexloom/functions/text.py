"""Text and number functions whose results must not depend on the engine."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: White space by the Unicode property of that name.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def norm(c: Column | str) -> Column:
    """Strip white space of any kind and lower; accents stay. The key of all graph probes.

    Trimming by a set of characters looks at the ends only; a pattern tries
    every position of every name.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c, F.lit(WHITE)))


#: What Python strips from ASCII texts.
_ASCII_WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f "


def fold_accents(c: Column | str) -> Column:
    """NFKD without combining marks, lowered and stripped. Only names beyond ASCII need more than Spark has, and go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(F.trim(c, F.lit(_ASCII_WHITE)))).otherwise(_fold(F.when(~plain, c)))


@F.pandas_udf(T.StringType())
def _fold(names: pd.Series) -> pd.Series:
    def fold(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip()

    return names.map(fold)


def whole(w: Column | str) -> Column:
    """Weight as text without decimals, halves to even."""
    return F.bround(w, 0).cast("bigint").cast("string")


def one_line(c: Column | str) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column | str) -> Column:
    """Letters, digits, dot, underscore and hyphen stay; runs of others become one underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def pipe_safe(c: Column | str) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("|"), F.lit("/"))


def polarity(w: Column | str) -> Column:
    """``négation`` for a negative weight, else ``affirmation`` (a weight of zero affirms)."""
    return F.when((F.col(w) if isinstance(w, str) else w) < 0, "négation").otherwise("affirmation")
