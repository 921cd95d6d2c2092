"""Fill-in-middle transformation by one repeated-capture match of each text.

``fullmatch`` of ``(unit)*`` with the ``regex`` library keeps every repetition
of the group, so the list of their ends gives the number of units and the
offset behind any of them.  Both cuts and the form of a document depend on its
id alone, so that a lost task makes the same rows again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One code point; any other regular expression without groups may be a unit.
CODE_POINT = r"(?s:.)"


@dataclass(frozen=True)
class Markers:
    """The strings in front of prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def inside(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text


def draws(doc_id: str, seed: str = "1") -> list[int]:
    """Four numbers of 32 bits that depend on the id only."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in range(0, 16, 4)]


@dataclass(frozen=True)
class Transform:
    """Turns a text into its parts; ``plain`` and ``spm`` are percentages."""

    unit: str = CODE_POINT
    markers: Markers = Markers()
    seed: str = "1"
    plain: int = 10
    spm: int = 20

    def compiled(self) -> regex.Pattern:
        return regex.compile(f"({self.unit})*+", regex.V1)

    def apply(self, pattern: regex.Pattern, doc_id: str, text: str) -> tuple[int, str, int | None, int | None]:
        """Units, form, and the code points of prefix and middle (None if the text stays plain)."""
        match = pattern.fullmatch(text)
        ends = match.ends(1) if match else []
        n = len(ends)
        h1, h2, h3, h4 = draws(doc_id, self.seed)
        if not n or self.markers.inside(text) or h3 % 100 >= 100 - self.plain:
            return n, "plain", None, None
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        first, second = (ends[k - 1] if k else 0 for k in (a, b))
        return n, "spm" if h4 % 100 < self.spm else "psm", first, second - first

    def written(self, text: str, form: str, prefix: int | None, middle: int | None) -> str:
        """The text in its form."""
        if form == "plain":
            return text
        m = self.markers
        head, inner, tail = text[:prefix], text[prefix : prefix + middle], text[prefix + middle :]
        if form == "psm":
            return f"{m.prefix}{head}{m.suffix}{tail}{m.middle}{inner}"
        return f"{m.suffix}{tail}{m.prefix}{head}{m.middle}{inner}"

    def restored(self, output: str, form: str) -> str:
        """The exact text again, from output and form alone."""
        if form == "plain":
            return output
        m = self.markers
        order = (m.prefix, m.suffix) if form == "psm" else (m.suffix, m.prefix)
        one, rest = output.removeprefix(order[0]).split(order[1], 1)
        two, inner = rest.split(m.middle, 1)
        head, tail = (one, two) if form == "psm" else (two, one)
        return head + inner + tail


def fill_in_middle(docs: DataFrame, transform: Transform = Transform(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars``, ``output`` and ``restored``.

    A null text counts as empty; an empty text, one that holds a marker, and
    one that is not wholly made of units (``n`` is 0 then) stay plain.  A null
    id draws as an empty one does.  Every row gives one row, repeated ones
    alike; an empty table gives an empty result.  Texts are matched whole: the
    match keeps some 60 bytes a unit while its text is in work.  Other
    columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = transform.compiled()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                cut = [transform.apply(pattern, *pair) for pair in zip(keys, texts)]
                outputs = [transform.written(text, *c[1:]) for text, c in zip(texts, cut)]
                back = [transform.restored(output, c[1]) for output, c in zip(outputs, cut)]
                n, form, prefix, middle = zip(*cut)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def report(found: DataFrame) -> DataFrame:
    """The result with digests in place of the texts."""
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), numbers AS (
  SELECT doc_id, text, n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 AS h4 FROM drawn
), forms AS (
  SELECT doc_id, text, n, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substr(text, 1, p) AS head, substr(text, p + 1, q - p) AS inner_part, substr(text, q + 1) AS tail FROM forms
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || inner_part ELSE '<S>' || tail || '<P>' || head || '<M>' || inner_part END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
