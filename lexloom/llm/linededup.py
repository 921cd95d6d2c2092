"""Line deduplication over content-defined chunks of lines.

A hash that rolls over the hashes of two adjacent lines decides where a chunk
begins, so an insertion moves only the boundaries next to it; a long line (a
passage of its own) is always a chunk.  Besides, from every line that is not
blank the fewest lines that hold :data:`LONG_LINE` words are a chunk, forwards
and backwards; so a repeated passage of that many words is covered from its
first to its last line wherever it stands.

Chunks of several lines, and long lines, whose hash the corpus has more than
once are compared byte by byte: one occurrence, that of the smallest document
and line, stays and the others go.  Chunks may overlap: a removed line always
stays at a smaller place, perhaps next to other lines than in its passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.storage import materialise

#: A boundary falls on one line in so many.
SPACING = 3
#: Words from which a line is a chunk of its own; fewer words than the second make no chunk worth removing.
LONG_LINE, LEAST_WORDS = 50, 5

_WORDS = r"[^\x20\x09-\x0D]+"
KEY = ["doc_id", "text_key"]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def chunks_of(text: Column) -> Column:
    """``array<struct<start, n_lines, n_words, chunk>>`` of a text that is not null, of the chunks that are worth it; starts count lines from 0."""

    def of_lines(lines: Column) -> Column:
        facts = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.regexp_count(x, F.lit(_WORDS)) >= LONG_LINE).alias("long")))
        return _let(facts, lambda f: cut(lines, f))

    def cut(lines: Column, facts: Column) -> Column:
        def begins(i: Column) -> Column:
            this, before = F.get(facts, i), F.get(facts, i - 1)
            # Not right after another boundary, so that chunks have two lines or more.
            return (rolls(i) & ~((i > 1) & rolls(i - 1))) | this.long | before.long

        def rolls(i: Column) -> Column:
            return F.pmod(F.xxhash64(F.get(facts, i - 1).h, F.get(facts, i).h), F.lit(SPACING)) == 0

        n = F.size(lines)
        inner = F.when(n > 1, F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), begins)).otherwise(F.array().cast("array<int>"))
        starts = F.concat(F.array(F.lit(0)), inner)
        return _let(starts, lambda s: F.transform(s, lambda a, k: piece(lines, a, F.coalesce(F.get(s, k + 1), F.size(lines)))))

    def piece(lines: Column, a: Column, b: Column) -> Column:
        text = F.array_join(F.slice(lines, a + 1, b - a), "\n")
        return _let(text, lambda t: F.struct(a.alias("start"), (b - a).alias("n_lines"), F.regexp_count(t, F.lit(_WORDS)).alias("n_words"), t.alias("chunk")))

    return _let(F.split(text, "\n"), lambda x: F.concat(F.filter(of_lines(x), _worth), _passages(x)))


def _passages(lines: Column) -> Column:
    """Per line that is not blank, the fewest such lines from it, and up to it, with :data:`LONG_LINE` words; blank lines do not count."""

    def reach(part: Column) -> Column:
        step = lambda acc, x: F.when(acc.w < LONG_LINE, F.struct((acc.w + x.w).alias("w"), (acc.k + 1).alias("k"))).otherwise(acc)
        return F.aggregate(part, F.struct(F.lit(0).alias("w"), F.lit(0).alias("k")), step)

    def of_full(full: Column) -> Column:
        down = F.transform(full, lambda _, i: _let(reach(F.slice(full, i + 1, F.lit(LONG_LINE))), lambda r: F.struct(i.alias("a"), r.k.alias("k"), r.w.alias("w"))))
        before = lambda i: F.reverse(F.slice(full, F.greatest(i - (LONG_LINE - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(LONG_LINE))))
        up = F.transform(full, lambda _, i: _let(reach(before(i)), lambda r: F.struct((i + 1 - r.k).alias("a"), r.k.alias("k"), r.w.alias("w"))))
        return F.transform(F.filter(F.concat(down, up), lambda s: s.w >= LONG_LINE), lambda s: piece(full, s))

    def piece(full: Column, s: Column) -> Column:
        first, last = F.get(full, s.a).pos, F.get(full, s.a + s.k - 1).pos
        chunk = F.array_join(F.transform(F.slice(full, s.a + 1, s.k), lambda x: x.line), "\n")
        return F.struct(first.alias("start"), (last + 1 - first).alias("n_lines"), s.w.alias("n_words"), chunk.alias("chunk"))

    full = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.regexp_count(x, F.lit(_WORDS)).alias("w"), x.alias("line")))
    return _let(F.filter(full, lambda x: x.w > 0), of_full)


def _worth(c: Column) -> Column:
    return ((c.n_lines > 1) | (c.n_words >= LONG_LINE)) & (c.n_words >= LEAST_WORDS)


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``(doc_id, text_key, n_lines, line_bytes)``, and the occurrences ``(doc_id, text_key, start, n_lines)`` to remove."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    hashed = F.transform(chunks_of(F.col("text")), lambda c: F.struct(c.start.alias("start"), F.xxhash64(c.chunk).alias("h")))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    rows = materialise(keyed.select(*KEY, n_lines.alias("n_lines"), F.transform(F.split("text", "\n"), F.octet_length).alias("line_bytes"), F.when(F.col("text").isNotNull(), hashed).alias("chunks")), "line-chunks")
    places = rows.select(*KEY, F.explode("chunks").alias("c")).select(*KEY, "c.start", "c.h").distinct()
    places = materialise(places, "chunk-places")
    often = materialise(places.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "chunk-hashes")
    suspects = materialise(places.join(often, "h"), "chunk-suspects").groupBy(*KEY).agg(F.collect_set("h").alias("hashes"))
    suspects = materialise(suspects.withColumnsRenamed({c: f"s_{c}" for c in KEY}), "chunk-suspects")
    same = keyed["doc_id"].eqNullSafe(suspects["s_doc_id"]) & (keyed["text_key"] == suspects["s_text_key"])
    # A merge join at every size: the list of suspects grows with the input.
    texts = keyed.join(suspects.hint("merge"), same).select(*KEY, F.explode(F.filter(chunks_of(F.col("text")), lambda c: F.array_contains(F.col("hashes"), F.xxhash64(c.chunk)))).alias("c"))
    texts = materialise(texts.select(*KEY, "c.start", "c.n_lines", "c.chunk", F.xxhash64("c.chunk").alias("h")), "chunk-texts")
    place = F.struct(*KEY, "start")
    first = texts.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    first = materialise(first.select("h", F.col("chunk").alias("first_chunk"), "first"), "chunk-firsts")
    gone = texts.join(first, "h").filter((F.col("chunk") == F.col("first_chunk")) & ~F.col("first").eqNullSafe(place))
    return rows, gone.select(*KEY, "start", "n_lines").distinct()


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``text_key``, ``n_lines``, ``n_removed_lines``, ``n_removed_chunks``, ``removed_bytes`` and ``removed``.

    ``removed`` lists the line ranges to drop as ``start-end`` (end exclusive)
    by start; chunks that overlap or adjoin are one range, and count as one.  A null text has no lines; an empty one has one, empty, line.
    Rows equal in id and text are one document and get equal results; ids may
    be null.  Other columns are ignored.
    """
    rows, gone = repeated_chunks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n_lines")).alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"))))
        return F.when((F.size(done) > 0) & (s.start <= F.get(done, F.size(done) - 1).end), longer).otherwise(F.concat(done, F.array(s)))

    by_doc = gone.groupBy(*KEY).agg(spans.alias("spans")).withColumn("spans", F.aggregate("spans", none, join))
    by_doc = materialise(by_doc.withColumnsRenamed({c: f"g_{c}" for c in KEY}), "removed")
    same = rows["doc_id"].eqNullSafe(by_doc["g_doc_id"]) & (rows["text_key"] == by_doc["g_text_key"])
    out = rows.drop("chunks").join(by_doc, same, "left").withColumn("spans", F.coalesce("spans", none))
    total = lambda of: F.aggregate(F.transform("spans", of), F.lit(0).cast("long"), lambda x, y: x + y)
    lines = lambda s: (s.end - s.start).cast("long")
    # With the line ends inside a range.
    size = lambda s: F.aggregate(F.slice("line_bytes", s.start + 1, s.end - s.start), lines(s) - 1, lambda x, y: x + y)
    return out.select(*KEY, "n_lines", total(lines).alias("n_removed_lines"), F.size("spans").cast("long").alias("n_removed_chunks"), total(size).alias("removed_bytes"), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated chunks cut out of their texts; columns as they were, whatever their names.

    Null texts stay null and empty ones empty.  Rows equal in id and text are
    one document and are cut alike, ids may be null; of equal chunks the one of
    the smallest place stays.  An empty table gives an empty one.
    """
    found = find_repeats(docs, id_col, text_col).filter("n_removed_chunks > 0").select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), "spans").distinct()
    found = materialise(found, "removed")
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col])
    rows = docs.select(rest.alias("row"), docs[id_col].alias("own_id"), docs[text_col].alias("body"), F.xxhash64(docs[text_col]).alias("own_key"))
    joined = rows.join(found, rows["own_id"].eqNullSafe(found["cut_id"]) & (rows["own_key"] == found["cut_key"]), "left")
    kept = F.array_join(F.filter(F.split("body", "\n"), lambda _, i: ~F.exists("spans", lambda s: (s.start <= i) & (i < s.end))), "\n")
    text = F.when(F.col("spans").isNull(), F.col("body")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def report(found: DataFrame) -> DataFrame:
    ranges = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "removed_bytes", ranges.alias("removed"))
