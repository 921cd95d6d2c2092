"""Licence scan with ordered signature rules.

Texts without any rule's stem are passed over by plain substring tests.  The
rest are brought to lower-case words, each carrying its number, and only the
rules whose keyword occurs run their regular expression; the numbers in a
match say which words it covers.  Of two detections of which one covers the
other's words, the one with the smaller priority number stays; with the same
number the wider one, and for the very same words the earlier rule.  Four base phrases are
counted apart from the rules and always stay.

All of it is one expression per row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.license_rules import RULES, Rule, stem
from lexloom.llm.text import JAVA_WORD, WORD

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _numbered(pattern: str) -> str:
    """A word pattern as it stands in numbered text: ``3:mit  4:license`` (two blanks between words)."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "[":  # a class is copied as it stands
            j = pattern.index("]", i + 2)
            out.append(pattern[i : j + 1])
            i = j + 1
            continue
        if pattern[i] == " ":
            optional = pattern[i + 1 : i + 2] == "?"
            out.append("(?:  [0-9]+:)?" if optional else "  [0-9]+:")
            i += 2 if optional else 1
            continue
        out.append(pattern[i])
        i += 1
    return "(?:^| )[0-9]+:" + "".join(out) + "(?: |$)"


def most_words(rules: list[Rule]) -> int:
    """Words that a match of any rule has at most: every blank of a pattern parts two words."""
    return max((r.pattern.count(" ") + 1 for r in rules), default=1)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _place(match: Column) -> Column:
    """``struct<start, end>`` of a match in numbered text, in words, end exclusive."""
    words = F.split(F.trim(match), "  ")
    start = F.substring_index(words[0], ":", 1).cast("int")
    return F.struct(start.alias("start"), (start + F.size(words)).alias("end"))


def _hits(rules: list[Rule]) -> Column:
    """Rules with a match, from columns ``words`` and ``numbered``: their facts and the ``found`` texts.

    Every pattern is a literal, so it is compiled once a task.  It is one SQL
    expression, as hundreds of rules are slow to build call by call.
    """

    def tried(r: Rule) -> str:
        facts = f"'number', {r.number}, 'priority', {r.priority}, 'confidence', {r.confidence}D, 'label', r'{r.label}'"
        return f"named_struct({facts}, 'found', if(contains(t.w, r'{r.keyword}'), regexp_extract_all(t.n, r'{_numbered(r.pattern)}', 0), null))"

    every = ", ".join(map(tried, rules)) or "named_struct('number', 0, 'priority', 0, 'confidence', 0D, 'label', '', 'found', array(''))"
    return F.expr(f"transform(array(named_struct('w', words, 'n', numbered)), t -> filter(array({every}), r -> size(r.found) > 0))[0]")


def _detections(hits: Column) -> Column:
    """Detections of all rules, ordered by start, longest first, then rank."""

    def detection(r: Column, match: Column) -> Column:
        return _let(_place(match), lambda p: F.struct(p.start.alias("start"), (-p.end).alias("minus_end"), r.priority.alias("priority"), r.number.alias("number"), r.label.alias("label"), r.confidence.alias("confidence")))

    return F.array_sort(F.flatten(F.transform(hits, lambda r: F.transform(r.found, lambda m: detection(r, m)))))


def _outranks(g: Column, h: Column) -> Column:
    """Detection ``g`` suppresses ``h``."""
    covers = (g.start <= h.start) & (g.minus_end <= h.minus_end)
    covered = (h.start <= g.start) & (h.minus_end <= g.minus_end)
    same = covers & covered
    return ((covers | covered) & (g.priority < h.priority)) | (covers & (g.priority == h.priority) & (~same | (g.number < h.number)))


def _survivors(found: Column, rules: list[Rule]) -> Column:
    """Detections that no other suppresses; each is held against those near it in the order of starts."""
    widest = most_words(rules)

    def spans(step: int) -> Column:
        """Detections that are ``step`` apart in the order never overlap."""
        return F.forall(F.sequence(F.lit(0), F.size(found)), lambda i: F.coalesce(F.get(found, i + step).start - F.get(found, i).start >= widest, F.lit(True)))

    def among(reach: Column) -> Column:
        near = lambda i: F.slice(found, F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1)
        return F.filter(found, lambda h, i: ~F.exists(near(i), lambda g: _outranks(g, h)))

    reach = F.lit(widest * len(rules))  # no more detections can start within one match
    for step in (512, 64, 8):
        reach = F.when(spans(step), step).otherwise(reach)
    return _let(reach, among)


def _base_places(phrase: str, label: str) -> Column:
    matches = F.regexp_extract_all("numbered", F.lit(_numbered(phrase)), F.lit(0))
    return F.transform(matches, lambda m: _let(_place(m), lambda p: F.struct(p.start.alias("start"), p.end.alias("end"), F.lit(label).alias("label"))))


def may_match(text: Column, rules: list[Rule]) -> Column:
    """Some rule's stem, or a base phrase's, occurs in the text."""
    stems = sorted({stem(r) for r in rules if stem(r) != "cc"} | {"licen"})

    def of_lower(low: Column) -> Column:
        out = F.contains(low, F.lit(stems[0]))
        for s in stems[1:]:
            out = out | F.contains(low, F.lit(s))
        return out | (F.contains(low, F.lit("cc")) & low.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))

    return _let(F.lower(text), of_lower)


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``base`` (phrase places) and ``kept`` (detections that no other suppresses).

    A null or empty text has no words and no detections.  Every row is read by
    itself: repeated rows and null ids are as any other.  Other columns are
    ignored.  Texts are read whole, whatever their length.
    """
    rules = RULES if rules is None else rules
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_words = F.regexp_count("text", F.lit(JAVA_WORD)).cast("long")
    words = F.trim(F.regexp_replace(F.translate("text", _UPPER, _LOWER), _GAP, " "))
    gated = rows.select("doc_id", n_words.alias("n_words"), F.when(may_match(F.col("text"), rules), words).alias("words"))
    numbered = F.array_join(F.transform(F.split("words", " "), lambda x, i: F.concat(i.cast("string"), F.lit(":"), x)), "  ")
    hits = gated.withColumn("numbered", numbered).withColumn("hits", F.when(F.col("numbered").isNotNull(), _hits(rules)))
    base = F.concat(*[_base_places(phrase, label) for phrase, label in BASE.items()])
    kept = _let(_detections(F.col("hits")), lambda found: _survivors(found, rules))
    return hits.select("doc_id", "n_words", base.alias("base"), kept.alias("kept"))


def report(found: DataFrame) -> DataFrame:
    """The digest form of :func:`scan_licenses`."""
    none = F.array().cast("array<string>")
    labels = lambda c: F.coalesce(F.transform(c, lambda x: x.label), none)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("base", lambda b: b.start)
    n_base = F.coalesce(F.size("base"), F.lit(0)).cast("long")
    best = F.greatest(F.array_max(F.transform("kept", lambda k: k.confidence)), F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)))
    return found.select("doc_id", "n_words", n_base.alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), joined(labels("base")).alias("base_labels"), joined(F.concat(labels("base"), labels("kept"))).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql(rules: list[Rule] | None = None) -> str:
    """The report as DuckDB SQL: every rule tried on every document's numbered words, without the keywords that spare most of that."""
    rules = RULES if rules is None else rules
    table = ",\n".join(f"({r.number}, {r.priority}, {r.confidence}, {_quoted(r.label)}, {_quoted(_numbered(r.pattern))})" for r in rules)
    base = ",\n".join(f"({_quoted(label)}, {_quoted(_numbered(phrase))})" for phrase, label in BASE.items())
    return rf"""
WITH rules(number, priority, confidence, label, pattern) AS (VALUES {table}),
base_rules(label, pattern) AS (VALUES {base}),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
numbered AS (
  SELECT doc_id, (SELECT string_agg((i - 1) || ':' || w[i], '  ' ORDER BY i) FROM unnest(range(1, len(w) + 1)) AS t(i)) AS line
  FROM docs WHERE len(w) > 0),
base AS (
  SELECT doc_id, label, CAST(split_part(trim(m), ':', 1) AS BIGINT) AS s
  FROM numbered, base_rules, unnest(regexp_extract_all(line, pattern)) AS t(m)),
found AS (
  SELECT doc_id, number, priority, confidence, label, CAST(split_part(trim(m), ':', 1) AS BIGINT) AS s,
    CAST(split_part(trim(m), ':', 1) AS BIGINT) + len(string_split(trim(m), '  ')) AS e
  FROM numbered CROSS JOIN rules, unnest(regexp_extract_all(line, pattern)) AS t(m)),
kept AS (
  SELECT * FROM found h WHERE NOT EXISTS (
    SELECT 1 FROM found g WHERE g.doc_id = h.doc_id AND (
      (g.priority < h.priority AND ((g.s <= h.s AND g.e >= h.e) OR (h.s <= g.s AND h.e >= g.e)))
      OR (g.priority = h.priority AND g.s <= h.s AND g.e >= h.e AND (g.s <> h.s OR g.e <> h.e OR g.number < h.number))))),
by_base AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi FROM base GROUP BY doc_id),
base_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id),
all_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names
  FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM kept) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, CAST(confidence AS DOUBLE) AS c FROM kept UNION ALL SELECT doc_id, CAST({BASE_CONFIDENCE} AS DOUBLE) FROM base) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(x.names, '') AS base_labels, coalesce(y.names, '') AS labels, coalesce(best.c, 0.0) AS score
FROM docs d LEFT JOIN by_base b USING (doc_id) LEFT JOIN base_names x USING (doc_id) LEFT JOIN all_names y USING (doc_id) LEFT JOIN best USING (doc_id)
"""
