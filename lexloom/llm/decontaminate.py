"""Benchmark decontamination as a prefix-filtered set join.

A window is ``width`` consecutive words of an item (a shorter item is one
window).  Its tokens are shingles of three words; ordered by how rarely the
corpus has them, the rarest is the window's necessary prefix: a document that
contains the window contains that shingle, at a known offset.

1. One scan of the texts counts the shingles that windows have.  A window with
   a shingle that no text has lies nowhere and is dropped.
2. A second scan stores, per text, the places of prefix shingles, each with the
   few words around it that a window could cover.
3. Places and windows are joined by prefix; the offset and the words left to
   the end of the text bound where a window can lie, and all its words are
   compared.

Both scans ask a bitmap of bounded size which shingles matter; where it errs,
the join drops the place.  So the texts are read twice whatever the number of
windows, nothing else of the items travels but by shuffle, and prefixes that
many places share are dealt in parts on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.membership import may_contain
from lexloom.llm.storage import TEXTS, lean, materialise
from lexloom.llm.text import WordHashes, scrambled, words_of

SHINGLE = 3
#: Bits of a bitmap per shingle in it, and at most: 16 MB.
BITS_PER_KEY, MOST_BITS = 16, 1 << 27
#: Places of one prefix that go to one part, at least; and into how many parts all places would be dealt, at most.
PART, MOST_PARTS = 10_000, 4096
#: Words that are hashed in one go, and places in one stored row.
GROUP, PLACES = 100_000, 4096

_rng = np.random.Generator(np.random.PCG64(20250117))
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _shingles(hashes: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every ``k`` consecutive words, and where they begin; ``ends`` are those of the texts, which no shingle crosses."""
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, k, np.uint64)
    inside = np.ones(n, bool)
    for j in range(k):
        total += hashes[j : j + n] * _PLACE[j]
        cut = ends - j
        inside[cut[(cut >= 0) & (cut < n)]] &= j == 0
    return scrambled(total)[inside], np.flatnonzero(inside)


def windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``(item, window)``: the words of every window, joined by blanks."""
    source = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                if words:
                    found = [b" ".join(words[i : i + width]).decode() for i in range(max(1, len(words) - width + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.string()), pa.array(found)], ["item", "window"])

    return source.mapInArrow(lean(run), "item string, window string").distinct()


def window_shingles(numbered: DataFrame) -> DataFrame:
    """``(wid, size, offset, h)``: the shingles of ``(wid, window)``; a window of fewer words than a shingle is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for wid, window in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.fromiter(map(hashes.__getitem__, window.encode().split(b" ")), np.uint64)
                h, at = _shingles(w, np.array([len(w)]), min(SHINGLE, len(w)))
                yield pa.RecordBatch.from_arrays([pa.array([wid] * len(h)), pa.array([len(w)] * len(h), pa.int32()), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], ["wid", "size", "offset", "h"])

    return numbered.mapInArrow(lean(run), "wid long, size int, offset int, h long")


class Bitmap:
    """Which shingle keys may be known: two bits a key, of a number of bits that is bounded whatever the table."""

    def __init__(self, keys: DataFrame, most_bits: int) -> None:
        wanted = BITS_PER_KEY * max(1, keys.count())
        self.mask = min(max(1 << 16, 1 << (wanted - 1).bit_length()), most_bits) - 1
        mask = F.lit(self.mask).cast("long")
        place = keys.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("p"))
        # At most one row per 64 bits of the bitmap.
        rows = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas()
        self.words = np.zeros((self.mask >> 6) + 1, np.int64)
        self.words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        self.words = self.words.view(np.uint64)

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), np.uint64)
        for p in (h & np.uint64(self.mask), (h >> np.uint64(32)) & np.uint64(self.mask)):
            out &= self.words[p >> np.uint64(6)] >> (p & np.uint64(63))
        return (out & np.uint64(1)).astype(bool)


def _grouped(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Word lists of neighbouring texts, some :data:`GROUP` words at a time, with the first one's number."""
    first, found, size = 0, [], 0
    for i in range(len(texts)):
        found.append(words_of(texts[i].as_py()))
        size += len(found[-1])
        if size >= GROUP:
            yield first, found
            first, found, size = i + 1, [], 0
    if found:
        yield first, found


def _known(lists: list[list[bytes]], hashes: WordHashes, sizes: list[int], bitmap: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that may be known, where they begin in all words of ``lists``, and the ends of the lists there."""
    ends = np.cumsum([len(x) for x in lists])
    w = np.fromiter((h for words in lists for h in map(hashes.__getitem__, words)), np.uint64, int(ends[-1]))
    keys, places = [], []
    for k in sizes:
        h, at = _shingles(w, ends, k)
        some = bitmap.test(h)
        keys.append(h[some])
        places.append(at[some])
    return np.concatenate(keys), np.concatenate(places), ends


def shingle_counts(docs: DataFrame, known: DataFrame, sizes: list[int], most_bits: int) -> DataFrame:
    """``(h, n)``: how often the texts have shingles, of those in ``known`` and a few others; shingles never seen are absent."""
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap(known, most_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, waiting, size = WordHashes(), [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, lists in _grouped(batch.column(0)):
                found = _known(lists, hashes, sizes, shared.value)[0]
                waiting.append(found)
                size += len(found)
                if size > 1_000_000:
                    yield counted()
                    waiting, size = [], 0
        if waiting:
            yield counted()

    return docs.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes_of(numbered: DataFrame, shingles: DataFrame, counts: DataFrame, part: int) -> DataFrame:
    """``(h, parts, wid, window, size, offset)``: every window that may occur, under its rarest shingle.

    ``parts`` says into how many parts the places of that shingle are dealt:
    one, but for shingles with more than ``part`` places and more than their
    share of the places of all prefixes.
    """
    n = F.coalesce("n", F.lit(0))
    rarest = shingles.join(counts, "h", "left").groupBy("wid", "size").agg(F.min(F.struct(n.alias("n"), "h", "offset")).alias("least"))
    rarest = materialise(rarest.select("wid", "size", "least.*").filter("n > 0"), "rarest", TEXTS)
    total = rarest.select("h", "n").distinct().agg(F.sum("n")).first()[0] or 0
    share = max(part, -(-total // MOST_PARTS))
    parts = F.ceil(F.col("n") / F.lit(share)).cast("int")
    return materialise(rarest.join(numbered, "wid").select("h", parts.alias("parts"), "wid", "window", "size", "offset"), "prefixes")


def _text(rows: DataFrame, inside: str | None) -> Column:
    return F.col("text") if inside is None else F.col("row").getField(inside)


def stored_places(rows: DataFrame, prefixes: DataFrame, width: int, sizes: list[int], most_bits: int, inside: str | None = None) -> DataFrame:
    """``rows`` (with ``rid`` and ``text``, or the text as field ``inside`` of the column ``row``, so that it travels once), stored with ``n_words``, ``n_places`` and ``places``; all but the first rows of one ``rid`` are null but for places.

    A place is a possible prefix at word ``pos``: its ``part``, the words
    ``around`` it, ``lead`` of them before it, and how many words are ``left``
    in the text from it on.
    """
    # The parts add up to MOST_PARTS beyond one each at most, so this list is bounded.
    hot = {r.h: r.parts for r in prefixes.filter("parts > 1").select("h", "parts").distinct().collect()}
    shared = rows.sparkSession.sparkContext.broadcast((Bitmap(prefixes.select("h").distinct(), most_bits), hot))
    place = pa.struct([("h", pa.int64()), ("part", pa.int32()), ("pos", pa.int32()), ("left", pa.int32()), ("lead", pa.int32()), ("around", pa.string())])
    kept = [c for c in rows.columns if c not in ("rid", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bitmap, hot = shared.value
        for batch in batches:
            text = batch.column("text") if inside is None else batch.column("row").field(inside)
            for first, lists in _grouped(text):
                keys, places, ends = _known(lists, hashes, sizes, bitmap)
                of = np.searchsorted(ends, places, side="right")
                found: list[list[dict]] = [[] for _ in lists]
                for h, at, i in zip(keys.view(np.int64).tolist(), places.tolist(), of.tolist()):
                    words = lists[i]
                    pos = at - int(ends[i]) + len(words)
                    start = max(0, pos - width + 1)
                    around = b" ".join(words[start : pos + width]).decode()
                    part = (first + i + pos) % hot.get(h, 1)
                    found[i].append({"h": h, "part": part, "pos": pos, "left": len(words) - pos, "lead": pos - start, "around": around})
                source, n_words, n_places, lots, rid = [], [], [], [], []
                for i, words in enumerate(lists):
                    for at in range(0, max(1, len(found[i])), PLACES):
                        rid.append(first + i)
                        source.append(first + i if at == 0 else None)
                        n_words.append(len(words) if at == 0 else None)
                        n_places.append(len(found[i]) if at == 0 else None)
                        lots.append(found[i][at : at + PLACES])
                take = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(pa.array(rid)), *[batch.column(c).take(take) for c in kept], pa.array(n_words, pa.int64()), pa.array(n_places, pa.int64()), pa.array(lots, pa.list_(place))],
                    ["rid", *kept, "n_words", "n_places", "places"],
                )

    fields = [T.StructField(f.name, f.dataType) for f in rows.select("rid", *kept).schema]
    more = T.StructType.fromDDL("n_words long, n_places long, places array<struct<h:long,part:int,pos:int,left:int,lead:int,around:string>>")
    return materialise(rows.mapInArrow(lean(run), T.StructType(fields + more.fields)), "places", TEXTS)


def match_windows(rows: DataFrame, items: DataFrame, width: int, item_col: str, item_text_col: str, most_bits: int, part: int, inside: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` with ``rid``, ``n_words`` and ``n_places``; hits ``(rid, wid, part, start, end)``; and ``(wid, part, item)``.

    ``rows`` has ``text`` and any other columns, which are kept but for it; or the text is the field ``inside`` of ``row``.
    A row without places has no hit.
    """
    of_items = materialise(windows(items, width, item_col, item_text_col), "item-windows")
    numbered = materialise(of_items.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()).select("wid", "window"), "windows")
    shingles = materialise(window_shingles(numbered), "window-shingles")
    # At most three numbers.
    sizes = [r.k for r in shingles.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect()] or [SHINGLE]
    counts = shingle_counts(rows.select(_text(rows, inside).alias("text")), shingles.select("h").distinct(), sizes, most_bits)
    prefixes = prefixes_of(numbered, shingles, counts, part)

    stored = stored_places(rows.withColumn("rid", F.monotonically_increasing_id()), prefixes, width, sizes, most_bits, inside)
    dealt = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    begins = (F.col("pos") - F.col("offset")).alias("start")
    there = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("size")), " ")
    fits = (F.col("pos") >= F.col("offset")) & (F.col("left") >= F.col("size") - F.col("offset"))
    places = stored.select("rid", F.explode("places").alias("p")).select("rid", "p.*")
    met = places.join(prefixes.select("h", dealt, "wid", "window", "size", "offset"), ["h", "part"]).filter(fits)
    hits = materialise(met.filter(there == F.col("window")).select("rid", "wid", "part", begins, (begins + F.col("size")).alias("end")), "hits")
    listed = of_items.filter(F.col("item").isNotNull()).join(numbered, "window").join(prefixes.select("wid", dealt), "wid").select("wid", "part", "item")
    return stored.filter(F.col("n_words").isNotNull()).drop("places"), hits, listed


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bits: int = MOST_BITS, part: int = PART) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids with an occurring window), ``contaminated``.

    Null texts have no words and no hits; null or empty items give no window,
    and an item without id marks words but is not listed.  Repeated rows are
    judged one by one; an empty ``items`` table hits nothing.  Texts may be of
    any length: their places are stored in pieces.  Other columns, also ones
    named like the results, are ignored.  ``most_bits`` (a power of two) bounds
    the bitmaps and ``part`` the places of one prefix in one part; neither
    changes the result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stored, hits, listed = match_windows(rows, items, width, item_col, item_text_col, most_bits, part)
    before = F.max("end").over(Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    n_hit = hits.select("rid", "start", "end").distinct().withColumn("fresh", fresh).groupBy("rid").agg(F.sum("fresh").alias("n_hit"))
    by_item = hits.select("rid", "wid", "part").distinct().join(listed, ["wid", "part"]).groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    marked = stored.filter("n_places > 0").join(n_hit, "rid", "left").join(by_item, "rid", "left")
    marked = marked.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    clean = stored.filter("n_places = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    return clean.unionByName(marked).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, part: int = PART) -> DataFrame:
    """The documents without any hit, with all their columns as they were.

    Documents without words have no hit and stay; repeated rows stay or go
    alike; names of columns do not matter; an empty table gives an empty one.
    Only rows that a bitmap of the hit ones lets through are shuffled: most
    texts have some place, as the prefixes' bitmap errs now and then.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    stored, hits, _ = match_windows(rows, items, width, "item_id", "text", most_bits, part, text_col)
    hit = materialise(hits.select("rid").distinct(), "hit-rows")
    marked = stored.select("rid", "row", may_contain(hit, ["rid"], [F.col("rid")]).alias("suspect"))
    suspects = marked.filter("suspect").join(hit.hint("merge"), "rid", "left_anti")
    clean = marked.filter("not suspect").select("row").unionByName(suspects.select("row"))
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def report(found: DataFrame) -> DataFrame:
    """The digest form: item lists as counts and SHA-256."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS width
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM doc_words, widths, unnest(range(1, len(w) - width + 2)) AS t(i) WHERE len(w) >= width),
hits AS (SELECT p.doc_id, p.i, p.width, v.item FROM places p JOIN windows v ON p.win = v.win AND p.width = v.width),
marked AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + width)) AS t(j) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
