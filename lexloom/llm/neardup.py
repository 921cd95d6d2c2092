"""Near-duplicate documents by MinHash bands, odd sketches and a check on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes), MinHash samples
   of it, band keys, and two odd sketches.  One folds the samples into a bitmap
   by parity, so that the bits in which two sketches differ estimate how many
   samples differ.  The other folds the whole set: its differing bits are never
   more than the shingles in which two sets differ, so it rules pairs out
   without any error, and almost exactly for sets of a few hundred shingles.
2. Texts with equal sets are one *class*; from here on classes stand for them.
3. Classes that share a band key meet that band's pivot (its smallest member).
   Pairs whose lengths or sketches rule the similarity out are dropped, the
   others are checked on their full sets; the links give components.
4. Where one band key still holds several components, all pairs across those
   components are compared in the same way, so that no candidate pair goes
   unchecked unless its ends are connected already.

With 50 bands of 5 samples a pair at the threshold of 0.75 shares no band with
a probability of 1.3e-6; an unlike pair at 0.3 shares one with 0.11.  A class
id is 64 bits of its set: among n classes two collide with probability
n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.membership import may_contain
from lexloom.llm.storage import TEXTS, lean, materialise, packed, unpacked
from lexloom.llm.text import WordHashes, lower_ascii, scrambled

SHINGLE = 5
BANDS, ROWS = 50, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS, SET_BITS = 512, 1024
#: Least similarity of a link, as a fraction of integers.
NUMERATOR, DENOMINATOR = 75, 100
#: Sketches that estimate less than this rule a pair out: five standard deviations below the threshold.
LEAST_ESTIMATE = 0.5

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(0, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FOLD = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_SLOT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    words = lower_ascii(text).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return scrambled(np.array([(w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    n = len(w) - SHINGLE + 1
    total = w[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += w[k : k + n] * _PLACE[k]
    return np.unique(scrambled(total))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch (as int64) of a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        low = np.minimum(low, (_A * x[at : at + 2048] + _B).min(1))
    samples = low.astype(np.uint64)
    keys = scrambled((samples.reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64) + _BAND)
    slots = scrambled(samples * _SLOT + _SLOT) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(slots.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits).view(np.int64)


def set_parity(shingles: np.ndarray) -> np.ndarray:
    """Odd sketch of the whole set (as int64)."""
    places = (shingles % np.uint64(SET_BITS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=SET_BITS) & 1).astype(np.uint8)).view(np.int64)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n, node, bands, bits, parity)`` per row of ``(doc_id, text)``; no words give n = 0 and a null node."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "n", "node", "bands", "bits", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, node, bands, bits, parity = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    found = shingle_set(text, hashes)
                    n.append(len(found))
                    if len(found):
                        b, s = sketch(found)
                        node.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63)
                        bands.append(b)
                        bits.append(s)
                        parity.append(set_parity(found))
                    else:
                        node.append(None)
                        bands.append(None)
                        bits.append(None)
                        parity.append(None)
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, long_list), pa.array(bits, long_list), pa.array(parity, long_list)], names)

    return rows.mapInArrow(lean(run), f"doc_id {kind}, text_key long, n long, node long, bands array<long>, bits array<long>, parity array<long>")


def _possible(a: str, b: str):
    """Neither the lengths nor the sketches of sides ``a`` and ``b`` rule a link out."""

    def differ(bits: str, size: int):
        return sum((F.bit_count(F.col(f"{a}.{bits}")[i].bitwiseXOR(F.col(f"{b}.{bits}")[i])) for i in range(size // 64)), F.lit(0))

    most = SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - LEAST_ESTIMATE) / SKETCH_BITS))
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    lengths = DENOMINATOR * F.least(n_a, n_b) >= NUMERATOR * F.greatest(n_a, n_b)
    # Similar sets differ in at most (1 - t) / (1 + t) of their total size.
    sets = (DENOMINATOR + NUMERATOR) * differ("parity", SET_BITS) <= (DENOMINATOR - NUMERATOR) * (n_a + n_b)
    return lengths & sets & (differ("bits", SKETCH_BITS) <= int(most))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full shingle sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = ends.join(classes.select("node", "min_id"), "node").select(F.col("min_id").alias("doc_id")).distinct()
    ids = materialise(ids, "ids")
    known = docs.select("doc_id", "text").filter(may_contain(ids, ["doc_id"], [F.col("doc_id")]) | F.col("doc_id").isNull())
    wanted = known.join(ids.filter(F.col("doc_id").isNotNull()), "doc_id", "left_semi").unionByName(known.filter(F.col("doc_id").isNull()))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = [shingle_set(t, hashes) for t in batch.column(1).slice(at, 1024).to_pylist()]
                found = [x for x in found if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "shingles"])

    sets = materialise(wanted.mapInArrow(lean(to_sets), "node long, shingles binary").join(ends, "node", "left_semi"), "shingle-sets", TEXTS).dropDuplicates(["node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable over ``edges`` ``(a, b)``, by large-star and small-star rounds until only stars are left."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
        # One row per edge at most; repeats go with those of the second half.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialise(large, "star")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.filter("u <> v").distinct(), "star")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        # A node with two upper ends, or with an upper and a lower one, is in no star.
        if not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("downs")).filter("ups > 1 or ups = 1 and downs = 1").count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` ``(node, root)`` after more ``links`` ``(a, b)``: only the components that these touch are compared again."""
    for side in ("a", "b"):
        at = roots.select(F.col("node").alias(side), F.col("root").alias("known"))
        links = links.join(at, side, "left").withColumn(side, F.coalesce("known", side)).drop("known")
    top = components(links)
    above = top.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(top)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``text_key``, ``n_shingles``, ``component_id``, ``kept`` and ``component`` (null without words).

    ``component_id`` is the smallest id among the rows reachable over links,
    ``kept`` marks the rows with that id.  A null or empty text, or one without
    words, links with nothing.  Ids may repeat or be null: rows are nodes by
    their texts, null ids rank after all others, and a component of null ids
    only has a null ``component_id`` and is kept.  Equal rows get equal
    results.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialise(sketch_documents(docs), "sketches", TEXTS)
    with_words = sketched.filter("n > 0")
    classes = materialise(with_words.groupBy("node").agg(F.min("doc_id").alias("min_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("parity").alias("parity")), "classes")

    members = classes.select("node", F.explode("bands").alias("bucket"))
    bucket = Window.partitionBy("bucket")
    shared = materialise(members.select("bucket", "node", F.min("node").over(bucket).alias("pivot"), F.max("node").over(bucket).alias("last")).filter("pivot < last").drop("last"), "buckets")

    sides = classes.select("node", "n", "bits", "parity")
    a, b = sides.withColumnRenamed("node", "a").alias("l"), sides.withColumnRenamed("node", "b").alias("r")
    stars = shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(b, "b").join(a, "a").filter(_possible("l", "r")).select("a", "b")
    links = materialise(confirm(materialise(stars, "pairs"), classes, docs), "links", TEXTS)
    roots = components(links)

    # Bands that still hold several components: their other pairs.
    placed = materialise(shared.join(roots, "node", "left").select("bucket", "node", "pivot", F.coalesce("root", "node").alias("root")), "placed")
    split = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("bucket")
    rest = placed.join(split, "bucket", "left_semi").filter("node <> pivot").join(sides, "node").select("bucket", "node", "root", F.struct("n", "bits", "parity").alias("side"))
    rest = materialise(rest, "rest")
    one = rest.select("bucket", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("side").alias("l"))
    two = rest.select("bucket", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("side").alias("r"))
    more = one.join(two, "bucket").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _possible("l", "r")).select("a", "b").distinct()
    more = materialise(more, "pairs")
    if more.take(1):
        extra = materialise(confirm(more, classes, docs), "links", TEXTS)
        if extra.take(1):
            roots = joined_components(roots, extra)

    ids = classes.select("node", "min_id")
    linked = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(ids, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("min_id").alias("component_id"))
    found = materialise(linked.join(least, "root").select("node", "root", "component_id"), "components")
    by_class = materialise(ids.join(found, "node", "left").select("node", F.coalesce("component_id", "min_id").alias("component_id"), F.coalesce("root", "node").alias("component")), "classes")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = sketched.select("doc_id", "text_key", "n", "node").join(by_class, "node", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component, columns as they were.

    It is the row of the smallest id (nulls last), of several such rows that of
    the smallest text key, and any one of rows equal in both.  Rows without
    words stay, all of them.  An empty table gives an empty one.
    """
    found = materialise(near_duplicates(docs, id_col, text_col).filter(F.col("component").isNotNull()).select("doc_id", "text_key", "component"), "members")
    # A struct's nulls come first, so a flag puts null ids last.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    best = found.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("n")).filter("n > 1")
    member = found.join(best, "component")
    chosen = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key"))
    by_text = member.groupBy(F.col("doc_id").alias("out_id"), F.col("text_key").alias("out_key")).agg(F.max(chosen).alias("stays"), F.count("*").alias("times"))
    # Rows that go, and rows of which one is to stay of several.
    out = materialise(by_text.filter(~F.col("stays") | (F.col("times") > 1)), "gone")
    own = [docs[id_col], F.xxhash64(docs[text_col])]
    rows = packed(docs, own_id=own[0], own_key=own[1], suspect=may_contain(out, ["out_id", "out_key"], own))
    seen = rows.filter("suspect")
    same = seen["own_id"].eqNullSafe(out["out_id"]) & (seen["own_key"] == out["out_key"])
    kept = seen.join(out.select("out_id", "out_key").hint("merge"), same, "left_anti").select("row")
    one_of = seen.join(out.filter("stays").hint("merge"), same).groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row")
    return unpacked(rows.filter("not suspect").select("row").unionByName(kept).unionByName(one_of), docs.columns)


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least l ON l.doc_id = w.doc_id
"""
