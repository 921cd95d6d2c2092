"""Quality rules with n-gram perplexity.

A text is read as lower-case characters.  Every gram of :data:`ORDER` symbols
is packed into a 60-bit key and counted per language over all documents: tasks
send sorted keys with their counts, Spark adds them up.  An interpolated
modified Kneser-Ney model of all orders is computed from the counts with joins
and aggregations (:func:`surprises`); it holds every gram of the corpus, grows
with it, and none of it is cut off.  Each place is judged without its own count
(leaving one out at all orders), so that a document does not vouch for itself.

For scoring, the model is read as sorted arrays of 64-bit hashes with a value
each, in blocks of at most :data:`BLOCK_KEYS` grams; every block is one scan of
the texts that adds to each text's sum.  A document's mean surprise is held
against a lower and an upper bound of its language, taken from the distinct
texts of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.storage import materialise

ORDER = 5
SYMBOL_BITS = 12
#: Code points below this are symbols of their own; those above share as many again, neighbours never one.
PLAIN = 1 << (SYMBOL_BITS - 1)
#: Grams of one broadcast block of the model (12 bytes each).
BLOCK_KEYS = 8_000_000
#: Distinct grams that a counting task holds before it sends them.
HELD_KEYS = 4_000_000
#: Half-width of a language's band in robust standard deviations, and the least half-width in nats per character.
BAND, LEAST_BAND = 7.0, 0.2
#: Width of the bins that the bands' medians are read from, in nats.
BIN = 0.005
#: Languages whose bounds travel in a broadcast; with more of them the bounds are joined by a shuffle.
BROADCAST_LANGS = 100_000

_tokens = re.compile(r"[^ \t-\r]+").findall
_SIGNS = "#*$%&|<>"


def _plain() -> np.ndarray:
    """Symbol of every code point below :data:`PLAIN`: white space is one symbol, digits are another."""
    fold = np.arange(PLAIN)
    fold[[9, 10, 11, 12, 13]] = 32
    fold[48:58] = 48
    return fold.astype(np.int64)


_FOLD = _plain()


def gram_keys(text: str) -> np.ndarray:
    """Packed key of the gram that ends at each character (blanks stand before the text), oldest symbol first."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.full(len(points) + ORDER - 1, 32, np.int64)
    s[ORDER - 1 :] = _FOLD[np.minimum(points, PLAIN - 1)]
    high = points >= PLAIN
    if high.any():
        s[ORDER - 1 :][high] = PLAIN + points[high] % PLAIN
    key = s[: len(points)].copy()
    for k in range(1, ORDER):
        key = (key << SYMBOL_BITS) | s[k : k + len(points)]
    return key


class _Counts:
    """Sorted keys with their counts, of one language."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        fresh, n = np.unique(keys, return_counts=True)
        merged = np.union1d(self.keys, fresh)
        total = np.zeros(len(merged), np.int64)
        total[np.searchsorted(merged, self.keys)] = self.n
        total[np.searchsorted(merged, fresh)] += n
        self.keys, self.n = merged, total


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang_key, gram, n)`` over all rows of ``(text, lang_key)``; a task holds :data:`HELD_KEYS` grams at most, and a batch's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Counts] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        size = 0

        def fold() -> None:
            for lang, parts in waiting.items():
                held.setdefault(lang, _Counts()).add(np.concatenate(parts))
            waiting.clear()

        def send() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c.keys), lang, np.int64)), pa.array(c.keys), pa.array(c.n)], ["lang_key", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if text := text.as_py():
                    waiting.setdefault(lang, []).append(keys := gram_keys(text))
                    size += len(keys)
                if size > 4_000_000:
                    fold()
                    size = 0
                    if sum(len(c.keys) for c in held.values()) > HELD_KEYS:
                        yield from send()
        fold()
        yield from send()

    return docs.select("text", "lang_key").mapInArrow(run, "lang_key long, gram long, n long").groupBy("lang_key", "gram").agg(F.sum("n").alias("n"))


# --- the model ------------------------------------------------------------------------------------------------------

def discounts(levels: list[DataFrame]) -> DataFrame:
    """``(order, lang_key, d1, d2, d3, grams)``: discounts of counts of 1, 2 and 3 or more (Chen and Goodman), kept within the count, and the number of grams."""
    every = [grams.select(F.lit(order).alias("order"), "lang_key", "n") for order, grams in enumerate(levels, 1)]
    counts = reduce(DataFrame.unionByName, every).groupBy("order", "lang_key")
    n = counts.agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("grams"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k: int) -> Column:
        found = k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        usable = (F.col("n1") > 0) & (F.col("n2") > 0)
        return F.when(usable, F.least(F.greatest(F.coalesce(found, F.lit(0.5)), F.lit(0.05)), F.lit(k - 0.01))).otherwise(0.5)

    return n.select("order", "lang_key", *[d(k).alias(f"d{k}") for k in (1, 2, 3)], "grams")


def _chance(lower: Column, less: int) -> Column:
    """Probability of a gram in its context, with ``less`` (0 or 1) of its places left out."""
    n, total = F.col("n") - less, F.col("total") - less
    was = lambda k: (F.col("n") == k).cast("int") * less
    kinds = [F.col("k1") - was(1) + was(2), F.col("k2") - was(2) + was(3), F.col("k3") - was(3)]
    mass = sum((F.col(f"d{i}") * k for i, k in enumerate(kinds, 1)), F.lit(0.0))
    off = F.when(n <= 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    return F.when(total > 0, (n - off) / total + mass / total * lower).otherwise(lower)


def surprises(counts: DataFrame) -> DataFrame:
    """``(lang_key, gram, surprise)`` of counted grams: the negative log probability of each without one of its places.

    Below the top a gram counts the different symbols that stand before it.
    The order below one spreads evenly over a language's symbols and one more.
    """
    levels = [materialise(counts, "grams")]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS * order)) - 1))
        levels.insert(0, materialise(levels[0].groupBy("lang_key", shorter.alias("gram")).agg(F.count("*").alias("n")), "grams"))
    by_order = materialise(discounts(levels), "discounts")
    small = by_order.count() <= BROADCAST_LANGS * ORDER
    below = None
    for order, grams in enumerate(levels, 1):
        kinds = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 2)]
        placed = grams.withColumn("context", F.shiftright("gram", SYMBOL_BITS))
        contexts = placed.groupBy("lang_key", "context").agg(F.sum("n").alias("total"), *[x.alias(f"k{i}") for i, x in enumerate(kinds, 1)])
        less = by_order.filter(F.col("order") == order).drop("order")
        rows = placed.join(contexts, ["lang_key", "context"]).join(F.broadcast(less) if small else less, "lang_key")
        if below is None:
            rows = rows.withColumn("full", 1 / (F.col("grams") + 1)).withColumn("less", F.col("full"))
        else:
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS * (order - 1))) - 1)))
            rows = rows.join(below.withColumnRenamed("gram", "shorter"), ["lang_key", "shorter"])
        # A gram with one place takes it from the shorter gram as well.
        without = _chance(F.when(F.col("n") == 1, F.col("less")).otherwise(F.col("full")), 1)
        if order == ORDER:
            return rows.select("lang_key", "gram", (-F.log(without)).cast("float").alias("surprise"))
        below = materialise(rows.select("lang_key", "gram", _chance(F.col("full"), 0).alias("p"), without.alias("q")).withColumnsRenamed({"p": "full", "q": "less"}), "chances")
    raise AssertionError("ORDER is at least one")


def _hashes(lang: np.ndarray | int, keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of grams of a language."""
    x = keys.astype(np.uint64) ^ np.asarray(lang, np.int64).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class HashArrays:
    """Sorted hashes with a value each; ``starts`` has the place of the first hash of every leading bit pattern."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        self.bits = max(1, len(hashes).bit_length())
        self.starts = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each hash (0 where it is not held), and whether it is held."""
        found = np.zeros(len(hashes), np.float32)
        known = np.zeros(len(hashes), bool)
        if not len(self.hashes):
            return found, known
        place = self.starts[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        ask, todo = hashes, np.arange(len(hashes))
        while len(todo):
            inside = place < len(self.hashes)
            todo, place, ask = todo[inside], place[inside], ask[inside]
            at = self.hashes[place]
            hit = at == ask
            found[todo[hit]], known[todo[hit]] = self.values[place[hit]], True
            more = at < ask  # hashes are sorted: a greater one ends the search
            todo, place, ask = todo[more], place[more] + 1, ask[more]
        return found, known


def model_blocks(model: DataFrame, limit: int = BLOCK_KEYS) -> Iterator[HashArrays]:
    """The model in blocks of about ``limit`` grams or fewer, each collected when it is due."""
    n_blocks = max(1, -(-model.count() // limit))
    for k in range(n_blocks):
        part = model if n_blocks == 1 else model.filter(F.pmod(F.xxhash64("lang_key", "gram"), F.lit(n_blocks)) == k)
        got = part.toArrow()  # one block
        lang, gram, value = (got.column(c).to_numpy() for c in ("lang_key", "gram", "surprise"))
        yield HashArrays(_hashes(lang, gram), value)


# --- documents ------------------------------------------------------------------------------------------------------

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _tokens(text)
    n = len(words)
    dup = 0
    if "\n" in text:
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            seen: set[str] = set()
            for line in lines:
                if line in seen:
                    dup += bool(_tokens(line))
                seen.add(line)
    repeat = 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) < len(grams):
        first: dict[tuple[str, str, str], int] = {}
        covered = bytearray(n)
        for i, g in enumerate(grams):
            j = first.setdefault(g, i)
            if j != i:
                covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
        repeat = sum(covered)
    return n, sum(map(len, words)), sum(map(text.count, _SIGNS)), dup, repeat


def score(docs: DataFrame, block: HashArrays, measured: bool) -> DataFrame:
    """Per row of ``(doc_id, text, lang, lang_key, text_key)`` the sum of the surprises that ``block`` holds, and how many; with the measures if ``measured``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = NAMES if measured else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        for batch in batches:
            sums, hits = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            measures, waiting, size = [], [], 0
            texts, langs = batch.column(1), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if measured:
                    measures.append(text_measures(text))
                if text:
                    waiting.append((i, _hashes(langs[i], gram_keys(text))))
                    size += len(text)
                if waiting and (size > 1_000_000 or i + 1 == batch.num_rows):
                    value, known = arrays.find(np.concatenate([h for _, h in waiting]))
                    ends = np.cumsum([len(h) for _, h in waiting])
                    rows = [k for k, _ in waiting]
                    starts = ends - [len(h) for _, h in waiting]
                    sums[rows] = np.add.reduceat(value, starts, dtype=np.float64)
                    hits[rows] = np.add.reduceat(known, starts, dtype=np.int64)
                    waiting, size = [], 0
            columns = np.array(measures, np.int64).reshape(-1, len(NAMES)).T if measured else []
            kept = [batch.column(k) for k in (0, 2, 4)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c) for c in columns], pa.array(sums), pa.array(hits)], ["doc_id", "lang", "text_key", *names, "total", "hits"])

    return docs.select("doc_id", "text", "lang", "lang_key", "text_key").mapInArrow(run, f"doc_id {kind}, lang string, text_key long, {''.join(f'{n} long, ' for n in names)}total double, hits long")


def scores(rows: DataFrame, model: DataFrame, limit: int = BLOCK_KEYS) -> DataFrame:
    """Measures and mean surprise (null without characters) per row; a block of the model is one scan of the texts."""
    out = None
    for block in model_blocks(model, limit):
        if out is None:
            out = materialise(score(rows, block, True), "surprise")
            continue
        # Rows equal in text and language have equal sums.
        more = score(rows, block, False).groupBy("lang", "text_key").agg(F.first("total").alias("t"), F.first("hits").alias("h"))
        out = materialise(out.join(more, ["lang", "text_key"]).withColumns({"total": F.col("total") + F.col("t"), "hits": F.col("hits") + F.col("h")}).drop("t", "h"), "surprise")
    return out.withColumn("surprise", F.col("total") / F.nullif(F.col("hits"), F.lit(0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", band: float = BAND, least: float = LEAST_BAND, block: int = BLOCK_KEYS) -> DataFrame:
    """Per document the five measures, ``base_failed``, ``kept``, and the perplexity per character with its band.

    A null language is the empty one.  A null or empty text has no words, fails
    the base rule and has no perplexity.  Bands come from the distinct texts
    that pass the base rule; a language without any has no band and rejects
    nothing more.  Repeated rows count and are judged one by one, ids may
    repeat or be null, and texts of any length are read whole.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    rows = rows.withColumns({"text_key": F.xxhash64("text"), "lang_key": F.xxhash64("lang")})
    model = materialise(surprises(count_grams(rows)), "surprises")
    n = F.col("n_words")
    scored = scores(rows, model, block).withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
    judged = scored.filter(~F.col("base_failed") & F.col("surprise").isNotNull()).groupBy("lang", "text_key").agg(F.first("surprise").alias("surprise"))
    limits = materialise(bands(judged, band, least), "bands")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_LANGS else limits
    outside = F.coalesce((F.col("surprise") < F.col("low")) | (F.col("surprise") > F.col("high")), F.lit(False))
    names = {"perplexity": "surprise", "least_perplexity": "low", "most_perplexity": "high"}
    return scored.join(limits, "lang", "left").select("doc_id", *NAMES, "base_failed", (~F.col("base_failed") & ~outside).alias("kept"), *[F.exp(c).alias(x) for x, c in names.items()])


def bands(scored: DataFrame, width: float, least: float) -> DataFrame:
    """``(lang, low, high)``: median plus and minus ``width`` robust deviations of the mean surprise, over all rows given."""
    bins = scored.groupBy("lang", F.floor(F.col("surprise") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins = materialise(bins, "bins")
    centre = _median(bins, "bin").withColumnRenamed("median", "centre")
    away = bins.join(centre, "lang").withColumn("away", F.abs(F.col("bin") - F.col("centre"))).groupBy("lang", "away").agg(F.sum("n").alias("n"))
    spread = _median(away, "away").withColumnRenamed("median", "spread")
    half = F.greatest(F.lit(least), F.lit(width * 1.4826 * BIN) * F.col("spread"))
    return centre.join(spread, "lang").select("lang", ((F.col("centre") + 0.5) * BIN - half).alias("low"), ((F.col("centre") + 0.5) * BIN + half).alias("high"))


def _median(bins: DataFrame, value: str) -> DataFrame:
    """Lower median of ``value`` weighted by ``n``, per language; a language has a bounded number of bins."""
    ordered = Window.partitionBy("lang").orderBy(value)
    total = F.sum("n").over(Window.partitionBy("lang"))
    cut = bins.withColumn("upto", F.sum("n").over(ordered)).withColumn("total", total)
    return cut.filter(2 * F.col("upto") >= F.col("total")).groupBy("lang").agg(F.min(value).alias("median"))
