"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score of a document with features x: sigmoid of ``b + w.x`` plus the sum over
all feature pairs of ``<v_i, v_j> x_i x_j``, computed in linear time as half of
``sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2``.  Features are built on the
executors, metadata from the text too; a bounded sample of labelled rows trains
the machine on the driver and calibrates its score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.storage import TEXTS, batches_of, lean, packed, unpacked

#: Word buckets; structure statistics and metadata take the places after them.
BUCKETS = 1 << 16
RANK = 8
#: Labelled rows that train the machine at most (the ones with the smallest hash of their id).
SAMPLE = 4000
#: Mini-batches at most, how many lie between two looks at the rows set aside, and after how many without a gain there training stops.
STEPS, LOOK, PATIENCE = 1000, 25, 150
#: Score from which a document counts as good.
THRESHOLD = 0.7

_tokens = re.compile(r"[^ \t-\r]+").findall
STATISTICS = ["bias", "log_words", "mean_word", "symbols", "signs_per_word", "bangs", "bars", "digits", "upper", "words_per_line", "distinct_words", "distinct_lines", "stops", "non_ascii", "echoes"]
#: Metadata that every document has, whatever its table says: its size in characters and lines.
METADATA = ["log_chars", "log_lines"]
WIDTH = BUCKETS + len(STATISTICS) + len(METADATA)


class _Buckets(dict):
    """Bucket of a word, with the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


def structure(text: str, words: list[str]) -> list[float]:
    """The statistics of :data:`STATISTICS` and :data:`METADATA`, each about 0 to 1."""
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = text.split("\n")
    joined = max(sum(map(len, words)), 1)
    upper = len(re.findall(r"[A-Z]", text))
    return [
        1.0,
        np.log1p(len(words)) / 10,
        min(joined / n / 12, 2.0),
        sum(map(text.count, "#*$%&<>")) / chars * 10,
        min(sum(map(text.count, "#*$%&<>")) / n, 3.0) / 3,
        min(text.count("!") / n, 2.0) / 2,
        min(text.count("|") / n, 1.0),
        len(re.findall(r"[0-9]", text)) / chars * 5,
        upper / joined,
        min(n / len(lines), 100.0) / 100,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        sum(map(text.count, ".,;")) / n,
        1 - len(text.encode("ascii", "ignore")) / chars,
        sum(map(str.__eq__, words, words[1:])) / n,
        # Metadata.
        np.log1p(len(text)) / 12,
        np.log1p(len(lines)) / 8,
    ]


def featurise(text: str | None, buckets: dict[str, int]) -> tuple[list[int], list[float]]:
    """Places and values of a text's features: words by square root of their share, then statistics and metadata."""
    text = text or ""
    words = _tokens(text)
    counts = Counter(map(buckets.__getitem__, words))
    norm = float(len(words) or 1)
    return [*counts, *range(BUCKETS, WIDTH)], [*[(c / norm) ** 0.5 for c in counts.values()], *structure(text, words)]


@dataclass
class FactorisationMachine:
    """Weights of single features and their low-rank interactions."""

    w: np.ndarray
    v: np.ndarray
    #: Calibration of the log-odds.
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-odds of ragged rows: row r has the features from ``starts[r]`` on; no row is empty."""
        linear = np.add.reduceat(self.w[places] * values, starts)
        vx = self.v[places] * values[:, None]
        return linear + 0.5 * (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)).sum(1)

    def score(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(places, values, starts) + self.offset, -30, 30)))


def _ragged(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and starts of rows that are not empty."""
    sizes = np.array([len(p) for p, _ in rows])
    return np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float32), np.cumsum(sizes) - sizes


def log_loss(raw: np.ndarray, labels: np.ndarray) -> float:
    """Mean loss of log-odds after their best calibration, as the score is calibrated too."""
    a, b = calibrate(raw, labels)
    z = np.clip(a * raw + b, -30, 30)
    return float(np.mean(np.logaddexp(0, z) - labels * z))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, aside: list[tuple[np.ndarray, np.ndarray]] = (), aside_labels: np.ndarray | None = None, seed: int = 7, steps: int = STEPS, rank: int = RANK, batch: int = 64, rate: float = 0.05, decay: float = 1e-5) -> FactorisationMachine:
    """Log-loss by AdaGrad over seeded mini-batches; no rows, or one class only, gives that class's rate.

    Of the machines met every :data:`LOOK` mini-batches the one with the least
    loss on the rows ``aside`` is the result, so how long to train is decided
    by training rows alone.  Without such rows all ``steps`` are taken.
    """
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, rank)).astype(np.float32))
    if not len(rows):
        return fm
    p = np.clip(labels.mean(), 0.01, 0.99)
    fm.w[BUCKETS] = np.log(p / (1 - p))
    gw, gv = np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, rank), 1e-2, np.float32)
    held = _ragged(aside) if len(aside) else None
    best, best_loss, best_step, step = None, np.inf, 0, 0
    order: list[int] = []
    while step < steps and step - best_step < (PATIENCE if held else steps):
        if not len(order):
            order = rng.permutation(len(rows))
        part, order = order[:batch], order[batch:]
        step += 1
        places, values, starts = _ragged([rows[i] for i in part])
        sizes = np.diff(np.append(starts, len(places)))
        vx = fm.v[places] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        raw = np.add.reduceat(fm.w[places] * values, starts) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, starts)).sum(1)
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
        each = np.repeat(error, sizes) * values
        by_pair = each[:, None] * (np.repeat(sums, sizes, 0) - vx)
        touched, of = np.unique(places, return_inverse=True)
        dw = np.bincount(of, each) + decay * fm.w[touched]
        dv = np.stack([np.bincount(of, by_pair[:, f]) for f in range(rank)], 1) + decay * fm.v[touched]
        gw[touched] += dw**2
        gv[touched] += dv**2
        fm.w[touched] -= rate * dw / np.sqrt(gw[touched])
        fm.v[touched] -= rate * dv / np.sqrt(gv[touched])
        if held and step % LOOK == 0:
            loss = log_loss(fm.raw(*held), aside_labels)
            if loss < best_loss:
                best, best_loss, best_step = FactorisationMachine(fm.w.copy(), fm.v.copy()), loss, step
    return best or fm


def held_out(id_col: str):
    """Rows whose labels are never learnt: CRC-32 of the id as text leaves 2 on division by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def calibrate(raw: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that make log-odds into probabilities (Platt: smoothed targets, Newton steps)."""
    good = float(labels.sum())
    bad = len(labels) - good
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        gradient = np.array([((p - target) * raw).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        curve = np.array([[(v * raw * raw).sum() + 1e-6, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """Train on at most ``sample`` labelled rows outside the held-out fold; every fifth of them decides how long, and calibrates.

    Rows without text, id or label are left out.  Of several labels of one id
    the smallest counts, of several texts the first in order, so the driver
    gets one row of at most :data:`WIDTH` features per id.  Without labelled
    rows the machine gives every text one half.
    """
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    by_id = labels.filter(usable).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("double")).alias("label"))
    chosen = by_id.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")  # at most ``sample`` rows are broadcast
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for b in batches:
            found = [featurise(x, buckets) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))], ["id", "label", "places", "values"])

    kind = rows.schema["id"].dataType.simpleString()
    with batches_of(docs.sparkSession, TEXTS):
        got = rows.mapInArrow(lean(run), f"id {kind}, label double, places array<int>, values array<float>").toPandas().sort_values("id", kind="stable")
    features = [(np.asarray(p), np.asarray(v)) for p, v in zip(got["places"], got["values"])]
    truth = got["label"].to_numpy(float)
    aside = np.arange(len(features)) % 5 == 4
    held = [x for x, a in zip(features, aside) if a]
    machine = train([x for x, a in zip(features, aside) if not a], truth[~aside], held, truth[aside])
    if held:
        machine.slope, machine.offset = calibrate(machine.raw(*_ragged(held)), truth[aside])
    return machine


def _verdict(machine: FactorisationMachine, text: Column, threshold: float) -> Column:
    """``struct<score, predicted>`` of a text."""
    shared = SparkSession.active().sparkContext.broadcast(machine)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets, fm = _Buckets(), shared.value
        for texts in batches:
            scores = np.zeros(len(texts))
            for at in range(0, len(texts), 64):
                found = [featurise(x, buckets) for x in texts.slice(at, 64).to_pylist()]
                sizes = np.array([len(p) for p, _ in found])
                scores[at : at + 64] = fm.score(np.concatenate([p for p, _ in found]).astype(np.int64), np.concatenate([v for _, v in found]).astype(np.float32), np.cumsum(sizes) - sizes)
            yield pa.StructArray.from_arrays([pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["score", "predicted"])

    # Arrow and not pandas, which would hold all texts of a batch a second time.
    judge = F.arrow_udf(lean(judge), "struct<score:double,predicted:int>")
    return judge.asNondeterministic()(text)  # else a filter on the verdict would be run twice


def score(docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only the text is an input.  Null and empty texts get the score of an empty
    text, texts of any length are read whole.  Every row is scored, repeated
    ones alike, and null ids are kept; an empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), _verdict(machine, F.col(text_col), threshold).alias("verdict"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "verdict.score", "verdict.predicted")


def accepted(docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, columns as they were; nulls and repeats as in :func:`score`."""
    judged = packed(docs, verdict=_verdict(machine, docs[text_col], threshold))
    return unpacked(judged.filter("verdict.predicted = 1"), docs.columns)
