"""Toxicity: a linear-chain conditional random field tags toxic spans, their marginals score the document.

Labels stand on documents, the field needs labelled tokens.  A word of a
labelled document counts as toxic if the document is and the word, or one of
its beginnings, is bound to toxic documents: rarer in clean ones than
:data:`PURITY` allows, and so by more than chance among all that were tried.
Near copies count once there.  The field has two tags; what speaks for a tag is
a sum over hashed features of a word and its neighbours, so each distinct word
is looked at once a worker, and a chain is solved by one ratio a token.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.quality import calibrate

#: Labelled rows that train the field at most, half of them toxic (those with the smallest hash of their id).
SAMPLE = 4000
#: Hashed features, for a word itself, the word to its left and the word to its right.
BUCKETS = 1 << 18
#: Steps of training, on pieces of at most so many tokens; the part of a word's features that a step sees, so that unseen words with some of them are known too.
STEPS, PIECE, SEEN = 40, 128, 0.5
#: Tokens that a step looks at in one go, and texts that are gathered so: they bound what the driver holds besides the texts.
BLOCK, GATHERED = 1 << 16, 128
#: Share of a seed's documents that are toxic, both kinds taken as equally many; share of false seeds that is borne.
PURITY, FALSE_SEEDS = 0.98, 0.02
#: Length of the word beginnings that may be seeds.
BEGINNINGS = range(4, 8)
THRESHOLD = 0.7
#: Sum of fourth powers of marginals below which documents look alike.
FLOOR = 0.01
#: Distinct words that a worker remembers before it starts anew.
CACHE_SIZE = 400_000

_word = re.compile(r"[^\W\d_]+")
words_of = _word.findall


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt: CRC-32 of the id as text leaves 1 on division by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Numbers(dict):
    """Words in the order in which they were first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, found: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))


def features(word: str) -> list[int]:
    """Buckets of a word: its shape and length, itself, its beginnings and endings (of so many bytes)."""
    low = word.lower()
    b = low.encode("utf-8", "surrogatepass")
    n, crc = len(b), zlib.crc32
    shape = 0 if word == low else 1 if word[1:] == low[1:] else 2
    found = [crc(b, 1), *[crc(b[:k], 2) for k in range(2, min(8, n))], *[crc(b[-k:], 3) for k in range(2, min(5, n))]]
    return [shape, 3 + min(n, 12), *[16 + h % (BUCKETS - 16) for h in found]]


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token of sequences that follow one another stands if all first tokens come first, then all second ones; and where each of these ranks begins."""
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    longest = int(sizes.max(initial=0))
    active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
    begins = np.concatenate([[0], np.cumsum(active)])
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return begins[at] + np.repeat(rank, sizes), begins


def forward_backward(odds: np.ndarray, begins: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios toxic : clean of the forward and the backward weights, by rank of token; ``odds`` are the tokens' own, ``move[i, j]`` weighs a step from tag i to tag j."""
    (t00, t01), (t10, t11) = move
    fore, back = odds.copy(), np.ones(len(odds))
    steps = len(begins) - 1
    if steps:
        fore[: begins[1]] *= start
    for t in range(1, steps):
        here, to = begins[t], begins[t + 1]
        r = fore[begins[t - 1] : begins[t - 1] + to - here]
        fore[here:to] *= (t01 + t11 * r) / (t00 + t10 * r)
    for t in range(steps - 1, 0, -1):
        here, to = begins[t], begins[t + 1]
        r = odds[here:to] * back[here:to]
        back[begins[t - 1] : begins[t - 1] + to - here] = (t10 + t11 * r) / (t00 + t01 * r)
    return fore, back


@dataclass
class Field:
    """Weights of the features by role (own, left, right), of the steps between tags, and of the document's score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, BUCKETS), np.float32))
    bias: float = -6.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    offset: float = 0.0

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Chance of the toxic tag for every token of the sequences."""
        to, begins = ragged(sizes)
        odds = np.empty(len(emissions))
        odds[to] = np.exp(np.clip(emissions, -30, 30))
        fore, back = forward_backward(odds, begins, np.exp(self.start), np.exp(self.moves))
        both = fore * back
        return (both / (1 + both))[to]

    def score(self, gathered: np.ndarray) -> np.ndarray:
        """Of documents, from their sums of fourth powers of marginals."""
        return 1 / (1 + np.exp(-(self.slope * np.log(gathered + FLOOR) + self.offset)))


class Emissions:
    """What each word says about its own tag and about its neighbours'; remembers the words of late."""

    def __init__(self, model: Field) -> None:
        self.model = model
        self.number = _Numbers()
        self.of = np.zeros((3, 0))

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Emission of every token and the number of tokens of every text."""
        if len(self.number) > CACHE_SIZE:
            self.number, self.of = _Numbers(), np.zeros((3, 0))
        number, found = self.number, [words_of(t) if t else [] for t in texts]
        known = len(number)
        codes = number.of(found)
        if len(number) > known:
            fresh = [features(w) for w in list(number)[known:]]
            sizes = np.array([len(f) for f in fresh])
            self.of = np.hstack([self.of, np.add.reduceat(self.model.weights[:, np.concatenate(fresh)].astype(float), np.cumsum(sizes) - sizes, 1)])
        sizes = np.array([len(words) for words in found], np.int64)
        return _joined(self.of, codes, sizes) + self.model.bias, sizes


def _joined(of: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own emissions plus those of left and right neighbours in the same sequence."""
    out = of[0][codes]
    if len(codes) > 1:
        inside = np.ones(len(codes), bool)
        inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        out[1:] += np.where(inside[1:], of[1][codes[:-1]], 0)
        out[:-1] += np.where(inside[1:], of[2][codes[1:]], 0)
    return out


def _copies(found: list[list[str]]) -> np.ndarray:
    """A weight for each text: one over the texts that share one of four least hashes of its word triples with it."""
    weight = np.ones(len(found))
    least = np.zeros((len(found), 4), np.uint64)
    for i, words in enumerate(found):
        codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] or [0], np.uint64)
        triple = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9) if len(codes) > 2 else codes
        for k in range(4):
            mixed = (triple ^ (triple >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            least[i, k] = (mixed ^ (mixed >> np.uint64(32))).min()
    for k in range(4):
        seen = Counter(least[:, k].tolist())
        weight = np.minimum(weight, [1 / seen[h] for h in least[:, k].tolist()])
    return weight


def seeds(found: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words, and beginnings of words with ``*`` behind, that are bound to toxic texts.

    A candidate's chance of being so often in toxic texts is bounded by its
    divergence from their share; those are taken that keep the expected share
    of false ones at :data:`FALSE_SEEDS` (Benjamini and Hochberg).
    """
    weight = _copies(found)
    total = [float(weight[~toxic].sum()), float(weight[toxic].sum())]
    if not total[0] or not total[1]:
        return set()
    number = _Numbers()
    keys = []
    for words in found:
        low = {x.lower() for x in words}
        keys.append(np.fromiter((number[k] for k in low | {f"{x[:k]}*" for x in low for k in BEGINNINGS if k < len(x)}), np.int32))
    flat, n_keys = np.concatenate(keys), [len(k) for k in keys]
    clean_of, toxic_of = (np.bincount(flat, np.repeat(weight * kind, n_keys), len(number)) for kind in (~toxic, toxic))
    rate = total[1] / sum(total)
    tested = []
    for key, b, a in zip(number, clean_of.tolist(), toxic_of.tolist()):
        share = a / (a + b)
        if share > rate:
            chance = -(a + b) * (share * np.log(share / rate) + ((1 - share) * np.log((1 - share) / (1 - rate)) if b else 0))
            tested.append((chance, key, a / total[1] / (a / total[1] + b / total[0])))
    tested.sort()
    passed = [i for i, (chance, _, _) in enumerate(tested) if chance <= np.log(FALSE_SEEDS * (i + 1) / len(number))]
    return {key for _, key, purity in tested[: max(passed, default=-1) + 1] if purity >= PURITY}


def is_seed(word: str, chosen: set[str]) -> bool:
    low = word.lower()
    return low in chosen or any(f"{low[:k]}*" in chosen for k in BEGINNINGS if k < len(low))


def train(texts: list[str], toxic: np.ndarray, rate: float = 0.4, decay: float = 1e-6, seed: int = 7) -> Field:
    """Tags by :func:`seeds`; then the likelihood of the tags is raised by adaptive steps over all pieces."""
    model = Field()
    pool: dict[str, str] = {}
    found = [[pool.setdefault(w, w) for w in words_of(t)] for t in texts]  # a word's text once, however often it stands
    chosen = seeds(found, toxic)
    if not chosen:
        return model
    number = _Numbers()
    codes = number.of(found)
    seed_word = np.array([is_seed(w, chosen) for w in number], bool)
    truth = seed_word[codes] & np.repeat(toxic, [len(w) for w in found])
    sizes = np.array([n for words in found for n in [PIECE] * (len(words) // PIECE) + [len(words) % PIECE] if n], np.int64)
    by_word = [features(w) for w in number]
    counts = np.array([len(f) for f in by_word])
    flat, word_starts = np.concatenate(by_word), np.cumsum(counts) - counts
    del found, pool
    blocks = [_Block(codes[i:j], truth[i:j].astype(float), own) for i, j, own in _blocks(sizes)]
    truth_step = sum(block.truth_step for block in blocks)
    speed = np.zeros_like(model.weights)
    small = np.zeros(6)
    n, rng = len(codes), np.random.default_rng(seed)
    for _ in range(STEPS):
        seen = rng.random(len(flat)) < SEEN
        of = np.stack([np.add.reduceat(model.weights[role, flat] * seen, word_starts) for role in range(3)])
        per_word, g, steps = np.zeros((3, len(number))), np.zeros(2), np.zeros((2, 2))
        for block in blocks:
            steps += block.look(model, of, per_word, g)
        for role in range(3):
            gw = np.bincount(flat, np.repeat(per_word[role], counts) * seen, BUCKETS) + decay * n * model.weights[role]
            speed[role] += gw * gw
            model.weights[role] -= rate * gw / (np.sqrt(speed[role]) + 1e-3)
        g = np.array([*g, *(steps - truth_step).ravel()])
        small += g * g
        change = rate * g / (np.sqrt(small) + 1e-3)
        model.bias, model.start = model.bias - change[0], model.start - change[1]
        model.moves = model.moves - change[2:].reshape(2, 2)
    return model


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Neighbouring sequences of some :data:`BLOCK` tokens together: first token, end, sizes."""
    ends = np.cumsum(sizes)
    of = (ends - 1) // BLOCK
    for k in np.unique(of):
        own = np.flatnonzero(of == k)
        yield int(ends[own[0]] - sizes[own[0]]), int(ends[own[-1]]), sizes[own]


class _Block:
    """Sequences whose share in the gradient is taken together."""

    def __init__(self, codes: np.ndarray, truth: np.ndarray, sizes: np.ndarray) -> None:
        self.codes, self.truth, self.sizes = codes, truth, sizes
        self.to, self.begins = ragged(sizes)
        self.firsts = np.cumsum(sizes) - sizes
        self.inside = np.ones(len(codes), bool)
        self.inside[self.firsts] = False
        self.truth_step = np.bincount((truth[:-1] * 2 + truth[1:]).astype(int)[self.inside[1:]], minlength=4).reshape(2, 2)

    def look(self, model: Field, of: np.ndarray, per_word: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Add the errors by word and role to ``per_word``, those of the bias and of the starts to ``g``; the expected steps between tags."""
        codes, to, inside = self.codes, self.to, self.inside
        odds = np.empty(len(codes))
        odds[to] = np.exp(np.clip(_joined(of, codes, self.sizes) + model.bias, -30, 30))
        move = np.exp(model.moves)
        fore, back = forward_backward(odds, self.begins, np.exp(model.start), move)
        p = (fore * back / (1 + fore * back))[to]
        r, s = fore[to][:-1], (odds * back)[to][1:]
        parts = np.stack([np.full(len(s), move[0, 0]), move[0, 1] * s, r * move[1, 0], r * s * move[1, 1]])
        error = p - self.truth
        left, right = error[1:] * inside[1:], error[:-1] * inside[1:]
        for role, (at, e) in enumerate([(codes, error), (codes[:-1], left), (codes[1:], right)]):
            per_word[role] += np.bincount(at, e, per_word.shape[1])
        g += [error.sum(), error[self.firsts].sum()]
        return (parts / parts.sum(0))[:, inside[1:]].sum(1).reshape(2, 2)


def gather(model: Field, texts: list[str | None]) -> np.ndarray:
    """Sum of the fourth powers of the marginals of each text: many faint tags do not add up to a clear one."""
    own, found = Emissions(model), [np.zeros(0)]
    for at in range(0, len(texts), GATHERED):
        emissions, sizes = own.tokens(texts[at : at + GATHERED])
        found.append(_gathered(model.marginals(emissions, sizes), sizes))
    return np.concatenate(found)


def _gathered(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), p**4, len(sizes))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """Train on at most ``sample`` labelled rows outside the held-out fold, half of them toxic.

    The field learns from four fifths of them, the score is calibrated on all:
    a small table has too few toxic rows for a fold of their own.

    Rows without text, id or label are left out.  Of several labels of one id
    the largest counts, of several texts the first in order.  The score leans
    on the share of toxic labels among all that may be learnt, not in the
    sample.  Without labels of both kinds, or without a word bound to toxic
    texts, every text gets the share of toxic labels.
    """
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    by_id = labels.filter(usable).groupBy(F.col(id_col).alias("id")).agg((F.max(F.col(label_col).cast("double")) > 0.5).alias("toxic"))
    have = {r["toxic"]: r["count"] for r in by_id.groupBy("toxic").count().collect()}
    chosen = [by_id.filter(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for kind in (True, False)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(chosen[0].union(chosen[1])), "id")  # at most ``sample`` ids
    got = sorted(rows.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).collect(), key=lambda r: str(r["id"]))
    toxic, texts = np.array([r["toxic"] for r in got], bool), [r["text"] for r in got]
    del got
    share = (have.get(True, 0) + 1) / (sum(have.values()) + 2)
    prior = float(np.log(share / (1 - share)))
    aside = np.arange(len(texts)) % 5 == 4
    model = train([t for t, a in zip(texts, aside) if not a], toxic[~aside])
    if model.weights.any():
        model.slope, model.offset = calibrate(np.log(gather(model, texts) + FLOOR), toxic.astype(float))
        in_sample = (toxic.sum() + 1) / (len(toxic) + 2)
        model.offset += prior - float(np.log(in_sample / (1 - in_sample)))
    else:
        model.offset = prior
    return model


def find_toxic(docs: DataFrame, model: Field, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``score``, ``predicted`` (1 from ``threshold`` on) and ``spans``: starts and ends, in code points, of runs of words that are rather toxic than not.

    Only the text is an input; a null one is an empty one, and either has no
    span.  Texts of any length are one chain each, never cut.  Every row is
    scored, repeated ones alike, null ids are kept; an empty table gives an
    empty result.  Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(1).to_pylist()
                own, sizes = emissions.tokens(texts)
                p = shared.value.marginals(own, sizes)
                scores = shared.value.score(_gathered(p, sizes))
                ends = np.cumsum(sizes)
                tagged = np.zeros(len(sizes), bool)
                tagged[np.searchsorted(ends, np.flatnonzero(p >= 0.5), "right")] = True
                spans = [spans_of(t, p[e - n : e] >= 0.5) if hit else [] for t, e, n, hit in zip(texts, ends.tolist(), sizes.tolist(), tagged.tolist())]
                columns = [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<array<long>>")


def spans_of(text: str, tags: np.ndarray) -> list[list[int]]:
    """Start and end of every run of tagged words."""
    spans: list[list[int]] = []
    before = False
    for match, tag in zip(_word.finditer(text), tags.tolist()):
        if tag and before:
            spans[-1][1] = match.end()
        elif tag:
            spans.append([match.start(), match.end()])
        before = tag
    return spans


def report(found: DataFrame) -> DataFrame:
    """The contract's columns, and the number of spans."""
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"))
