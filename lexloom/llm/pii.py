"""Personal data: base patterns and a character-level tagger.

The tagger is a bidirectional LSTM whose scores per character feed a linear
chain CRF over begin/inside tags; it is trained in numpy from labelled spans.
Texts are read in overlapping windows.  The scores of a character are averaged
over its windows (those near a window's edge weigh less), and one Viterbi pass
runs along each stretch of adjoining windows, so a span may be of any length;
of a document's spans the set without overlaps that has the largest total score
is taken.

A span must hold a digit or an at sign to be reported, so windows without
either are only read where they hold part of a long word that has one.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds, in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone"]
#: Kinds of the tagger; ``secret`` is its own.
TAGGED = [*KINDS, "secret"]
TAGS = 1 + 2 * len(TAGGED)

WINDOW, STRIDE = 96, 48
HIDDEN, EMBEDDED = 16, 12
#: Least margin over "outside", summed over the characters of a span that the tagger reports.
LEAST_SCORE = 8.0

Span = tuple[str, int, int]

_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = frozenset(string.ascii_letters + string.digits + "._%+-")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of ``local@domain``, found from the at signs: the local part is the run of its characters before one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        domain = _domain(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base patterns by kind as in :data:`KINDS`, then start (code points, end exclusive)."""
    if not text:
        return []
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _ip(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _card(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _phone(text) if 8 <= sum(map(m[0].count, string.digits)) <= 15]
    return out


# --- the tagger -----------------------------------------------------------------------------------------------------

_CLASSES = 100


def _char_ids() -> np.ndarray:
    """Input id of every code point below 256 (1 and up; 0 is padding); higher ones share the last id."""
    ids = np.full(257, _CLASSES - 1, np.int64)
    ids[128:256] = _CLASSES - 2
    ids[:32] = 1
    ids[32:127] = np.arange(95) + 2
    ids[127] = 1
    ids[10] = 97
    return ids


CHAR_IDS = _char_ids()


def encode(text: str) -> np.ndarray:
    return CHAR_IDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    """Parameters by name: ``E`` characters; ``U f/b``, ``X f/b``, ``B f/b`` LSTM; ``O``, ``c`` output; ``T``, ``S`` CRF."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.3, (_CLASSES, EMBEDDED)), "O": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "T": r.normal(0, 0.05, (TAGS, TAGS)), "S": np.zeros(TAGS)}
        for d in "fb":
            p["X" + d], p["U" + d] = r.normal(0, 0.25, (EMBEDDED, 4 * HIDDEN)), r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p["B" + d] = np.zeros(4 * HIDDEN)
            p["B" + d][HIDDEN : 2 * HIDDEN] = 1.0  # forget gate
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _states(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, unit) of one direction; gates are ordered input, forget, output, candidate."""
        inputs = (self.p["E"] @ self.p["X" + d] + self.p["B" + d])[ids.T]
        steps = range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1)
        h = np.zeros((ids.shape[0], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.empty((ids.shape[1], ids.shape[0], HIDDEN), np.float32)
        for t in steps:
            z = inputs[t] + h @ self.p["U" + d]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, old = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, old, tc))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (time, row, tag)."""
        both = np.concatenate([self._states(ids, "f"), self._states(ids, "b")], 2)
        return both @ self.p["O"] + self.p["c"]

    def decode(self, scores: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Best tag path per row (time, row) under the CRF; steps from a row's size on repeat its last tag."""
        steps, rows, _ = scores.shape
        best = scores[0] + self.p["S"]
        back = np.empty((steps, rows, TAGS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.p["T"]
            back[t] = ways.argmax(1)
            new = ways.max(1) + scores[t]
            if sizes is not None and (over := sizes <= t).any():
                back[t][over] = np.arange(TAGS)
                new[over] = best[over]
            best = new
        path = np.empty((steps, rows), np.int64)
        path[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][np.arange(rows), path[t]]
        return path

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths (row, time), and its gradients."""
        p, (rows, steps) = self.p, ids.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._states(ids, d, kept[d]) for d in "fb"], 2)
        scores = both @ p["O"] + p["c"]
        # CRF: forward and backward sums in log space, then expected minus observed.
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + p["S"]
        lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["T"], 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(p["T"] + (beta[t + 1] + scores[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = tags.T
        observed = p["S"][gold[0]].sum() + np.take_along_axis(scores, gold[:, :, None], 2).sum() + p["T"][gold[:-1], gold[1:]].sum()
        loss = float(z.sum() - observed) / rows
        dscores = np.exp(alpha + beta - z[None, :, None])
        g = {"S": dscores[0].sum(0) - np.bincount(gold[0], minlength=TAGS)}
        pair = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            pair += np.exp(alpha[t - 1][:, :, None] + p["T"] + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        g["T"] = pair - np.bincount((gold[:-1] * TAGS + gold[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        dscores[np.arange(steps)[:, None], np.arange(rows)[None], gold] -= 1
        g["O"], g["c"] = np.einsum("trh,trk->hk", both, dscores), dscores.sum((0, 1))
        dboth = dscores @ p["O"].T
        g["E"] = np.zeros_like(p["E"])
        embedded = p["E"][ids]
        for k, d in enumerate("fb"):
            dz_all = np.zeros((steps, rows, 4 * HIDDEN), np.float32)
            dh = np.zeros((rows, HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            dU = np.zeros_like(p["U" + d])
            for t, i, f, o, cand, before, old, tc in reversed(kept[d]):
                dh = dh + dboth[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], 1)
                dz_all[t] = dz
                dU += old.T @ dz
                dh, dc = dz @ p["U" + d].T, dc * f
            g["U" + d], g["B" + d] = dU, dz_all.sum((0, 1))
            g["X" + d] = np.einsum("rte,trz->ez", embedded, dz_all)
            np.add.at(g["E"], ids, (dz_all @ p["X" + d].T).transpose(1, 0, 2))
        return loss, {name: x / rows for name, x in g.items()}


def train(ids: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 5) -> tuple[Tagger, list[float]]:
    """Fit by Adam on windows of character ids with their tags; returns the tagger and the mean loss of each epoch."""
    tagger = Tagger.fresh(seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    s = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    step, losses = 0, []
    for epoch in range(epochs):
        total, order = [], rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            loss, grad = tagger.gradients(ids[part], tags[part])
            total.append(loss)
            step += 1
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            lr = rate * (1 - epoch / (epochs + 2)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = (g * min(1.0, 5.0 / (size + 1e-9))).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                tagger.p[k] -= (lr * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
        losses.append(float(np.mean(total)))
    return tagger, losses


# --- labelled spans -------------------------------------------------------------------------------------------------

#: What every secret has inside: a digit, or a capital behind a small letter.
_secret_like = re.compile(r"[0-9]|[a-z][A-Z]").search


def _luhn_number(rng: np.random.Generator, size: int) -> str:
    body = "".join(map(str, rng.integers(0, 10, size - 1)))
    return next(body + c for c in string.digits if luhn(body + c))


_B62 = string.ascii_letters + string.digits
#: Alphabets of secrets.
ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base64": f"{_B62}+/", "url": f"{_B62}-_", "mixed": _B62, "upper": string.ascii_uppercase + string.digits, "lower": string.ascii_lowercase + string.digits}
#: What some secrets begin with.
PREFIXES = ["sk_live_", "ghp_", "AKIA", "xoxb-", "pk-", "AIza", "glpat-", "eyJ"]


def secret_text(rng: np.random.Generator, alphabet: str | None = None, size: int | None = None) -> str:
    """An invented secret: of one alphabet, some with a prefix, in dashed groups or with padding; it holds a digit or changes case inside."""
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    kind = alphabet or pick([*ALPHABETS, "prefixed", "dashed"])
    n = size or int(rng.integers(16, 44) if rng.random() < 0.6 else rng.integers(44, 210))
    chars = ALPHABETS.get(kind) or (ALPHABETS["mixed"] if kind == "prefixed" else pick([ALPHABETS["hex"], ALPHABETS["upper"]]))
    while True:
        text = "".join(chars[i] for i in rng.integers(0, len(chars), n))
        if kind == "prefixed":
            text = (pick(PREFIXES) + text)[:n]
        elif kind == "dashed":
            step = pick([4, 5, 8])
            text = "-".join(text[i : i + step] for i in range(0, n, step))[:n].rstrip("-")
        elif kind == "base64" and rng.random() < 0.3:
            text = text[: -1 - int(rng.integers(0, 2))].rstrip("+/") + "=" * (1 + int(rng.integers(0, 2)))
        if _secret_like(text):
            return text


def labelled_window(rng: np.random.Generator, size: int = WINDOW) -> tuple[str, list[Span]]:
    """A window of invented words with personal data, or look-alikes, put in; the labelled spans are exact."""
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    word = lambda: "".join(pick("an en ti on er le ou re th sch ción qu ä é al ver st pa mi do".split()) for _ in range(int(rng.integers(1, 5))))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    text, spans = "", []
    # A part of the windows begins anywhere in a longer text, also inside a span.
    skip = int(rng.integers(1, 160)) if rng.random() < 0.4 else 0
    while len(text) < size + skip:
        kind = int(rng.integers(0, 15))
        start, piece, label = len(text), word(), None
        if kind == 0:
            piece, label = f"{word()}{pick(['.', '_', '', '-', '+'])}{digits(2)}@{word()}{pick(['', digits(1)])}.{pick(['example.com', 'com', 'org', 'mail.net', 'fr'])}", "email"
        elif kind == 1:
            piece, label = ".".join(str(int(x)) for x in rng.integers(0, 256, 4)), "ip"
        elif kind == 2:
            number, gap = _luhn_number(rng, int(rng.integers(16, 20))), pick(["", "", " ", "-"])
            piece, label = gap.join(number[i : i + 4] for i in range(0, len(number), 4)), "card"
        elif kind == 3:
            piece, label = f"+{digits(int(rng.integers(1, 3)))} {pick([f'({digits(3)})', digits(3)])} {digits(3)}{pick(['-', ' ', '.'])}{digits(4)}", "phone"
        elif kind in (4, 8):
            secret = secret_text(rng)
            lead = pick(['token = "', "key: ", 'secret="', "password=", "api_key: '", "", ""])
            text += lead
            start, piece, label = len(text), secret, "secret"
        elif kind == 5:
            number, gap = digits(int(rng.integers(10, 24))), pick(["", " ", "-"])
            if luhn(number):  # numbers that are no card
                number = number[:-1] + str((int(number[-1]) + 1) % 10)
            piece = gap.join(number[i : i + 4] for i in range(0, len(number), 4))
        elif kind == 6:
            piece = pick([f"{word()}{word().title()}", f"{word()}-{word()}-{word()}", f"http://{word()}.{pick(['com', 'org'])}/{word()}{digits(2)}/{word()}", f"{word().upper()}-{digits(3)}", f"{word()}_{word()}{digits(1)}", f"{word()}={digits(2)}", f"{digits(3)}{word()}", word().upper() + word().upper()])
        elif kind == 7:
            piece = pick([f"{word()}{pick('#$%&*') * 3}", f"version {digits(1)}.{digits(1)}", digits(int(rng.integers(1, 5))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.0.", "|", f"{digits(2)}%"])
        text += piece
        if label:
            spans.append((label, start, len(text)))
            text += pick(['" ', '" ', " ", "' ", ". ", ",\n"]) if label == "secret" else pick([" ", " ", ", ", ".", "\n"])
        else:
            text += pick([" ", " ", " ", ", ", ". ", ".\n"])
    text = text[skip : skip + size]
    return text, [(k, a - skip, min(b - skip, size)) for k, a, b in spans if a < size + skip and b > skip]


def tags_of(size: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * TAGGED.index(kind)
        out[max(a, 0) : b] = k + 1
        if a >= 0:
            out[a] = k
    return out


def labelled_set(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = [labelled_window(rng) for _ in range(n)]
    return np.stack([encode(t) for t, _ in made]), np.stack([tags_of(len(t), s) for t, s in made])


_trained: dict[tuple[int, int], Tagger] = {}


def default_tagger(windows: int = 1000, seed: int = 5) -> Tagger:
    """The tagger trained on ``windows`` labelled windows; made once per process, the same for the same parameters."""
    if (windows, seed) not in _trained:
        _trained[windows, seed] = train(*labelled_set(windows, seed), seed=seed)[0]
    return _trained[windows, seed]


# --- reading documents ----------------------------------------------------------------------------------------------

#: What some character of every span, or two next to each other, must be.
TRIGGER = r"[0-9@]|[a-z][A-Z]"
_trigger = re.compile(TRIGGER).search


_long_words = re.compile(rf"\S{{{STRIDE},}}").finditer
#: Weight of a window's scores at each of its characters.
_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]
#: Windows that are scored at once, and characters (padding counts) that are decoded at once.
_SCORED, _DECODED = 512, 200_000


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an at sign, or part of a long word with one."""
    last = max(len(text) - WINDOW, 0)
    starts = [*range(0, last, STRIDE), last]
    long = [(m.start(), m.end()) for m in _long_words(text) if _trigger(text, m.start(), m.end())]
    ends = [b for _, b in long]

    def in_long(s: int) -> bool:
        k = bisect_right(ends, s)
        return k < len(long) and long[k][0] < s + WINDOW

    return [s for s in starts if _trigger(text, s, s + WINDOW) or in_long(s)]


def _reconcile(found: list[tuple[float, Span]]) -> list[Span]:
    """The spans without overlaps whose scores add up highest (ties: the earlier ending ones)."""
    spans = sorted(set(found), key=lambda x: (x[1][2], x[1][1], x[1][0]))
    ends = [s[2] for _, s in spans]
    best, take = [0.0], []
    for i, (score, (_, a, _)) in enumerate(spans):
        j = bisect_right(ends, a, 0, i)
        take.append((best[j] + score > best[i], j))
        best.append(max(best[i], best[j] + score))
    out, i = [], len(spans)
    while i:
        use, j = take[i - 1]
        if use:
            out.append(spans[i - 1][1])
        i = j if use else i - 1
    return out[::-1]


def tagged_spans(texts: list[str | None], tagger: Tagger) -> list[list[Span]]:
    """Spans that the tagger finds in each whole text."""
    out: list[list[Span]] = [[] for _ in texts]
    group: list[tuple[int, list[int]]] = []
    held = 0
    for i, text in enumerate(texts):
        if text and _trigger(text):
            group.append((i, window_starts(text)))
            held += len(group[-1][1])
        if group and (held >= _SCORED or i + 1 == len(texts)):
            for k, spans in _spans_of(texts, group, tagger).items():
                out[k] = _reconcile(spans)
            group, held = [], 0
    return out


def _spans_of(texts: list[str | None], group: list[tuple[int, list[int]]], tagger: Tagger) -> dict[int, list[tuple[float, Span]]]:
    """Scored spans by text, of texts given with the starts of their windows."""
    # Stretches of adjoining windows, each with room for its weighted scores.
    stretches: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    jobs: list[tuple[int, int, int]] = []
    for i, starts in group:
        size = len(texts[i])
        first = 0
        for k, s in enumerate(starts):
            if k + 1 == len(starts) or starts[k + 1] > s + WINDOW:
                length = min(s + WINDOW, size) - starts[first]
                jobs += [(len(stretches), i, x) for x in starts[first : k + 1]]
                stretches.append((i, starts[first], np.zeros((length, TAGS), np.float32), np.zeros((length, 1), np.float32)))
                first = k + 1
    encoded: dict[int, np.ndarray] = {}
    for at in range(0, len(jobs), _SCORED):
        part = jobs[at : at + _SCORED]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (_, i, s) in enumerate(part):
            if i not in encoded:
                encoded = {i: encode(texts[i])}
            piece = encoded[i][s : s + WINDOW]
            ids[row, : len(piece)] = piece
        scores = tagger.emissions(ids)
        for row, (k, i, s) in enumerate(part):
            _, begin, total, weight = stretches[k]
            n = min(WINDOW, len(texts[i]) - s)
            total[s - begin : s - begin + n] += (scores[:, row] * _WEIGHT)[:n]
            weight[s - begin : s - begin + n] += _WEIGHT[:n]
    found: dict[int, list[tuple[float, Span]]] = {}
    order = sorted(range(len(stretches)), key=lambda k: len(stretches[k][2]))
    while order:
        longest = len(stretches[order[-1]][2])
        take = max(1, _DECODED // longest)
        part, order = order[-take:], order[:-take]
        sizes = np.array([len(stretches[k][2]) for k in part])
        scores = np.zeros((longest, len(part), TAGS), np.float32)
        for row, k in enumerate(part):
            scores[: sizes[row], row] = stretches[k][2] / stretches[k][3]
        path = tagger.decode(scores, sizes)
        margin = scores.max(2) - scores[:, :, 0]
        for row, k in enumerate(part):
            i, begin, *_ = stretches[k]
            spans = _whole_secrets(texts[i], begin, int(sizes[row]), list(_runs(path[: sizes[row], row])))
            for kind, a, b in spans:
                value = float(margin[max(a, 0) : b, row].sum())
                if value >= LEAST_SCORE and _trigger(texts[i], begin + a, begin + b):
                    found.setdefault(i, []).append((round(value, 3), (kind, begin + a, begin + b)))
    return found


_secret_run = re.compile(r"[A-Za-z0-9+/=_-]{12,}").finditer
#: Part of a run of secret characters that must be tagged for the whole run to be a secret.
SECRET_SHARE = 0.5


def _whole_secrets(text: str, begin: int, size: int, spans: list[Span]) -> list[Span]:
    """Tagged ``spans`` of a stretch with secrets made whole: a run of secret characters that is tagged for the most part is one span, pieces of others go.

    Positions are relative to ``begin``; a run may reach over the stretch's ends.
    """
    # An address without its sign is a piece of something else.
    spans = [("secret", a, b) if kind == "email" and "@" not in text[begin + a : begin + b] else (kind, a, b) for kind, a, b in spans]
    tagged = [(a, b) for kind, a, b in spans if kind == "secret"]
    if not tagged:
        return spans
    low, high = max(begin - STRIDE, 0), begin + size + STRIDE
    while low > 0 and not text[low].isspace():
        low -= 1
    while high < len(text) and not text[high].isspace():
        high += 1
    out = [s for s in spans if s[0] != "secret"]
    for m in _secret_run(text, low, high):
        a, b = m.start() - begin, m.end() - begin
        lead = re.match(r"[A-Za-z_]{2,16}=(?=[^=])", m[0])  # a name before an equals sign
        a += lead.end() if lead else 0
        if a < b and sum(max(0, min(b, y) - max(a, x)) for x, y in tagged) >= SECRET_SHARE * (b - a):
            out.append(("secret", a, b))
    return sorted(out, key=lambda s: s[1])


def _runs(tags: np.ndarray) -> Iterator[Span]:
    """Spans of begin/inside tags; an inside tag of another kind begins a span."""
    start, kind = 0, 0
    for t, tag in enumerate([*tags.tolist(), 0]):
        k = (tag + 1) // 2
        if kind and (k != kind or tag % 2):
            yield TAGGED[kind - 1], start, t
            kind = 0
        if k and not kind:
            start, kind = t, k


def all_spans(base: list[Span], tagged: list[Span]) -> list[Span]:
    """Base spans, and tagged ones that overlap none of them, by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    extra = [s for s in tagged if not (n := bisect_right(starts, s[2] - 1)) or reach[n - 1] <= s[1]]
    return sorted([*base, *extra], key=lambda s: (TAGGED.index(s[0]), s[1], s[2]))


def find_pii(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the ``base`` spans and all ``spans`` as arrays of (kind, start, end).

    Positions are code points of the whole text.  A null or empty text has no
    spans.  Every row is read by itself, repeated rows and null ids included;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows_of = lambda xs: [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            near = pc.fill_null(pc.match_substring_regex(column, TRIGGER), False).to_pylist()
            texts = [column[i].as_py() if hit else None for i, hit in enumerate(near)]
            base = list(map(base_spans, texts))
            every = [all_spans(b, t) for b, t in zip(base, tagged_spans(texts, shared.value))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows_of(base), spans), pa.array(rows_of(every), spans)], ["doc_id", "base", "spans"])

    part = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {kind}, base {part}, spans {part}")


def report(found: DataFrame) -> DataFrame:
    """The digest form: counts of base spans by kind, their SHA-256, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of_kind = lambda k: F.filter("base", lambda s: s.kind == F.lit(k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
