"""Secrets of every alphabet at shifting offsets, look-alikes, and reconciling against all subsets."""

import itertools

import numpy as np
import pytest
from lexloom.llm import pii


def words(rng, n):
    return " ".join("".join(rng.choice(list("aeinrstlouhdé"), int(rng.integers(2, 9)))) for _ in range(n))


@pytest.mark.parametrize("alphabet", [*pii.ALPHABETS, "prefixed", "dashed"])
def test_secrets_are_found_whole(alphabet):
    rng = np.random.default_rng(17)
    texts, gold = [], []
    for size in (16, 20, 24, 32, 40, 48, 64, 96, 128, 200):
        for _ in range(16):
            secret = pii.secret_text(rng, alphabet, size)
            before = f"{words(rng, int(rng.integers(0, 50)))} {rng.choice(['', 'key: ', 'token = '])}"
            texts.append(f"{before}{secret}{rng.choice([' ', '. ', ', '])}{words(rng, int(rng.integers(0, 50)))}")
            gold.append((len(before), len(before) + len(secret)))
    found = pii.tagged_spans(texts, pii.default_tagger())
    exact = [("secret", *g) in spans for g, spans in zip(gold, found)]
    assert np.mean(exact) >= 0.95
    for (a, b), spans in zip(gold, found):
        for kind, x, y in spans:
            if x < b and y > a:  # no piece of a secret
                assert min(b, y) - max(a, x) >= 0.9 * (b - a), (alphabet, spans, a, b)


def test_look_alikes_are_left_alone():
    rng = np.random.default_rng(23)
    texts = []
    for _ in range(300):
        number = "".join(map(str, rng.integers(0, 10, int(rng.integers(12, 24)))))
        if pii.luhn(number):
            number = number[:-1] + str((int(number[-1]) + 1) % 10)
        texts.append(f"{words(rng, 12)} {number} {words(rng, 12)}")
    assert np.mean([bool(s) for s in pii.tagged_spans(texts, pii.default_tagger())]) < 0.05
    plain = [f"{words(rng, 80)} version 2.0, camelCase of 2024-05-06 and AB-123 {words(rng, 80)}" for _ in range(60)]
    assert sum(map(len, pii.tagged_spans(plain, pii.default_tagger()))) <= 1


def test_secrets_are_never_pieces():
    text = "x" * 40 + " " + "a1B2" * 10 + " y"
    tagged = [("secret", 44, 60), ("secret", 62, 79)]
    assert pii._whole_secrets(text, 0, len(text), tagged) == [("secret", 41, 81)]
    assert pii._whole_secrets(text, 30, 40, [("secret", 14, 20)]) == []  # the lesser part
    assert pii._whole_secrets("token=ab12ab12ab12ab12", 0, 22, [("secret", 6, 22)]) == [("secret", 6, 22)]
    assert pii._whole_secrets("a +33 1 b", 0, 9, [("phone", 2, 7)]) == [("phone", 2, 7)]


@pytest.mark.parametrize("seed", range(8))
def test_reconcile_equals_the_best_subset(seed):
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(9):
        a = int(rng.integers(0, 30))
        found.append((float(rng.integers(1, 200)) + float(rng.random()), ("email", a, a + int(rng.integers(1, 12)))))
    best = 0.0
    for n in range(len(found) + 1):
        for chosen in itertools.combinations(found, n):
            spans = sorted(s[1:] for _, s in chosen)
            if all(x[1] <= y[0] for x, y in zip(spans, spans[1:])):
                best = max(best, sum(v for v, _ in chosen))
    got = pii._reconcile(found)
    assert sum(v for v, s in found if s in got) == pytest.approx(best) and len(set(got)) == len(got)
    assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))
