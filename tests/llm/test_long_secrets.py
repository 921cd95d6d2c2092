"""Secrets longer than a window's half, at every offset of a long text."""

import numpy as np
import pytest

from lexloom.llm import pii


@pytest.mark.parametrize("length", [48, 64, 95, 128, 200])
def test_long_secret_at_all_offsets(length):
    rng = np.random.default_rng(length)
    secret = "".join(rng.choice(list("0123456789abcdef")) for _ in range(length))
    words = "the onth ver enal mi stpa erle reouth ti andor " * 8
    texts, at = [], []
    for shift in range(pii.STRIDE):
        lead = words[: 150 + shift] + ' token = "'
        at.append((len(lead), len(lead) + length))
        texts.append(f'{lead}{secret}" {words}')
    found = pii.tagged_spans(texts, pii.default_tagger())
    covered = [sum(max(0, min(b, d) - max(a, c)) for k, c, d in spans if k == "secret") for (a, b), spans in zip(at, found)]
    whole = [any(k == "secret" and abs(c - a) <= 2 and abs(d - b) <= 2 for k, c, d in spans) for (a, b), spans in zip(at, found)]
    assert min(covered) >= 0.9 * length and all(whole), (min(covered), sum(whole))
