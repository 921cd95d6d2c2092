"""How long the factorisation machine trains is decided by the rows set aside, and by nothing else."""

import numpy as np

from lexloom.llm import quality


def rows_of(rng, labels):
    """Rows of ten hashed words; the first word tells the label."""
    return [(np.array([int(y), *rng.integers(10, 5000, 9), quality.BUCKETS]), np.ones(11)) for y in labels]


def test_rows_set_aside_choose_the_machine(monkeypatch):
    rng = np.random.default_rng(1)
    y, z = rng.integers(0, 2, 300).astype(float), rng.integers(0, 2, 80).astype(float)
    rows, aside = rows_of(rng, y), rows_of(rng, z)
    seen = []
    real = quality.log_loss
    monkeypatch.setattr(quality, "log_loss", lambda raw, labels: seen.append(real(raw, labels)) or seen[-1])
    fm = quality.train(rows, y, aside, z, steps=200)
    raw = fm.raw(*quality._ragged(aside))
    assert len(seen) == 200 // quality.LOOK and np.isclose(real(raw, z), min(seen))
    assert ((raw > 0) == (z > 0.5)).mean() > 0.95


def test_stops_where_nothing_is_gained():
    rng = np.random.default_rng(2)
    rows, aside = rows_of(rng, rng.integers(0, 2, 200)), rows_of(rng, rng.integers(0, 2, 60))
    looks = []
    noise = rng.integers(0, 2, 200).astype(float)
    other = rng.integers(0, 2, 60).astype(float)
    real, quality.log_loss = quality.log_loss, lambda *a: looks.append(1) or real(*a)
    try:
        quality.train(rows, noise, aside, other, steps=100_000)
    finally:
        quality.log_loss = real
    assert len(looks) < 100


def test_no_rows_set_aside():
    assert quality.train([], np.zeros(0)).w.shape == (quality.WIDTH,)
    rng = np.random.default_rng(3)
    y = np.array([0.0, 1.0, 1.0])
    fm = quality.train(rows_of(rng, y), y, steps=50)
    assert fm.w.any()
