"""The classifiers' fits on the driver: temporary arrays are of parts of the sample, whatever its size."""

import tracemalloc

import numpy as np
import pytest

from lumenframe.llm import quality, toxicity, training


def sample(rows, words):
    rng = np.random.default_rng(1)
    w = np.array([f"w{k:x}" for k in range(3000)])
    return [("\n".join(" ".join(line) for line in w[rng.integers(0 if c else 1000, 2000 if c else 3000, (words // 10, 10))]), c) for c in rng.integers(0, 2, rows).tolist()]


@pytest.mark.parametrize("fitted,words,most", [(toxicity.fitted, 600, 45), (quality.fitted, 600, 25)])
def test_memory_of_a_fit(fitted, words, most):
    rows = sample(600, words)
    tracemalloc.start()
    try:
        fitted(rows, steps=2)
        peak = tracemalloc.get_traced_memory()[1]
        assert peak < most * 1e6
    finally:
        tracemalloc.stop()


def test_parts_do_not_change_a_fit(monkeypatch):
    rows = sample(60, 200)
    few = toxicity.fitted(rows, steps=20), quality.fitted(rows, steps=20)
    monkeypatch.setattr(toxicity, "FIT_TERMS", 100)
    monkeypatch.setattr(quality, "FIT_LINES", 7)
    many = toxicity.fitted(rows, steps=20), quality.fitted(rows, steps=20)
    assert all(np.allclose(a.w, b.w, atol=1e-6) for a, b in zip(few, many, strict=True)) and np.allclose(few[0].v, many[0].v, atol=1e-6)
    assert training.parts(np.array([0, 3, 3, 9, 10]), 4) == [(0, 2), (2, 3), (3, 4)]
