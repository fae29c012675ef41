import numpy as np
import pytest

from lumenframe.llm import webp

RNG = np.random.default_rng(4)


def noisy(h, w):
    base = RNG.integers(0, 256, (h, w, 4))
    base[h // 2 :] = base[: h - h // 2]
    base[:, : w // 3] = [255, 10, 20, 30]
    return (base[..., 0] << 24 | base[..., 1] << 16 | base[..., 2] << 8 | base[..., 3]).ravel()


def same(px, w, **how):
    got, width = webp.decode(webp.encode(px, w, **how))
    assert width == w and (got == px).all()


@pytest.mark.parametrize("h,w", [(1, 1), (1, 40), (33, 1), (20, 37), (64, 64)])
def test_round_trips(h, w):
    px = noisy(h, w)
    same(px, w)
    same(px, w, grey=True, lz=True)
    same(px, w, cache_bits=5, lz=True)
    bits = 2
    gh, gw = (h + 3) >> bits, (w + 3) >> bits
    for low, high in [(m, m + 1) for m in range(14)] + [(0, 14)]:
        same(px, w, predictor=(bits, RNG.integers(low, high, (gh, gw))))
    same(px, w, cross=(bits, RNG.integers(0, 256, (3, gh, gw))))
    same(px, w, predictor=(bits, RNG.integers(0, 14, (gh, gw))), cross=(bits, RNG.integers(0, 256, (3, gh, gw))), grey=True, cache_bits=3, lz=True)
    groups = RNG.integers(0, 3, (gh, gw))
    groups.flat[-1] = 2
    same(px, w, groups=(bits, groups), cache_bits=4, lz=True)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200, 256])
def test_palettes(colours):
    table = np.unique(RNG.integers(0, 2**32, colours * 2))[:colours]
    px = table[RNG.integers(0, colours, 31 * 45)]
    px[:colours] = table
    for lz in (False, True):
        same(px, 45, palette=True, lz=lz)
    same(px, 45, palette=True, cache_bits=6, lz=True)


def test_grey_text_in_windows(monkeypatch):
    """Tokens as arrays, over many windows of the stream, with overlapping copies."""
    text = b"".join(RNG.choice([b"the ", b"end ", b"of ", b"zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", b"q"], 4000)) + bytes(range(256)) * 3
    v = np.frombuffer(text[: len(text) // 64 * 64], np.uint8).astype(np.int64)
    px = 255 << 24 | v << 16 | v << 8 | v
    file = webp.encode(px, 64, grey=True, lz=True)
    assert len(file) < len(v) / 2
    assert (webp.decode(file)[0] == px).all()
    inner = webp._green_only
    monkeypatch.setattr(webp, "_green_only", lambda *a: inner(*a, window=512))
    assert (webp.decode(file)[0] == px).all()


def test_codes_are_bounded():
    fib = np.array([1, 1, *[0] * 30])
    for k in range(2, 32):
        fib[k] = fib[k - 1] + fib[k - 2]
    n = webp.code_lengths(fib)
    assert n.max() <= 15 and np.isclose((0.5 ** n[n > 0]).sum(), 1)
    webp.Code(n)


def test_distances():
    assert len(webp.NEAR) == 120 and len(set(webp.NEAR)) == 120
    for v in [*range(1, 300), 4096, 10**6]:
        p, n, e = webp.prefix_of(v)
        assert webp._OFFSET[p] + e == v and webp._EXTRA[p] == n


def test_broken_files():
    file = webp.encode(noisy(9, 9), 9)
    for bad in (b"", b"RIFF", file[:40], b"x" + file[1:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
