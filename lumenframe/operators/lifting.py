"""The reversible 8x8 transform by lifting: integer rotations that undo themselves exactly.

The flow graph follows from the recursive factorisation of the orthogonal DCT-II and DCT-IV (G. Plonka and M. Tasche, "Fast
and numerically stable algorithms for discrete cosine transforms", 2005): a DCT-II of n values is butterflies, a DCT-II of
the sums and a DCT-IV of the differences; a DCT-IV is rotations by odd multiples of pi / 4n, two DCT-II of half the size
and butterflies. `plan` unrolls it to a list of plane rotations and negations. A rotation is three rounded shears ("Invertible
integer DCT algorithms", 2003, by the same authors), and the inverse runs the list backwards. Blocks are handled as Arrow
batches of dense arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 12


def _times(v: np.ndarray, c: float) -> np.ndarray:
    return (v * round(c * (1 << BITS)) + (1 << BITS >> 1)) >> BITS


class Plan:
    """Steps (first, second, angle) of rotations, (place,) of negations; and where each frequency ends up."""

    def __init__(self, n: int):
        self.steps: list[tuple] = []
        self.order = self.dct2(list(range(n)))

    def butterfly(self, a: int, b: int) -> None:
        """Sum and difference, both over the root of two."""
        self.steps += [(a, b, np.pi / 4), (b,)]

    def dct2(self, at: list[int]) -> list[int]:
        """The places of the frequencies of the DCT-II of the values at these places."""
        n, half = len(at), len(at) // 2
        if n == 1:
            return at
        for i in range(half):
            self.butterfly(at[i], at[n - 1 - i])
        even, odd = self.dct2(at[:half]), self.dct4(at[: half - 1 : -1])
        return [x for pair in zip(even, odd, strict=True) for x in pair]

    def dct4(self, at: list[int]) -> list[int]:
        n, half = len(at), len(at) // 2
        if n == 1:
            return at
        for i in range(half):
            self.steps.append((at[i], at[n - 1 - i], (2 * i + 1) * np.pi / (4 * n)))
            if i % 2:
                self.steps.append((at[n - 1 - i],))
        u, v = self.dct2(at[:half]), self.dct2(at[: half - 1 : -1])
        self.steps.append((v[0],))
        out = [u[0]] * n
        out[n - 1] = v[0]
        for m in range(1, half):
            self.butterfly(u[m], v[half - m])
            out[2 * m], out[2 * m - 1] = u[m], v[half - m]
        return out


@lru_cache(maxsize=1)
def plan() -> Plan:
    return Plan(8)


def forward(v: np.ndarray) -> np.ndarray:
    """Along the last axis: eight samples to eight frequencies."""
    x = [v[..., k] for k in range(8)]
    for a, *turn in plan().steps:
        if not turn:
            x[a] = -x[a]
            continue
        b, angle = turn
        t, s = np.tan(angle / 2), np.sin(angle)
        x[a] = x[a] + _times(x[b], t)
        x[b] = x[b] - _times(x[a], s)
        x[a] = x[a] + _times(x[b], t)
    return np.stack([x[k] for k in plan().order], axis=-1)


def inverse(c: np.ndarray) -> np.ndarray:
    x: list[np.ndarray] = [None] * 8
    for f, k in enumerate(plan().order):
        x[k] = c[..., f]
    for a, *turn in reversed(plan().steps):
        if not turn:
            x[a] = -x[a]
            continue
        b, angle = turn
        t, s = np.tan(angle / 2), np.sin(angle)
        x[a] = x[a] - _times(x[b], t)
        x[b] = x[b] + _times(x[a], s)
        x[a] = x[a] - _times(x[b], t)
    return np.stack(x, axis=-1)


def forward_block(v: np.ndarray, level: int = 128) -> np.ndarray:
    """(n, 8, 8) samples to coefficients: columns, then rows; the level is taken off the DC."""
    c = forward(forward(v.swapaxes(-1, -2)).swapaxes(-1, -2))
    c[..., 0, 0] -= level << 3
    return c


def inverse_block(c: np.ndarray, level: int = 128) -> np.ndarray:
    c = c.copy()
    c[..., 0, 0] += level << 3
    return inverse(inverse(c).swapaxes(-1, -2)).swapaxes(-1, -2)


def _mapped(blocks: DataFrame, column: str, name: str, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 8, 8)
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * 64), pa.array(of(v).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("block"), out], names=["block", name])

    return blocks.select("block", column).mapInArrow(run, f"block bigint, {name} array<bigint>")


def transformed(blocks: DataFrame) -> DataFrame:
    """block, c from block, v."""
    return _mapped(blocks, "v", "c", forward_block)


def restored(blocks: DataFrame) -> DataFrame:
    """block, v from block, c."""
    return _mapped(blocks, "c", "v", inverse_block)
