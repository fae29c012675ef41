"""Integer expressions of the codec's arithmetic, as SQL text that Spark compiles: clipping, wrapping, rounding shifts."""

from __future__ import annotations

FIX_BITS, COLOUR_BITS = 13, 4


def clamp(x: str, high: int | str, low: int | str = 0) -> str:
    return f"greatest({low}L, least({high}L, {x}))"


def rounded_shift(x: str, bits: int) -> str:
    """(x + half) >> bits."""
    return f"shiftright({x} + {1 << bits >> 1}L, {bits})" if bits else x


def signed16(x: str) -> str:
    """x reduced to a signed 16-bit value."""
    return f"((({x}) + 32768L & 65535L) - 32768L)"


def unsigned16(x: str) -> str:
    return f"(({x}) & 65535L)"


def to_fix(c: float, bits: int = FIX_BITS) -> int:
    """A constant in fixed point, rounded half up."""
    return int(c * (1 << bits) + 0.5)


def dot(names: list[str], row: list[int]) -> str:
    return " + ".join(f"{n} * {c}L" for n, c in zip(names, row, strict=True))
