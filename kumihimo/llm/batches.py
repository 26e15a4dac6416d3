"""Arrow-batch helpers: many texts handled by a few NumPy calls."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_SEP = "\x01"
#: What it is folded to, which no character is.
_CUT = 0x110000


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    from kumihimo.llm.glyphs import fold_table

    table = fold_table()
    table[1] = _CUT  # the separator survives folding
    return table


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code units of all texts and the offsets at which each begins (n + 1 of them).

    Nulls count as empty; a U+0001 in a text is dropped, as it separates texts here.
    """
    joined = _SEP.join(t.replace(_SEP, " ") if t and _SEP in t else (t or "") for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = _table()[raw]
    codes = codes[codes != 0]
    ends = np.flatnonzero(codes == _CUT)
    n = len(texts)
    starts = np.zeros(n + 1, dtype=np.int64)
    starts[1:n] = ends - np.arange(len(ends))
    codes = codes[codes != _CUT]
    starts[n] = len(codes)
    return codes, starts


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(codes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-gram that lies within one text, and the index where it begins."""
    m = len(codes) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    wide = codes.astype(np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + wide[i : i + m] + np.uint64(1)
    inside = np.ones(m, dtype=bool)
    for e in starts[1:-1]:
        inside[max(0, e - k + 1) : e] = False
    at = np.flatnonzero(inside)
    return mix(h[at]), at


def owners(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(starts, at, side="right") - 1


def fingerprints(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each text's folded form, as two int64 columns; 0, 0 where it is empty."""
    n = len(starts) - 1
    out = np.zeros((n, 2), dtype=np.uint64)
    if len(codes):
        pos = (np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.uint64)
        wide = codes.astype(np.uint64)
        full = np.flatnonzero(np.diff(starts))
        for j, salt in enumerate((0x1234567, 0x89ABCDEF01)):
            each = mix(wide * np.uint64(0x100000001B3) + mix(pos + np.uint64(salt)))
            out[full, j] = mix(np.add.reduceat(each, starts[:-1][full]))
    return out.view(np.int64)


def minhash_registers(hashes: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """One-permutation minhash: per text and register the least hash of the grams in it.

    Empty registers borrow from the next full one, its value changed by the distance, so
    equal texts keep equal registers. Texts without grams have all registers 0.
    """
    worst = np.uint32(0xFFFFFFFF)
    reg = np.full(n * registers, worst, dtype=np.uint32)
    bucket = ((hashes >> np.uint64(40)) % np.uint64(registers)).astype(np.int64)
    value = (hashes & np.uint64(0x7FFFFFFF)).astype(np.uint32)
    np.minimum.at(reg, owner * registers + bucket, value)
    reg = reg.reshape(n, registers)
    some = (reg != worst).any(axis=1)
    filled = reg.copy()
    for step in range(1, registers):
        empty = filled == worst
        empty[~some] = False
        if not empty.any():
            break
        lent = np.roll(reg, -step, axis=1)
        ok = empty & (lent != worst)
        filled[ok] = lent[ok] + np.uint32(step * 0x01000193)
    filled[~some] = 0
    return mix(filled.astype(np.uint64) + np.arange(registers, dtype=np.uint64) * np.uint64(0x9E37))


def binary_column(rows: np.ndarray) -> pa.Array:
    """Each row of a uint8 matrix as one binary value."""
    n, w = rows.shape
    data = pa.py_buffer(np.ascontiguousarray(rows, dtype=np.uint8).tobytes())
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * w).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])
