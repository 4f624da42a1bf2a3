"""Content-defined anchors: which windows of bytes can have an equal elsewhere, and where to look for it.

A window of WINDOW bytes has one anchor: its GRAM bytes with the least hash (the last of equals). Equal windows have equal
anchors at equal offsets, so they meet under the anchor's hash. Neighbouring windows mostly share their anchor; a maximal
run of such windows is a block, about 40 bytes apart on average.
"""

from __future__ import annotations

import numpy as np
import xxhash

from folioflow.llm.shingles import mix

WINDOW, GRAM = 100, 24
#: Bytes read at once; places within fit in PLACE bits.
PIECE, PLACE = 1 << 17, 20
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.uint64((1 << PLACE) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


_BASE_INVERSE = np.uint64(_inverse(int(_BASE)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1 and their inverses, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        most = max(n, 1 << 16)
        for name, base in (("_POWERS", _BASE), ("_INVERSES", _BASE_INVERSE)):
            row = np.full(most, base, np.uint64)
            row[0] = 1
            globals()[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[:n], _INVERSES[:n]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if width > done else keys


def blocks_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows, anchor hashes and block hashes of the blocks of texts laid end to end in raw.

    Anchors are hashed by a polynomial modulo 2**64, which rolls; blocks that only seem to share an anchor merely meet. Blocks
    are equal by XXH3 of their bytes together with their anchor's hash: two independent hashes of 64 bits.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    p, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * p, out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1], 1)
    keys = (grams & ~_MASK) | (_MASK - np.arange(len(grams), dtype=np.uint64))
    at = (_MASK - (_least(keys, WINDOW - GRAM + 1) & _MASK)).astype(np.int64)
    start = np.arange(len(at))
    fits = start + WINDOW <= ends[np.searchsorted(ends, start, side="right")]
    new = fits & np.r_[True, (at[1:] != at[:-1]) | ~fits[:-1]]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(fits & np.r_[new[1:] | ~fits[1:], True]) + 1
    size = stop - first
    whole = memoryview(raw)
    content = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:z]) for a, z in zip(first.tolist(), (stop + WINDOW - 1).tolist(), strict=True)), np.uint64, len(first))
    return first, size, grams[at[first]], content


def read(texts: list[bytes]):
    """Of all texts: number of the text, first window, number of windows, anchor hash and block hash of each block.

    Short texts are read many at once; long ones in pieces that overlap by a window less one byte.
    """
    out, held, size = [], [], 0

    def flush():
        raw = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        ends = np.cumsum([len(t) for _, _, t in held])
        first, n, anchor, content = blocks_of(raw, ends)
        of = np.searchsorted(ends, first, side="right")
        number, shift = np.array([k for k, _, _ in held]), np.array([s for _, s, _ in held])
        out.append((number[of], first - np.r_[0, ends[:-1]][of] + shift[of], n, anchor, content))
        held.clear()

    for k, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            part = text[lo : lo + PIECE + WINDOW - 1]
            held.append((k, lo, part))
            size += len(part)
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))
