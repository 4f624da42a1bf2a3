"""Hashes of word shingles, in numpy over whole texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Bytes of a text whose words are hashed at once.
BLOCK = 1 << 19
_GAP = re.compile(rb"[\x20\x09-\x0d]")
#: The base of polynomials over words.
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection that spreads each bit over all."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _blocks(text: bytes, size: int = BLOCK):
    """The text in pieces of about size bytes that end at white space."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word (a run without ASCII white space), A-Z as a-z. Long texts are read in blocks.

    Words are hashed by their bytes with XXH3: polynomials modulo 2**64, as a shingle's over its words, have collisions that
    can be written down (Thue-Morse words) where their digits are bytes.
    """
    parts = []
    for block in _blocks(text):
        words = block.lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of k words, sorted; of fewer words their whole sequence as one; of none nothing."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        h = h * _STEP + w[j : len(w) - width + 1 + j]
    return np.unique(mix(h))
