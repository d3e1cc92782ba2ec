"""Word shingles as 64-bit hashes, computed over the bytes of whole batches."""

from __future__ import annotations

import numpy as np

POWER = np.uint64(0x9E3779B97F4A7C15)
FIRST, SECOND, ALONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of words before each text.

    Words are runs of bytes other than 9 to 13 and 32; A to Z count as lower case. `raw`, `at`: bytes of all texts and
    their offsets.
    """
    upper = (raw >= 65) & (raw <= 90)
    low = raw | (upper.astype(np.uint8) << 5)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    places = np.flatnonzero(inside)
    firsts = np.searchsorted(places, starts)
    sizes = np.diff(firsts, append=len(places))
    position = np.arange(len(places)) - np.repeat(firsts, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), POWER, np.uint64))
    terms = (low[places].astype(np.uint64) + np.uint64(1)) * powers[position]
    return mix(np.add.reduceat(terms, firsts) + sizes.astype(np.uint64)), before


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int = 2) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `words` words; the whole sequence where there are fewer."""
    hashes, before = word_hashes(raw, at)
    if words == 2:
        rolled = np.zeros(0, np.uint64) if len(hashes) < 2 else mix(hashes[:-1] * FIRST + (hashes[1:] ^ SECOND) * SECOND)
    else:
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            rolled = mix(rolled * FIRST + (hashes[k : k + len(rolled)] ^ SECOND))
    out = []
    for start, end in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if end - start >= words:
            out.append(np.unique(rolled[start : end - words + 1]))
        elif end > start:
            whole = np.full(1, ALONE, np.uint64)
            for h in hashes[start:end]:
                whole = mix(whole * FIRST + (h ^ ALONE))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
