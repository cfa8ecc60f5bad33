"""Word and shingle hashes of many UTF-8 texts at once, computed on their bytes with numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, then mixed.
Separators are ASCII bytes, which never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK = 1 << 19

#: \x20 and \x09-\x0D separate words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
#: All ASCII but letters and digits separates words.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, BLOCK + 4096), base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well-spread bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _cuts(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray, block: int):
    """Byte ranges of about ``block`` bytes that end at a text's end or before a separator."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + block)
        if hi < end:
            text_end = int(offsets[np.searchsorted(offsets, hi)])
            at = hi
            while at < text_end:
                if (found := np.flatnonzero(separators[buf[at : min(text_end, at + 65536)]])).size:
                    at += int(found[0])
                    break
                at = min(text_end, at + 65536)
            hi = at
        yield lo, hi
        lo = hi


def unspaced(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the characters of scripts that are written without spaces: Thai, Lao,
    Myanmar, Khmer, kana and Han, with the signs of their blocks. ``part`` holds whole characters."""
    at = np.flatnonzero(part >= 0xE0)
    if not at.size:
        return at, at
    lead, second = part[at], part[at + 1]
    # The blocks' first and second bytes in UTF-8.
    thai_lao = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    myanmar_khmer = (lead == 0xE1) & ((second <= 0x81) | (second == 0x9E) | (second == 0x9F))
    east_asian = ((lead == 0xE2) & (second >= 0xBA)) | ((lead >= 0xE3) & (lead <= 0xE9))
    more_han = ((lead == 0xEF) & (second >= 0xA4) & (second <= 0xAB)) | ((lead == 0xF0) & (second >= 0xA0) & (second <= 0xB2))
    found = at[thai_lao | myanmar_khmer | east_asian | more_han]
    return found, found + 3 + (part[found] == 0xF0)


def hashed_words(buf, offsets, separators=WHITE, block=BLOCK, single=False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order (A-Z as a-z), and each text's number of words.
    With ``single``, a character of a script without spaces is a word."""
    hashes, counts, _, _ = placed_words(buf, offsets, separators, LOWER, block, single)
    return hashes, counts


def placed_words(buf, offsets, separators, fold, block=BLOCK, single=False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes after ``fold``, the number of words of each text, and the words' places
    in ``buf``: starts and ends."""
    hashes, owners, firsts, lasts = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in _cuts(buf, offsets, separators, block):
        part = fold[buf[lo:hi]]
        inside = ~separators[part]
        first = np.zeros(hi - lo + 1, bool)
        at = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo
        first[at] = True
        first[0] = first[-1] = True
        if single:
            for edge in unspaced(part):
                first[edge] = True
        starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
        if not starts.size:
            continue
        ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        powers, inverse = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum((part.astype(U) + U(1)) * powers[: hi - lo], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        hashes.append(mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))
        owners.append(np.searchsorted(offsets, starts + lo, side="right") - 1)
        firsts.append(starts + lo)
        lasts.append(ends + lo)
    return np.concatenate(hashes), np.bincount(np.concatenate(owners), minlength=len(offsets) - 1), np.concatenate(firsts), np.concatenate(lasts)


def hash_word(word: str) -> int:
    """The hash that :func:`hashed_words` gives to one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashed_words(raw, np.array([0, len(raw)]), np.zeros(256, bool))[0][0])


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``width`` words; a shorter text
    is one run, and a text without words has none."""
    factors = mix(np.arange(1, width + 1, dtype=U) * U(_BASE)) | U(1)
    n, out, at = len(words), [], 0
    runs = np.zeros(max(0, n - width + 1), U)
    for j in range(width if len(runs) else 0):
        runs += words[j : n - width + 1 + j] * factors[j]
    runs = mix(runs)
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(runs[at : at + c - width + 1]))
        elif c:
            out.append(mix((words[at : at + c] * factors[:c]).sum(keepdims=True) ^ U(c)))
        else:
            out.append(np.zeros(0, U))
        at += c
    return out
