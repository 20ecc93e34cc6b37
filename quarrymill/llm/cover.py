"""A difference cover of the windows of a text, on its words where it has enough of them and on its symbols elsewhere.

A set D of residues is a difference cover of v if every two places have a shift below v that takes both into D. Places are first
the words' beginnings, counted within a text, with WORDS as cover: of two equal windows with as many words as the cover's period,
one of these words is sampled in both. Whether a window has enough words shows in the window itself, so equal windows agree in it;
for those that have too few (long words, scripts without spaces), places are the symbols, with a cover of a longer period.

Each sampled place stands for the run of windows in which it can be the one: those that hold the gram of k symbols that begins there,
and no more words before it than the period allows. So every two equal windows are in runs of equal grams, at the same distance.
"""

from __future__ import annotations

import numpy as np

from .common import mix

#: Perfect difference sets (fixed values): every difference but 0 modulo the period occurs once.
SETS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}
WORDS = 7
_OTHER = np.uint64(0x5851F42D4C957F2D)


def sampled(place: np.ndarray, period: int) -> np.ndarray:
    table = np.zeros(period, bool)
    table[list(SETS[period])] = True
    return table[place % period]


def period_of(length: int) -> int:
    """The longest period that leaves at least a quarter of a window for the gram."""
    return max((v for v in SETS if v <= 3 * length // 4), default=0)


def cover_runs(white: np.ndarray, ok: np.ndarray, offset: np.ndarray, size: np.ndarray, length: int, k: int, words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.uint64]]:
    """(first window, number of windows, sampled place, symbols of the gram, salt) of the runs by words and of those by symbols.
    white: which symbols are white space; ok: which windows lie in one text; offset, size: where the texts are."""
    begin = np.zeros(len(white), bool)
    begin[1:] = white[:-1] & ~white[1:]
    begin[offset[offset < len(begin)]] = False
    s = np.flatnonzero(begin)
    piece = np.searchsorted(offset, s, side="right") - 1
    at = np.arange(len(s))
    number = at - np.searchsorted(s, offset)[piece]
    keep = sampled(number, words)
    s_, piece, number, at = s[keep], piece[keep], number[keep], at[keep]
    before = np.where(number >= words, s[np.maximum(at - words, 0)], offset[piece]) if len(s) else s_
    low = np.maximum(np.maximum(before, s_ + k - length), offset[piece])
    high = np.minimum(s_ - 1, offset[piece] + size[piece] - length)
    some = low <= high
    runs = [(low[some], (high - low + 1)[some], s_[some], k, np.uint64(0))]

    seventh = np.cumsum(begin)[: len(ok)] + words - 1
    place = np.append(s, np.full(1, len(white) + length))[np.minimum(seventh, len(s))]
    rest = np.flatnonzero(ok & (place + k > np.arange(len(ok)) + length))
    if len(rest):
        period = period_of(length)
        depth = length - period + 1
        p = np.arange(len(white) - depth + 1)
        p = p[sampled(p - offset[np.searchsorted(offset, p, side="right") - 1], period)]
        a, z = np.searchsorted(rest, p - period + 1), np.searchsorted(rest, p, side="right")
        some = a < z
        low, high = rest[a[some]], rest[z[some] - 1]
        runs.append((low, high - low + 1, p[some], depth, _OTHER))
    return runs


def named(gram: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, at: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Names of sampled places to the depth of their grams (48 bits) and of all their windows (56 bits), from the hashes of the gram,
    the first and the last window."""
    span = mix(mix(first + salt) * np.uint64(0x9E3779B97F4A7C15) + last + (n * 512 + at).astype(np.uint64))
    return (gram ^ salt) & ~np.uint64((1 << 16) - 1), span & ~np.uint64(0xFF)
