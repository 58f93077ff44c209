"""Alignment of a short text with every offset of a long one, in numpy words of 64 bits.

The score of a window is 200 * LCS / (length of the short text + characters of the window): the
share of characters that stay when one is turned into the other by insertions and deletions. Windows
are as long as the short text; at both ends of the long one they may stick out.
"""

from __future__ import annotations

import numpy as np

#: Length of the character runs that seed windows, and the windows that are aligned at once.
RUN, BLOCK = 3, 4096


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def common(short: np.ndarray, padded: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``short`` with each window of ``padded``.

    One bit a character of ``short``, one row of words a window: a step adds a character to all windows at once."""
    m, words = len(short), -(-len(short) // 64)
    letters, at = np.unique(short, return_inverse=True)
    table = np.zeros((len(letters) + 1, words), np.uint64)
    for k, row in enumerate(at):
        table[row, k // 64] |= np.uint64(1 << (k % 64))
    place = np.searchsorted(letters, padded)
    place[(place == len(letters)) | (letters[np.minimum(place, len(letters) - 1)] != padded)] = len(letters)
    out = np.empty(len(starts), np.int64)
    last = np.uint64((1 << ((m - 1) % 64 + 1)) - 1)
    for a in range(0, len(starts), BLOCK):
        some = starts[a : a + BLOCK]
        left = np.full((len(some), words), np.iinfo(np.uint64).max, np.uint64)
        for k in range(m):
            hit = left & table[place[some + k]]
            carry = np.zeros(len(some), bool)
            for w in range(words):
                was = left[:, w]
                total = was + hit[:, w]
                over = total < was
                total += carry
                carry = over | (carry & (total == 0))
                left[:, w] = total | (was & ~hit[:, w])
        left[:, -1] &= last
        out[a : a + BLOCK] = m - np.bitwise_count(left).sum(axis=1, dtype=np.int64)
    return out


def partial_ratio(one: str, two: str, floor: float = 0.0) -> float:
    """The best score over all windows, 0 to 100; 0 if none reaches ``floor``.

    Windows that share too few runs of RUN characters with the short text to reach ``floor`` are not aligned. A
    character that goes breaks RUN runs of the short text, one that comes RUN - 1; so none that reaches it is passed over.
    """
    short, long = sorted((_codes(one), _codes(two)), key=len)
    m, n = len(short), len(long)
    if not m:
        return 100.0 if not n else 0.0
    nothing = np.uint32(0xFFFFFFFF)
    padded = np.concatenate([np.full(m - 1, nothing), long, np.full(m - 1, nothing)]).astype(np.uint32)
    starts = np.arange(n + m - 1)
    size = np.minimum(starts + 1, n) - np.maximum(starts + 1 - m, 0)
    if floor > 0 and m >= RUN:
        need = np.ceil(floor * (m + size) / 200 - 1e-9)
        least = (m - RUN + 1) - RUN * (m - need) - (RUN - 1) * (size - need)
        run = lambda x: [x[k : len(x) - RUN + 1 + k].astype(np.uint64) << np.uint64(21 * k) for k in range(RUN)]
        known, here = np.unique(sum(run(short))), sum(run(padded))
        shared = np.concatenate([[0], np.cumsum(np.isin(here, known))])
        starts = np.flatnonzero((shared[starts + m - RUN + 1] - shared[starts] >= least) & (need <= np.minimum(size, m)))
        size = size[starts]
    if not len(starts):
        return 0.0
    best = float((200.0 * common(short, padded, starts) / (m + size)).max())
    return best if best >= floor - 1e-9 else 0.0
