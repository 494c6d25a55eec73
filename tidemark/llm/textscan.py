"""Vectorised views of texts for the scans: code points, words with single separators, hashes of all windows."""

from __future__ import annotations

import numpy as np

MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20

_fold: np.ndarray | None = None


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _folding() -> np.ndarray:
    """For each code point its lower case, or a space if it is neither letter nor digit; built once in a worker."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                table[i] = ord(c.lower()[0])
        _fold = table
    return _fold


def folded(text: str) -> np.ndarray:
    """The words in lower case with one space before, between and after them, as code points."""
    table, parts, last = _folding(), [np.array([32], np.uint32)], True
    for at in range(0, len(text), CHUNK):
        x = table[code_points(text[at : at + CHUNK])]
        space = x == 32
        drop = space & np.concatenate([[last], space[:-1]])
        parts.append(x[~drop])
        last = bool(space[-1])
    if not last:
        parts.append(np.array([32], np.uint32))
    return np.concatenate(parts)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def window_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` code points, by doubling: no window is read more than log(width) times."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = _mixed(x.astype(np.uint64) + np.uint64(0x51ED2701))
        out, done, have, power = None, 0, 1, BASE
        bits = width
        while True:
            if bits & 1:
                out = h[: len(x) - have + 1].copy() if out is None else out[: len(x) - done - have + 1] * np.uint64(power) + h[done : len(x) - have + 1]
                done += have
            bits >>= 1
            if not bits:
                return _mixed(out[:n])
            h = h[: len(h) - have] * np.uint64(power) + h[have:]
            have, power = have * 2, power * power & MASK64


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """The positions that are least in some run of ``width`` hashes; of equal neighbours in a row the first and last."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(width, n)

    def sliding(x: np.ndarray, op: np.ufunc) -> np.ndarray:
        have = 1
        while have * 2 <= width:
            x = op(x[:-have], x[have:])
            have *= 2
        return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x

    least = sliding(h, np.minimum)
    pad = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(sliding(pad, np.maximum) == h)
    same = h[at][1:] == h[at][:-1]
    inner = np.concatenate([[False], same]) & np.concatenate([same, [False]])
    return at[~inner]
