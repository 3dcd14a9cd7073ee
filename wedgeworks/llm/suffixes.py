"""Suffix sort by words of eight bytes, and prefix hashes, in numpy.

Suffixes are put in order by their first eight bytes, then those that are equal so far
by the next eight, and so on; what has no equal left takes no further part.  Bytes are
compared themselves, so equality is exact.  Prefix polynomial hashes give the hash of
any substring in constant time.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: By base: its powers, as far as they have been needed.
_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = _known.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    _known[base] = out
    return out[:n]


#: A random odd value for each byte.
_rng = np.random.default_rng(20_240_601)
VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes:
    """Prefix polynomial hashes of a byte buffer, modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.raw = raw
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[raw] * _powers(BASE, n), out=self.prefix[1:])
        self.back = _powers(INVERSE, n + 1)


def words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number: the first byte counts most."""
    return np.ndarray(max(0, len(raw) - 7), ">u8", raw, 0, (1,))


def sort_within(raw: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``at``, cut to ``length`` bytes (eight at least), inside each group; and in that order, which
    differ from the one before in group or in a byte."""
    order = np.argsort(group, kind="stable")
    view, new = words(raw), np.ones(len(at), bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    for offset in [*range(0, length - 8, 8), length - 8]:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        some, of = order[open_], np.cumsum(new)[open_]
        word = view[at[some] + offset].astype(np.uint64)
        by = np.lexsort((word, of))
        order[open_], word, of = some[by], word[by], of[by]
        new[open_[1:]] |= (word[1:] != word[:-1]) & (of[1:] == of[:-1])
    return order, new
