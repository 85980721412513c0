"""Tokens as runs of bytes of one kind, with 64-bit hashes, found in pieces so that a long text needs no long work arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from loomgraph.llm.common import mix, powers, prefix_sums

#: Bytes of a term: ASCII letters and digits, and all bytes of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


class Tokens(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    code: np.ndarray


def cuts(data: np.ndarray, inside: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``step`` bytes that end before a byte that is not ``inside`` a token."""
    lo = 0
    while lo < len(data):
        hi = min(lo + step, len(data))
        while hi < len(data):
            run = inside[data[hi : hi + 4096]]
            if not run.all():
                hi += int(run.argmin())
                break
            hi += len(run)
        yield lo, hi
        lo = hi


def tokens(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: np.ndarray, step: int = 1 << 20) -> Iterator[Tokens]:
    """Tokens of all rows, piece by piece: where they start and end in ``data``, their row and their hash."""
    for lo, hi in cuts(data, inside, step):
        piece = data[lo:hi]
        within = inside[piece]
        edge = np.zeros(len(piece) + 1, bool)
        bounds = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")]
        edge[bounds - lo] = True
        edge[[0, -1]] = True
        before = edge.copy()
        before[1 : len(piece)] |= ~within[:-1]
        after = edge.copy()
        after[:-1] |= ~within
        start = np.flatnonzero(within & before[:-1])
        end = np.flatnonzero(within & after[1:]) + 1
        folded = lower[piece]
        sums = prefix_sums(folded)
        code = mix((sums[end] - sums[start]) * powers(len(piece) + 1)[1][start] + (end - start).astype(np.uint64))
        yield Tokens(start + lo, end + lo, np.searchsorted(offsets, start + lo, "right") - 1, code)
