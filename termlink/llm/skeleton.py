"""Sampled skeleton of long symbol sequences, shared by the two repeat removers.

Every window of ``length`` symbols has one anchor: the leftmost smallest-hashed gram of ``gram`` symbols
in it.  Equal windows have equal anchors at equal places, so repeats are found among anchors (about two
for every ``length - gram + 2`` symbols) instead of among all positions.  Consecutive windows with the
same anchor form a block, the unit of work of both removers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .kernels import prefix_hash, ragged, range_hash

_U = np.uint64


@dataclass
class Blocks:
    """Blocks of some documents; places count symbols from the document's start."""

    doc: np.ndarray  # index of the document in its batch
    low: np.ndarray  # first window start
    count: np.ndarray  # windows
    anchor: np.ndarray  # identity of the anchor gram
    name: np.ndarray  # identity of all the block's symbols
    at: np.ndarray  # the anchor's place
    prefix: np.ndarray
    first: np.ndarray  # documents' first symbols

    def windows(self, which: np.ndarray, length: int):
        """Documents, starts and identities of the windows of some blocks."""
        count = self.count[which]
        start = ragged(self.low[which], count)
        doc = np.repeat(self.doc[which], count)
        at = start + self.first[doc]
        return doc, start, range_hash(self.prefix, at, at + length)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def blocks(symbols: np.ndarray, first: np.ndarray, length: int, gram: int) -> Blocks:
    prefix = prefix_hash(symbols)
    windows = np.maximum(np.diff(first) - length + 1, 0)
    if not windows.sum():
        none = np.zeros(0, np.int64)
        return Blocks(none, none, none, np.zeros(0, _U), np.zeros(0, _U), none, prefix, first)
    at = np.arange(len(symbols) - gram + 1)
    grams = range_hash(prefix, at, at + gram)
    bits = _U((1 << len(symbols).bit_length()) - 1)
    smallest = sliding_min((grams & ~bits) | at.astype(_U), length - gram + 1)
    start = ragged(first[:-1], windows)
    anchor = (smallest[start] & bits).astype(np.int64)
    doc = np.repeat(np.arange(len(windows)), windows)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([begin, [len(start)]]))
    low, doc = start[begin], doc[begin]
    return Blocks(doc, low - first[doc], count, grams[anchor[begin]], range_hash(prefix, low, low + count - 1 + length), anchor[begin] - first[doc], prefix, first)
