"""Windows of consecutive words, and the anchors that equal windows share."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from rolegrain.llm.textvec import gram_hashes

LONGEST_CELL = 32


def sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """better (np.minimum or np.maximum) over each run of width values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = better(out[: len(out) - step], out[step:])
        have += step
    return out


class Cells(NamedTuple):
    """Runs of consecutive windows of one row that share their smallest gram."""

    anchor: np.ndarray  # hash of that gram
    first: np.ndarray  # first window, as a position among the chunk's words
    count: np.ndarray  # windows


def window_minima(hashes: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, smallest gram of each window, whether the window lies in one row)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = gram_hashes(hashes, gram)
    least = sliding(grams, width - gram + 1, np.minimum)
    row_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return grams, least, np.arange(n) + width <= row_end


def anchor_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The hash of each gram that is the smallest of some window, once per place. Two equal windows at
    different places give one hash at two places."""
    grams, least, inside = window_minima(hashes, bounds, width, gram)
    if not inside.any():
        return np.zeros(0, np.uint64)
    span = width - gram
    masked = np.where(inside, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span, np.uint64), masked, np.zeros(span, np.uint64)])
    most = sliding(padded, span + 1, np.maximum)
    return grams[grams == most]


def cells_of(hashes: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> Cells:
    _, least, inside = window_minima(hashes, bounds, width, gram)
    at = np.flatnonzero(inside)
    if not len(at):
        return Cells(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)))
    new = np.r_[True, (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    start = np.flatnonzero(new)
    run = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    first = np.flatnonzero(run % LONGEST_CELL == 0)
    return Cells(least[at[first]], at[first], np.diff(np.r_[first, len(at)]))
