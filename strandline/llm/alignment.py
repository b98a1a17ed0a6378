"""Batched local alignment of word sequences, and an exact test for nearly verbatim windows."""

from __future__ import annotations

import numpy as np

#: Smith-Waterman scores.
MATCH, MISMATCH, GAP = 1, -1, -1
_PAD_A, _PAD_B = -2, -3


def _padded(rows: list[np.ndarray], pad: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), pad, np.int32)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def smith_waterman(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The best local alignment score of each pair ``a[k], b[k]`` of id arrays."""
    left, right = _padded(a, _PAD_A), _padded(b, _PAD_B)
    n, width = right.shape
    ramp = np.arange(width, dtype=np.int16)[None, :] * np.int16(-GAP)
    above = np.zeros((n, width), np.int16)
    best = np.zeros(n, np.int16)
    for i in range(left.shape[1]):
        step = np.where(left[:, i, None] == right, np.int16(MATCH), np.int16(MISMATCH))
        step[:, 1:] += above[:, :-1]
        np.maximum(step, above + np.int16(GAP), out=step)
        np.maximum(step, 0, out=step)
        step += ramp
        np.maximum.accumulate(step, axis=1, out=step)
        step -= ramp
        above = step
        np.maximum(best, above.max(axis=1), out=best)
    return best


def nearly_verbatim(a: list[np.ndarray], b: list[np.ndarray], window: int) -> np.ndarray:
    """Whether ``window`` successive words of ``a[k]`` stand in ``b[k]`` with at most one edit.

    A word may be replaced, dropped or added; a word dropped at either end counts too.
    """
    left, right = _padded(a, _PAD_A), _padded(b, _PAD_B)
    n, width = right.shape
    rows = left.shape[1]
    ahead = np.zeros((rows + 2, n, width + 2), np.int8)  # [i, :, j]: run that starts at word i, j
    for i in range(rows - 1, -1, -1):
        same = left[:, i, None] == right
        ahead[i, :, :width] = np.where(same, np.minimum(ahead[i + 1, :, 1 : width + 1] + 1, window), 0)
    found = ahead.max(axis=(0, 2)) >= window - 1
    before = np.zeros((n, width), np.int8)  # run that ends at the word before i, and at word j
    for i in range(rows):
        if i:
            run = before
            replaced = run[:, :width] + ahead[i + 1, :, 2 : width + 2]
            dropped = run[:, :width] + ahead[i + 1, :, 1 : width + 1]
            added = run[:, :width] + ahead[i, :, 2 : width + 2]
            near = (run > 0) & ((np.maximum(replaced, dropped) >= window - 1) | (added >= window))
            found |= near.any(axis=1)
        same = left[:, i, None] == right
        longer = np.ones((n, width), np.int8)
        longer[:, 1:] += before[:, :-1]
        before = np.where(same, np.minimum(longer, window), 0).astype(np.int8)
    return found
