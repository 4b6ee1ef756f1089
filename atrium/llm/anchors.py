"""Winnowed anchors: each window of a text picks its gram of least hash.

A window's anchor depends on the window's content alone, so equal windows have
equal anchors at equal offsets.  The windows that share an anchor start at
consecutive places; such a run is the unit in which repeats are compared.
"""

from __future__ import annotations

import numpy as np

_POS = np.uint64((1 << 36) - 1)


def sliding_min(values: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each m consecutive values, from running minima of blocks of m."""
    n = len(values)
    if n < m:
        return values[:0]
    pad = -n % m
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    blocks = np.concatenate([values, np.full(pad, top)]).reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - m + 1], ahead[m - 1 : n])


def anchor_runs(grams: np.ndarray, of: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all documents: (document, anchor position, first window, windows) of each run.

    grams: hash of the gram that starts at each symbol; of: bounds of the
    documents' symbols (n + 1).  Ties go to the leftmost gram.
    """
    m = window - gram + 1
    if len(grams) < m:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    composite = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(composite, m) & _POS).astype(np.int64)
    n = len(anchor)
    full = of[1:] - of[:-1] >= window
    first, stop = of[:-1][full], of[1:][full] - window + 1
    valid = np.zeros(n, bool)
    if len(first):
        # documents don't overlap, so starts and stops alternate; a stop may be the next start
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, first, 1)
        np.add.at(step, stop, -1)
        valid = np.cumsum(step[:n]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    own = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(new)
    return np.searchsorted(of, at[i], "right") - 1, own[i], at[i], np.diff(np.append(i, len(at)))
