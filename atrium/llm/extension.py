"""Extension of matches from anchors, both ways.

Rows stand for the symbols (bytes, or hashes of words) around an anchor.  Sorted
by what follows the anchor, neighbours have a common-prefix length (LCP).  Going
back symbol by symbol, rows of one group part where they differ; those that stay
together keep their order, since a suffix one symbol longer is ordered by that
symbol and the rank it had before, and the LCP of neighbours is the least LCP
between the ranks that they come from, plus the symbols gone back.  Rows that
have parted never meet again, so each step works on what is still together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def common_prefixes(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Length in bytes of the common prefix of each string with the one before it (0 for the first)."""
    size = np.diff(off)
    out = np.zeros(len(size), np.int64)
    for a in range(0, len(size) - 1, 1024):
        n = np.minimum(size[a : a + 1025][:-1], size[a + 1 : a + 1025])
        width = int(n.max(initial=0))
        if not width:
            continue
        step = np.arange(width)
        most = len(raw) - 1
        left = raw[np.minimum(off[a : a + len(n)][:, None] + step, most)]
        right = raw[np.minimum(off[a + 1 : a + 1 + len(n)][:, None] + step, most)]
        unlike = left != right
        at = unlike.argmax(1)
        at[~unlike[np.arange(len(n)), at]] = width
        out[a + 1 : a + 1 + len(n)] = np.minimum(at, n)
    return out


def extend_back(group: np.ndarray, back: np.ndarray, off: np.ndarray, lcp: np.ndarray, report: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Call report(d, order, same, lcp) for d = 0, 1, ... symbols before the anchors, as long as rows are together.

    Rows are in order of (group, what follows the anchor), lcp is theirs; back:
    the symbols before the anchors and their bounds.  order: the rows that are
    left, in order; same: whether each belongs with the one before it (one entry
    less); lcp: symbols from the anchor on that each shares with the one before.
    """
    size, end = np.diff(off), off[1:]
    order = np.arange(len(size))
    for d in range(int(size.max(initial=0)) + 1):
        if d:
            stay = np.flatnonzero(size[order] >= d)
            part, symbol = group[stay], back[end[order[stay]] - d]
            if ((part[1:] == part[:-1]) & (symbol[1:] < symbol[:-1])).any():
                by = np.argsort((part << 8) | symbol, kind="stable") if back.dtype == np.uint8 else np.lexsort((symbol, part))
                stay, part, symbol = stay[by], part[by], symbol[by]
            group = np.cumsum(np.append(False, (part[1:] != part[:-1]) | (symbol[1:] != symbol[:-1]))[: len(part)])
            between = np.append(lcp, 0)
            bounds = np.stack([np.append(0, stay[:-1] + 1)[: len(stay)], stay + 1], 1).ravel()
            lcp = np.minimum.reduceat(between, bounds)[::2] if len(stay) else lcp[:0]
            order = order[stay]
        same = group[1:] == group[:-1]
        lone = ~(np.append(False, same) | np.append(same, False))[: len(order)]
        if lone.any():  # nothing is left to compare these with
            group, order, lcp = group[~lone], order[~lone], lcp[~lone]
            same = group[1:] == group[:-1]
        if not len(order):
            return
        report(d, order, same, lcp)


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, nearest and farthest distance of each run of hits (rows x distances)."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edge == 1)
    return row, near, np.nonzero(edge == -1)[1] - 1


def by_key(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Rows in order of key as tables of about so many bytes of a column; the rows of a key stay together."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            held.append(part)
            held_bytes += part.column(column).nbytes
            if held_bytes < size:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            n = int((key != key[-1]).sum())  # the last key may go on
            if n:
                yield table.slice(0, n).combine_chunks()
                held = table.slice(n).to_batches()
                held_bytes = sum(x.column(column).nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
