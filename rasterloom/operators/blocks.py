"""Window operators whose cost doesn't follow the window, on tiles with their surroundings (``plans.tiling.dispatch_tiled``)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def sliding_distinct(a: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Number of different values, NaN left out, in the window of each cell.

    Window rows slide down; a cell enters and leaves once. Of every value the columns that hold it are kept in order: a
    column adds to the windows that reach it but not its neighbour on the left, so a change touches two places of a line
    of differences, whose running sum is the count.
    """
    h, w = a.shape
    numbers = np.full(a.shape, -1, np.int64)
    held = ~np.isnan(a)
    numbers[held] = np.unique(a[held], return_inverse=True)[1]
    rows = numbers.tolist()
    last: list[dict[int, int]] = [{} for _ in range(w)]  # of a column: how often the window holds a value there
    columns: dict[int, list[int]] = {}
    steps = np.zeros(w + 2 * rx + 2, np.int64)  # by the window's centre, counted from -rx on
    reach = 2 * rx + 1
    changes: list[tuple[int, int]] = []

    def put(v: int, c: int) -> None:
        at = columns.setdefault(v, [])
        k = bisect_left(at, c)
        before, after = (c - at[k - 1] if k else reach), (at[k] - c if k < len(at) else reach)
        span(c, min(before, reach), min(after, reach), 1)
        insort(at, c)

    def drop(v: int, c: int) -> None:
        at = columns[v]
        k = bisect_left(at, c)
        del at[k]
        before, after = (c - at[k - 1] if k else reach), (at[k] - c if k < len(at) else reach)
        span(c, min(before, reach), min(after, reach), -1)

    def span(c: int, before: int, after: int, sign: int) -> None:
        # centres that reach c (reach of them), without those that the columns before and after it reach already
        first, end = c + reach - before, c + after
        if first < end:
            changes.append((first, sign))
            changes.append((end, -sign))

    out = np.zeros(a.shape)
    for r in range(-ry, h):
        enter, leave = r + ry, r - ry - 1
        if enter < h:
            for c, v in enumerate(rows[enter]):
                if v >= 0:
                    n = last[c].get(v, 0)
                    last[c][v] = n + 1
                    if not n:
                        put(v, c)
        if leave >= 0:
            for c, v in enumerate(rows[leave]):
                if v >= 0:
                    n = last[c][v] - 1
                    if n:
                        last[c][v] = n
                    else:
                        del last[c][v]
                        drop(v, c)
        if changes:
            at, by = np.array(changes).T
            np.add.at(steps, at, by)
            changes.clear()
        if r >= 0:
            out[r] = np.cumsum(steps)[rx : rx + w]
    return out


def convolved(a: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value times weight and of weights around each cell (correlation; NaN left out), by Fourier transforms. Where the
    weights' sum is within rounding of zero both sums are taken term by term."""
    h, w = a.shape
    kh, kw = kernel.shape
    ry, rx = kh // 2, kw // 2
    held = ~np.isnan(a)
    shape = (h + kh - 1, w + kw - 1)
    turned = np.fft.rfft2(kernel[::-1, ::-1], shape)

    def around(x: np.ndarray) -> np.ndarray:
        # the last ry (rx) rows of an even kernel reach one cell less
        return np.fft.irfft2(np.fft.rfft2(x, shape) * turned, shape)[kh - 1 - ry : kh - 1 - ry + h, kw - 1 - rx : kw - 1 - rx + w]

    middle = np.nanmean(a) if held.any() else 0.0  # values about their mean: less to cancel
    den = around(held.astype(float))
    num = around(np.where(held, a - middle, 0.0)) + middle * den
    near = np.argwhere(np.abs(den) < 1e-9 * np.abs(kernel).sum())
    for r, c in near.tolist():
        r0, r1, c0, c1 = max(0, r - ry), min(h, r - ry + kh), max(0, c - rx), min(w, c - rx + kw)
        part, weight = a[r0:r1, c0:c1], kernel[r0 - r + ry : r1 - r + ry, c0 - c + rx : c1 - c + rx]
        some = ~np.isnan(part)
        num[r, c], den[r, c] = (part[some] * weight[some]).sum(), weight[some].sum()
    return num, den
