"""Bilinear samples beside places of a line, as arrays."""

from __future__ import annotations

import functools

import numpy as np


def mirror(i: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Index reflected at the image border, the border pixel repeated."""
    j = np.mod(i, 2 * n)
    return np.where(j < n, j, 2 * n - 1 - j)


def corners(place: dict[str, np.ndarray], half_width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and weight of the pixels under the samples of n places, each of shape (4, 2 * half_width + 1, n).

    A place has _x, _y, its unit normal _nx, _ny, and the image's height _h and width _w.  A weight that
    isn't above 0 means that the pixel has no part in the sample.
    """
    off = np.arange(-half_width, half_width + 1.0)[:, None]
    low, part = {}, {}
    for c in "xy":
        at = place[f"_{c}"] + place[f"_n{c}"] * off
        floor = np.floor(at)
        low[c] = np.where(np.isnan(floor), 0, floor).astype(np.int64)
        part[c] = at - low[c]
    xs = [mirror(low["x"] + i, place["_w"]) for i in (0, 1)]
    ys = [mirror(low["y"] + j, place["_h"]) for j in (0, 1)]
    wx, wy = (1 - part["x"], part["x"]), (1 - part["y"], part["y"])
    four = [(i, j) for i in (0, 1) for j in (0, 1)]
    return np.stack([xs[i] for i, _ in four]), np.stack([ys[j] for _, j in four]), np.stack([wx[i] * wy[j] for i, j in four])


def sampled(
    values: np.ndarray, known: np.ndarray, at: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray | None]:
    """Samples (frames, offsets, n) of ``values`` (frames, pixels), and which of them have no known pixel.

    ``at`` and ``weights`` are like those of ``corners``; the last pixel stands for none and is never known.
    The second result is None where every sample has all its pixels.
    """
    none = values.shape[1] - 1
    met = np.zeros(none + 1, bool)
    met[at] = True
    met[none] = False
    whole = known[:, met].all()
    total, lacks = 0.0, True
    for i, w in zip(at, weights):
        term = np.take(values, i, axis=1)
        term *= w
        if not whole or not np.isfinite(w).all():
            there = np.take(known, i, axis=1)
            term[~there] = 0.0
            lacks = lacks & ~there
        total = total + term
    return total, None if whole else lacks


@functools.lru_cache(64)
def mirrored_weights(half: tuple[float, ...], first: int, n: int, size: int) -> np.ndarray:
    """Weight (2 * radius + 1, n) of the neighbours of n places from ``first`` on, with their images behind the borders 0 and ``size``."""
    kernel, radius, here = np.array(half), len(half) - 1, np.arange(first, first + n)
    q = here + np.arange(-radius, radius + 1)[:, None]

    def tap(p: np.ndarray) -> np.ndarray:
        j = np.abs(p - here)
        return np.where(j <= radius, kernel[np.minimum(j, radius)], 0.0)

    edge = (here < radius) | (here >= size - radius)
    near = tap(q) + np.where(edge, tap(-1 - q) + tap(2 * size - 1 - q), 0.0)
    if size > radius:
        return near
    far = 0.0
    for m in (-3, -2, -1, 1, 2, 3):
        far = far + tap(q + 2 * size * m)
        if m != 1:
            far = far + tap(2 * size * m - 1 - q)
    return near + far


def weighted_sums(pairs: list[tuple[np.ndarray, np.ndarray]], axis: int) -> np.ndarray:
    """Sum over (values, weights) of the neighbours' values along ``axis``; places beyond the ends hold 0.

    Neighbours are added in their order, so equal rows give equal sums.
    """
    radius, n = len(pairs[0][1]) // 2, pairs[0][0].shape[axis]
    margin = [(radius, radius) if k == axis else (0, 0) for k in (0, 1)]
    padded = [(np.pad(v, margin), w[:, :, None] if axis == 0 else w[:, None, :]) for v, w in pairs]
    total = np.zeros(pairs[0][0].shape)
    for j in range(2 * radius + 1):
        for v, w in padded:
            total += (v[j : j + n] if axis == 0 else v[:, j : j + n]) * w[j]
    return total
