"""One spot in one bounded crop, with the same estimator as the relational job."""

from __future__ import annotations

import numpy as np


def measure(
    y: np.ndarray,
    x: np.ndarray,
    v: np.ndarray,
    centre: tuple[float, float],
    crop: int,
    size: tuple[int, int],
    sigma_min: float,
    fixed_background: float | None = None,
    snr: float = 4.0,
    tol: float = 4.0,
    passes: int = 2,
    border: float = 0.25,
    min_peak: float = 4.0,
) -> tuple[float, float, float, float, float, float] | None:
    """(x, y, sigma, peak, background, intensity), or None where a gate fails."""
    height, width = size
    half = crop // 2
    rx, ry = round(centre[0]), round(centre[1])
    gate = v[(x >= rx - half) & (x < rx + half) & (y >= ry - half) & (y < ry + half)]
    if not len(gate) or gate.max() - np.median(gate) < snr * gate.std():
        return None
    cx, cy = centre
    for _ in range(passes):
        x0, y0 = max(round(cx) - half, 0), max(round(cy) - half, 0)
        x1, y1 = min(x0 + crop, width), min(y0 + crop, height)
        inside = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        if not inside.any():
            return None
        px, py, pv = x[inside], y[inside], v[inside]
        b = max(1, int(min(y1 - y0, x1 - x0) * border))
        strips = (py < y0 + b).astype(int) + (py >= y1 - b) + (px < x0 + b) + (px >= x1 - b)
        edge = float(np.median(np.repeat(pv, strips)))
        top = pv.max()
        if top - edge < snr * pv.std():
            return None
        off = edge if fixed_background is None else fixed_background
        q = np.maximum(pv - off, 0.0)
        total = q.sum()
        if total <= 0:
            return None
        mx, my = (q * px).sum() / total, (q * py).sum() / total
        sx = max((q * px * px).sum() / total - mx * mx, 0.0) ** 0.5
        sy = max((q * py * py).sum() / total - my * my, 0.0) ** 0.5
        cx, cy = max(cx - tol, min(cx + tol, mx)), max(cy - tol, min(cy + tol, my))
        if not (tol < cx - x0 < crop - tol and tol < cy - y0 < crop - tol):
            return None
    peak = float(top - off)
    if peak < min_peak:
        return None
    sx, sy = (max(sigma_min, min(crop / 4.0, s)) for s in (sx, sy))
    return cx, cy, 0.5 * (sx + sy), peak, max(off, 0.0), max(2 * np.pi * peak * sx * sy, 0.0)
