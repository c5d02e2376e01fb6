"""The oriented line filter of one raster, in NumPy; Spark deals the stretches to tasks."""

from __future__ import annotations

import math

import numpy as np

# Directions, and sizes of the filter in metres.
DIRECTIONS, LINE_M, FLANK_M, COLUMN_M = 12, 0.3, 0.045, 0.015


def box_mean(x: np.ndarray, half: int) -> np.ndarray:
    """Centred means that shrink at the edges."""
    sums = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
    i = np.arange(len(x))
    low, high = np.maximum(i - half, 0), np.minimum(i + half + 1, len(x))
    return (sums[high] - sums[low]) / np.maximum(high - low, 1)


def oriented_means(image: np.ndarray, px: float, py: float, theta: float, half_m: float) -> np.ndarray:
    """Means along the direction theta over half_m to either side; NaN where under 80 % of the pixels count."""
    steps = max(1, round(half_m / max(abs(math.cos(theta)) * px, abs(math.sin(theta)) * py, min(px, py))))
    total, count = np.zeros(image.shape), np.zeros(image.shape)
    for k in range(-steps, steps + 1):
        di, dj = round(math.cos(theta) * half_m * k / steps / px), round(math.sin(theta) * half_m * k / steps / py)
        moved = shifted(image, di, dj)
        has = ~np.isnan(moved)
        total += np.where(has, moved, 0)
        count += has
    return np.where(count >= 0.8 * (2 * steps + 1), total / np.maximum(count, 1), np.nan)


def shifted(image: np.ndarray, di: int, dj: int) -> np.ndarray:
    """image[j + dj, i + di], NaN outside."""
    out = np.full(image.shape, np.nan)
    h, w = image.shape
    if abs(di) < w and abs(dj) < h:
        out[max(0, -dj) : h - max(0, dj), max(0, -di) : w - max(0, di)] = image[max(0, dj) : h + min(0, dj), max(0, di) : w + min(0, di)]
    return out


def line_responses(image: np.ndarray, px: float, py: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For dark and bright lines: the greatest robust z of any direction at each pixel, and that direction."""
    best = {p: (np.zeros(image.shape), np.zeros(image.shape, dtype=np.int16)) for p in ("dark", "bright")}
    for a in range(DIRECTIONS):
        theta = a * math.pi / DIRECTIONS
        di, dj = round(-math.sin(theta) * FLANK_M / px), round(math.cos(theta) * FLANK_M / py)
        if not di and not dj:
            di, dj = (-int(np.sign(math.sin(theta))), 0) if abs(math.sin(theta)) * py > abs(math.cos(theta)) * px else (0, int(np.sign(math.cos(theta))))
        along = oriented_means(image, px, py, theta, LINE_M / 2)
        response = (shifted(along, di, dj) + shifted(along, -di, -dj)) / 2 - along
        some = response[~np.isnan(response)][::5]
        if len(some) < 100:
            continue
        centre = np.sort(some)[len(some) // 2]
        spread = 1.4826 * np.sort(np.abs(some - centre))[len(some) // 2]
        if not spread > 0:
            continue
        z = np.nan_to_num((response - centre) / spread)
        for sign, (top, angle) in zip((1, -1), best.values()):
            more = sign * z > top
            top[more] = sign * z[more]
            angle[more] = a
    return best


def ridges(image: np.ndarray, px: float, py: float, low: float) -> list[tuple[str, int, int, float, int]]:
    """(polarity, i, j, z, direction) of pixels no weaker than both neighbours across their line."""
    out = []
    h, w = image.shape
    for polarity, (z, angle) in line_responses(image, px, py).items():
        keep = z >= low
        keep[[0, -1], :] = False
        keep[:, [0, -1]] = False
        for a in range(DIRECTIONS):
            theta = a * math.pi / DIRECTIONS
            nx, ny = -math.sin(theta) / px, math.cos(theta) / py
            scale = max(abs(nx), abs(ny))
            di, dj = round(nx / scale), round(ny / scale)
            top = np.fmax(shifted(z, di, dj), shifted(z, -di, -dj))
            keep &= (angle != a) | (z >= top)
        jj, ii = np.nonzero(keep)
        out += [(polarity, i, j, float(z[j, i]), int(angle[j, i])) for j, i in zip(jj.tolist(), ii.tolist())]
    return out
