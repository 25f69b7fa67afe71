"""Small numpy helpers over single planes (2-D float64 arrays).

They are the parts that a Column expression cannot say cheaply: filters over
neighbourhoods, one function per border rule.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from . import constants as K


def gaussian_matrix(n: int, sigma: float, radius: int) -> np.ndarray:
    """n x n blur of a line; taps outside are dropped and the rest rescaled."""
    d = np.arange(n)[:, None] - np.arange(n)[None, :]
    k = np.where(np.abs(d) <= radius, np.exp(-d * d / (2 * sigma * sigma)), 0.0)
    return k / k.sum(axis=1, keepdims=True)


def blur(plane: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """Separable Gaussian, renormalised at the borders."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    out = plane
    for axis in (0, 1):
        n = out.shape[axis]
        if n <= 64:
            m = gaussian_matrix(n, sigma, radius)
            out = m @ out if axis == 0 else out @ m.T
            continue
        moved = np.moveaxis(out, axis, 0)
        total, weight = np.zeros_like(moved), np.zeros(n)
        for j, w in zip(range(-radius, radius + 1), k, strict=True):
            at = slice(max(0, -j), min(n, n - j))
            source = slice(max(0, j), min(n, n + j))
            total[at] += w * moved[source]
            weight[at] += w
        out = np.moveaxis(total / weight.reshape(-1, *[1] * (moved.ndim - 1)), 0, axis)
    return out


def psycho_blur(plane: np.ndarray, name: str) -> np.ndarray:
    sigma = K.PSYCHO_SIGMAS[name]
    return blur(plane, sigma, max(int(sigma * 3), 8))


def halve(plane: np.ndarray) -> np.ndarray:
    """Mean of 2 x 2 pixels, the last row and column standing twice at odd sizes."""
    h, w = plane.shape
    p = np.pad(plane, ((0, h % 2), (0, w % 2)), mode="edge")
    return 0.25 * (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2])


def cubic(x: np.ndarray, b: float = 1 / 3, c: float = 1 / 3) -> np.ndarray:
    """The bicubic kernel of two parameters."""
    x = np.abs(x)
    near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
    far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(maxsize=256)
def resample_taps(have: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Per place of a line of `want` samples, its places on a line of `have` (mirrored at the ends) and their weights.

    The bicubic kernel, made as much wider as the line becomes shorter."""
    step = min(1.0, want / have)
    centre = (np.arange(want) + 0.5) * have / want
    n = 2 * math.ceil(2 / step)
    begin = np.floor(centre - n / 2 + 0.5).astype(np.int64)
    places = begin[:, None] + np.arange(n)
    weights = cubic((places + 0.5 - centre[:, None]) * step)
    inside = np.mod(places, 2 * have)
    return np.minimum(inside, 2 * have - 1 - inside), weights / weights.sum(axis=1, keepdims=True)


def resample(plane: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A plane at any other size: columns first, then rows."""
    out = plane
    for axis in (1, 0):
        if out.shape[axis] != shape[axis]:
            places, weights = resample_taps(out.shape[axis], shape[axis])
            moved = np.moveaxis(out, axis, 0)
            total = sum(w.reshape(-1, *[1] * (moved.ndim - 1)) * moved[p] for p, w in zip(places.T, weights.T, strict=True))
            out = np.moveaxis(total, 0, axis)
    return out


def line_sums(plane: np.ndarray, lines) -> np.ndarray:
    """Sum over all lines of the squared sum of their taps; pixels outside are 0."""
    h, w = plane.shape
    p = np.pad(plane, 4)
    out = np.zeros_like(plane)
    for taps in lines:
        total = sum(p[4 + dy : 4 + dy + h, 4 + dx : 4 + dx + w] for dx, dy in taps)
        out += total * total
    return out


def erode(plane: np.ndarray, step: int = 3) -> np.ndarray:
    """Weighted mean of the three least of the centre, twice its double, and the eight neighbours `step` away."""
    h, w = plane.shape
    p = np.pad(plane, step, constant_values=np.inf)
    stack = [plane, 2 * plane, 2 * plane]
    stack += [p[step + dy : step + dy + h, step + dx : step + dx + w] for dy in (-step, 0, step) for dx in (-step, 0, step) if dx or dy]
    least = np.sort(np.stack(stack), axis=0)[:3]
    return 0.45 * least[0] + 0.3 * least[1] + 0.25 * least[2]


def _reflect(i: np.ndarray, n: int) -> np.ndarray:
    if n <= 1:
        return np.zeros_like(i)
    return np.clip(np.where(i < 0, -i, np.where(i >= n, 2 * n - 2 - i, i)), 0, n - 1)


def reduce_plane(plane: np.ndarray) -> np.ndarray:
    """The next pyramid level: five taps, every second pixel, mirrored borders, half size rounded down."""
    out = plane
    for axis in (0, 1):
        n = out.shape[axis]
        centre = np.arange(max(1, n // 2)) * 2
        out = sum(w * np.take(out, _reflect(centre + k - 2, n), axis=axis) for k, w in enumerate(K.PYRAMID_TAPS))
    return out


def expand_plane(plane: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A level at twice the size: zeros between, five taps, replicated borders."""
    out = plane
    for axis, n in enumerate(shape):
        have = out.shape[axis]
        at = np.arange(n)
        total = 0.0
        for k, w in enumerate(K.PYRAMID_TAPS):
            source = at - (k - 2)
            even = (source % 2 == 0).astype(float).reshape([-1 if a == axis else 1 for a in (0, 1)])
            total = total + 2 * w * even * np.take(out, np.clip(source // 2, 0, have - 1), axis=axis)
        out = total
    return out


def band_sizes(width: int, height: int, ppd: float) -> list[tuple[int, int, float]]:
    """(width, height, cycles per degree) of every band, the base last."""
    n = max(1, int(np.floor(np.log2(max(1, min(width, height))))) - 1)
    out, w, h = [], width, height
    for i in range(n):
        frequency = K.BASE_FREQUENCY if i == n - 1 else ppd / 2 if i == 0 else 0.3228 * 2.0 ** -(i - 1) * ppd / 2
        out.append((w, h, frequency))
        w, h = max(1, w // 2), max(1, h // 2)
    return out


def pyramid(plane: np.ndarray, bands: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(differences, levels); the last difference is the last level."""
    levels = [plane]
    for _ in range(bands - 1):
        levels.append(reduce_plane(levels[-1]))
    return [a - expand_plane(b, a.shape) for a, b in zip(levels, levels[1:], strict=False)] + [levels[-1]], levels


def clamped_blur(plane: np.ndarray, dilate: int) -> np.ndarray:
    """Separable Gaussian of 4 * dilate + 1 taps, replicated borders."""
    r = (4 * dilate + 1) // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2.0 * dilate * dilate))
    k /= k.sum()
    out = plane
    for axis in (1, 0):
        n = out.shape[axis]
        out = sum(w * np.take(out, np.clip(np.arange(n) + j - r, 0, n - 1), axis=axis) for j, w in enumerate(k))
    return out


def interpolate_index(axis: np.ndarray, v) -> np.ndarray:
    """Fractional place of v on an ascending axis; 0 when it lies outside."""
    v = np.asarray(v, np.float64)
    i = np.clip(np.searchsorted(axis, v, "left") - 1, 0, len(axis) - 2)
    place = i + (v - axis[i]) / (axis[i + 1] - axis[i])
    return np.where((v >= axis[0]) & (v <= axis[-1]), place, 0.0)


def bilinear(table: np.ndarray, x, y) -> np.ndarray:
    """table[y, x] at fractional places, clamped to the table."""
    h, w = table.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    return (table[y0, x0] * (1 - fx) + table[y0, x1] * fx) * (1 - fy) + (table[y1, x0] * (1 - fx) + table[y1, x1] * fx) * fy
