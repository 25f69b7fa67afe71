"""Psychovisual distance: a difference map and its norms (0: identical).

Tasks turn a pair into its map (full and half size, added up) without moving its planes;
norms are taken there too, unless the map itself is asked for.  The map comes tile by tile,
each from the tile and HALO pixels around it, which is as far as its stages reach one after
the other; so beside the frames themselves a task's memory does not grow with their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.planes import erode, halve, line_sums, psycho_blur
from .rows import both_planes, tiles, widened

_OPSIN = np.array(K.PSYCHO_OPSIN)
#: Pixels of a tile's side.
TILE = 512


def _reach(name: str) -> int:
    return max(int(K.PSYCHO_SIGMAS[name] * 3), 8)


#: How far a pixel of the map sees: the blurs one after the other, and then lines of 4 pixels or the mask with its erosion.
HALO = sum(_reach(n) for n in ("opsin", "lf", "mf", "hf")) + max(4, _reach("mask") + 3)


def _absorb(rgb: np.ndarray) -> np.ndarray:
    return np.tensordot(_OPSIN[:, :3], rgb, 1) + _OPSIN[:, 3, None, None]


def adapted(rgb: np.ndarray, intensity: float) -> np.ndarray:
    """Linear RGB to adapted x, y, b."""
    floor = _OPSIN[:, 3, None, None]
    around = np.maximum(np.maximum(_absorb(np.stack([psycho_blur(p, "opsin") for p in rgb]) * intensity), floor), 1e-4)
    sensitivity = np.maximum((K.RESPONSE_SCALE * np.log(around + K.RESPONSE_SHIFT) - K.RESPONSE_OFFSET) / around, 1e-4)
    l, m, s = np.maximum(_absorb(rgb * intensity) * sensitivity, floor)
    return np.stack([l - m, l + m, s])


def _shrink(v: np.ndarray, w: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - w, 0)


def _stretch(v: np.ndarray, w: float) -> np.ndarray:
    return np.where(np.abs(v) > w, v + np.sign(v) * w, 2 * v)


def _soft(v: np.ndarray, most: float) -> np.ndarray:
    return np.where(np.abs(v) > most, np.sign(v) * ((np.abs(v) - most) * K.SOFT_SLOPE + most), v)


def bands(xyb: np.ndarray) -> dict[str, list[np.ndarray]]:
    """Low, middle, high and ultra-high frequencies; b ends at the middle."""
    low = [psycho_blur(p, "lf") for p in xyb]
    rest = [p - q for p, q in zip(xyb, low, strict=True)]
    middle = [psycho_blur(p, "mf") for p in rest]
    high = [rest[c] - middle[c] for c in (0, 1)]
    middle[0], middle[1] = _shrink(middle[0], 0.29), _stretch(middle[1], 0.1)
    high[0] = high[0] * (K.SUPPRESSION + 46.0 * (1 - K.SUPPRESSION) / (46.0 + high[1] ** 2))
    soft = [psycho_blur(p, "hf") for p in high]
    hf_x, uhf_x = _shrink(soft[0], 1.5), _shrink(high[0] - soft[0], 0.04)
    clamped = _soft(soft[1], K.HF_MOST)
    uhf_y, hf_y = _soft(high[1] - clamped, K.UHF_MOST) * K.UHF_GAIN, _stretch(clamped * 2.155, 0.132)
    x, y, b = low
    values = [x * K.LOW_X, y * K.LOW_Y, (b - K.LOW_B_FROM_Y * y) * K.LOW_B]
    return {"lf": values, "mf": middle, "hf": [hf_x, hf_y], "uhf": [uhf_x, uhf_y]}


def _outside(a: np.ndarray, b: np.ndarray, low: float, high: float) -> np.ndarray:
    side, size = np.where(a < 0, -1.0, 1.0), np.abs(a)
    return np.maximum(np.maximum(size * low - side * b, side * b - size * high), 0)


def _oriented(a: np.ndarray, b: np.ndarray, lines: str, weight: float, exponent: float, norm: float) -> np.ndarray:
    per = K.LINE_SCALE[lines] / (K.LINE_LENGTH * 2 + 1) * norm / (norm + 0.5 * np.abs(a) + 0.5 * np.abs(b))
    more, less = np.sqrt(0.5 * weight * K.ASYMMETRY**exponent), np.sqrt(0.33 * weight / K.ASYMMETRY**exponent)
    d = a - b
    field = per * (more * d + np.where(d < 0, -1, 1) * less * _outside(a, b, 0.55, 1.05))
    return line_sums(field, K.LINES_HIGH if lines == "high" else K.LINES_LOW)


def _mask(one: dict) -> np.ndarray:
    (hx, hy), (ux, uy) = one["hf"], one["uhf"]
    v = np.sqrt(((ux + hx) * 2.5) ** 2 + (uy * 0.4 + hy * 0.4) ** 2)
    mul, bias = K.COMPRESS_GAIN, K.COMPRESS_BIAS
    return psycho_blur(np.sqrt(mul * v + mul * bias) - np.sqrt(mul * bias), "mask")


def difference_map(a: np.ndarray, b: np.ndarray, intensity: float) -> np.ndarray:
    """Linear RGB planes to the difference map of one size."""
    p, q = bands(adapted(a, intensity)), bands(adapted(b, intensity))
    ac = np.zeros(a.shape[1:])
    for band, channel, lines, weight, exponent, norm in K.ORIENTED:
        c = "xy".index(channel)
        ac += _oriented(p[band][c], q[band][c], lines, weight, exponent, norm)
    for c, w in enumerate(K.HF_WEIGHTS):
        s, t = p["hf"][c], q["hf"][c]
        ac += 0.8 * w * K.ASYMMETRY * (s - t) ** 2 + 0.8 * w / K.ASYMMETRY * _outside(s, t, 0.4, 1.0) ** 2
    ac += sum(w * (s - t) ** 2 for w, s, t in zip(K.MF_WEIGHTS, p["mf"], q["mf"], strict=True))
    dc = sum(w * (s - t) ** 2 for w, s, t in zip(K.LF_WEIGHTS, p["lf"], q["lf"], strict=True))
    mask_a, mask_b = _mask(p), _mask(q)
    ac += K.MASK_WEIGHT * (mask_a - mask_b) ** 2
    m = erode(mask_a)
    gain = lambda offset, scaler, mul: ((1 + mul / (scaler * m + offset)) / K.GAIN_DIVISOR) ** 2
    return np.sqrt(gain(*K.FINE_GAIN) * ac + gain(*K.COARSE_GAIN) * dc)


def _linear(planes: np.ndarray) -> np.ndarray:
    planes = planes.astype(np.float64)
    return np.sign(planes) * np.abs(planes) ** 2.4


def map_tiles(a: np.ndarray, b: np.ndarray, intensity: float, tile: int = TILE) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(lines, columns, their part of the map) of two encoded frames: full size, and half size twice as large added."""
    if tile % 2:
        raise ValueError("a tile has to hold whole pixels of the half size")
    h, w = a.shape[1:]
    for rows, columns in tiles(h, w, tile):
        whole, own = zip(*(widened(s, HALO, n) for s, n in ((rows, h), (columns, w))), strict=True)
        d = difference_map(*(_linear(p[:, whole[0], whole[1]]) for p in (a, b)), intensity)[own[0], own[1]]
        half = [slice(s.start // 2, -(-s.stop // 2)) for s in (rows, columns)]
        outer, inside = zip(*(widened(s, HALO, -(-n // 2)) for s, n in zip(half, (h, w), strict=True)), strict=True)
        cut = [slice(2 * s.start, min(2 * s.stop, n)) for s, n in zip(outer, (h, w), strict=True)]
        small = difference_map(*(np.stack([halve(c) for c in _linear(p[:, cut[0], cut[1]])]) for p in (a, b)), intensity)[inside[0], inside[1]]
        yield rows, columns, d * 0.85 + 0.5 * small.repeat(2, 0).repeat(2, 1)[: d.shape[0], : d.shape[1]]


def _maps(intensity: float, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = both_planes(batch, i)
                d = np.zeros(a.shape[1:])
                for rows, columns, part in map_tiles(a, b, intensity, tile):
                    d[rows, columns] = part
                size = [pa.array([d.shape[1]], pa.int32()), pa.array([d.shape[0]], pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *size, pa.array([d.ravel()], pa.list_(pa.float64()))], ["pair_id", "ord", "width", "height", "data"])

    return run


def _norms(intensity: float, q: float, tile: int):
    """Norms in the task, so that no map goes back to Spark."""

    def norms(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
        powers, cubes, most = 0.0, 0.0, 0.0
        for _, _, part in map_tiles(a, b, intensity, tile):
            d = np.abs(part)
            powers, cubes, most = powers + float((d**q).sum()), cubes + float((d**3).sum()), max(most, float(d.max()))
        n = a.shape[1] * a.shape[2]
        return (powers / n) ** (1 / q), (cubes / n) ** (1 / 3), most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [norms(*both_planes(batch, i)) for i in range(batch.num_rows)]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["pair_id", "ord", "norm_q", "norm_3", "norm_inf"])

    return run


def _inputs(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", F.col("ord").cast("int"), "a_width", "a_height", "a_planes", "b_width", "b_height", "b_planes")


def distortion_maps(pairs: DataFrame, intensity: float = 203.0, tile: int = TILE) -> DataFrame:
    """(pair_id, ord, width, height, data) of pairs(pair_id, ord, a_*, b_*)."""
    return _inputs(pairs).mapInArrow(_maps(intensity, tile), f"pair_id {dict(pairs.dtypes)['pair_id']}, ord int, width int, height int, data array<double>")


def psychovisual_distance(pairs: DataFrame, q: float = 2.0, intensity: float = 203.0, tile: int = TILE) -> DataFrame:
    """(pair_id, ord, norm_q, norm_3, norm_inf)."""
    return _inputs(pairs).mapInArrow(_norms(intensity, q, tile), f"pair_id {dict(pairs.dtypes)['pair_id']}, ord int, norm_q double, norm_3 double, norm_inf double")
