"""Display-aware visual difference in quality units (10: identical, 0: worst).

Stages as DataFrames: a pair's row becomes rows of its bands' strips (some lines, with as
many more at both sides as the mask's blur reaches); each strip is filtered over time and
masked in groups of a bounded number of frames, so memory depends on neither the frame
size nor the length (strips travel as single-precision floats); pooling over pixels, bands and channels and the quality map are
aggregates and expressions.

The contrast sensitivity table is given by the caller; none is part of this library.  So are the
metric's parameters, where others than the built-in ones are wanted (sources/config.py reads them
from a document): every stage takes them as data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import pixel
from ..functions.planes import band_sizes, bilinear, clamped_blur, interpolate_index, pyramid
from ..sources.config import Display
from .pooling import pool_bands
from .rows import both_planes
from .temporal import filter_length, kernels, with_history

P = K.DISPLAY_PARAMETERS
#: Pixels of a strip.
STRIP = 1 << 16
MODES = ("weber_g1", "weber_g1_ref", "weber_g0_ref")


@dataclass(frozen=True)
class Sensitivity:
    """log10 sensitivities of y, rg, by and transient y over log10 background and log10 frequency."""

    log_background: np.ndarray
    log_frequency: np.ndarray
    tables: tuple[np.ndarray, ...]  # four, [background, frequency]

    @classmethod
    def from_axes(cls, background, frequency, tables) -> Sensitivity:
        low = lambda v: np.log10(np.maximum(np.asarray(v, np.float64), 1e-6))
        shape = (len(background), len(frequency))
        arrays = tuple(np.asarray(t, np.float64) for t in tables)
        if len(arrays) != 4 or any(t.shape != shape for t in arrays):
            raise ValueError(f"four tables of shape {shape} are needed")
        return cls(low(background), low(frequency), arrays)

    def gains(self, frequency: float, log_background: np.ndarray, correction: float = P["sensitivity_correction"]) -> list[np.ndarray]:
        x = interpolate_index(self.log_frequency, np.log10(frequency))
        y = interpolate_index(self.log_background, log_background)
        return [10.0 ** (bilinear(t, np.broadcast_to(x, y.shape), y) + correction / 20) * g for t, g in zip(self.tables, K.CHANNEL_GAIN, strict=True)]


def light(planes: np.ndarray, display: Display) -> np.ndarray:
    """Encoded RGB to the opponent channels of the display's light."""
    v, peak, black = np.maximum(planes, 0), display.peak, display.black
    if display.eotf == "PQ":
        p = v ** (1 / 78.84375)
        v = np.maximum(10000 * (np.maximum(p - 0.8359375, 0) / np.maximum(18.8515625 - 18.6875 * p, 1e-10)) ** (1 / 0.1593017578125), black)
    elif display.eotf == "HLG":
        v = np.maximum(np.where(v <= 0.5, v * v / 3, (np.exp((v - 0.55991073) / 0.17883277) + 0.28466892) / 12) * peak, black)
    else:
        if display.eotf == "sRGB":
            v = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
        elif display.eotf == "gamma":
            v = v**display.gamma
        v = black + (peak - black) * v
    m = np.array(K.LMS_TO_DKL) @ np.array(K.XYZ_TO_LMS) @ np.array(display.rgb_to_xyz)
    return np.tensordot(m, v, 1)


def halo(p: dict) -> int:
    """Lines that a strip's neighbours share with it: as far as the mask's blur reaches."""
    return (4 * p["pu_dilate"] + 1) // 2


def _bands(display: Display, table: Sensitivity, mode: str, strip: int, p: dict):
    around = halo(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ref, test = (light(img.astype(np.float64), display) for img in both_planes(batch, i))
                sizes = band_sizes(ref.shape[2], ref.shape[1], display.ppd)
                both = [[pyramid(plane, len(sizes)) for plane in img] for img in (test, ref)]
                for k, (w, h, frequency) in enumerate(sizes):
                    back = [np.maximum(img[0][1][k], 0.01) for img in both]
                    if mode != "weber_g1":
                        back[0] = back[1]
                    gains = table.gains(frequency, 0.5 * (np.log10(back[0]) + np.log10(back[1])), p["sensitivity_correction"])
                    lap = [np.stack([ch[0][k] for ch in img]) for img in both]
                    if k < len(sizes) - 1:
                        lap = [np.minimum(x / y, 1000) for x, y in zip(lap, back, strict=True)]
                    t, r = (x * np.stack(gains[:3]) for x in lap)
                    lines = max(1, strip // w)
                    for y in range(0, h, lines):
                        top, end = max(0, y - around), min(h, y + lines + around)
                        whole = {"band": k, "bands": len(sizes), "width": w, "height": h, "strip": y, "first": y - top, "lines": min(lines, h - y)}
                        yield pa.RecordBatch.from_pydict({
                            "pair_id": batch.column(0).slice(i, 1), "ord": batch.column(1).slice(i, 1), **{n: pa.array([v], pa.int32()) for n, v in whole.items()},
                            "test": pa.array([t[:, top:end].ravel().astype(np.float32)], pa.list_(pa.float32())), "ref": pa.array([r[:, top:end].ravel().astype(np.float32)], pa.list_(pa.float32())),
                        })

    return run


def contrast_bands(pairs: DataFrame, display: Display, table: Sensitivity, mode: str | None = None, strip: int = STRIP, parameters: dict = P) -> DataFrame:
    """Weighted contrasts of three channels, a row per strip: (pair_id, ord, band, bands, width, height of the band,
    strip's first line, first own line in it, own lines, test, ref)."""
    mode = mode or parameters["contrast"]
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    rows = pairs.select("pair_id", F.col("ord").cast("int"), "a_width", "a_height", "a_planes", "b_width", "b_height", "b_planes")
    kind = dict(pairs.dtypes)["pair_id"]
    return rows.mapInArrow(_bands(display, table, mode, strip, parameters), f"pair_id {kind}, ord int, band int, bands int, width int, height int, strip int, first int, lines int, test array<float>, ref array<float>")


def _power(v: np.ndarray, p: float) -> np.ndarray:
    return (v + 1e-5) ** p - 1e-5**p


def clamped(d: np.ndarray, kind: str, most: float) -> np.ndarray:
    """Masked differences below a bound: approached softly, cut off, or none."""
    if kind not in ("soft", "hard", "none"):
        raise ValueError(f"dclamp_type {kind!r}")
    return most * d / (most + d) if kind == "soft" else np.minimum(d, most) if kind == "hard" else d


def masked(t: np.ndarray, r: np.ndarray, size: tuple[int, int], p: dict = P) -> np.ndarray:
    """Masked differences of (channels, lines, width) contrasts out of a band of the given size."""
    n = len(t)
    mutual = np.minimum(np.abs(t), np.abs(r))
    if p["pu_dilate"] and min(size) > 2 * p["pu_dilate"]:
        mutual = np.stack([clamped_blur(m, p["pu_dilate"]) for m in mutual])
    mutual = mutual * 10.0 ** p["mask_c"]
    across = (2.0 ** np.array(p["xcm_weights"]).reshape(4, 4))[:n, :n]
    mask = np.maximum(np.tensordot(across.T, mutual, 1), 0)
    d = np.stack([_power(np.abs(t[c] - r[c]), p["mask_p"]) / (1 + _power(mask[c], p["mask_q"][c])) for c in range(n)])
    return clamped(d, p["dclamp_type"], 10.0 ** p["d_max"])


def _filtered(length: int, taps: np.ndarray, chunk: int, p: dict):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        w, h, first, lines = (int(rows[c].iloc[0]) for c in ("width", "height", "first", "lines"))
        pair, band, bands = (rows[c].iloc[0] for c in ("pair_id", "band", "bands"))
        at, own = rows["ord"].to_numpy(), rows["ord"].to_numpy() // chunk == rows["chunk"].to_numpy()
        planes = {o: (np.reshape(t, (3, -1, w)).astype(np.float64), np.reshape(r, (3, -1, w)).astype(np.float64)) for o, t, r in zip(at, rows["test"], rows["ref"], strict=True)}
        out = []
        for o in at[own]:
            t, r = planes[o]
            if band == bands - 1:
                d = np.abs(t - r)
            else:
                past = [planes[max(o - k, 0)] for k in range(length)]
                t, r = (_fir([both[s] for both in past], taps) for s in (0, 1))
                n = 3 if o == 0 else 4
                d = masked(t[:n], r[:n], (h, w), p)
            d = d[:, first : first + lines]
            total = (np.abs(d) ** p["beta"]).sum(axis=(1, 2))
            own = zip(total, d.sum(axis=(1, 2)), d.min(axis=(1, 2)), d.max(axis=(1, 2)), strict=True)
            out += [(pair, int(o), int(band), int(bands), c, *map(float, v), lines * w) for c, v in enumerate(own)]
        return pd.DataFrame(out, columns=["pair_id", "ord", "band", "bands", "ch", "total", "added", "least", "most", "pixels"])

    return run


def _fir(past: list[np.ndarray], taps: np.ndarray) -> np.ndarray:
    """Three sustained channels and transient luma."""
    stack = np.stack(past)  # (taps, 3, h, w)
    sustained = [np.tensordot(taps[c], stack[:, c], 1) for c in range(3)]
    return np.stack([*sustained, np.tensordot(taps[3], stack[:, 0], 1)])


def band_scores(bands: DataFrame, fps: float = 30.0, chunk: int = 64, parameters: dict = P) -> DataFrame:
    """(pair_id, ord, band, bands, ch, q, minimum, maximum, mean, pixels): filtered over time, masked, pooled over pixels."""
    p = parameters
    length, taps = filter_length(fps, p["filter_len"]), kernels(fps, p["filter_len"], p["sigma_tf"], p["beta_tf"])
    spread = with_history(bands, ["pair_id", "band", "strip"], length, chunk)
    kind = dict(bands.dtypes)["pair_id"]
    sums = spread.groupBy("pair_id", "band", "strip", "chunk").applyInPandas(_filtered(length, taps, chunk, p), f"pair_id {kind}, ord int, band int, bands int, ch int, total double, added double, least double, most double, pixels long")
    return sums.groupBy("pair_id", "ord", "band", "bands", "ch").agg(
        F.pow(F.sum("total") / F.sum("pixels"), F.lit(1 / p["beta"])).alias("q"),
        F.min("least").alias("minimum"), F.max("most").alias("maximum"), (F.sum("added") / F.sum("pixels")).alias("mean"), F.sum("pixels").alias("pixels"),
    )


def display_difference(pairs: DataFrame, display: Display, table: Sensitivity, fps: float = 30.0, mode: str | None = None, chunk: int = 64, strip: int = STRIP, parameters: dict = P) -> DataFrame:
    """(pair_id, ord, score); ord numbers a pair's frames from 0 without gaps.  mode is that of the parameters if not given."""
    scores = band_scores(contrast_bands(pairs, display, table, mode, strip, parameters), fps, chunk, parameters)
    pooled = pool_bands(scores, ["pair_id", "ord", "bands"], parameters)
    still = (F.col("ord") == 0) | (F.col("bands") == 1)  # no band has a second frame yet
    q = F.col("q") * F.when(still, F.lit(parameters["image_int"])).otherwise(F.lit(1.0))
    return pooled.select("pair_id", "ord", pixel.quality_units(q, parameters["jod_a"], parameters["jod_exp"]).alias("score"))
