"""The temporal filter: a causal FIR over a pair's frames in order.

Before the first frame, the first frame is taken.  History is one per pair, in
ascending ord."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .sampling import numbered


def filter_length(fps: float = 30.0, override: int = -1) -> int:
    if override > 0:
        return max(3, override + (override % 2 == 0))
    return 2 * max(1, math.ceil(0.25 * (fps if fps > 0 else 30.0) / 2)) + 1


def kernels(fps: float = 30.0, override: int = -1, sigma=K.DISPLAY_PARAMETERS["sigma_tf"], beta=K.DISPLAY_PARAMETERS["beta_tf"]) -> np.ndarray:
    """4 x n taps: three sustained channels, and the transient one as the first's complement.

    The inverse transform is not divided by n, so sustained taps add up to n."""
    n = filter_length(fps, override)
    half = n // 2 + 1
    omega = np.arange(half) * ((fps / 2) / (half - 1)) if half > 1 else np.zeros(1)
    response = np.stack([np.exp(-(omega ** beta[c]) / max(1e-6, sigma[c])) for c in range(3)])
    response = np.vstack([response, 1 - response[0]])
    angle = 2 * np.pi * np.outer(np.arange(1, half), np.arange(n)) / n
    taps = response[:, :1] + 2 * response[:, 1:] @ np.cos(angle)
    return np.roll(taps, n // 2, axis=1)


def fir(value: Column, taps, keys: list[str], order: list[str]) -> Column:
    """The filtered value as a window expression."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start = F.first_value(value).over(w)
    return sum((F.coalesce(F.lag(value, k).over(w), start) * F.lit(float(t)) for k, t in enumerate(taps) if k), value * F.lit(float(taps[0])))


def with_history(rows: DataFrame, keys: list[str], length: int, chunk: int = 64, order: str = "ord") -> DataFrame:
    """Rows with `chunk`, each sent to its own chunk and, near a chunk's end, to the next ones that look back to it.

    So a filter runs per (keys, chunk), groups have at most chunk + length - 1 rows, and a long
    video is many tasks."""
    last = F.floor((F.col(order) + length - 1) / chunk)
    return rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col(order) / chunk), last)))


def filtered_series(rows: DataFrame, value: str, taps: dict[str, np.ndarray], keys: tuple[str, ...], order: tuple[str, ...], chunk: int = 4096) -> DataFrame:
    """rows with `ord` and one filtered column per kernel, for series of any length.

    Rows are numbered inside their key without a window over it (sampling.numbered) and filtered in chunks that get
    the few rows before them, so one long series is many tasks; the order has to tell all rows of a key apart."""
    length = max(len(t) for t in taps.values())
    placed = numbered(rows, keys, order).drop("size")
    spread = with_history(placed, list(keys), length, chunk)
    found = spread.withColumns({name: fir(F.col(value), t, [*keys, "chunk"], ["ord"]) for name, t in taps.items()})
    return found.where(F.col("chunk") == F.floor(F.col("ord") / chunk)).drop("chunk")
