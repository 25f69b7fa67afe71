"""Structural score: one number of at most 100 per frame pair (100: identical).

Tasks turn a pair into pooled maps, a few rows per scale, without moving its planes; the
rest (weights, polynomial) is a join with a 108-row table and a sum.  A pair is worked through
in tiles of TILE pixels with as much around them as the blur reaches on each scale, so beside
the frames themselves a task's memory does not grow with their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import pixel
from ..functions.planes import blur, halve
from .rows import both_planes, tiles, widened

MAPS = ("structure", "artifact", "detail")
#: Pixels of a tile's side.
TILE = 1024


def weights(spark: SparkSession) -> DataFrame:
    """(plane, scale, kind, map, weight), 108 rows."""
    order = [(p, s, n, m) for p in range(3) for s in range(K.STRUCTURAL_SCALES) for n in ("mean", "norm4") for m in MAPS]
    return spark.createDataFrame([(*o, w) for o, w in zip(order, K.STRUCTURAL_WEIGHTS, strict=True)], "plane int, scale int, kind string, map string, weight double")


def _xyb(planes: np.ndarray) -> np.ndarray:
    m = np.array(K.STRUCTURAL_OPSIN)
    l, md, s = np.cbrt(np.maximum(np.tensordot(m[:, :3], planes, 1) + m[:, 3, None, None], 0)) + K.STRUCTURAL_CUBE_BIAS
    x = 0.5 * (l - md)
    y = x + md
    return np.stack([x * 14 + 0.42, y + 0.01, s - y + 0.55])


def _maps(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    soft = lambda p: blur(p, K.STRUCTURAL_SIGMA, K.STRUCTURAL_RADIUS)
    m1, m2, s11, s22, s12 = soft(a), soft(b), soft(a * a), soft(b * b), soft(a * b)
    d = m1 - m2
    yield np.maximum(1 - (1 - d * d) * (2 * (s12 - m1 * m2) + 0.0009) / ((s11 - m1 * m1) + (s22 - m2 * m2) + 0.0009), 0)
    v = (np.abs(b - m2) + 1) / (np.abs(a - m1) + 1) - 1
    yield np.maximum(v, 0)
    yield np.maximum(-v, 0)


def _halved(planes: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        planes = np.stack([halve(p) for p in planes])
    return planes


def pooled_maps(a: np.ndarray, b: np.ndarray, tile: int = TILE) -> dict[tuple[int, int, str], tuple[float, float]]:
    """(scale, plane, map) -> (mean, 4-norm) of two encoded frames, tile by tile."""
    if tile % (1 << (K.STRUCTURAL_SCALES - 1)):
        raise ValueError("a tile has to hold whole pixels of the coarsest scale")
    h, w = a.shape[1:]
    sums: dict[tuple[int, int, str], list[float]] = {}
    for rows, columns in tiles(h, w, tile):
        for scale in range(K.STRUCTURAL_SCALES):
            unit = 1 << scale
            cut, inner = [], []
            for own, length in ((rows, h), (columns, w)):
                small = slice(own.start // unit, -(-own.stop // unit))
                outer, inside = widened(small, K.STRUCTURAL_RADIUS, -(-length // unit))
                cut.append(slice(outer.start * unit, min(outer.stop * unit, length)))
                inner.append(inside)
            both = [p[:, cut[0], cut[1]].astype(np.float64) for p in (a, b)]
            x, y = (_xyb(_halved(np.sign(p) * np.abs(p) ** 2.4, scale)) for p in both)
            for plane in range(3):
                for name, v in zip(MAPS, _maps(x[plane], y[plane]), strict=True):
                    v = v[inner[0], inner[1]]
                    total = sums.setdefault((scale, plane, name), [0.0, 0.0, 0])
                    total[0] += float(v.sum())
                    total[1] += float((v**4).sum())
                    total[2] += v.size
    return {k: (s / n, (s4 / n) ** 0.25) for k, (s, s4, n) in sums.items()}


def _scales(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [(*k, *v) for k, v in pooled_maps(*both_planes(batch, i), tile).items()]
                own = pa.array([i] * len(rows))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *columns], ["pair_id", "ord", "scale", "plane", "map", "mean", "norm4"])

    return run


def scale_maps(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """(pair_id, ord, scale, plane, map, mean, norm4) of pairs(pair_id, ord, a_*, b_*)."""
    rows = pairs.select("pair_id", F.col("ord").cast("int"), "a_width", "a_height", "a_planes", "b_width", "b_height", "b_planes")
    return rows.mapInArrow(_scales(tile), f"pair_id {dict(pairs.dtypes)['pair_id']}, ord int, scale int, plane int, map string, mean double, norm4 double")


def structural_score(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """(pair_id, ord, score)."""
    maps = scale_maps(pairs, tile)
    long = maps.select("pair_id", "ord", "scale", "plane", "map", F.explode(F.array(F.struct(F.lit("mean").alias("kind"), F.col("mean").alias("v")), F.struct(F.lit("norm4").alias("kind"), F.col("norm4").alias("v")))).alias("s"))
    weighted = long.select("pair_id", "ord", "scale", "plane", "map", "s.kind", "s.v").join(F.broadcast(weights(pairs.sparkSession)), ["plane", "scale", "kind", "map"])
    return weighted.groupBy("pair_id", "ord").agg(F.sum(F.col("v") * F.col("weight")).alias("total")).select("pair_id", "ord", pixel.structural_value(F.col("total")).alias("score"))
