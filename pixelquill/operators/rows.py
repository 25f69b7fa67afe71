"""Planes in and out of Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..errors import DifferingInputs


def plane_arrays(batch: pa.RecordBatch, i: int, side: str) -> np.ndarray:
    """(planes, height, width) of row i's `side` ("a" or "b"), as they are in the batch."""
    at = batch.schema.get_field_index
    width, height = (batch.column(at(f"{side}_{n}"))[i].as_py() for n in ("width", "height"))
    planes = batch.column(at(f"{side}_planes"))[i].values
    flat = planes.flatten().to_numpy(zero_copy_only=False)
    if flat.size != len(planes) * width * height:
        raise DifferingInputs(f"a plane of {width} x {height} has {flat.size / max(len(planes), 1):.0f} samples")
    return flat.reshape(len(planes), height, width)


def tiles(height: int, width: int, size: int) -> Iterator[tuple[slice, slice]]:
    """Squares of `size` pixels that cover a plane."""
    for y in range(0, height, size):
        for x in range(0, width, size):
            yield slice(y, min(y + size, height)), slice(x, min(x + size, width))


def widened(own: slice, halo: int, length: int) -> tuple[slice, slice]:
    """(an interval with a halo, as far as the line goes; the interval's own part of that)."""
    begin, end = max(0, own.start - halo), min(length, own.stop + halo)
    return slice(begin, end), slice(own.start - begin, own.stop - begin)


def both_planes(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Row i's planes of both sides, which have to be of one shape."""
    a, b = (plane_arrays(batch, i, s) for s in ("a", "b"))
    if a.shape != b.shape:
        raise DifferingInputs(f"frames differ: {a.shape[2]} x {a.shape[1]} of {len(a)} planes and {b.shape[2]} x {b.shape[1]} of {len(b)}")
    return a, b
