"""Frames written to files: Y4M clips of three full planes, and headerless files.

Frames are dealt by clip and written in order, so a clip is one task's work however many
frames it has, and no more than a frame is held.  A task writes under a name of its own and
moves the file when it is whole, so tasks that run again or twice leave one whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DifferingInputs
from .video import PACKED, SAMPLES, Raw


def _store(path: str) -> tuple[fs.FileSystem, str]:
    where = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(where)


def samples(planes: np.ndarray, raw: Raw | None, padding: int = 0) -> bytes:
    """Planes of 0..1, rounded to stored samples, as the bytes of one frame."""
    if raw is None:
        return np.rint(planes * 255).astype("<u1").tobytes()
    kind, top = SAMPLES[raw.kind]
    stored = (np.rint(planes * top) if top > 1 else planes).astype(kind)
    if raw.layout == "planar":
        rows = np.full((3, raw.height, raw.row), padding, kind)
        rows[:, :, : raw.width] = stored
        return rows.tobytes()
    _, places, per = PACKED[raw.layout]
    pixels = np.full((raw.height, raw.width, per), padding, kind)
    pixels[:, :, list(places)] = np.moveaxis(stored, 0, 2)
    rows = np.full((raw.height, raw.row), padding, kind)
    rows[:, : raw.across] = pixels.reshape(raw.height, -1)
    return rows.tobytes()


def write_clips(frames: DataFrame, folder: str, raw: Raw | None = None, padding: int = 0) -> DataFrame:
    """(path, frames) of the files written, one for each video_id, in ascending frame_idx.

    raw None writes Y4M of 4:4:4 (planes are its y, cb and cr); else a headerless layout, whose padding gets a value."""
    layout = None if raw is None else asdict(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top)
        form = None if layout is None else Raw(**layout)
        name, size, out, n = None, None, None, 0
        suffix = f".{TaskContext.get().taskAttemptId()}.part"

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{top}/{name}{suffix}", f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "frames": pa.array([n], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["video_id"] != name:
                    if name is not None:
                        yield close()
                    name, size, n = row["video_id"], (row["height"], row["width"]), 0
                    out = store.open_output_stream(f"{top}/{name}{suffix}")
                    if form is None:
                        rate = Fraction(row["fps"]).limit_denominator(1001)
                        out.write(f"YUV4MPEG2 W{size[1]} H{size[0]} F{rate.numerator}:{rate.denominator} Ip C444\n".encode())
                if (row["height"], row["width"]) != size or (form and (form.height, form.width) != size):
                    raise DifferingInputs(f"a frame of {name} has another size")
                planes = np.array(row["planes"], np.float64).reshape(3, *size)
                out.write((b"FRAME\n" if form is None else b"") + samples(planes, form, padding))
                n += 1
        if name is not None:
            yield close()

    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frames.select("video_id", "frame_idx", "width", "height", F.col("fps").cast("double"), "planes")
    dealt = rows.repartition(n, "video_id").sortWithinPartitions("video_id", "frame_idx")
    return dealt.mapInArrow(run, "path string, frames long")
