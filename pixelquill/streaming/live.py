"""Streams: live score output, and the temporal filter over numbers and over planes.

Frames carry an ordinal.  The filters hold what arrives early until its turn, so late
and reordered frames give the same values as a batch; their state is the last samples of a
pair and the early ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that keeps state by column families, which stateful processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_scores(scores: DataFrame, path: str, checkpoint: str, values: list[str], pairs: int, once: bool = False) -> StreamingQuery:
    """The number of pairs, and then "ord value..." lines as batches complete; order is that of arrival.

    A batch's lines go to a folder of its own number and replace what is there, so a batch that runs
    again after a failure or restart neither repeats lines nor loses any.  `live_lines` reads the folders.
    `once` ends the query when it has gone through what is there."""
    scores.sparkSession.createDataFrame([(str(pairs),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/batch=-1")

    def put(rows: DataFrame, batch: int) -> None:
        line = F.concat_ws(" ", F.col("ord").cast("string"), *(F.col(v).cast("string") for v in values))
        rows.select(line.alias("value")).write.mode("overwrite").text(f"{path}/batch={batch}")

    writer = scores.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_lines(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value): what live_scores has written so far; batch -1 holds the number of pairs."""
    return spark.read.schema("value string, batch long").text(path).select("batch", "value")


def stream_fir(series: DataFrame, taps: list[float], key: str = "pair_id", value: str = "v") -> DataFrame:
    """(key, ord, filtered) of a stream of (key, ord, value)."""
    taps = [float(t) for t in taps]

    def step(keys: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, past, early = (0, [], {}) if not state.exists else (state.get[0], json.loads(state.get[1]), {int(k): v for k, v in json.loads(state.get[2]).items()})
        for pdf in frames:
            early.update((int(o), float(v)) for o, v in zip(pdf["ord"], pdf[value], strict=True) if int(o) >= due)
        out = []
        while due in early:
            now = early.pop(due)
            past = [now, *(past or [now] * (len(taps) - 1))][: len(taps)]
            out.append((keys[0], due, sum(t * x for t, x in zip(taps, past, strict=True))))
            due += 1
        state.update((due, json.dumps(past), json.dumps(early)))
        yield pd.DataFrame(out, columns=[key, "ord", "filtered"])

    kind = dict(series.dtypes)[key]
    return series.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ord long, filtered double", "due long, past string, early string", "append", GroupStateTimeout.NoTimeout)


class PlaneFilter(StatefulProcessor):
    """The temporal filter of one strip of one pair.

    State: the next frame's number, when the pair was last heard of, and a map of frames by number, which are those
    that the filter still looks back to and those that came early.  It goes when a pair's last frame is out
    (`frames` is their number), or when nothing has come for `idle` milliseconds (None: never), early frames included."""

    def __init__(self, taps: np.ndarray, idle: int | None):
        self.taps, self.idle = np.asarray(taps, np.float64), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ord long")
        self.heard = handle.getValueState("heard", "at long")
        self.planes = handle.getMapState("planes", "ord long", "data binary")

    def _drop_timers(self) -> None:
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def _forget(self) -> None:
        self._drop_timers()
        self.due.clear()
        self.heard.clear()
        self.planes.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        length = self.taps.shape[1]
        due = self.due.get()[0] if self.due.exists() else 0
        total, out = None, []
        for batch in rows:
            for o, planes, n in zip(batch["ord"], batch["planes"], batch["frames"], strict=True):
                total = int(n) if n is not None and not pd.isna(n) else total
                if o >= due:
                    self.planes.updateValue((int(o),), (np.stack([np.asarray(p, "<f4") for p in planes]).tobytes(),))
        held: dict[int, np.ndarray] = {}

        def frame(o: int) -> np.ndarray:
            if o not in held:
                held[o] = np.frombuffer(self.planes.getValue((o,))[0], "<f4").reshape(3, -1).astype(np.float64)
            return held[o]

        while self.planes.containsKey((due,)):
            past = np.stack([frame(max(due - k, 0)) for k in range(length)])  # before the first frame stands the first
            channels = [np.tensordot(self.taps[c], past[:, c], 1) for c in range(3)]
            if due:
                channels.append(np.tensordot(self.taps[3], past[:, 0], 1))
            out.append((*key, due, channels))
            gone = due - length + 1  # no later frame looks back to it
            if gone >= 0 and self.planes.containsKey((gone,)):
                self.planes.removeKey((gone,))
                held.pop(gone, None)
            due += 1
        if total is not None and due >= total:
            self._forget()
        else:
            self.due.update((due,))
            self._drop_timers()
            if self.idle is not None:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.heard.update((now,))
                self.handle.registerTimer(now + self.idle)
        yield pd.DataFrame(out, columns=["pair_id", "strip", "ord", "filtered"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.heard.exists() and self.heard.get()[0] + self.idle <= timerValues.getCurrentProcessingTimeInMs():
            self._forget()
        return iter([])

    def close(self) -> None:
        pass


def stream_planes(frames: DataFrame, taps: np.ndarray, idle: int | None = 600_000) -> DataFrame:
    """(pair_id, strip, ord, filtered) of a stream of (pair_id, strip, ord, frames, planes).

    planes holds the three channels of a strip (as large as one wants a task's frame to be), frames the pair's number of
    frames, or null where it is not known; taps are those of temporal.kernels.  filtered has the three sustained
    channels, and the transient one from the second frame on.  Frames that come twice count once.

    Timers keep a stream busy, so one that is to end by itself takes idle=None and says how many frames its pairs have."""
    frames.sparkSession.conf.set(*STATE_STORE)
    kinds = dict(frames.dtypes)
    shape = f"pair_id {kinds['pair_id']}, strip {kinds['strip']}, ord long, filtered array<array<double>>"
    rows = frames.select("pair_id", "strip", F.col("ord").cast("long"), F.col("frames").cast("long"), F.col("planes").cast("array<array<float>>"))
    return rows.groupBy("pair_id", "strip").transformWithStateInPandas(PlaneFilter(taps, idle), shape, "append", "none" if idle is None else "processingTime")
