"""Runs of words that repeat periodically inside a text, by probing a harmonic grid.

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) and length at least max(6, 4 q), as long as it goes.  A run of period p holds three
neighbouring points jp, (j+1)p, (j+2)p of the grid of step p whose words equal those one
step on.  So for every p up to a quarter of the words only the grid of step p is probed,
n/p words each and n log n in all; three hits in a row survive and are extended to both
sides by comparing chunks of growing size.  Periods go up, and survivors whose three steps
lie inside a run that is found already are skipped: that run's own further grid points, and
multiples of its period, which are no smallest ones (two periods on a stretch as long as
both together have their greatest common divisor as a period too).

Words are runs of bytes other than ASCII white space, compared by 64-bit hashes and not
folded.  A row is judged on its own in one pass; nothing is exchanged.

Cases: null and empty texts have no words and no runs; repeated rows are judged each; a
null id is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import SPACED, Words, pieces, texts_of

#: A run has this many words at least, and so many periods.
LEAST, PERIODS = 6, 4
#: Grid points probed at once; words compared at once at first, and at most.
PROBES = 1 << 19
CHUNK, LARGE = 64, 1 << 14

SCHEMA = "id {id}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"


def _agreeing(h: np.ndarray, p: int, at: int, stop: int) -> int:
    """How many words from `at` on, before `stop`, equal those p on."""
    done, chunk = at, CHUNK
    while done < stop:
        end = min(done + chunk, stop)
        differ = h[done:end] != h[done + p : end + p]
        first = int(differ.argmax())
        if differ[first]:
            return done + first - at
        done, chunk = end, min(2 * chunk, LARGE)
    return stop - at


def _agreeing_before(h: np.ndarray, p: int, at: int, stop: int) -> int:
    """How many words before `at`, down to `stop`, equal those p on."""
    done, chunk = at, CHUNK
    while done > stop:
        begin = max(done - chunk, stop)
        differ = (h[begin:done] != h[begin + p : done + p])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return at - (done - first)
        done, chunk = begin, min(2 * chunk, LARGE)
    return at - stop


def _survivors(h: np.ndarray, first: np.ndarray, periods: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, place) of three hits in a row on the grids of the given texts' periods; places count over all texts."""
    n = (first[text + 1] - first[text] - 1) // periods - 2  # triples that fit
    total = np.cumsum(n)
    found = []
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PROBES, "right")))
        m = n[begin:end]
        of = np.repeat(np.arange(begin, end), m)
        j = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        p = periods[of]
        at = first[text[of]] + j * p
        alive = np.flatnonzero(h[at] == h[at + p])
        for step in (1, 2):
            a, q = at[alive], p[alive]
            alive = alive[h[a + step * q] == h[a + (step + 1) * q]]
        found.append((text[of[alive]], p[alive], at[alive]))
        begin = end
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_runs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, ordered by text, start and period; `first` holds the texts' ranges in h."""
    count = np.diff(first)
    reach = np.zeros(len(h), np.int64)  # per word, the farthest end of a run found that holds it
    runs = []
    low = 1
    while low <= (top := int(count.max(initial=0)) // PERIODS):
        high = min(2 * low - 1, top)  # no period of a round is a multiple of another
        texts = np.flatnonzero((count >= LEAST) & (count // PERIODS >= low))
        m = np.minimum(count[texts] // PERIODS, high) - low + 1
        text = np.repeat(texts, m)
        periods = low + np.arange(len(text)) - np.repeat(np.cumsum(m) - m, m)
        of, p, at = _survivors(h, first, periods, text)
        open_ = reach[at] <= at + 3 * p
        for t, q, i in zip(of[open_].tolist(), p[open_].tolist(), at[open_].tolist(), strict=True):
            if reach[i] > i + 3 * q:
                continue
            base, stop = int(first[t]), int(first[t + 1]) - q
            begin = i - _agreeing_before(h, q, i, base)
            end = i + _agreeing(h, q, i, stop) + q
            if end - begin >= max(LEAST, PERIODS * q) and reach[begin] < end:
                runs.append((t, begin - base, end - begin, q))
                reach[begin:end] = np.maximum(reach[begin:end], end)
        low = high + 1
    out = np.array(runs, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _kept(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    step = np.zeros(first[-1] + 1, np.int32)
    base = first[runs[:, 0]] + runs[:, 1]
    np.add.at(step, base + runs[:, 3], 1)
    np.add.at(step, base + runs[:, 2], -1)
    return np.cumsum(step)[: first[-1]] == 0


def joined_words(words: Words, stays: np.ndarray) -> list[bytes]:
    """Per text, the words that stay, joined by one space."""
    data, start, end = words.data, words.start, words.end
    # Bytes of the words that stay, each word with one more byte for its space.
    length = np.where(stays, end - start + 1, 0)
    held = np.flatnonzero(stays)
    total = int(length.sum())
    out = np.full(total, 0x20, np.uint8)
    own = (end - start)[held]
    put = np.cumsum(own + 1) - own - 1
    within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(put, own) + within] = data[np.repeat(start[held], own) + within]
    edges = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=edges[1:])
    cut = edges[words.first]
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            words = Words(*texts_of(piece.column(1)), SPACED)
            runs = find_runs(words.hashes(), words.first)
            kept = joined_words(words, _kept(runs, words.first))
            of = np.searchsorted(runs[:, 0], np.arange(piece.num_rows + 1))
            lines = [b"%d,%d,%d\n" % (s, n, p) for s, n, p in runs[:, 1:].tolist()]
            listed = [b"".join(lines[a:b]) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
            fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(pa.array(of, pa.int32()), fields), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in listed]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                ["id", "n_words", "runs", "collapsed", "runs_sha256", "collapsed_sha256"],
            )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_words, its runs (start, length, period; by start, then period), the text without
    repetitions (`collapsed`: each run's first period stays, words joined by one space), and digests of both."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_search, SCHEMA.format(id=dict(docs.dtypes)[id_col])).withColumnRenamed("id", id_col)


def longest(runs: Column) -> Column:
    """The run of greatest length, of equals the first; null where there is none."""
    better = lambda best, x: F.when(best.isNull() | (x["length"] > best["length"]), x).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def with_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts in which a tenth of the rows, chosen by the crc32 of their ids, end in a repeated stretch.

    With h that crc32, g = h // 10 and n words: where 10 divides h, words from a = g % n on are
    those of the p = 1 + (n - a) // (3 + g % 8) words at a, again and again.  Null ids and texts stay."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10).cast("long"), F.size("_words")
    a = F.when(n > 0, g % n).cast("int")
    p = (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int")
    unit = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - F.col("_a")) / F.col("_p")).cast("int"))), F.lit(1), n - F.col("_a"))
    chosen = docs.select(F.col(id_col), F.col(text_col), F.when(h % 10 == 0, words).alias("_words"))
    placed = chosen.withColumn("_a", a).withColumn("_p", p)
    changed = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return placed.select(id_col, F.when(n > 0, changed).otherwise(F.col(text_col)).alias(text_col))
