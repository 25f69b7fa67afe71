"""Repeated passages with sparse suffix arrays.

Only suffixes that begin at content-selected places are kept: the word positions
whose GRAM-word hash is the least of some WINDOW neighbours (minimisers).  Any
passage of LEAST words holds such a place within its first WINDOW positions, so a
repeat shows as two kept suffixes that agree for REACH = LEAST - WINDOW + 1 words and more.

1. The kept suffixes of all documents are sorted by their words, in the order of the
   words' one-byte codes, as deep as a match has to reach: a suffix's key is the
   string of its first REACH codes, not a hash of them.  Neighbours are compared by
   the length of their common prefix; a suffix that shares REACH words with one of
   another document is a candidate.  The order ends with document and position, so
   a passage of any number of copies is spread over partitions; runs that meet a
   partition's edge are settled from the edges alone.
2. Candidates are extended to the left and right: every stretch of LEAST whole words
   that contains one is sorted (by a 64-bit hash, as all have one length) and compared
   with its neighbours in the same way, and stretches found in two documents are
   merged to maximal spans per document.  So equal codes of different words are
   told apart here.

Words are runs of bytes other than ASCII white space, compared as 64-bit hashes.

Cases: null and empty texts, and texts of fewer than LEAST words, have no spans;
a passage that repeats only inside one document is not reported unless `within`;
rows that share an id are told apart by their texts' hashes, rows that repeat wholly
count as one document; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import kept, written
from ._text import LOWER, SPACED, U64, Words, ngrams, pieces, signed, texts_of
from .decontaminate import winnow

LEAST = 50
GRAM, WINDOW = 8, 32


SHAPE = "key {kind}, doc long, at int"


def _placed(piece: pa.RecordBatch, words: Words, keys: pa.Array, places: np.ndarray) -> pa.RecordBatch:
    """Keys with their document and the position inside it."""
    text = words.text[places]
    return pa.RecordBatch.from_arrays([keys, piece.column(0).take(pa.array(text)), pa.array((places - words.first[text]).astype(np.int32))], ["key", "doc", "at"])


def strings(rows: np.ndarray) -> pa.Array:
    """A binary value per row of bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def common_prefixes(column: pa.Array) -> np.ndarray:
    """How far each key agrees with the one before it: bytes of equally long strings, or 0 and 1 for numbers."""
    if pa.types.is_binary(column.type):
        data, off = texts_of(column)
        rows = data.reshape(len(column), -1)
        same = rows[1:] == rows[:-1]
        return np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    key = np.asarray(column)
    return (key[1:] == key[:-1]).astype(np.int64)


def _suffixes(least: int):
    reach = least - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = texts_of(piece.column(1))
                words = Words(data, off, SPACED)
                h = words.hashes(LOWER)
                gram, at = ngrams(h, words.first, GRAM)
                places = at[winnow(gram, at, WINDOW)]
                places = places[places + reach <= words.first[words.text[places] + 1]]  # others have too few words left
                codes = (h >> U64(56)).astype(np.uint8)
                keys = sliding_window_view(codes, reach)[places] if len(places) else np.zeros((0, reach), np.uint8)
                yield _placed(piece, words, strings(keys), places)

    return run


@dataclass
class Run:
    """The run of equal keys that a partition's reader stands in."""

    key: object
    doc: int
    many: bool
    lone: list  # its rows, as long as one document has them all
    sample: pa.RecordBatch
    first: bool


def _neighbours(within: bool, reach: int):
    """The rows of sorted partitions that agree for `reach` and more with a row of another document (or any other row, `within`).

    state 0: they do; 1: a run at a partition's edge, open until the other side is known; 2: the mark of such a run."""

    def out(rows: pa.RecordBatch, state: int, many: bool = False) -> pa.RecordBatch:
        n, part = rows.num_rows, TaskContext.get().partitionId()
        more = [pa.array(np.full(n, state, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, many))]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "state", "part", "many"])

    def close(run: Run, edge: bool) -> Iterator[pa.RecordBatch]:
        if edge:
            yield from (out(r, 1) for r in run.lone)
            yield out(run.sample, 2, run.many)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column(0), np.asarray(batch.column(1))
            begin = np.flatnonzero(np.r_[True, common_prefixes(key) < reach])
            end = np.append(begin[1:], len(doc))
            # Rows of a key are in order of documents: one document if the first and the last are one.
            many = (doc[begin] != doc[end - 1]) | (within & (end - begin > 1))

            def started(k: int, first: bool) -> Run:
                rows = batch.slice(begin[k], end[k] - begin[k])  # noqa: B023
                return Run(key[int(begin[k])].as_py(), doc[begin[k]], bool(many[k]), [] if many[k] else [rows], rows.slice(0, 1), first)  # noqa: B023

            if run is not None and run.key == key[0].as_py():
                run.many = bool(many[0]) or run.many or run.doc != doc[0] or within
                many[0] = run.many
                if run.many:
                    yield from (out(r, 0) for r in run.lone)
                    run.lone = []
                else:
                    run.lone.append(batch.slice(0, end[0]))
            else:
                if run is not None:
                    yield from close(run, run.first)
                run = started(0, run is None)
            if len(begin) > 1:
                yield from close(run, run.first)
                run = started(len(begin) - 1, False)
            sure = np.repeat(many, end - begin)
            if sure.any():
                yield out(batch.filter(pa.array(sure)), 0)
        if run is not None:
            yield from close(run, True)

    return read


def repeated(rows: DataFrame, within: bool, reach: int = 1) -> DataFrame:
    """Rows (doc, at) whose keys agree with one of another document for `reach`."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "key", "doc", "at").sortWithinPartitions("key", "doc", "at")
    marked = ordered.mapInArrow(_neighbours(within, reach), f"{SHAPE.format(kind=dict(rows.dtypes)['key'])}, state int, part int, many boolean")
    found = written(marked.withColumn("key", F.when(F.col("state") > 0, F.col("key"))), "runs")  # only edges need their keys yet
    edges = found.where("state = 2").groupBy("key").agg(F.max("many").alias("many"), F.countDistinct("part").alias("parts"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    edges = edges.where(F.col("many") | (F.col("low") != F.col("high")) | (F.lit(within) & (F.col("parts") > 1))).select("key")
    settled = found.where("state = 1").join(edges, "key", "left_semi")
    return found.where("state = 0").unionByName(settled).select("doc", "at")


def _stretches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = texts_of(piece.column(1))
                words = Words(data, off, SPACED)
                gram, at = ngrams(words.hashes(LOWER), words.first, least)
                wanted = np.zeros(len(words) + 1, np.int32)
                places = piece.column(2)
                counts = np.diff(np.asarray(places.offsets))
                flat = np.asarray(places.flatten()) + np.repeat(words.first[:-1], counts)
                owner = np.repeat(words.first[:-1], counts)
                np.add.at(wanted, np.maximum(flat - WINDOW + 1, owner), 1)
                np.add.at(wanted, flat + 1, -1)
                keep = np.cumsum(wanted)[at] > 0
                yield _placed(piece, words, pa.array(signed(gram[keep])), at[keep])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, within: bool = False) -> DataFrame:
    """Maximal spans of `least` words and more that repeat: id, first_word, n_words.
    Spans of one document may overlap only if their parts repeat in different places."""
    if least < WINDOW + GRAM - 1:
        raise ValueError(f"least must be {WINDOW + GRAM - 1} or more")
    # A document is a 64-bit hash of its id and text; the id comes back at the end.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("doc"), F.col(text_col).alias("text"))
    candidates = repeated(rows.select("doc", "text").mapInArrow(_suffixes(least), SHAPE.format(kind="binary")), within, least - WINDOW + 1)
    places = kept(candidates.groupBy("doc").agg(F.collect_set("at").alias("places")))  # bounded by the document's length
    met = rows.select("doc", "text").join(places, "doc")
    hits = repeated(met.mapInArrow(_stretches(least), SHAPE.format(kind="long")), within).groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("at"))
    named = rows.select("id", "doc").distinct()
    spans = hits.join(named, "doc").select("id", F.explode(_spans(F.col("at"), least)).alias("s"))
    return spans.select(F.col("id").alias(id_col), F.col("s.first").cast("long").alias("first_word"), F.col("s.n").cast("long").alias("n_words"))


def _spans(at, least: int):
    """Sorted stretch starts as merged (first, n) spans; overlapping and touching stretches join."""
    n = F.size(at)
    index = F.sequence(F.lit(1), n)
    begins = F.filter(index, lambda i: (i == 1) | (F.element_at(at, i) > F.element_at(at, F.greatest(i - 1, F.lit(1))) + least))
    ends = F.filter(index, lambda i: (i == n) | (F.element_at(at, F.least(i + 1, n)) > F.element_at(at, i) + least))
    return F.zip_with(begins, ends, lambda a, b: F.struct(F.element_at(at, a).alias("first"), (F.element_at(at, b) + least - F.element_at(at, a)).alias("n")))
