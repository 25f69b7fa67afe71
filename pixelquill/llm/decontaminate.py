"""Benchmark decontamination by winnowing.

Items are cut into windows of 13 consecutive words.  A document is scanned for
winnowed fingerprints: of every 6 neighbouring 8-word hashes the least is kept,
so any 13 words shared with an item share at least one kept fingerprint.  Hits
are extended to the windows around them, which are then compared whole.  Items
of fewer than 13 words are one window each, looked up at their own length.

The item windows are a stated query set.  They are counted first and split into
blocks of about MAX_BLOCK windows by a hash of item and window, so that an item of
any length is split too; each block is broadcast and scans all
documents in its own pass, so the broadcast has a fixed bound at any size.

Cases: null or empty texts have no words and no hits; an item without words has
no window; repeated items count each, repeated documents are judged each; an
empty benchmark leaves every document clean.  Equality is that of 64-bit hashes
of words and windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import kept
from ._text import ALNUM, LOWER, U64, Words, covered, in_sorted, ngrams, pieces, signed, texts_of

WINDOW = 13
GRAM = 8
SPAN = WINDOW - GRAM + 1
#: Windows broadcast at once: 16 bytes each, twice with the fingerprints.
MAX_BLOCK = 1 << 20


def winnow(h: np.ndarray, at: np.ndarray, width: int = SPAN) -> np.ndarray:
    """Positions in h of the least hash (the rightmost of equals) of every `width`
    neighbouring k-grams; `at` holds the k-grams' places, where gaps part texts."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(n) + width - 1
    low = h[best].copy()
    for back in range(2, width + 1):
        other = np.arange(n) + width - back
        less = h[other] < low
        best[less] = other[less]
        low[less] = h[other[less]]
    whole = at[width - 1 :] - at[:n] == width - 1
    return np.unique(best[whole])


@dataclass
class Block:
    """Sorted item windows with the items of each, and their fingerprints."""

    length: np.ndarray  # per window
    window: np.ndarray
    begin: np.ndarray
    items: list
    prints: np.ndarray


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, off = texts_of(piece.column(1))
            words = Words(data, off, ALNUM)
            h = words.hashes(LOWER)
            ids = piece.column(0)
            for n in sorted({WINDOW, *np.minimum(words.count, WINDOW).tolist()} - {0}):
                gram, at = ngrams(h, words.first, n)
                of = words.text[at]
                right = np.ones(len(at), bool) if n == WINDOW else words.count[of] == n
                gram, at, of = gram[right], at[right], of[right]
                prints = gram[:, None]
                if n == WINDOW:
                    small, where = ngrams(h, words.first, GRAM)
                    place = np.searchsorted(where, at)
                    prints = small[place[:, None] + np.arange(SPAN)] if len(at) else np.zeros((0, SPAN), U64)
                yield pa.RecordBatch.from_pydict({
                    "item": ids.take(pa.array(of)), "length": pa.array(np.full(len(at), n, np.int32)), "window": pa.array(signed(gram)),
                    "print": pa.array(signed(prints.min(axis=1) if len(at) else gram)),
                })


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, length, window, print): the windows of the items and each one's winnowed fingerprint."""
    kind = dict(items.dtypes)[id_col]
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_item_windows, f"item {kind}, length int, window long, print long").distinct()


def _block(rows: pd.DataFrame) -> Block:
    rows = rows.sort_values(["window"], kind="stable")
    window = rows["window"].to_numpy(np.int64).view(U64)
    order = np.argsort(window, kind="stable")
    window, items = window[order], rows["item"].to_numpy()[order]
    length, prints = rows["length"].to_numpy()[order], rows["print"].to_numpy(np.int64).view(U64)[order]
    begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
    return Block(length[begin], window[begin], np.r_[begin, len(window)], items.tolist(), np.unique(prints[length == WINDOW]))


def find(words: Words, h: np.ndarray, block: Block) -> tuple[list[tuple[np.ndarray, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """Where the block's windows occur: per length (first words, length), and (texts, windows) that meet."""
    spans, met = [], []
    text = words.text
    for n in np.unique(block.length).tolist():
        if n == WINDOW:
            small, where = ngrams(h, words.first, GRAM)
            picked = winnow(small, where)
            hit = where[picked[in_sorted(small[picked], block.prints) >= 0]]
            if not len(hit):
                continue
            starts = np.unique((hit[:, None] - np.arange(SPAN)).ravel())
            gram, at = ngrams(h, words.first, WINDOW)
            place = in_sorted(starts, at)
            place = place[place >= 0]
            gram, at = gram[place], at[place]
        else:
            gram, at = ngrams(h, words.first, n)
        found = in_sorted(gram, block.window)
        found[found >= 0] = np.where(block.length[found[found >= 0]] == n, found[found >= 0], -1)
        there = found >= 0
        spans.append((at[there], n))
        met.append((text[at[there]], found[there]))
    return spans, met


def _scan(shared, last: bool):
    """With one block the verdict is made at once; else the hit words and items go on to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = texts_of(piece.column(1))
                words = Words(data, off, ALNUM)
                hit = np.zeros(len(words), bool)
                items: list[set] = [set() for _ in range(piece.num_rows)]
                if len(block.window):
                    spans, met = find(words, words.hashes(LOWER), block)
                    for at, n in spans:
                        hit |= covered(at, n, len(words))
                    for texts, found in met:
                        pairs = pd.DataFrame({"t": texts, "w": found}).drop_duplicates()
                        for t, w in zip(pairs["t"].tolist(), pairs["w"].tolist(), strict=True):
                            items[t].update(block.items[block.begin[w] : block.begin[w + 1]])
                base = {"id": piece.column(0), "n_words": pa.array(words.count, pa.int64())}
                if last:
                    n_hit = [int(hit[a:b].sum()) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                    listed = [sorted(map(str, x)) for x in items]
                    yield pa.RecordBatch.from_pydict(base | {"n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(listed, pa.list_(pa.string()))})
                else:
                    where = [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict(base | {"row": piece.column(2), "hits": pa.array(where, pa.list_(pa.int32())), "items": pa.array([sorted(map(str, x)) for x in items], pa.list_(pa.string()))})

    return run


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_block: int = MAX_BLOCK) -> DataFrame:
    """Per row of docs: id, n_words, n_hit and the sorted texts of the ids of items with occurring windows."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    windows = kept(item_windows(items, item_col, item_text))
    blocks = max(1, -(-windows.count() // max_block))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks == 1:
        shared = spark.sparkContext.broadcast(_block(windows.toPandas()))
        return rows.mapInArrow(_scan(shared, True), f"id {kind}, n_words long, n_hit long, items array<string>")
    # A row's own key, as ids may repeat; equal rows have equal results and join as one.
    rows = rows.withColumn("row", F.struct(F.xxhash64("text"), F.sha2(F.coalesce("text", F.lit("")), 256)).cast("string"))
    parts = None
    for b in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(_block(own.toPandas()))
        part = rows.mapInArrow(_scan(shared, False), f"id {kind}, n_words long, row string, hits array<int>, items array<string>").withColumn("block", F.lit(b))
        parts = part if parts is None else parts.unionAll(part)
    merged = parts.groupBy("id", "row").agg(
        F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / F.lit(blocks)).cast("int").alias("times"),
    )
    return merged.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select("id", "n_words", "n_hit", "items")


def contaminated() -> F.Column:
    """Contaminated: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.  Rows go by id and
    whole text, so one that shares a contaminated row's id, or has none either, stays if its text is clean."""
    key = "_key_by_decontaminate"
    of = F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text"))
    found = scan(docs.select(of.alias(key), text_col), items, key, text_col, **kw).where(contaminated()).select("id.*").distinct()
    bad = found.select(F.col("id").alias("_bad_id_by_decontaminate"), F.col("text").alias("_bad_text_by_decontaminate"))
    same = docs[id_col].eqNullSafe(F.col("_bad_id_by_decontaminate")) & (of["text"] == F.col("_bad_text_by_decontaminate"))
    return docs.join(bad, same, "left_anti")


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
