"""Repeated word windows by prefix-partitioned suffix trees.

A window is `least` consecutive words of one text; a word goes if a window that holds it also
starts anywhere else, in the same text or another.  Windows are suffixes cut at that depth, so a
window repeats where its suffix hangs below an internal node of at least that depth.

1. Prefixes.  Each window has an anchor: of its SPAN runs of least - SPAN + 1 words the one of
   least hash.  Equal windows have equal anchors, and neighbours mostly share theirs, so a text
   has few.  Anchors are counted over all texts; where one occurs once, no window repeats.
2. Groups.  Suffixes go to the group of their anchor; those that share it inside a text travel as
   one row of word codes.  Prefixes are of variable length: a group of more than GROUP rows, which
   would not fit a task's memory, is split by the whole prefix of `least` words instead, and a
   prefix that is still hot is salted; a salt that sees but one suffix of it leaves the verdict to
   the sum of all salts (SALTS rows a prefix at most).
3. Subtrees.  Each group's tree is built from its root down: a node's suffixes part by the words
   of their next edges (1, 1, 2, 4, 8... words), a suffix that is alone in its node is a leaf and
   is left there; those that reach depth `least` in company lie below deep internal nodes, and
   runs of such neighbours are maximal repeats.

Wholly equal texts are counted by their hash beforehand: their windows all repeat, and one of a
task stands for all in the trees.  Texts that more than a thousandth of the rows share are
salted in the exchange of texts.  The exchange of texts is one of the plan, used twice: for the
suffixes, and for the removal.

Words are runs of bytes other than ASCII white space, unchanged, as 32-bit codes in suffixes
(windows that differ count as equal only if all differing words' codes collide); texts and
anchors are 64-bit hashes.

Cases: null and empty texts have no words, texts of fewer than `least` words lose none; rows
that share an id are judged by their texts; wholly repeated rows are repeats of each other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import HOT_SHARE, written
from ._text import SPACED, U64, Words, mix, ngrams, pieces, signed, texts_of
from .periodic_runs import joined_words

LEAST = 35
#: Runs of words of a window from which its anchor is chosen.
SPAN = 16
#: Rows of a group that one tree takes, salts of a hot prefix, and suffixes in memory at once.
GROUP, SALTS = 4096, 256
SUFFIXES = 1 << 17

ANCHORS = "anchor long, key long, at int"
SEGMENTS = "prefix long, salt int, wide boolean, key long, at int, codes binary"
FOUND = "name long, sure boolean, key long, at int, n int"
REMOVED = "id {id}, n_words long, n_removed long, spans array<struct<first: long, n: long>>, kept string"


def anchors(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, place of the anchor in gram) of every window; of equal hashes the rightmost counts.
    `at` holds the words at which the grams begin; gaps part texts."""
    n = len(gram) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = np.arange(n) + SPAN - 1
    low = gram[best].copy()
    for back in range(2, SPAN + 1):
        other = np.arange(n) + SPAN - back
        less = gram[other] < low
        best[less] = other[less]
        low[less] = gram[other[less]]
    whole = at[SPAN - 1 :] - at[:n] == SPAN - 1
    return at[:n][whole], best[whole]


def _first_seen(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows hold a key that this task has not had."""
    fresh = ~pd.Series(keys).duplicated().to_numpy() & np.fromiter((k not in seen for k in keys.tolist()), bool, len(keys))
    seen.update(keys[fresh].tolist())
    return fresh


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(_first_seen(np.asarray(batch.column(0)), seen)))
            for piece in pieces(batch, "text"):
                words = Words(*texts_of(piece.column(1)), SPACED)
                gram, at = ngrams(words.hashes(), words.first, least - SPAN + 1)
                place = np.unique(anchors(gram, at)[1])
                text = words.text[at[place]]
                yield pa.RecordBatch.from_arrays([pa.array(signed(gram[place])), piece.column(0).take(pa.array(text)), pa.array((at[place] - words.first[text]).astype(np.int32))], ["anchor", "key", "at"])

    return run


def _segments(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(_first_seen(np.asarray(batch.column(1)), seen)))
            for piece in pieces(batch, "text"):
                words = Words(*texts_of(piece.column(2)), SPACED)
                h = words.hashes()
                gram, at = ngrams(h, words.first, least - SPAN + 1)
                begin, place = anchors(gram, at)
                listed = piece.column(3)
                flat = listed.flatten()
                base = np.repeat(words.first[:-1], np.asarray(listed.value_lengths()))
                state = np.zeros(len(words) + 1, np.int8)  # of anchors' words: 1 in company, 2 in more than a tree takes
                state[np.asarray(flat.field(0)) + base] = 1 + np.asarray(flat.field(1).cast(pa.int8()))
                where = at[place]
                held = np.flatnonzero(state[where])
                begin, where, gram_of = begin[held], where[held], gram[place[held]]
                wide = state[where] == 2
                # Windows of one anchor follow each other; wide groups' windows go alone.
                new = np.ones(len(begin), bool)
                new[1:] = (where[1:] != where[:-1]) | wide[1:] | (begin[1:] != begin[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(begin)))
                start = begin[first]
                length = n + least - 1
                codes = (h >> U64(32)).astype("<u4")
                edges = np.r_[0, np.cumsum(length)]
                cut = np.arange(edges[-1]) + np.repeat(start - edges[:-1], length)
                binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(codes[cut])])
                whole, whole_at = ngrams(h, words.first, least)
                prefix = np.where(wide[first], mix(whole[np.searchsorted(whole_at, start)]) if len(start) else start.astype(U64), gram_of[first]) if len(first) else np.zeros(0, U64)
                text = words.text[start]
                inside = (start - words.first[text]).astype(np.int32)
                salt = np.where(wide[first], (mix(start.astype(U64) ^ np.asarray(piece.column(1)).view(U64)[text]) % U64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(signed(prefix)), pa.array(salt, pa.int32()), pa.array(wide[first]), piece.column(1).take(pa.array(text)), pa.array(inside), binary], ["prefix", "salt", "wide", "key", "at", "codes"])

    return run


def edges(depth: int) -> list[int]:
    """How many words the edges read from the root down to a depth: 1, 1, 2, 4, 8..., and the rest."""
    out = [1]
    while sum(out) < depth:
        out.append(min(max(1, sum(out)), depth - sum(out)))
    return out


def in_company(codes: np.ndarray, start: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes (words from `start` on, in trees named `node`) lie below an internal node of a depth."""
    alive, so_far = np.arange(len(start)), 0
    for step in edges(depth):
        label = codes[start[alive] + so_far].astype(U64)
        with np.errstate(over="ignore"):
            for k in range(1, step):
                label = label * U64(0x9E3779B97F4A7C15) + codes[start[alive] + so_far + k]
            named, _ = pd.factorize(mix(label) + mix(node[alive].astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))
        company = np.bincount(named)[named] > 1 if len(named) else np.zeros(0, bool)
        alive = alive[company]
        node = node.copy()
        node[alive] = named[company]
        so_far += step
    out = np.zeros(len(start), bool)
    out[alive] = True
    return out


def _trees(least: int, suffixes: int):
    def grow(rows: pa.RecordBatch) -> pa.RecordBatch:
        """All subtrees of whole groups; rows are ordered by prefix."""
        prefix, key, at = (np.asarray(rows.column(k)) for k in (0, 3, 4))
        wide = np.asarray(rows.column(2))
        data, off = texts_of(rows.column(5))
        codes = np.frombuffer(np.ascontiguousarray(data), "<u4")
        n = (np.diff(off) // 4 - least + 1).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, place = (off[:-1] // 4)[row] + nth, at[row] + nth
        once = ~pd.DataFrame({"prefix": prefix[row], "key": key[row], "at": place}).duplicated().to_numpy()  # copies of one text
        row, start, place = row[once], start[once], place[once]
        node = np.cumsum(np.r_[0, prefix[1:] != prefix[:-1]])[row] if len(prefix) else row
        deep = in_company(codes, start, node, least)
        told = deep | wide[row]  # of wide groups other salts may know more
        row, place, deep = row[told], place[told], deep[told]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(row)))
        row, place, sure = row[first], place[first], deep[first]
        own = signed(mix(key[row].view(U64) ^ mix(place.astype(U64))))
        return pa.RecordBatch.from_arrays([pa.array(np.where(sure, own, prefix[row])), pa.array(sure), pa.array(key[row]), pa.array(place, pa.int32()), pa.array(length, pa.int32())], ["name", "sure", "key", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(5).nbytes // 4
            if size >= suffixes:
                rows = pa.concat_batches(held)
                prefix = np.asarray(rows.column(0))
                last = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on
                if last:
                    yield grow(rows.slice(0, last))
                held, size = [rows.slice(last)], rows.slice(last).column(5).nbytes // 4
        if held:
            yield grow(pa.concat_batches(held))

    return run


def _removal(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(*texts_of(piece.column(1)), SPACED)
                step = np.zeros(len(words) + 1, np.int32)
                listed = piece.column(3).fill_null([]) if piece.column(3).null_count else piece.column(3)
                flat = listed.flatten()
                base = np.repeat(words.first[:-1], np.asarray(listed.value_lengths())) + np.asarray(flat.field(0))
                np.add.at(step, base, 1)
                np.add.at(step, base + np.asarray(flat.field(1)) + least - 1, -1)
                gone = np.cumsum(step)[: len(words)] > 0
                copies = np.asarray(piece.column(2).fill_null(False)) & (words.count >= least)
                gone |= np.repeat(copies, words.count)
                text = words.text
                new = gone.copy()
                new[1:] &= ~gone[:-1] | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                total = np.r_[0, np.cumsum(gone)]
                end = np.flatnonzero(gone & np.r_[~gone[1:] | (text[1:] != text[:-1]), True]) + 1 if len(gone) else first
                spans = pa.StructArray.from_arrays([pa.array(first - words.first[text[first]]), pa.array(end - first)], ["first", "n"])
                held = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, words.first), pa.int32()), spans)
                stays = pa.array(joined_words(words, ~gone), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words.count, pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]]), held, stays], ["id", "n_words", "n_removed", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: id, n_words, n_removed, the removed spans (first, n) and the words that stay, joined by one space (`kept`)."""
    if least <= SPAN:
        raise ValueError(f"least must be more than {SPAN}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    copies = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    # HOT_SHARE keys at most; a table, as plans that read a checkpoint share no exchange.
    hot = written(copies.where(F.col("times") * HOT_SHARE > rows.count()).select("key", F.lit(True).alias("hot")), "hot")
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def to_all_salts(table: DataFrame) -> DataFrame:
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        return table.join(F.broadcast(hot), "key", "left").withColumn("part", F.explode(every)).drop("hot")

    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    part = F.coalesce(F.when(F.col("hot"), salt), F.lit(0))  # never null, or the exchange below would be filtered in one place
    texts = rows.join(F.broadcast(hot), "key", "left").select("key", part.alias("part"), "id", "text")

    placed = rows.select("key", "text").mapInArrow(_anchors(least), ANCHORS)
    # Written, so that both sides of the join below are plain exchanges, which Spark can split where an anchor is hot.
    shared = written(placed.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor", (F.col("times") > GROUP).alias("wide")), "anchors")
    places = placed.join(shared, "anchor").groupBy("key").agg(F.collect_set(F.struct("at", "wide")).alias("places"))  # a text's length at most
    suffixes = texts.join(to_all_salts(places), ["key", "part"]).select("id", "key", "text", "places").mapInArrow(_segments(least), SEGMENTS)
    grown = suffixes.repartition("prefix", "salt").sortWithinPartitions("prefix", "salt").mapInArrow(_trees(least, SUFFIXES), FOUND)
    # What a salt leaves open is settled by all salts of its prefix together; what is sure has a name of its own.
    settled = grown.groupBy("name").agg(F.collect_set(F.struct("key", "at", "n", "sure")).alias("found")).where((F.size("found") > 1) | F.col("found")[0]["sure"])
    spans = settled.select(F.inline("found")).select("key", F.struct("at", "n").alias("span"), F.lit(False).alias("copied"))
    marks = spans.unionByName(copies.select("key", F.lit(None).cast("struct<at: int, n: int>").alias("span"), F.lit(True).alias("copied")))
    marks = marks.groupBy("key").agg(F.max("copied").alias("copied"), F.collect_list("span").alias("spans"))
    marked = texts.join(to_all_salts(marks), ["key", "part"], "left")
    return marked.select("id", "text", "copied", "spans").mapInArrow(_removal(least), REMOVED.format(id=dict(docs.dtypes)[id_col])).withColumnRenamed("id", id_col)
