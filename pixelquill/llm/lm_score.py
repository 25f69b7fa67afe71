"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training documents are gathered as packed
arrays: a task counts its own share, cuts the sorted hashes into buckets and
ships one binary row per bucket, so the shuffle moves bytes, not a row per
n-gram.  Each bucket is merged on its own into

* exact word counts (for the base score), and
* Bloom filter bits: an n-gram of count c is inserted with the levels 1 to
  1 + floor(log2 c), so its quantised count is read back by probing level after
  level until one is missing.  Errors are one-sided and halve with each level.

Filters are sharded by hash, in as many buckets as the texts' bytes call for, and have
BITS_EACH bits an entry at any size.  Scoring broadcasts, pass by pass, one
group of buckets of at most MAX_BROADCAST bytes: a pass adds what its words and
pairs contribute to each document, and the passes are summed.  So no broadcast
grows with the data; passes do.

The model is linear interpolation: p(w | v) = a * c(vw) / c(v) + (1 - a) * (c(w) + 1) /
(N + V + 1), counts read from the filter; a pair in the filter adds to its pass, all
others count in the pass of their pair's bucket with the second term only.  Every
pass needs the words' levels.  Word filters of at most MAX_WORDS bytes in all go with
each pass; larger ones are probed first, one group of buckets of at most MAX_WORDS
bytes after the other, and the texts carry a byte per token, the level found, into
the passes over pairs.

Cases: null and empty texts have the end token only; a document without an id
trains as one whose id reads as the empty text; repeated rows count each; with no
training rows all counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop_path, kept, new_path
from ._text import LOWER, SPACED, U64, Words, in_sorted, mix, per_text, pieces, signed, texts_of

FOLDS, HELD_OUT = 7, 2
#: Filter bits per inserted (n-gram, level), and probes of each.
BITS_EACH, PROBES = 9, 4
#: Bytes of tables broadcast in one pass.
MAX_BROADCAST = 128 << 20
#: Bytes of word filters that are broadcast at once.
MAX_WORDS = 64 << 20
#: Weight of the pair's relative frequency.
PAIR_WEIGHT = 0.6
#: N-grams a task counts before it ships them.
FLUSH = 1_500_000
END = U64(0x1234567)


def fold(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids], np.int64)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end token after each, and each text's range."""
    words = Words(data, off, SPACED)
    first = words.first + np.arange(len(words.first))
    out = np.empty(len(words) + len(words.count), U64)
    end = np.zeros(len(out), bool)
    end[first[1:] - 1] = True
    out[end] = END
    out[~end] = words.hashes(LOWER)
    return out, first


def pairs(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text's first follows the end token."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[first[:-1]] = END
    with np.errstate(over="ignore"):
        return mix(before * U64(0x9E3779B97F4A7C15) + t)


def count_sorted(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their summed counts."""
    if c is None:
        h = np.sort(h)
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return h[begin], np.diff(np.r_[begin, len(h)])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[begin], np.add.reduceat(c, begin) if len(h) else c


def _gather(buckets: int, orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = total = 0

        def ship() -> pa.RecordBatch:
            order, where, hashes, counts = [], [], [], []
            for n in orders:
                h, c = count_sorted(np.concatenate([x[n - 1] for x in held]))
                edge = np.searchsorted((h >> U64(40)), (np.arange(buckets + 1, dtype=np.int64) << 24) // buckets)
                for b in range(buckets):
                    part = slice(edge[b], edge[b + 1])
                    if edge[b] < edge[b + 1]:
                        order.append(n)
                        where.append(b)
                        # The top bits name the bucket; sorted hashes are kept as differences, which compress better.
                        hashes.append(np.diff(h[part], prepend=U64(0)).tobytes())
                        counts.append(c[part].astype("<i8").tobytes() if c[part].max() >> 32 else c[part].astype("<u4").tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(where, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["n", "bucket", "hashes", "counts"])

        for batch in batches:
            train = fold(batch.column(0).to_pylist()) != HELD_OUT
            for piece in pieces(batch.filter(pa.array(train)), "text"):
                t, first = tokens(*texts_of(piece.column(1)))
                held.append((t, pairs(t, first)) if 2 in orders else (t,))
                size += len(t)
                total += len(t)
                if size >= FLUSH:
                    yield ship()
                    size = 0
        if size:
            yield ship()

    return run


def bloom_bits(entries: int) -> int:
    return max(64, -(-entries * BITS_EACH // 64) * 64)


def levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)


def _cells(h: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """PROBES cells of each (hash, level)."""
    with np.errstate(over="ignore"):
        x = mix(h + U64(level) * U64(0xA24BAED4963EE407))
        step = (x >> U64(32)) | U64(1)
    for i in range(PROBES):
        with np.errstate(over="ignore"):
            cell = x + U64(i) * step
        yield (cell >> U64(11)) % bits


def build_filter(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The filter of n-grams and their counts."""
    level = levels(count)
    bits = bloom_bits(int(level.sum()))
    out = np.zeros(bits // 8, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = h[level >= q]
        for i in range(0, len(own), 1 << 20):
            for cell in _cells(own[i : i + (1 << 20)], q, U64(bits)):
                np.bitwise_or.at(out, (cell >> U64(3)).astype(np.int64), (U64(1) << (cell & U64(7))).astype(np.uint8))
    return out


class Filters:
    """The filters of several buckets in a row."""

    def __init__(self, buckets: int, parts: dict[int, bytes]):
        self.bits, self.base = np.zeros(buckets, U64), np.zeros(buckets, U64)
        at = 0
        for b in sorted(parts):
            self.bits[b], self.base[b] = len(parts[b]) * 8, at
            at += len(parts[b]) * 8
        self.data = np.frombuffer(b"".join(parts[b] for b in sorted(parts)), np.uint8)

    def probe(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The quantised level of each hash: probes go on while a level is there, up to TOP."""
        level = np.zeros(len(h), np.int64)
        live = np.flatnonzero(self.bits[bucket] > 0)
        q = 1
        while len(live) and q <= TOP:
            b = bucket[live]
            there = np.ones(len(live), bool)
            for cell in _cells(h[live], q, self.bits[b]):
                cell += self.base[b]
                there &= ((self.data[(cell >> U64(3)).astype(np.int64)] >> (cell & U64(7)).astype(np.uint8)) & 1).astype(bool)
            live = live[there]
            level[live] = q
            q += 1
        return level


#: The count a level stands for: the middle of its range, for the few levels there are.
VALUE = np.r_[0.0, 1.0, 1.5 * 2.0 ** np.arange(1, 62)]
TOP = len(VALUE) - 1


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    h = np.concatenate([np.cumsum(np.frombuffer(x, U64), dtype=U64) for x in rows["hashes"]])
    # A task's counts have four bytes each, or eight where one needs them.
    c = np.concatenate([np.frombuffer(x, "<u4" if 2 * len(x) == len(k) else "<i8") for x, k in zip(rows["counts"], rows["hashes"], strict=True)]).astype(np.int64)
    h, c = count_sorted(h, c)
    n, bucket = int(rows["n"].iloc[0]), int(rows["bucket"].iloc[0])
    exact = n == 1
    return pd.DataFrame({
        "n": [n], "bucket": [bucket], "entries": [len(h)], "total": [int(c.sum())], "bloom": [build_filter(h, c).tobytes()],
        "hashes": [h.tobytes() if exact else b""], "counts": [c.astype("<i8").tobytes() if exact else b""],
    })


def ngram_tables(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """A row per order (1, 2) and bucket: its filter, and the exact word counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_gather(buckets, orders), "n int, bucket int, hashes binary, counts binary")
    return packed.groupBy("n", "bucket").applyInPandas(_merge, "n int, bucket int, entries long, total long, bloom binary, hashes binary, counts binary")


class Tables:
    """One pass's buckets, and the word filters of all (None: the texts carry the levels).
    Buckets are ranges of hashes in order, so the exact words of all stand in order too."""

    def __init__(self, buckets: int, n: int, v: int, words: Filters | None, exact: dict[int, tuple[bytes, bytes]], pair: Filters | None, own: list[int]):
        self.buckets, self.n, self.v, self.words, self.pair = buckets, n, v, words, pair
        self.own = np.zeros(buckets, bool)
        self.own[own] = True
        self.keys = np.frombuffer(b"".join(exact[b][0] for b in sorted(exact)), U64)
        self.counts = np.frombuffer(b"".join(exact[b][1] for b in sorted(exact)), "<i8")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted((np.arange(1, buckets + 1, dtype=np.int64) << 24) // buckets, (h >> U64(40)).astype(np.int64), "right")


def _carried(piece: pa.RecordBatch) -> np.ndarray:
    """The levels that texts carry, one after another."""
    return np.frombuffer(b"".join(piece.column("levels").to_pylist()), np.uint8)


def _levels(shared, begin: bool):
    """The texts with the levels of the group's words added; words of other groups read as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, words = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 22):
                h, first = tokens(*texts_of(piece.column(1)))
                code, distinct = pd.factorize(h)
                distinct = np.asarray(distinct, U64)
                level = words.probe(distinct, bucket_of(distinct, buckets)).astype(np.uint8)[code]
                if not begin:
                    level += _carried(piece)
                yield pa.RecordBatch.from_pydict({"id": piece.column(0), "text": piece.column(1), "row": piece.column(2), "levels": pa.array([level[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())})

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        log_all = np.log10(t.n + t.v + 1.0)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 22):
                data, off = texts_of(piece.column(1))
                h, first = tokens(data, off)
                code, distinct = pd.factorize(h)  # words repeat: look each up once
                distinct = np.asarray(distinct, U64)
                bucket = bucket_of(distinct, t.buckets)
                place = in_sorted(distinct, t.keys)
                exact = np.where(place >= 0, t.counts[place] if len(t.keys) else 0, 0).astype(np.int64)
                base = np.where(t.own[bucket], np.log10(exact + 1.0) - log_all, 0.0)[code]
                known = (exact > 0)[code]
                ids = piece.column(0)
                out = {
                    "id": ids, "row": piece.column(2), "held_out": pa.array(fold(ids.to_pylist()) == HELD_OUT), "n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": pa.array(per_text(known.astype(np.int8), first), pa.int64()),
                    "base_score": pa.array(_sums(base, first)),
                }
                if t.pair is None:
                    yield pa.RecordBatch.from_pydict(out)
                    continue
                near = VALUE[t.words.probe(distinct, bucket)[code] if t.words else _carried(piece)]
                unigram = (near + 1) / (t.n + t.v + 1)
                ahead = np.empty(len(h))  # c(v): each token's predecessor, the end token at a text's start
                ahead[1:] = near[:-1]
                ahead[first[:-1]] = near[first[1:] - 1]
                p = pairs(h, first)
                bucket = bucket_of(p, t.buckets)
                both = VALUE[t.pair.probe(p, bucket)]
                share = np.minimum(both / np.maximum(ahead, 1.0), 1.0)
                model = np.where(t.own[bucket], np.log10(PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * unigram), 0.0)
                yield pa.RecordBatch.from_pydict({**out, "score": pa.array(_sums(model, first))})

    return run


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums per text, each on its own, so that rounding does not depend on the batch."""
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)


def groups_of(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Neighbouring buckets of at most `most` bytes together, or one bucket."""
    groups: list[list[int]] = [[]]
    held = 0
    for b in sorted(sizes):
        if groups[-1] and held + sizes[b] > most:
            groups.append([])
            held = 0
        groups[-1].append(b)
        held += sizes[b]
    return groups


def buckets_for(docs: DataFrame, text_col: str, max_broadcast: int, max_words: int) -> int:
    """So many buckets that the mean one stays well below the broadcasts, whatever the texts hold.

    A text of b bytes has at most b / 2 + 1 tokens; each adds at most one entry of
    BITS_EACH bits to a filter, and one of 16 bytes to the exact counts."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("bytes"), F.count("*").alias("rows")).collect()[0]
    tokens = (size["bytes"] or 0) // 2 + size["rows"]
    most = max(tokens * (16 + BITS_EACH / 8) / max_broadcast, tokens * BITS_EACH / 8 / max_words)
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(2 * most) + 1)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, max_broadcast: int = MAX_BROADCAST, max_words: int = MAX_WORDS, model: bool = True) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score; without the model neither pairs nor filters are needed, and there is no score."""
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs, text_col, max_broadcast, max_words)
    tables = kept(ngram_tables(docs, buckets, id_col, text_col, (1, 2) if model else (1,)))
    bloom = F.length("bloom").alias("bloom")
    sizes = tables.select("n", "bucket", "entries", "total", bloom, (bloom + F.length("hashes") + F.length("counts")).alias("bytes")).collect()  # two short rows a bucket
    n, v = sum(r["total"] for r in sizes if r["n"] == 1), sum(r["entries"] for r in sizes if r["n"] == 1)
    per_bucket, filters = dict.fromkeys(range(buckets), 0), dict.fromkeys(range(buckets), 0)
    for r in sizes:
        # Word filters have passes of their own.
        per_bucket[r["bucket"]] += r["bytes"] - (r["bloom"] if r["n"] == 1 else 0)
        filters[r["bucket"]] += r["bloom"] if r["n"] == 1 else 0
    groups, word_groups = groups_of(per_bucket, max_broadcast), groups_of(filters, max_words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    kind = dict(docs.dtypes)[id_col]
    before = words = None
    for own in word_groups if model else []:
        found = tables.where(F.col("bucket").between(own[0], own[-1]) & (F.col("n") == 1)).select("bucket", "bloom").collect()
        words = Filters(buckets, {r["bucket"]: bytes(r["bloom"]) for r in found})
        if len(word_groups) == 1:
            break
        shared = spark.sparkContext.broadcast((buckets, words))
        path = new_path(spark, "levels")
        carried = rows.mapInArrow(_levels(shared, before is None), f"id {kind}, text string, row long, levels binary")
        carried.write.parquet(path)
        rows = spark.read.schema(carried.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before, words = path, None
        shared.destroy()
    parts, scores = None, ["base_score", "score"] if model else ["base_score"]
    for own in groups:
        exact, pair = {}, {}
        needed = tables.select("n", "bucket", F.when(F.col("n") == 2, F.col("bloom")).alias("bloom"), "hashes", "counts")  # word filters are there already
        for r in needed.where(F.col("bucket").between(own[0], own[-1])).toLocalIterator():
            if r["n"] == 1:
                exact[r["bucket"]] = (bytes(r["hashes"]), bytes(r["counts"]))
            else:
                pair[r["bucket"]] = bytes(r["bloom"])
        shared = spark.sparkContext.broadcast(Tables(buckets, n, v, words, exact, Filters(buckets, pair) if model else None, own))
        del exact, pair
        part = rows.mapInArrow(_score(shared), f"id {kind}, row long, held_out boolean, n_tokens long, n_known long, base_score double" + ", score double" * model)
        parts = part if parts is None else parts.unionAll(part)
    if len(groups) > 1:
        times = F.count("*") / F.lit(len(groups))  # equal rows add up; each comes out as often as it came in
        summed = parts.groupBy("id", "row", "held_out", "n_tokens").agg(times.cast("int").alias("times"), *((F.sum(c) / times).alias(c) for c in ("n_known", *scores)))
        parts = summed.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).withColumn("n_known", F.col("n_known").cast("long"))
    return parts.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), *scores)
