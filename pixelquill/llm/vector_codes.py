"""Vectors as short codes: product quantisation in integers, with partial-distance search.

Components become floor(4096 x), and a vector is cut into PARTS equal consecutive parts.
Each part position has a codebook of ENTRIES entries, first those of the vectors of the
smallest ids.  In each of ROUNDS rounds every part goes to its nearest entry and entries
become their parts' floored means; a last assignment gives codes and errors.

Nearest entries are found by partial distances: dimensions are taken in descending variance
of the codebook, and for each entry in turn a mask drops the parts whose distance so far
already exceeds (strictly) the best complete distance they have; those that reach the last
dimension are compared.  Entries go up, so of equal distances the lower index stays.

A round is one pass over the integers, which are written once in the shared folder; tasks
return one row per entry and dimension (sums and counts), so what reaches the driver has the
size of the codebooks.  Everything is integer arithmetic, so the result does not depend on
how rows are dealt out.

Cases: rows whose vector is null, or holds null or non-finite components, are dropped;
repeated rows count each; rows of one id are taken in the order of their integers' bytes, null
ids come last and are coded like all; with fewer than ENTRIES rows there are as many entries;
null labels are one label; an empty table gives no rows; other columns are ignored.  Vectors
of differing lengths, of a length that PARTS does not divide, or with components of 2^16 and more
are an error, as sums of their squares leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop_path, join_by_key, kept, new_path

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Steps of a unit, and the bound of an integer component.
SCALE, BOUND = 4096, 1 << 28
#: Vectors searched at once.
ROWS = 1 << 14


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with sound vectors, these as little-endian 32-bit integers."""
    for batch in batches:
        vectors = batch.column(2)
        flat = vectors.flatten()
        lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
        x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
        edges = np.r_[0, np.cumsum(lengths)]
        wrong = np.r_[0, np.cumsum(~np.isfinite(x))]
        sound = np.asarray(vectors.is_valid()) & (wrong[edges[1:]] == wrong[edges[:-1]])
        x = np.floor(x[np.repeat(sound, lengths)] * SCALE)
        if (np.abs(x) > BOUND).any():
            raise ValueError(f"components have to be below {BOUND // SCALE} in size")
        stays = pa.array(sound)
        cut = np.r_[0, np.cumsum(4 * lengths[sound])].astype(np.int32)
        whole = pa.Array.from_buffers(pa.binary(), int(sound.sum()), [None, pa.py_buffer(cut), pa.py_buffer(x.astype("<i4"))])
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(stays), batch.column(1).filter(stays), whole], ["id", "label", "q"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ROWS."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) per row of part, by partial-distance search."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    columns = np.ascontiguousarray(part.T[order])
    book = book[:, order]
    best = ((columns - book[0][:, None]) ** 2).sum(axis=0)
    code = np.zeros(len(part), np.int64)
    for k in range(1, len(book)):
        alive, so_far = None, np.zeros(len(part), np.int64)
        for column, at in zip(columns, book[k].tolist(), strict=True):
            step = (column if alive is None else column[alive]) - at
            so_far += step * step
            stays = so_far <= (best if alive is None else best[alive])
            alive = np.flatnonzero(stays) if alive is None else alive[stays]
            so_far = so_far[stays]
        less = so_far < best[alive]
        alive = alive[less]
        best[alive], code[alive] = so_far[less], k
    return code, best


@dataclass(frozen=True)
class Codebooks:
    """PARTS codebooks of equally many entries, rows of `width` integers."""

    entries: np.ndarray  # part, entry, place

    def parts(self, q: pa.Array) -> Iterator[np.ndarray]:
        """The vectors of a batch, part by part."""
        width = PARTS * self.entries.shape[2]
        if len(q) and (np.diff(np.frombuffer(q.buffers()[1], np.int32)[q.offset : q.offset + len(q) + 1]) != 4 * width).any():
            raise ValueError(f"all vectors have to have {width} components, as the first have")
        whole = np.frombuffer(b"".join(q.to_pylist()), "<i4").astype(np.int64).reshape(-1, PARTS, self.entries.shape[2])
        return (whole[:, j] for j in range(PARTS))

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _first(rows: DataFrame) -> Codebooks | None:
    """Codebooks of the vectors of the smallest ids."""
    taken = [np.frombuffer(r.q, "<i4") for r in rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).collect()]
    if not taken:
        return None
    if len({len(v) for v in taken}) > 1 or not len(taken[0]) or len(taken[0]) % PARTS:
        raise ValueError(f"vectors have to have one length that {PARTS} divides")
    return Codebooks(np.stack(taken).astype(np.int64).reshape(len(taken), PARTS, -1).swapaxes(0, 1))


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries as the floored means of the parts nearest to them."""
    _, n, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n, width), np.int64)
        for batch in _joined(batches):
            for j, part in enumerate(books.parts(batch.column(0))):
                code, _ = nearest(part, books.entries[j])
                count[j] += np.bincount(code, minlength=n)
                np.add.at(total[j], code, part)
        part, entry, place = np.indices(total.shape).reshape(3, -1).astype(np.int32)
        used = np.repeat(count.ravel(), width) > 0
        columns = (part, entry, place, np.repeat(count.ravel(), width), total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], ["part", "entry", "place", "n", "total"])

    found = rows.select("q").mapInArrow(sums, "part int, entry int, place int, n long, total long").groupBy("part", "entry", "place")
    out = books.entries.copy()
    for r in found.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # the codebooks' size
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return Codebooks(out)


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            found = [nearest(part, books.entries[j]) for j, part in enumerate(books.parts(batch.column(2)))]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            binary = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * PARTS), pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary, pa.array(sum(d for _, d in found))], ["id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(rows of id, label, code of one byte a part and error, all named so; the codebooks, None without rows)."""
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    label = F.col(label_col) if label_col in kinds else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = f"id {kinds[id_col]}, label {kinds.get(label_col, 'string')}"
    path = new_path(spark, "vectors")
    rows.mapInArrow(_integers, f"{kind}, q binary").write.parquet(path)
    whole = spark.read.schema(f"{kind}, q binary").parquet(path)
    books = _first(whole)
    if books is None:
        return spark.createDataFrame([], f"{kind}, code binary, error long"), None
    for _ in range(ROUNDS):
        books = _moved(whole, books)
    coded = kept(whole.mapInArrow(_coded(books), f"{kind}, code binary, error long"))
    drop_path(spark, path)
    return coded, books


def decoded(codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """The integer vectors that rows of code bytes stand for."""
    return np.concatenate([books.entries[j][codes[:, j]] for j in range(PARTS)], axis=1)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per sound row: id, code in hex, error, label_error (summed over equal labels) and the digest of all codebooks."""
    coded, books = compress(vectors, id_col, vector_col, label_col)
    rows = coded.withColumn("_label", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    by_label = rows.groupBy("_label").agg(F.sum("error").alias("label_error"))
    digest = books.digest if books else hashlib.sha256(b"").hexdigest()
    joined = join_by_key(rows, by_label, "_label")
    return joined.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
