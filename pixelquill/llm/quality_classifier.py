"""Quality classifier by co-training of two views.

The text view is a logistic regression over hashed words and symbol runs.  The
page view sees metadata only: source, language, length and their combinations.
Both start from labelled rows; in each round each view judges all documents, and of
those it is sure of, EXCHANGE are drawn by hash, half of each label, to teach the
other view, which is then fitted anew.  Each view is calibrated on labelled rows held
out of the training, and a last logistic regression over the two calibrated views,
fitted on the same rows, scores every document.

Two heads are fitted this way, quality and toxicity; a document is kept if its
quality is at least KEEP_QUALITY and its toxicity below DROP_TOXIC.

The fit uses at most SAMPLE labelled rows, drawn by a hash of their ids; no draw of
texts, labelled or taught, brings more than SAMPLE rows and BYTES bytes to the
driver.  Judging covers all rows, in the rounds too, with a fixed table of weights
(2^20 per head).

Cases: null and empty texts have no words, the page view judges them; null
languages, sources and lengths are values of their own; a row that several labels
name counts once for each; without labels of both kinds a head gives 0.5 for
quality and 0 for toxicity, which keeps everything; repeated rows are judged each
(and teach once); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import drop_path, new_path
from ._text import ALNUM, LOWER, U64, Words, mix, per_text, pieces, texts_of

#: Labelled rows of the fit, and bytes of text of one draw.
SAMPLE, BYTES = 4000, 64 << 20
ROUNDS = 3
#: Rows that a view labels for the other in one round, how sure it must be, and by
#: how much its log odds must differ from those of the labels at large.
EXCHANGE, SURE, LIFT = 500, 0.9, 1.5
TEXT_BITS, PAGE_BITS = 20, 12
#: Standard errors by which a feature's log odds must differ from 0 to be used, by view.
TELLING = (3.0, 0.0)
KEEP_QUALITY, DROP_TOXIC = 0.5, 0.5

_codes = np.arange(256)
_SYMBOL = (_codes > 32) & (_codes < 127) & ~ALNUM


@dataclass
class Rows:
    """Sparse features of several documents, row after row."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        n = np.diff(self.first)[at]
        place = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Rows(self.index[place], self.value[place], np.r_[0, np.cumsum(n)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return per_text(w[self.index] * self.value, self.first)


def text_features(data: np.ndarray, off: np.ndarray) -> Rows:
    """Words (lower case) and symbol runs, damped counts scaled to length 1."""
    parts = []
    for member, salt in ((ALNUM, 0), (_SYMBOL, 1)):
        spans = Words(data, off, member)
        h = spans.hashes(LOWER)
        parts.append(((spans.text.astype(np.int64) << TEXT_BITS) | (mix(h + U64(salt)) >> U64(64 - TEXT_BITS)).astype(np.int64)))
    key = np.sort(np.concatenate(parts))
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[begin, len(key)])
    row, index = key[begin] >> TEXT_BITS, key[begin] & ((1 << TEXT_BITS) - 1)
    value = np.log1p(count)
    first = np.searchsorted(row, np.arange(len(off)))
    norm = np.sqrt(per_text(value * value, first))
    return Rows(index.astype(np.int32), (value / np.maximum(norm, 1e-9)[row]).astype(np.float32), first)


def page_features(lang: list, source: list, n_chars: list) -> Rows:
    """Five categories a document."""
    size = [None if n is None else int(np.log2(max(n, 1)) * 2) for n in n_chars]
    flat = np.array([x for a, b, c in zip(lang, source, size, strict=True) for x in (f"l{a}", f"s{b}", f"n{c}", f"ls{a}|{b}", f"sn{b}|{c}")], dtype=object)
    index = (pd.util.hash_array(flat) >> np.uint64(64 - PAGE_BITS)).astype(np.int32) if len(flat) else np.zeros(0, np.int32)
    return Rows(index, np.full(len(index), 5**-0.5, np.float32), np.arange(len(lang) + 1) * 5)


def features(piece: pa.RecordBatch) -> tuple[Rows, Rows]:
    """Both views of rows (id, text, lang, source, n_chars)."""
    return text_features(*texts_of(piece.column(1))), page_features(*(piece.column(i).to_pylist() for i in (2, 3, 4)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(rows: Rows, y: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which features are told apart by y: their log odds differ from 0 by `least` standard errors."""
    own = np.repeat(y, np.diff(rows.first)) > 0
    a, b = (np.bincount(rows.index[m], minlength=size) + 0.5 for m in (own, ~own))
    odds = np.log(a / (y.sum() + 1)) - np.log(b / ((1 - y).sum() + 1))
    return np.abs(odds) >= least * np.sqrt(1 / a + 1 / b)


def fit(rows: Rows, y: np.ndarray, size: int, least: float = 0.0, steps: int = 80, rate: float = 0.5, shrink: float = 1e-4) -> np.ndarray:
    """Logistic regression by full gradients with per-weight rates; both classes weigh the same."""
    use = telling(rows, y, size, least)
    kept_features = use[rows.index]
    seen_features, index = np.unique(rows.index[kept_features], return_inverse=True)  # all others keep weight 0
    rows = Rows(index, rows.value[kept_features], np.r_[0, np.cumsum(kept_features)][rows.first])
    n = len(seen_features)
    w, seen = np.zeros(n + 1), np.full(n + 1, 1e-8)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    owner = np.repeat(np.arange(len(y)), np.diff(rows.first))
    for _ in range(steps):
        d = weight * (sigmoid(rows.dot(w) + w[n]) - y)
        g = np.bincount(rows.index, rows.value * d[owner], n + 1).astype(np.float64)  # of no rows it makes integers
        g[n] = d.sum()
        g += shrink * w / (size + 1)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    out = np.zeros(size + 1)
    out[seen_features], out[size] = w[:n], w[n]
    return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate scores, with smoothed targets."""
    center, spread = score.mean(), score.std() + 1e-9
    z, a, b = (score - center) / spread, 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(400):
        g = sigmoid(a * z + b) - target
        a, b = a - 0.5 * (g * z).mean(), b - 0.5 * g.mean()
    return a / spread, b - a * center / spread


NO_ROWS = Rows(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64))


@dataclass
class Head:
    """Two calibrated views and their combination."""

    weights: list = field(default_factory=list)
    scales: list = field(default_factory=list)
    join: np.ndarray | None = None
    otherwise: float = 0.5

    def views(self, rows: tuple[Rows, Rows]) -> np.ndarray:
        return np.stack([a * (r.dot(w) + w[-1]) + b for r, w, (a, b) in zip(rows, self.weights, self.scales, strict=True)])

    def probability(self, rows: tuple[Rows, Rows]) -> np.ndarray:
        if self.join is None:
            return np.full(len(rows[0].first) - 1, self.otherwise)
        return sigmoid(self.join[:2] @ np.clip(self.views(rows), -8, 8) + self.join[2])


class CoTraining:
    """One head on its way: the labelled rows, and what each view was taught by the other."""

    def __init__(self, labelled: tuple[Rows, Rows], y: np.ndarray, otherwise: float):
        self.labelled, self.y, self.head = labelled, y, Head(otherwise=otherwise)
        self.able = 0 < y.sum() < len(y)
        self.taught = [(NO_ROWS, np.zeros(0)), (NO_ROWS, np.zeros(0))]
        order = np.random.default_rng(1).permutation(len(y))
        self.out, self.own = order[: len(y) // 4], order[len(y) // 4 :]
        if self.able and min(y[self.out].sum(), (1 - y[self.out]).sum(), y[self.own].sum(), (1 - y[self.own]).sum()) < 2:
            self.out = self.own = order

    @property
    def usual(self) -> float:
        """The log odds of the labels at large."""
        return float(np.log(self.y.sum() / (1 - self.y).sum()))

    def teach(self, view: int, rows: Rows, y: np.ndarray) -> None:
        have = self.taught[view]
        self.taught[view] = _stack(have[0], rows), np.r_[have[1], y]

    def fit(self) -> None:
        y, head = self.y, self.head
        head.weights, head.scales = [], []
        for view, bits in ((0, TEXT_BITS), (1, PAGE_BITS)):
            extra, given = self.taught[view]
            w = fit(_stack(self.labelled[view].take(self.own), extra), np.r_[y[self.own], given], 1 << bits, TELLING[view])
            head.weights.append(w.astype(np.float32))  # they are broadcast
            held = self.labelled[view].take(self.out)
            head.scales.append(platt(held.dot(w) + w[-1], y[self.out]))

    def combine(self) -> None:
        y = self.y[self.out]
        z = np.clip(self.head.views(tuple(r.take(self.out) for r in self.labelled)), -8, 8)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        join = np.array([0.5, 0.5, 0.0])
        for _ in range(2000):
            g = sigmoid(join[:2] @ z + join[2]) - target
            join -= 0.05 * np.r_[z @ g / len(g), g.mean()]
        self.head.join = join


def _stack(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate([a.index, b.index]), np.concatenate([a.value, b.value]), np.r_[a.first, a.first[-1] + b.first[1:]])


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), have("lang", "string"), have("source", "string"), have("n_chars", "long"))


def _bounded(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows (id, text, ...) in an order that all columns break ties of, as far as BYTES reach; one at least."""
    order = [*order, "id", "source", "lang", "n_chars", F.xxhash64("text")]
    few = rows.orderBy(*order).limit(n)
    # One window over the at most n rows that are left.
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.row_number().over(Window.orderBy(*order))
    return few.select("*", upto.alias("_upto"), nth.alias("_nth")).where((F.col("_upto") <= BYTES) | (F.col("_nth") == 1)).drop("_upto", "_nth")


def _sure(shared):
    """(head, view, mark, id, y) of every row that a view is sure of and has not labelled yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, told = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows, mark = features(piece), np.asarray(piece.column(5))
                for h, (head, usual) in heads.items():
                    odds = head.views(rows)
                    p = sigmoid(odds)
                    for view in (0, 1):
                        sure = (np.abs(odds[view] - usual) >= LIFT) & (np.maximum(p[view], 1 - p[view]) >= SURE) & ~np.isin(mark, told[h, view])
                        at = np.flatnonzero(sure)
                        yes = (p[view][at] > 0.5).astype(np.int32)
                        same = lambda v: pa.array(np.full(len(at), v, np.int32))  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([same(h), same(view), pa.array(mark[at]), piece.column(0).take(pa.array(at)), pa.array(yes)], ["head", "view", "mark", "id", "y"])

    return run


def _lessons(rows: DataFrame, named: DataFrame, heads: dict, told: dict) -> list[tuple]:
    """(head, view, y, mark): per head, view and label EXCHANGE / 2 rows without labels, drawn by hash from all it is sure of."""
    spark = rows.sparkSession
    shared, path = spark.sparkContext.broadcast((heads, told)), new_path(spark, "sure")
    rows.mapInArrow(_sure(shared), f"head int, view int, mark long, id {dict(rows.dtypes)['id']}, y int").write.parquet(path)
    sure = spark.read.parquet(path)
    many = {tuple(r[:3]): r[3] for r in sure.groupBy("head", "view", "y").count().collect()}  # eight rows at most
    each = EXCHANGE // 2
    # The least hashes lie below a share of all hashes.
    below = F.lit(2**63 - 1)
    for (h, view, y), n in sorted(many.items()):
        if n > 8 * each:
            below = F.when((F.col("head") == h) & (F.col("view") == view) & (F.col("y") == y), F.lit(-(2**63) + int(2**64 * 4 * each / n))).otherwise(below)
    few = sure.where(F.col("mark") <= below).select("head", "view", "y", "mark", "id").distinct()
    few = few.join(named.select("_id"), F.col("id") == F.col("_id"), "left_anti")
    nth = F.row_number().over(Window.partitionBy("head", "view", "y").orderBy("mark", "id"))
    found = [tuple(r) for r in few.withColumn("nth", nth).where(F.col("nth") <= each).select("head", "view", "y", "mark").collect()]
    drop_path(spark, path)
    shared.destroy()
    return found


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Head, Head]:
    """Heads for quality and toxicity."""
    rows = _inputs(docs, id_col, text_col)
    named = labels.select(F.col("doc_id").alias("_id"), "quality", "toxic").where("quality IS NOT NULL AND toxic IS NOT NULL")
    # Draw the ids first, so that only drawn rows carry their texts on; ids may repeat, so bound the rows again.
    drawn = named.orderBy(F.xxhash64("_id"), "_id", "quality", "toxic").limit(sample)
    met = rows.join(F.broadcast(drawn), F.col("id") == F.col("_id")).drop("_id")
    known = _collect(_bounded(met, sample, F.xxhash64("id"), "quality", "toxic"))
    views = _views(known)
    both = [CoTraining(views, np.array([float(x) for p in known for x in p.column(k).to_pylist()]), otherwise) for k, otherwise in ((5, 0.5), (6, 0.0))]
    able = {h: c for h, c in enumerate(both) if c.able}
    marked = rows.withColumn("mark", F.xxhash64("id", "text"))
    told = {(h, view): np.zeros(0, np.int64) for h in able for view in (0, 1)}
    for turn in range(ROUNDS + 1):
        for c in able.values():
            c.fit()
        if turn == ROUNDS or not able:
            break
        lessons = _lessons(marked, named, {h: (c.head, c.usual) for h, c in able.items()}, told)
        if not lessons:
            break
        marks = docs.sparkSession.createDataFrame([(m,) for m in sorted({r[3] for r in lessons})], "mark long")
        texts = marked.join(F.broadcast(marks), "mark").dropDuplicates(["mark"]).select("id", "text", "lang", "source", "n_chars", "mark")
        found = _collect(_bounded(texts, sample, "mark"))
        place = {m: i for i, m in enumerate(m for p in found for m in p.column(5).to_pylist())}
        rest = _views(found)
        for h, c in able.items():
            for view in (0, 1):
                own = sorted((m, y) for a, b, y, m in lessons if (a, b) == (h, view) and m in place)
                told[h, view] = np.r_[told[h, view], np.array([m for m, _ in own], np.int64)]
                c.teach(1 - view, rest[1 - view].take(np.array([place[m] for m, _ in own], np.int64)), np.array([float(y) for _, y in own]))
    for c in able.values():
        c.combine()
    return both[0].head, both[1].head


def _collect(rows: DataFrame) -> list[pa.RecordBatch]:
    """Bounded rows, in a defined order."""
    table = rows.toArrow()
    if not table.num_rows:
        return []
    table = table.sort_by([(c, "ascending") for c in table.column_names if c != "text"]).combine_chunks()
    return [p for b in table.to_batches() for p in pieces(b, "text")]


def _views(batches: list[pa.RecordBatch]) -> tuple[Rows, Rows]:
    out = (NO_ROWS, NO_ROWS)
    for b in batches:
        out = tuple(_stack(x, y) for x, y in zip(out, features(b), strict=True))
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = features(piece)
                both = sigmoid(quality.views(rows)) if quality.join is not None else np.full((2, piece.num_rows), 0.5)
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, pa.float64()) for x in (both[0], both[1], quality.probability(rows), toxic.probability(rows)))], ["id", "p_text", "p_page", "p_quality", "p_toxic"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Per row: id, the views' and the joint quality, the toxicity, and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **sizes))
    scored = _inputs(docs, id_col, text_col).mapInArrow(_score(shared), f"id {dict(docs.dtypes)[id_col]}, p_text double, p_page double, p_quality double, p_toxic double")
    return scored.withColumn("kept", (F.col("p_quality") >= KEEP_QUALITY) & (F.col("p_toxic") < DROP_TOXIC)).withColumnRenamed("id", id_col)


def _filter(shared, at: dict[str, int | None], id_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic = shared.value
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[at["text"]]):
                take = lambda c, kind: pa.nulls(piece.num_rows, kind) if at[c] is None else piece.column(at[c]).cast(kind)  # noqa: E731, B023
                rows = features(pa.RecordBatch.from_arrays([piece.column(id_at), piece.column(at["text"]), take("lang", pa.string()), take("source", pa.string()), take("n_chars", pa.int64())], ["id", "text", "lang", "source", "n_chars"]))
                good = (quality.probability(rows) >= KEEP_QUALITY) & (toxic.probability(rows) < DROP_TOXIC)
                yield piece.filter(pa.array(good))

    return run


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """The rows of docs that are kept, with all their columns, in one pass after the fit."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **sizes))
    at = {c: (docs.columns.index(c) if c in docs.columns else None) for c in ("lang", "source", "n_chars")} | {"text": docs.columns.index(text_col)}
    return docs.mapInArrow(_filter(shared, at, docs.columns.index(id_col)), docs.schema)
