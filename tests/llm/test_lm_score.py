import collections
import math
import re
import zlib

import numpy as np
import pandas as pd

from pixelquill.llm import lm_score as L

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["</end>"]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def check(docs, **kw):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    count, pair = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            count.update(w)
            pair.update(zip(["</end>", *w], w, strict=False))
    n, v = sum(count.values()), len(count)
    expect = sorted((str(i), held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    got = L.lm_scores(docs, **kw).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expect
    return {r.doc_id: r for r in got}, count, pair, n, v, dict(rows)


def test_against_counts(spark, real):
    got, count, pair, n, v, rows = check(real)
    errors = []
    for i, r in got.items():
        w = tokens(rows[i])
        exact = sum(math.log10(L.PAIR_WEIGHT * min(1, pair[(a, b)] / max(count[a], 1)) + (1 - L.PAIR_WEIGHT) * (count[b] + 1) / (n + v + 1)) for a, b in zip(["</end>", *w], w, strict=False))
        errors.append((r.score - exact) / len(w))
    assert abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.5  # quantised counts, one-sided filter


def test_passes_add_up(spark, real, edges):
    for docs in (real, edges):
        one, many = (L.lm_scores(docs, buckets=64, max_broadcast=b).collect() for b in (1 << 30, 20_000))
        order = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
        assert order(one) == order(many)


def test_edges(spark, edges, empty):
    check(edges)
    assert L.lm_scores(empty).count() == 0


def test_filter_levels():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    c = rng.geometric(0.3, len(h))
    halves = L.bucket_of(h, 2)
    table = L.Filters(2, {b: L.build_filter(h[halves == b], c[halves == b]).tobytes() for b in (0, 1)})
    ask = lambda x: table.probe(x, L.bucket_of(x, 2))
    level = ask(h)
    assert (level >= L.levels(c)).all()  # never too low
    assert (level > L.levels(c)).mean() < 0.05
    assert (ask(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.05
    assert L.Filters(2, {}).probe(h, halves).max() == 0


def test_word_filter_grows_with_its_words(monkeypatch):
    monkeypatch.setattr(L, "MAX_WORDS", 4096)
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    packed = np.diff(h, prepend=np.uint64(0)).tobytes()
    many = np.full(len(h), 0xFFFFFFFF, "<u4").tobytes()
    out = L._merge(pd.DataFrame({"n": 1, "bucket": 0, "hashes": [packed] * 2, "counts": [many] * 2})).iloc[0]
    assert set(np.frombuffer(out["counts"], "<i8")) == {2 * 0xFFFFFFFF}
    wide = np.full(len(h), 5 << 40, "<i8").tobytes()
    both = L._merge(pd.DataFrame({"n": 1, "bucket": 0, "hashes": [packed] * 2, "counts": [many, wide]})).iloc[0]
    assert set(np.frombuffer(both["counts"], "<i8")) == {0xFFFFFFFF + (5 << 40)}
    table = L.Filters(1, {0: out["bloom"]})
    other = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (table.probe(other, np.zeros(len(other), np.int64)) > 0).mean() < 0.05


def test_probing_ends():
    h = np.arange(1, 100, dtype=np.uint64)
    assert set(L.VALUE[L.Filters(1, {0: b"\xff" * 64}).probe(h, np.zeros(len(h), np.int64))]) == {L.VALUE[-1]}


def test_word_passes_change_nothing(spark, real, edges):
    for docs in (real, edges):
        one, many, both = (L.lm_scores(docs, buckets=64, **kw).collect() for kw in ({}, {"max_words": 4000}, {"max_words": 4000, "max_broadcast": 20_000}))
        order = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
        assert order(one) == order(many) == order(both)


def test_buckets_follow_the_texts(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "repeat('ab ', 1000) AS text")
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert L.buckets_for(docs, "text", 1 << 30, 1 << 30) == least
    assert L.buckets_for(docs, "text", 1 << 10, 1 << 30) > 100 * 1500 * 16 / 1024
    assert L.buckets_for(docs.limit(0), "text", 1, 1) == least


def test_base_scores_without_the_model(spark, edges):
    """The same rows in one pass and in many; no pair is counted or sent."""
    whole = sorted(map(str, L.lm_scores(edges).drop("score").collect()))
    for sizes in ({}, {"buckets": 16, "max_broadcast": 64}):
        got = L.lm_scores(edges, model=False, **sizes)
        assert "score" not in got.columns
        assert sorted(str(r) for r in got.collect()) == whole or len(sizes)
        assert [r.n_known for r in got.orderBy("doc_id", "n_tokens").collect()] == [r.n_known for r in L.lm_scores(edges).orderBy("doc_id", "n_tokens").collect()]
    assert {r.n for r in L.ngram_tables(edges, 4, orders=(1,)).select("n").collect()} == {1}
