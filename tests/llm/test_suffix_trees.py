import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelquill.llm import suffix_trees as T
from pixelquill.llm.queries import op13_substring_dedup

from .conftest import make, words


def brute(rows, least):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = {}
    for d, w in enumerate(split):
        for k in range(len(w) - least + 1):
            places.setdefault(tuple(w[k : k + least]), []).append((d, k))
    gone = {(d, k + j) for at in places.values() if len(at) > 1 for d, k in at for j in range(least)}
    out = []
    for d, ((i, _), w) in enumerate(zip(rows, split, strict=True)):
        stays = [x for k, x in enumerate(w) if (d, k) not in gone]
        out.append((i, len(w), len(w) - len(stays), " ".join(stays)))
    return sorted(out, key=repr)


def texts(rng, least):
    """Texts of chance words, shared passages around `least` words, near and exact copies, and repeats inside."""
    shared = [words(rng, n, 10_000) for n in (least - 1, least, least + 1, 2 * least, 5 * least)]
    out = [None, "", " \n", "few words", " ".join(shared[1]), " ".join(shared[0])]
    for k in range(50):
        w = words(rng, rng.randrange(3 * least), 10_000)
        if k % 3:
            w += shared[k % 5]
        w += words(rng, rng.randrange(4), 10_000) + shared[0][: least // 2]
        out.append("  ".join(w))
    near = words(rng, 6 * least, 10_000)
    for _ in range(6):
        w = list(near)
        w[rng.randrange(len(w))] = "other"
        out.append("\t".join(w))
    out.append(" ".join(words(rng, least + 3, 10_000) * 3))
    out.append("la " * (2 * least))
    return out + out[10:14] + [out[12].upper()]


@pytest.mark.parametrize(("least", "group"), [(35, T.GROUP), (20, T.GROUP), (35, 3), (35, 1)])
def test_against_brute_force(spark, least, group, monkeypatch):
    """With small groups, more prefixes are long ones."""
    monkeypatch.setattr(T, "GROUP", group)
    rows = texts(random.Random(least + group), least)
    ids = [*range(len(rows) - 2), None, 12]
    for parts in (1, 7):
        got = T.without_repeats(make(spark, rows, ids).repartition(parts), least=least).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute(list(zip(ids, rows, strict=True)), least)
        assert all(sum(s.n for s in r.spans) == r.n_removed for r in got)


def test_a_passage_and_a_text_of_most_rows(spark, monkeypatch):
    """A text that a third of the rows are and a passage that another third hold, over salts and long prefixes."""
    monkeypatch.setattr(T, "GROUP", 20)
    rng = random.Random(8)
    passage, copied = words(rng, 45, 10_000), " ".join(words(rng, 90, 10_000))
    rows = [copied if k % 3 == 0 else " ".join([f"a{k}x{j}" for j in range(20)] + (passage if k % 3 == 1 else []) + [f"b{k}x{j}" for j in range(15)]) for k in range(900)]
    docs = make(spark, rows).repartition(9)
    got = {r.doc_id: r for r in T.without_repeats(docs).collect()}
    assert {r.n_removed for i, r in got.items() if i % 3 == 0} == {90}
    assert {(r.n_removed, tuple(map(tuple, r.spans))) for i, r in got.items() if i % 3 == 1} == {(45, ((20, 45),))}
    assert {r.n_removed for i, r in got.items() if i % 3 == 2} == {0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=60), st.integers(1, 12))
def test_trees_of_small_alphabets(w, depth):
    codes = np.array(w, "<u4")
    start = np.arange(len(w) - depth + 1)
    node = start % 2
    got = T.in_company(codes, start, node, depth)
    seen = [(k % 2, tuple(w[k : k + depth])) for k in start.tolist()]
    assert got.tolist() == [seen.count(x) > 1 for x in seen]


def test_trees_in_parts():
    """Groups that spread over batches and parts of memory stay whole."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = []
    for key in range(60):
        prefix = int(rng.integers(0, 6))
        rows.append((prefix, 0, False, key, 3, np.repeat(np.arange(9) // 4 + prefix, 3).astype("<u4").tobytes() if key % 2 else rng.integers(0, 2, 22).astype("<u4").tobytes()))
    rows.sort(key=lambda r: r[0])
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["prefix", "salt", "wide", "key", "at", "codes"])
    results = []
    for step, limit in ((60, 1 << 20), (7, 40), (1, 1)):
        out = T._trees(20, limit)(iter([whole.slice(i, step) for i in range(0, 60, step)]))
        results.append(sorted(tuple(r.values()) for b in out for r in b.to_pylist()))
    assert results[0] and results[0] == results[1] == results[2]


def test_query(spark, tmp_path):
    rows = texts(random.Random(1), 35)
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_substring_dedup(spark, str(tmp_path)).collect()))
    assert got == sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(list(enumerate(rows)), 35))


def test_edges(spark, edges, empty):
    got = T.without_repeats(edges).collect()
    assert len(got) == edges.count() and {r.n_removed for r in got if r.doc_id == 6} == {120}
    assert T.without_repeats(empty).count() == 0


def test_texts_are_exchanged_once(spark, tmp_path):
    make(spark, texts(random.Random(1), 35)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T.without_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"ReusedExchange \[key#\d+L, part#\d+, id#\d+L, text#\d+\]", plan), plan
