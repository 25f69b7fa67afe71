import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelquill.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q int"


def plain(rows):
    """The contract, row by row in Python's integers."""
    held = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(4096 * float(np.float32(x))) for x in v], label))
    width = len(held[0][1]) // 8 if held else 0
    part = lambda v, j: v[j * width : (j + 1) * width]
    smallest = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:16]
    books = [[part(v, j) for _, v, _ in smallest] for j in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((distance(part(v, j), e), k) for k, e in enumerate(books[j])) for j in range(8)] for _, v, _ in held]

    for _ in range(6):
        found = assigned()
        for j in range(8):
            for k in range(len(books[j])):
                own = [part(v, j) for (_, v, _), f in zip(held, found, strict=True) if f[j][1] == k]
                if own:
                    books[j][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assigned()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(held, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(held, found, errors, strict=True)]


def vectors(rng, n, dims=16):
    out = [(i, [rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([None, 1, 1, 1, 2, 7])) for i in rng.sample(range(1000), n)]
    for k in range(n // 4):  # ties and repeated rows
        out.append((2000 + k, list(out[k % 5][1]), 1))
    return out + out[:3]


@pytest.mark.parametrize(("n", "dims"), [(60, 16), (7, 8), (1, 64), (150, 24)])
def test_against_plain_python(spark, n, dims):
    rng = random.Random(n)
    rows = vectors(rng, n, dims)
    bad = [(1, None, 1), (2, [None] * dims, 2), (3, [float("nan")] * dims, None), (4, [0.5] * (dims - 1) + [float("inf")], 1), (None, [0.1] * dims, 1)]
    for parts in (1, 5):
        df = spark.createDataFrame([(*r, "x", 1) for r in bad + rows], SCHEMA).repartition(parts)
        got = [tuple(r) for r in V.vector_codes(df).collect()]
        assert sorted(got, key=repr) == sorted(plain(bad + rows), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=16))
def test_partial_distances_find_the_nearest(parts, book):
    p, b = np.array(parts, np.int64), np.array(book, np.int64)
    every = ((p[:, None] - b[None]) ** 2).sum(axis=2)
    code, best = V.nearest(p, b)
    assert code.tolist() == every.argmin(axis=1).tolist() and best.tolist() == every.min(axis=1).tolist()


def test_large_components_are_exact():
    rng = np.random.default_rng(3)
    p, b = rng.integers(-V.BOUND, V.BOUND, (200, 8)), rng.integers(-V.BOUND, V.BOUND, (16, 8))
    every = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, e, strict=True)) for e in b] for r in p]
    code, best = V.nearest(p, b)
    assert best.tolist() == [min(r) for r in every] and code.tolist() == [r.index(min(r)) for r in every]


def test_errors_are_the_distances_of_decoded_vectors(spark):
    rows = vectors(random.Random(9), 80)
    coded, books = V.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    by_id = {i: np.floor(np.array(v, np.float32) * 4096).astype(int) for i, v, _ in rows}
    for r in coded.collect():
        assert ((by_id[r.id] - V.decoded(np.frombuffer(r.code, np.uint8)[None], books)[0]) ** 2).sum() == r.error


def test_empty_and_wrong_lengths(spark):
    assert V.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.vector_codes(spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA)).count() == 0
    for odd in ([[0.1] * 8, [0.1] * 16], [[0.1] * 9]):
        with pytest.raises(Exception, match="components|length"):
            V.vector_codes(spark.createDataFrame([(i, v, 1, "", 0) for i, v in enumerate(odd)], SCHEMA)).collect()
    with pytest.raises(Exception, match="below"):
        V.vector_codes(spark.createDataFrame([(1, [1e9] * 8, 1, "", 0)], SCHEMA)).collect()


def test_a_label_of_most_rows(spark):
    """The error of a hot label is joined by broadcast, not in one task."""
    df = spark.range(6000).selectExpr("id AS vec_id", "transform(sequence(0, 7), k -> CAST(sin(id * 8 + k) AS float)) AS embedding", "IF(id % 3 = 0, null, CAST(id AS int)) AS label")
    got = V.vector_codes(df).collect()
    nulls = {r.label_error for r in got if r.vec_id % 3 == 0}
    assert len(got) == 6000 and nulls == {sum(r.error for r in got if r.vec_id % 3 == 0)}
    assert all(r.label_error == r.error for r in got if r.vec_id % 3)
