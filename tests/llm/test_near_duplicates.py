import random
import re

import numpy as np
import pytest

from pixelquill.llm import _components as C
from pixelquill.llm import near_duplicates as N
from pixelquill.llm._components import components

from .conftest import make, words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d is not None, d or 0), len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(spark, size, edge_texts, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)  # several blocks a cluster
    rng = random.Random(size)
    texts = list(edge_texts[:9])
    for family in range(4):
        base = words(rng, 90)
        texts.append(" ".join(base))
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts += [texts[-1], texts[-1].upper(), texts[-1].replace(" ", "  ")]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = None
    rows = list(zip(ids, texts, strict=True))
    out = N.near_duplicates(make(spark, texts, ids), size=size)
    assert got(out) == brute(rows, size)


def test_edges_and_filter(spark, edges, empty):
    out = N.near_duplicates(edges, size=5).collect()
    assert len(out) == edges.count()
    by = {r.doc_id: r for r in out}
    assert by[0].kept and by[1].kept and by[1].component_id == 1  # empty sets stand alone
    assert by[7].component_id == by[14].component_id == 6 and not by[7].kept
    kept = N.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}
    assert N.near_duplicates(empty).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    whole = np.sort(rng.integers(0, 1 << 63, 1200).astype(np.uint64))
    gram, first = [], [0]
    for share in (1.0, 0.9, 0.8, 0.5):
        keep = np.sort(rng.permutation(whole)[: int(1200 * share)])
        gram.append(keep)
        first.append(first[-1] + len(keep))
    m = N.minhashes(np.concatenate(gram), np.array(first))
    s = N.odd_sketches(m)
    assert np.abs(N.estimate(s[:1], s) - [1, 0.9, 0.8, 0.5]).max() < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 300: 300}


@pytest.mark.parametrize("few", [0, 30, 1 << 13])
def test_components_take_few_rounds(spark, few, monkeypatch):
    """The last edges are settled at once: later rounds over a handful of them cost as much as the first."""
    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(150)] + [(-5, 1000 + i) for i in range(100)] + [(-7, -7), (2, 1), (1, 2)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    writes, write = [], C.written
    monkeypatch.setattr(C, "FEW", few, raising=False)
    monkeypatch.setattr(C, "written", lambda df, *a: writes.append(1) or write(df, *a))
    found = [(r.node, r.label) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(found) == sorted(low.items())
    assert len(writes) <= 3 or few < 400


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(words(rng, 120, 5000)) for _ in range(5))
    rows = [(1, a), (None, a + " end"), (None, b), (2, c), (2, a + " tail"), (3, d), (3, d), (3, d + " more"), (None, e), (None, e), (4, ""), (4, ""), (None, None)]
    kept = N.drop_near_duplicates(make(spark, [t for _, t in rows], [i for i, _ in rows]))
    got = sorted(((r.doc_id or 0), r.text or "") for r in kept.collect())
    copies = [x for x in got if x[0] == 3]
    assert len(copies) == 1 and copies[0][1].startswith(d)
    assert [x for x in got if x[0] != 3] == sorted([(1, a), (0, b), (2, c), (0, e), (4, ""), (4, ""), (0, "")])
