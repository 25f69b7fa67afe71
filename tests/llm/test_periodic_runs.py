import binascii
import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelquill.llm import periodic_runs as P
from pixelquill.llm.queries import op11_periodic_runs

from .conftest import make


def brute(w):
    """(start, length, period) of all runs, from the definition."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            stretch = w[s : i + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((s, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tailed(i, w):
    h = None if i is None else binascii.crc32(str(i).encode())
    if h is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(i, text):
    w = tailed(i, split(text))
    runs = brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), min_size=1, max_size=4))
def test_runs_of_small_alphabets(texts):
    words = [[x for unit, k in t for x in unit * k] for t in texts]
    first = np.cumsum([0, *map(len, words)])
    h = np.array([x for w in words for x in w], np.uint64)
    assert [tuple(r) for r in P.find_runs(h, first).tolist()] == [(t, *r) for t, w in enumerate(words) for r in brute(w)]


def test_probes_in_many_parts(monkeypatch):
    monkeypatch.setattr(P, "PROBES", 7)
    monkeypatch.setattr(P, "CHUNK", 2)
    rng = random.Random(2)
    w = [x for _ in range(30) for x in [rng.randrange(3) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 7)]
    assert [tuple(r[1:]) for r in P.find_runs(np.array(w, np.uint64), np.array([0, len(w)])).tolist()] == brute(w)


def test_one_word_again_and_again_is_one_run():
    h = np.full(200_000, 7, np.uint64)
    assert P.find_runs(h, np.array([0, len(h)])).tolist() == [[0, 0, 200_000, 1]]


def documents():
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "la la la la la la la la la", "é " * 9, "x\ty\nz " * 8]
    for _ in range(40):
        w = []
        for _ in range(rng.randrange(1, 8)):
            unit = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))]
            w += unit * rng.choice([1, 1, 2, 4, 5, 9]) + unit[: rng.randrange(3)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return texts


def test_query_against_brute_force(spark, tmp_path):
    texts = documents() * 5
    ids = list(range(len(texts) - 2)) + [None, 3]
    make(spark, [*texts, texts[5]], [*ids, 5]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = [expected(i, t) for i, t in zip([*ids, 5], [*texts, texts[5]], strict=True)]
    assert got == sorted(want, key=repr)
    assert any(tailed(i, split(t)) != split(t) for i, t in zip(ids, texts, strict=True))


def test_spans_and_collapsed_texts(spark, edges, empty):
    got = {r.doc_id: r for r in P.periodic_runs(make(spark, ["so so so so so so it goes", None, "a b a b a b a b c"])).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 6, 1)] and got[0].collapsed == "so it goes"
    assert got[1].runs == [] and got[1].collapsed == "" and got[1].n_words == 0
    assert got[2].collapsed == "a b c"
    assert P.periodic_runs(edges).count() == edges.count()
    assert P.periodic_runs(empty).count() == 0
