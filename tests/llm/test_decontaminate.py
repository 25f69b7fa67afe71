import random
import re

import pytest

from pixelquill.llm import decontaminate as D

from .conftest import make, words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items):
    wins = [(i, tuple(w[k : k + min(len(w), 13)])) for i, t in items for w in [split(t)] if w for k in range(len(w) - min(len(w), 13) + 1)]
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_against_brute_force(spark, block):
    rng = random.Random(1)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([13, 14, 20, 30, 5, 1, 12, 40, 0])] + [(9, None), (2, "again " + " ".join(words(rng, 15))), (10, "One two")]
    texts = [" ".join(words(rng, 60)) for _ in range(20)]
    for k in range(12):
        source = items[k % len(items)][1] or ""
        w = split(source)
        texts.append(" ".join([*words(rng, 9), *w[: rng.randint(0, len(w))], *words(rng, 5), *w]))
    texts += [None, "", "one TWO", items[2][1].upper(), texts[-1], "w1 " * 3000]
    docs = list(zip([*range(len(texts) - 1), None], texts, strict=True))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.id, r.n_words, r.n_hit, list(r["items"])) for r in D.scan(make(spark, texts, [d for d, _ in docs]), bench, max_block=block).collect()]
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_filter_keeps_columns_and_clean_rows(spark, edges):
    bench = spark.createDataFrame([(1, "Zwei Wörter")], "item_id long, text string")
    kept = D.drop_contaminated(edges, bench)
    assert kept.columns == edges.columns
    assert sorted(r.row for r in kept.collect()) == [k for k in range(edges.count()) if k != 5]


def test_empty_tables(spark, empty, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(empty, none).count() == 0
    assert D.scan(edges, none).where("n_hit > 0").count() == 0
    assert D.drop_contaminated(empty, none).count() == 0


def test_winnowing_guarantee():
    import numpy as np

    from pixelquill.llm._text import U64

    rng = np.random.default_rng(2)
    h = rng.integers(0, 50, 300).astype(U64)  # many ties
    at = np.arange(300)
    picked = set(D.winnow(h, at).tolist())
    assert all(any(k in picked for k in range(i, i + D.SPAN)) for i in range(300 - D.SPAN + 1))


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_clean_rows_stay_beside_contaminated_ones(spark, block):
    bench = spark.createDataFrame([(1, "Zwei Wörter"), (2, "other words here")], "item_id long, text string")
    rows = [(None, "Zwei Wörter"), (None, "clean"), (None, None), (5, "zwei wörter"), (5, "clean too"), (6, "Zwei Wörter"), (7, "clean")]
    kept = D.drop_contaminated(make(spark, [t for _, t in rows], [i for i, _ in rows]), bench, max_block=block).collect()
    assert sorted(r.row for r in kept) == [1, 2, 4, 6]
