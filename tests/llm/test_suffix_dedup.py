import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pixelquill.llm import suffix_dedup as S

from .conftest import make, words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, within=False):
    places = {}
    for d, (i, t) in enumerate(dict.fromkeys(rows)):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        for k in range(len(w) - least + 1):
            places.setdefault(tuple(w[k : k + least]), []).append((d, k))
    hit = {}
    for at in places.values():
        if len({d for d, _ in at}) > 1 or (within and len(at) > 1):
            for d, k in at:
                hit.setdefault(d, set()).add(k)
    out = []
    for d, (i, _) in enumerate(dict.fromkeys(rows)):
        span = None
        for k in sorted(hit.get(d, ())):
            if span and k <= span[1] + least:
                span[1] = k
            else:
                span = [k, k]
                out.append((i, span))
    return sorted(((i is not None, i or 0), a, b + least - a) for i, (a, b) in out)


@pytest.mark.parametrize(("least", "within"), [(50, False), (39, False), (50, True)])
def test_against_brute_force(spark, least, within, edge_texts):
    rng = random.Random(least)
    shared = [words(rng, n, 10_000) for n in (49, 50, 51, 80, 200)]
    texts = [*edge_texts]
    for k in range(40):
        w = words(rng, rng.randrange(5, 120), 10_000)
        w += shared[k % 5] if k % 3 else words(rng, 60, 10_000)
        w += words(rng, rng.randrange(4), 10_000) + shared[0][:30]
        texts.append(" ".join(w))
    texts.append(" ".join(words(random.Random(9), 70) * 3))  # repeats inside itself only
    ids = [*range(len(texts) - 1), None]
    got = S.repeated_passages(make(spark, texts + texts[6:7], [*ids, 6]), least=least, within=within).collect()
    rows = list(zip([*ids, 6], texts + texts[6:7], strict=True))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.first_word, r.n_words) for r in got) == brute(rows, least, within)


def test_one_passage_everywhere(spark):
    """A run of equal keys over all partitions and their edges."""
    rng = random.Random(3)
    shared = " ".join(words(rng, 60, 10_000))
    texts = [shared + f" own{k} " + " ".join(words(rng, 8, 10_000)) for k in range(300)]
    got = S.repeated_passages(make(spark, texts)).collect()
    assert len(got) == 300 and all(r.first_word == 0 and r.n_words == 60 for r in got)


def test_empty(spark, empty):
    assert S.repeated_passages(empty).count() == 0
    with pytest.raises(ValueError):
        S.repeated_passages(empty, least=20)


def test_suffixes_are_sorted_by_their_words(spark):
    """Keys are strings of word codes; the prefixes that neighbours share are counted in words."""
    rng = random.Random(2)
    docs = make(spark, [" ".join(words(rng, 300, 50)) for _ in range(4)])
    rows = docs.selectExpr("doc_id AS doc", "text").mapInArrow(S._suffixes(50), S.SHAPE.format(kind="binary")).collect()
    h = {}
    for r in docs.collect():
        w = r.text.split(" ")
        data, off = S.texts_of(pa.array([r.text]))
        h[r.doc_id] = (S.Words(data, off, S.SPACED).hashes(S.LOWER) >> np.uint64(56)).astype(np.uint8)
        assert len(h[r.doc_id]) == len(w)
    assert rows and all(bytes(r.key) == h[r.doc][r.at : r.at + 19].tobytes() for r in rows)
    keys = sorted(bytes(r.key) for r in rows)
    shared = S.common_prefixes(pa.array(keys, pa.binary()))
    for a, b, n in zip(keys, keys[1:], shared, strict=False):
        assert a[:n] == b[:n] and (n == 19 or a[n] != b[n])
    # Of any 50 words the first 32 hold a kept place.
    for d in h:
        at = sorted(r.at for r in rows if r.doc == d)
        assert all(any(s <= x < s + 32 for x in at) for s in range(len(h[d]) - 49))
