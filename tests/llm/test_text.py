import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelquill.llm._text import ALNUM, LOWER, SPACED, Words, covered, ngrams, pieces, texts_of

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab Z9é🙂\n\t.-_"), max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(items):
    data, off = texts_of(pa.array(items, pa.string()))
    for member, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        w = Words(data, off, member)
        got = [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
        assert got == [x for t in items for x in re.findall(pattern, t or "")]
        assert w.count.tolist() == [len(re.findall(pattern, t or "")) for t in items]


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 10))
def test_ngram_hashes_are_equal_when_the_words_are(items, n):
    data, off = texts_of(pa.array(items, pa.string()))
    w = Words(data, off, SPACED)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    ws = [[x.translate(low) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in items]
    expect = [tuple(x[i : i + n]) for x in ws for i in range(len(x) - n + 1)]
    gram, at = ngrams(w.hashes(LOWER), w.first, n)
    assert len(gram) == len(expect)
    seen = {}
    for g, e in zip(gram.tolist(), expect, strict=True):
        assert seen.setdefault(e, g) == g
    assert len(set(seen.values())) == len(seen)
    assert (np.diff(at) > 0).all()


def test_long_words_and_slices():
    column = pa.array(["skip", "x" * 700_000, "x" * 700_000, None, "y"]).slice(1)
    data, off = texts_of(column)
    h = Words(data, off, SPACED).hashes()
    assert h[0] == h[1] != h[2]
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert sum(p.num_rows for p in pieces(batch, "text", 10)) == 4
    assert covered(np.array([1, 2]), 2, 5).tolist() == [False, True, True, True, False]
