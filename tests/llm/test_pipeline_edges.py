"""The stages over null, empty, long, repeated and clashing rows, against plain Python."""

import random
import re

import pytest

from pixelquill.llm import decontaminate, near_duplicates, secrets

from .conftest import SCHEMA, make, words

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def one_of_each_class(rows):
    """Numbers of classes' rows: linked rows reach each other; rows without words stand alone."""
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def hit_share(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit = set()
    for item in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(LOW))
        n = min(13, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        hit |= {i + k for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in wins for k in range(n)}
    return len(hit), len(w)


@pytest.fixture(scope="module")
def folder(spark, edges, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    rng = random.Random(12)
    item = " ".join(words(rng, 40, 9000))
    base = words(rng, 150, 9000)
    near = [*base[:70], "changed", *base[71:]]
    texts = [" ".join(base), " ".join(near), " ".join(base) + " x", item + " tail of words", " ".join(words(rng, 400, 9000)) + " " + item[:60], "short", "short"]
    # One id on rows of differing texts: (3, A), (5, A), (5, B), and rows without an id.
    a, b = " ".join(words(rng, 90, 9000)), " ".join(words(rng, 90, 9000))
    more = make(spark, [*texts, a, a, b, b.upper(), "no id and " + a, "no id " + item], [*range(100, 107), 3, 5, 5, 205, None, None])
    edges.unionAll(more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("i1", item), ("i2", None), ("i3", ""), ("i4", item)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, None, 0), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def key(r):
    return tuple(str(v) for v in r)


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality classifier"](spark, docs, folder)
    rows = docs.collect()
    assert first.columns == docs.columns and sorted(map(key, first.collect())) == sorted(map(key, rows))  # no labels of both kinds: all stay

    kept = stages["near duplicates"](spark, docs, folder)
    left = kept.collect()
    assert kept.columns == docs.columns and not {key(r) for r in left} - {key(r) for r in rows}
    group = one_of_each_class(rows)
    place = {}
    for g, r in zip(group, rows, strict=True):
        place.setdefault(key(r), set()).add(g)
    found = [min(place[key(r)]) for r in left]
    worded = {min(place[key(r)]) for r in rows if shingles(r.text)}
    assert {g for g, r in zip(found, left, strict=True) if shingles(r.text)} == worded  # every class has a row
    assert sum(1 for r in left if shingles(r.text)) == len(worded)  # and one only
    assert sum(1 for r in left if not shingles(r.text)) == sum(1 for r in rows if not shingles(r.text))

    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, docs, folder)
    stays = [r for r in rows if not (lambda h, n: h > 0 and 20 * h >= n)(*hit_share(r.text, items))]
    assert 0 < len(stays) < len(rows)
    assert clean.columns == docs.columns and sorted(map(key, clean.collect())) == sorted(map(key, stays))

    safe = stages["secret scans"](spark, docs, folder).collect()
    assert len(safe) == len(rows)
    assert not any(secrets.base_spans(r.text or "") for r in safe)
    plain = {key(r) for r in rows if not secrets.base_spans(r.text or "") and not re.search(secrets.CANDIDATE, r.text or "")}
    assert plain <= {key(r) for r in safe}

    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) >= 15 and all(r.n_tokens == len(r.ids) for r in out)


def test_one_id_on_rows_of_several_texts(spark):
    """(3, A), (5, A), (5, B): B is clean and unique, so it stays; of A one row stays."""
    rng = random.Random(3)
    a, b = " ".join(words(rng, 60, 5000)), " ".join(words(rng, 60, 5000))
    docs = make(spark, [a, a, b, b], [3, 5, 5, 5]).drop("row")
    left = near_duplicates.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(3, a), (5, b)])
    bench = spark.createDataFrame([("x", a)], "item_id string, text string")
    assert [(r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, bench).collect()] == [(5, b), (5, b)]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
