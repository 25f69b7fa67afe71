import re

import pytest

from pixelquill.llm import bpe, decontaminate, near_duplicates, quality_classifier, secrets

from .conftest import SF

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_each_other(spark):
    """Each stage's rows are those that its operator's verdicts leave, judged on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, SF).cache()
        kept[name] = {r.doc_id for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        ids = {r.doc_id for r in before.collect()}
        if k == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert kept[name] == {r.doc_id for r in quality_classifier.classify(before, labels).where("kept").collect()} and kept[name] < ids
        if k == 1:
            assert kept[name] == {r.doc_id for r in near_duplicates.near_duplicates(before, size=5).where("kept").collect()} and kept[name] < ids
        if k == 2:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            bad = {r.id for r in decontaminate.scan(before, bench).where(decontaminate.contaminated()).collect()}
            assert kept[name] == ids - bad
        if k == 3:
            assert kept[name] == ids
            assert not any(re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text or "") or secrets.base_spans(r.text or "") for r in docs.collect())
        if k == 4:
            assert kept[name] == ids
            texts = {r.doc_id: r.text for r in before.collect()}
            coder = bpe.Coder(open(__import__("public_tokenizers").path(corpus_pipeline.VOCABULARY), encoding="utf-8").read())
            for r in docs.limit(20).collect():
                assert r.ids == coder.encode([texts[r.doc_id] or ""])[0] and r.decoded == coder.decode(r.ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept[names[-1]]


def test_encoding_against_the_library(spark, edges):
    """The last stage's ids and texts are those of the tokenizers library, row by row."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(__import__("public_tokenizers").path(corpus_pipeline.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    rows = dict(corpus_pipeline.STAGES)["encoding"](spark, edges, SF).collect()
    want = []
    for r in edges.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, len(ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.ids, r.n_tokens, r.decoded) for r in rows), key=repr) == sorted(want, key=repr)


def test_rejection_follows_the_labels(spark):
    """What the first stage drops, held against the labels themselves."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, "/root/testdata/sf0.01").collect()}
    told = labels.join(docs.select("doc_id"), "doc_id").collect()
    good = [r.doc_id in kept for r in told if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id in kept for r in told if r.quality == 0 or r.toxic == 1]
    assert len(good) > 50 and len(bad) > 10 and sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_redaction_replaces_every_span(spark):
    """The fourth stage's texts are the input's with each span that the scan finds replaced, those of the network too."""
    import numpy as np

    from .conftest import make
    from .test_secrets import FAMILIES

    rng = np.random.default_rng(6)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(600).collect()]
    texts += [f"{texts[rng.integers(600)]} then {secret(rng)} end of text" for secret in FAMILIES.values() for _ in range(2)]
    docs = make(spark, texts)
    found = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert sum(s.kind == 3 for spans in found.values() for s in spans) >= 10  # the network's
    for r in dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, SF).collect():
        text, done, out = texts[r.doc_id], 0, ""
        for s in sorted(found[r.doc_id], key=lambda s: (s.start, -s.end)):
            if s.start >= done:
                out += text[done : s.start] + "[secret]"
            done = max(done, s.end)
        assert r.text == out + text[done:]


def test_queries_are_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
