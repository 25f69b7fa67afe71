import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelquill.llm import quality_classifier as Q
from pixelquill.llm import quality_rules as R

from .conftest import make, words

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(SPACE, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    wins = {}
    for k in range(len(w) - 2):
        wins.setdefault(tuple(w[k : k + 3]), []).append(k)
    hit = {k + j for at in wins.values() if len(at) > 1 for k in at for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_rules_base_against_brute_force(spark, real, edges):
    extra = make(spark, ["a b c a b c", "l1 x\nl1 x\n\n \nl1 x\r\nl1 x\r", "x\ny\nx", "q " * 200, "\n\n\n", "##é%% é"])
    for docs in (real, edges, extra):
        want = {}
        for r in docs.select("doc_id", "text").collect():
            want.setdefault(r.doc_id, []).append(brute(r.text))
        got = {}
        for r in R.quality_rules(docs).collect():
            n = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            got.setdefault(r.doc_id, []).append(n)
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.base_failed and r.kept)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_rules_adapt_to_their_group(spark, empty):
    rng = random.Random(1)
    plain = lambda sep: " ".join(w + (sep if k % 3 == 0 else "") for k, w in enumerate(words(rng, 90, 5000)))
    rows = [(i, plain(""), "en", "calm", 1) for i in range(60)] + [(100 + i, plain("##"), "en", "wild", 1) for i in range(60)] + [(500, plain("#####"), "en", "calm", 1), (501, plain("##"), "en", "wild", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in R.quality_rules(docs).collect()}
    assert not kept[500] and kept[501] and all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60))
    assert R.quality_rules(empty).count() == 0
    assert R.quality_rules(docs.drop("lang", "source")).count() == 122


STATS = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def test_thresholds_come_from_the_sketches(spark):
    rng = np.random.default_rng(0)
    repeat = rng.random(3000) ** 8
    stats = spark.createDataFrame([("en", "s", 1000, int(v), int(v) // 2, 0, 1, int(1000 * r)) for v, r in zip(rng.integers(3000, 9000, 3000), repeat, strict=True)], STATS)
    t = R.thresholds(stats).collect()[0]
    # Uniform: the fence lies beyond the last quantile, which is the cutoff; a long tail: the fence lies below the first.
    assert abs(t.word_length_most / R.UNITS - 8.97) < 0.1 and abs(t.word_length_least / R.UNITS - 3.03) < 0.1
    assert np.quantile(repeat, R.NEAR / 1000 - 0.02) < t.repeat_ratio_most / R.UNITS < np.quantile(repeat, R.FAR / 1000)
    # All the same: the cutoff is that value, so nothing fails, and any other value would.
    assert t.dup_line_ratio_most == 0


def test_verdicts_do_not_depend_on_chance_or_partitions(spark):
    """A group of 100,000 rows, judged three times over different partitions, gets the same verdict row by row."""
    word = "substr(sha2(CAST(id * 131 + k AS string), 256), 1, 1 + CAST(pow(rand(5) * 3, 2) AS int))"
    docs = spark.range(100_000).selectExpr("id AS doc_id", f"array_join(transform(sequence(0, 51 + CAST(id % 13 AS int)), k -> {word}), ' ') AS text", "'en' AS lang", "'web' AS source").persist()
    judged = [R.quality_rules(docs.repartition(n) if n else docs).select("doc_id", "kept", F.concat_ws(",", "failed_rules").alias("failed")) for n in (0, 3, 17)]
    assert judged[0].where("NOT kept").count() > 500
    for other in judged[1:]:
        assert judged[0].exceptAll(other).count() == 0
    docs.unpersist()


def test_quantiles_lie_in_the_bucket_of_the_exact_rank(spark):
    v = np.sort(np.random.default_rng(1).lognormal(0, 2, 5000))
    stats = spark.createDataFrame([("en", None, 1_000_000, int(x * 1e6), 0, 0, 1, 0) for x in v], STATS)
    t = R.thresholds(stats).collect()[0]
    exact = np.floor(v * R.UNITS)
    # The fence lies between the far quantiles, whose buckets are at most 1/128 wide.
    assert exact[4850] <= t.word_length_most <= exact[4975] * (1 + 1 / 128) and exact[25] * (1 - 1 / 128) - 1 <= t.word_length_least <= exact[150]


def test_thresholds_find_what_base_rules_pass(spark):
    """Cutoffs of few groups catch planted outliers of each measure; with the base rules alone all stay."""
    rng = random.Random(8)
    rows, odd = [], set()
    for i in range(1200):
        n = rng.randrange(80, 160)
        w = words(rng, n, 8000)
        lines = [" ".join(w[k : k + 10]) for k in range(0, n, 10)]
        kind = i % 100
        if kind == 1:
            lines = [x.replace(" ", " #%& ") for x in lines]
        elif kind == 2:
            lines = [x for k, x in enumerate(lines) for _ in range(2 if k < 2 else 1)]
        if kind in (1, 2):
            odd.add(i)
        rows.append((i, "\n".join(lines), "en" if i % 2 else "de", f"s{i % 3}", 1))
    got = R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert not any(r.base_failed for r in got)
    assert all(not r.kept for r in got if r.doc_id in odd)
    assert np.mean([r.kept for r in got if r.doc_id not in odd]) > 0.93


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        junk, toxic = rng.random() < 0.25, rng.random() < 0.15
        w = words(rng, 80, 3000)
        if junk:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(["vileword", "nastyword", "crudeword"])
        source = "s3" if junk and rng.random() < 0.9 else f"s{i % 3}"
        rows.append((i, " ".join(w), "en", source, 400, junk, toxic))
        if i < 500:
            labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[5:] for r in rows}


def test_classifier_on_rows_it_never_saw(labelled):
    docs, labels, truth = labelled
    rows = [r for r in Q.classify(docs, labels).collect() if r.doc_id >= 500]
    assert len(rows) == 400
    clean = [r.kept for r in rows if not any(truth[r.doc_id])]
    assert np.mean(clean) > 0.95
    assert np.mean([r.kept for r in rows if truth[r.doc_id][0]]) < 0.1
    assert np.mean([r.kept for r in rows if truth[r.doc_id][1]]) < 0.25
    kept = Q.drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.classify(docs, labels).where("kept").collect()}


def test_views_teach_each_other(labelled):
    docs, labels, truth = labelled
    few = labels.where("doc_id < 120")
    rows = [r for r in Q.classify(docs, few).collect() if r.doc_id >= 500]
    good = np.array([not truth[r.doc_id][0] for r in rows])
    for view in ("p_text", "p_page", "p_quality"):
        p = np.array([r[view] for r in rows])
        assert ((p > 0.5) == good).mean() > 0.85, view


def one_process(docs, labels, sample=Q.SAMPLE):
    """The whole co-training over collected rows, without Spark's draws."""
    rows = sorted(((r.id, r.text, r.lang, r.source, r.n_chars, r.mark) for r in Q._inputs(docs, "doc_id", "text").withColumn("mark", F.xxhash64("id", "text")).collect()), key=lambda r: r[5])
    batch = pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(("id", "text", "lang", "source", "n_chars"))})
    views = Q.features(batch)
    named = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    hashes = {r.doc_id: r.h for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    known = sorted(named, key=lambda i: (hashes[i], i))[:sample]
    at = np.array([k for i in sorted(known) for k, r in enumerate(rows) if r[0] == i])
    heads = []
    for k, otherwise in ((0, 0.5), (1, 0.0)):
        y = np.array([float(named[rows[i][0]][k]) for i in at])
        own = [v.take(at) for v in views]
        order = np.random.default_rng(1).permutation(len(y))
        held, fitted = order[: len(y) // 4], order[len(y) // 4 :]
        taught = [[], []]
        for turn in range(Q.ROUNDS + 1):
            w, scale, odds = [], [], []
            for v, bits in ((0, Q.TEXT_BITS), (1, Q.PAGE_BITS)):
                more = views[v].take(np.array([i for i, _ in taught[v]], np.int64))
                w.append(Q.fit(Q._stack(own[v].take(fitted), more), np.r_[y[fitted], [float(t) for _, t in taught[v]]], 1 << bits, Q.TELLING[v]).astype(np.float32))
                h = own[v].take(held)
                scale.append(Q.platt(h.dot(w[v].astype(np.float64)) + w[v][-1], y[held]))
                odds.append(scale[v][0] * (views[v].dot(w[v]) + w[v][-1]) + scale[v][1])
            if turn == Q.ROUNDS:
                break
            usual = np.log(y.sum() / (1 - y).sum())
            for v in (0, 1):
                p = 1 / (1 + np.exp(-odds[v]))
                before = {i for i, _ in taught[1 - v]}
                sure = [i for i in range(len(rows)) if abs(odds[v][i] - usual) >= Q.LIFT and max(p[i], 1 - p[i]) >= Q.SURE and rows[i][0] not in named and i not in before]
                for label in (0, 1):
                    taught[1 - v] += [(i, label) for i in sure if (p[i] > 0.5) == bool(label)][: Q.EXCHANGE // 2]
        heads.append(odds)
    return {r[0]: (heads[0][0][i], heads[0][1][i]) for i, r in enumerate(rows)}


def test_against_co_training_in_one_process(labelled):
    docs, labels, _ = labelled
    want = one_process(docs, labels)
    for r in Q.classify(docs, labels).collect():
        for got, odds in zip((r.p_text, r.p_page), want[r.doc_id], strict=True):
            assert abs(got - 1 / (1 + np.exp(-odds))) < 0.02


def test_what_comes_to_the_driver_is_bounded(spark, monkeypatch):
    """An id that very many rows share does not widen the sample, nor do long texts."""
    docs = spark.range(50_000).selectExpr("7L AS doc_id", "concat('word', id, ' text') AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    sizes = []
    whole = Q._collect

    def counting(rows):
        out = whole(rows)
        sizes.append(sum(b.num_rows for b in out))
        return out

    monkeypatch.setattr(Q, "_collect", counting)
    Q.train(docs, labels, sample=100)
    assert sizes == [100]
    monkeypatch.setattr(Q, "BYTES", 200)
    Q.train(docs, labels, sample=100)
    assert 1 <= sizes[1] <= 20


def test_fit_against_plain_gradients():
    rng = np.random.default_rng(0)
    x = (rng.random((40, 12)) < 0.3) * rng.random((40, 12))
    y = (x[:, 0] + 0.2 * rng.random(40) > 0.2).astype(float)
    at = [np.flatnonzero(r) for r in x]
    rows = Q.Rows(np.concatenate(at).astype(np.int32), np.concatenate([r[k] for r, k in zip(x, at, strict=True)]), np.r_[0, np.cumsum([len(k) for k in at])])
    w, seen = np.zeros(13), np.full(13, 1e-8)
    full = np.hstack([x, np.ones((40, 1))])
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(80):
        g = full.T @ (each * (1 / (1 + np.exp(-full @ w)) - y)) + 1e-4 * w / 13
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    assert np.allclose(Q.fit(rows, y, 12), w)


def test_classifier_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in Q.classify(edges, none).collect())
    odd = spark.createDataFrame([(1, None, 0), (6, 1, 0), (6, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.classify(edges, odd).count() == edges.count()
    assert Q.drop_rejected(edges, none).count() == edges.count()
    assert Q.classify(empty, none).count() == 0
