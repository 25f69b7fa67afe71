import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pixelquill.llm import bpe as B
from pixelquill.llm import token_store as T
from pixelquill.llm._text import texts_of

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

TRICKY = ["", " ", "  a", "a  b", "a \n b", "\n\n", "x\n\n\ny", "a<|endoftext|> b <|endoftext|>", "x y z　q", "it's 'S don't ''s 'll", "tab\t x", "é à\nÉ", "😀 😀", "12 34 5", "A. b, c!", "ΣΑΣ Σ", "İ ǅ", "é ﬁ", "<|startoftext|><|x", "</w> a</w>", "ab" * 3000 + "!" * 50, "a.b.c ,x", "a\u0085 b", " \n", "end. \n"]


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(BYTES), tokenizers.Tokenizer.from_file(WORDS)


def test_encoder_equals_the_library(both):
    texts = TRICKY + [" ".join(TRICKY)] + [a + b for a in TRICKY[:20] for b in TRICKY[:20]]
    ids, first = T.Encoder(BYTES).encode(*texts_of(pa.array(texts)))
    for k, (t, e) in enumerate(zip(texts, both[0].encode_batch(texts, add_special_tokens=False), strict=True)):
        assert ids[first[k] : first[k + 1]].tolist() == e.ids, t


@pytest.mark.parametrize("base", [50257, 70000])
def test_grammar_round_trip(base):
    rng = np.random.default_rng(0)
    for n, docs in ((0, 1), (1, 1), (5000, 40), (20_000, 3)):
        tokens = np.concatenate([rng.integers(0, 12, n), np.zeros(docs, np.int64)]).astype(np.int32)
        ends = np.sort(rng.permutation(len(tokens) - 1)[: docs - 1]) if docs > 1 else np.zeros(0, np.int64)
        ends = np.append(ends, len(tokens) - 1)
        symbols, stops, rules = T.compress(tokens, ends, base)
        table = T.expansions(rules, base)
        assert (T.expand(symbols, table) == tokens).all()
        starts = np.r_[0, stops[:-1] + 1]
        for a, b, c, d in zip(starts, stops, np.r_[0, ends[:-1] + 1], ends, strict=True):
            assert (T.expand(symbols[a : b + 1], table) == tokens[c : d + 1]).all()
        if n >= 5000:
            assert len(symbols) < 0.8 * len(tokens) and len(rules)


def test_grammar_goes_on_to_its_end():
    """No pair that pays is left; runs of one symbol take few rounds."""
    rng = np.random.default_rng(7)
    phrase = rng.integers(0, 50, 300)
    for tokens in (np.full(1 << 16, 9), np.tile(phrase, 60), rng.zipf(1.5, 30_000) % 400):
        tokens = tokens.astype(np.int32)
        symbols, _, rules = T.compress(tokens, np.array([len(tokens) - 1]), 50257)
        assert (T.expand(symbols, T.expansions(rules, 50257)) == tokens).all()
        uses, last = {}, None
        for p in zip(symbols.tolist(), symbols[1:].tolist(), strict=False):
            last = None if p == last else p  # a run's overlapping pairs count once in two
            if last:
                uses[p] = uses.get(p, 0) + 1
        assert max(uses.values(), default=0) < T.MIN_USES
    assert len(T.compress(np.tile(phrase, 60).astype(np.int32), np.array([17_999]), 50257)[0]) < 40


def test_grammar_goes_on_beyond_16_bits():
    """A block whose rules outgrow 16-bit symbols ends with no pair of MIN_USES inside documents."""
    rng = np.random.default_rng(2)
    phrases = [rng.integers(0, 50_000, rng.integers(2, 9)) for _ in range(25_000)]
    tokens = np.concatenate([phrases[k] for k in rng.integers(0, len(phrases), 160_000)]).astype(np.int32)
    ends = np.append(np.sort(rng.permutation(len(tokens) - 1)[:700]), len(tokens) - 1)
    symbols, stops, rules = T.compress(tokens, ends, 50257)
    assert 50257 + len(rules) > 1 << 16
    table = T.expansions(rules, 50257)
    assert (T.expand(symbols, table) == tokens).all()
    uses = {}
    for a, b in zip(np.r_[0, stops[:-1] + 1].tolist(), (stops + 1).tolist(), strict=True):
        last = None
        for p in zip(symbols[a:b].tolist(), symbols[a + 1 : b].tolist(), strict=False):
            last = None if p == last else p
            if last:
                uses[p] = uses.get(p, 0) + 1
    assert max(uses.values()) < T.MIN_USES
    bits = T.symbol_bits(50257, len(rules))
    assert bits > 16 and (T.unpacked(T.packed(symbols, bits), bits)[: len(symbols)] == symbols).all()


@pytest.mark.parametrize("bits", [8, 9, 16, 17, 23, 32])
def test_packed_integers(bits):
    for n in (0, 1, 7, 8, 1000):
        v = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64)
        data = T.packed(v, bits)
        assert len(data) == -(-n * bits // 8) and (T.unpacked(data, bits)[:n] == v).all()


def key(r):
    return (r[0] is not None, r[0] or 0, *r[2:])


def test_store_against_the_library(spark, edges, real, both, empty):
    for docs in (edges, real):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        at, expect = 0, []
        for i, t in rows:
            ids = both[0].encode(t, add_special_tokens=False).ids + [0]
            expect.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.token_store(docs, BYTES).collect()]
        assert sorted(got, key=key) == sorted(expect, key=key)
        assert len({r[1] for r in got}) == len(got)
    assert T.token_store(empty, BYTES).count() == 0


def test_blocks_give_single_documents(spark, real, tmp_path, both):
    path = T.write_store(real, BYTES, str(tmp_path / "store"), shards=2)
    texts = {r.doc_id: r.text for r in real.collect()}
    for row in spark.read.parquet(path).collect():
        block = T.Block(row.asDict())
        for k in (0, len(block.ids) - 1):
            assert block.document(k).tolist() == both[0].encode(texts[block.ids[k]], add_special_tokens=False).ids + [0]


def test_bpe_equals_the_library(both):
    coder = B.Coder(open(WORDS, encoding="utf-8").read())
    texts = TRICKY + [" ".join(TRICKY)] + [a + b for a in TRICKY[:20] for b in TRICKY[:20]]
    ids = coder.encode(texts)
    for t, own, e in zip(texts, ids, both[1].encode_batch(texts, add_special_tokens=False), strict=True):
        assert own == e.ids, t
        assert coder.decode(own) == both[1].decode(e.ids, skip_special_tokens=False)


def test_bpe_over_documents(spark, edges, real, both, empty):
    for docs in (edges, real):
        expect = []
        for r in docs.select("doc_id", "text").collect():
            ids = both[1].encode(r.text or "", add_special_tokens=False).ids
            expect.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [tuple(r) for r in B.encode_decode(docs, WORDS, digests=True).collect()]
        assert sorted(got, key=str) == sorted(expect, key=str)
    assert B.encode_decode(empty, WORDS).count() == 0
    first = B.encode_decode(real.limit(2), WORDS).collect()[0]
    assert first.n_tokens == len(first.ids) and first.decoded


def test_segment_trees_against_plain_merging():
    vocab = B.Vocabulary(open(WORDS, encoding="utf-8").read())
    look = {(int(k >> 32), int(k & 0xFFFFFFFF)): (int(r), int(m)) for k, r, m in zip(vocab.pair, vocab.rank, vocab.made, strict=True)}
    rng = np.random.default_rng(4)
    for size in (2, 8, 32):
        count = rng.integers(1, size + 1, 40)
        symbols = np.full((40, size), -1)
        rows = []
        for k, n in enumerate(count):
            row = vocab.plain[rng.choice(list(b"theinandor"), n)].tolist()
            row[-1] = int(vocab.final[ord("n")])
            symbols[k, :n] = row
            while True:
                ranked = [(look[p][0], i) for i, p in enumerate(zip(row, row[1:], strict=False)) if p in look]
                if not ranked:
                    break
                i = min(ranked)[1]
                row[i : i + 2] = [look[(row[i], row[i + 1])][1]]
            rows.append(row)
        out = B.merge_words(symbols, count, vocab)
        assert [r[r >= 0].tolist() for r in out] == rows
