import re

import numpy as np

from pixelquill.llm import secrets as S

from .conftest import make


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


CASES = ["", "token=abc", "token=abcdef", "TOKEN : 'abc.def=' secret: token: abcdef", "ſecret=abcdefgh", "api_Key=\"x/y+z-1\" apikey:1234567", "AKIA" + "A" * 15, "é AKIA" + "A1" * 8 + "x", "AKIAAKIA" + "Q" * 12, "f" * 23, "0" * 24 + "g" + "a" * 30, "Passwd\t=abcdefg", "password = = abcdef", "🙂 password='hunter22'", "secret=secret=abcdefgh token=token", "K token K: abcdefghi"]


def test_patterns():
    for t in CASES:
        assert S.base_spans(t) == brute(t), t


def test_scan_over_documents(spark, real, edges, empty):
    for docs in (edges, make(spark, CASES), real):
        rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        for r in S.scan(docs).collect():
            got = [(s.start, s.kind, s.end) for s in r.spans]
            assert [s for s in got if s[1] < 3] == brute(rows[r.doc_id] or "")
            assert got == sorted(got)
    assert S.scan(empty).count() == 0


def test_network_tells_secrets_from_numbers_and_words(spark):
    rng = np.random.default_rng(1)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(120)]
    say = lambda: " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(4))
    texts = [f"{say()} token = \"{h}\" {say()}" for h in hexes]
    texts += [f"{say()} {rng.integers(10**15, 10**16)} {say()} www.some-site{k}.example.com/index {say()}" for k in range(150)]
    net = S.train(S.findings(make(spark, texts)))
    ask = lambda t: net.judge([S.windows(t, t.index("~") + 1, len(t) - 4)])[0]
    fresh = ["the key ~" + "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"), 40)) + " end" for _ in range(40)]
    plain = [f"n ~{rng.integers(10**15, 10**16)} end" for _ in range(40)]
    assert np.mean([ask(t) >= net.threshold for t in fresh]) > 0.8
    assert np.mean([ask(t) >= net.threshold for t in plain]) < 0.1


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def draw(rng, letters, n):
    return "".join(rng.choice(list(letters), n))


#: Kinds of secrets that no pattern knows, so none of them is ever labelled positive.
FAMILIES = {
    "mixed-case key": lambda r: draw(r, ALNUM, 40),
    "prefixed key": lambda r: "ghp_" + draw(r, ALNUM, 36),
    "base64": lambda r: draw(r, ALNUM + "+/", 43) + "=",
    "upper-case key": lambda r: draw(r, ALNUM[:26] + "0123456789", 32),
    "three dotted parts": lambda r: ".".join(draw(r, ALNUM + "-_", n) for n in (36, 60, 43)),
    "base32": lambda r: draw(r, ALNUM[:26] + "234567", 32),
    "upper-case hex": lambda r: draw(r, "0123456789ABCDEF", 32),
    "hex with dashes": lambda r: "-".join(draw(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
}


def test_recall_on_families_it_never_saw(spark):
    """Fitted on documents with a few such secrets among the unlabelled: each family at 0.9 or more, other runs left alone."""
    rng = np.random.default_rng(6)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(600).collect()]
    put = lambda t, secret: t[: t.find(" ", len(t) // 2) + 1] + secret + t[t.find(" ", len(t) // 2) :]
    planted = [(f, put(texts[rng.integers(600)] + " end of text", draw_one(rng))) for f, draw_one in FAMILIES.items() for _ in range(2)]
    docs = make(spark, texts + [t for _, t in planted])
    found = S.scan(docs).collect()
    assert sum(any(s.kind == 3 for s in r.spans) for r in found if r.doc_id >= 600) >= 13
    assert sum(any(s.kind == 3 for s in r.spans) for r in found if r.doc_id < 600) <= 6
    assert all(s.p is None or 0 <= s.p <= 1 for r in found for s in r.spans) and any(s.kind == 0 and s.p for r in found for s in r.spans)
    net = S.train(S.findings(docs))
    ask = lambda t: net.judge([S.windows(t, 5, len(t) - 4)])[0] >= net.threshold
    for f, draw_one in FAMILIES.items():
        recall = np.mean([ask("note " + draw_one(rng) + " end") for _ in range(60)])
        assert recall >= 0.9, (f, recall)
    plain = ["note www.{}-{}.example.org/{}/index.html end".format(*rng.choice(["river", "garden", "market", "winter", "harbour", "letters"], 3)) for _ in range(60)]
    assert np.mean([ask(t) for t in plain]) <= 0.1  # no such address is in the documents


def test_joined_words_are_made_of_the_surroundings():
    rng = np.random.default_rng(2)
    x = np.frombuffer(S.windows("some plain words " + "q" * 40 + " there", 17, 57), np.uint8).reshape(1, -1)
    made = S.joined(x, rng, 50)
    inside = [bytes(r[S.BEFORE : S.BEFORE + S.INSIDE]).rstrip(b"\x00").decode() for r in made]
    assert all(S.MIN_RUN <= len(t) <= S.INSIDE and S.CANDIDATE.fullmatch(t) for t in inside)
    assert any("plain" in t.lower() for t in inside)
    assert len(S.joined(np.full((3, S.LENGTH), 32, np.uint8), rng, 5)) == 0


def test_what_stands_beside_a_pattern_is_judged_too():
    text = "x/" + "0123456789abcdef01234567" + "/" + "Q7x" * 10 + " y"
    spans = S.base_spans(text)
    assert [s[1] for s in spans] == [2]
    assert S.beside(0, len(text) - 2, spans) == [(26, len(text) - 2)]
    assert S.beside(0, 40, []) == [] and S.beside(0, 40, [(0, 2, 30)]) == []


def test_without_labels_nothing_is_added(spark):
    out = S.scan(make(spark, ["nothing", "AbCdEfGh0123456789AbCdEfGh0123456789", None])).collect()
    assert all(not r.spans for r in out)


def test_redaction(spark, edges):
    docs = S.redact(edges)
    assert docs.columns == edges.columns and docs.count() == edges.count()
    texts = {r.row: (r.text, r.n_chars) for r in docs.collect()}
    before = {r.row: (r.text, r.n_chars) for r in edges.collect()}
    changed = [k for k in before if texts[k] != before[k]]
    assert changed == [15] and texts[15][0] == "[secret] and [secret]".replace("[secret] and", "[secret]\" and") and texts[15][1] == len(texts[15][0])


def test_all_findings_train_in_any_number_of_shards(spark):
    """Three shards learn as one does, every finding is in one of them, and partitions change nothing."""
    rng = np.random.default_rng(8)
    say = lambda: " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(4))
    texts = [f"{say()} token = \"{draw(rng, '0123456789abcdef', 40)}\" {say()}" for _ in range(200)]
    texts += [f"{say()} {rng.integers(10**15, 10**16)} {say()} www.some-site{k}.example.com/index {say()}" for k in range(300)]
    docs = make(spark, texts)
    found = S.findings(docs)
    distinct = {(bytes(c.windows[: S.LENGTH]), c.hit) for r in found.collect() for c in r.found if not c.part}
    nets = [S.train(f, shard=300) for f in (found, S.findings(docs.repartition(7)))]
    assert np.array_equal(S._packed(nets[0]), S._packed(nets[1])) and nets[0].threshold == nets[1].threshold
    ask = lambda t: nets[0].judge([S.windows(t, t.index("~") + 1, len(t) - 4)])[0]
    assert np.mean([ask("the key ~" + draw(rng, ALNUM, 40) + " end") >= nets[0].threshold for _ in range(40)]) > 0.8
    assert np.mean([ask(f"n ~{rng.integers(10**15, 10**16)} end") >= nets[0].threshold for _ in range(40)]) < 0.1
    assert len(distinct) > 700
