import collections
import math
import random
import re

from pixelquill.llm import url_filter as U

from .conftest import SF

URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x", "https://example.org/en/12#y", "http://notexample.org/es/", "x://sub.example.org", "http://a.com/fr/é?b://c/d", "ftp://COM/de/", "http://b.com/de", "http://x.net:80/Path/To", "://org/", "http://exampleorg/es/", "http://Éa.COM/fr/x", "http://user@h.org?q", "http://a.b.org#f/es/"]


def parse(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u[u.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>some words words</p>", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, html string, odds double")
    rows = {r.page_id: r for r in U.url_filter(pages).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parse(u)
        assert (rows[i].host, rows[i].path) == (host, path), u
        name, verdict = rule(host, path)
        assert rows[i].rule == name, u
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")


def test_naive_bayes_against_counts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = U.url_filter(pages).collect()
    words = {r.word: r.n for r in U.word_counts(pages, "html").collect()}
    unknown = math.log(sum(words.values()) + 1.0)
    cost = {w: unknown - math.log(n) for w, n in words.items()}

    def tokens(r):
        out = []
        for place, text in (("h", r.host), ("p", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.path))):
            for part in re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", text):
                out += [f"{place}:" + (f"#{len(t)}" if re.fullmatch("[0-9]+", t) else t) for t in U.segment(part, cost, unknown)]
        return out

    bags = {v: [t for r in rows if r.rule and r.verdict == v for t in tokens(r)] for v in ("allow", "block")}
    urls = {v: sum(r.verdict == v for r in rows if r.rule) for v in bags}
    seen = {v: collections.Counter(b) for v, b in bags.items()}
    vocabulary = set(bags["allow"]) | set(bags["block"])
    for r in rows:
        p = {v: math.log(urls[v] + 1) + sum(math.log((seen[v][t] + 1) / (len(bags[v]) + len(vocabulary))) for t in tokens(r) if t in vocabulary) for v in bags}
        assert abs(p["block"] - p["allow"] - r.log_odds) < 1e-6
        if r.rule is None:
            assert r.verdict == ("block" if p["block"] > p["allow"] else "allow")


def splits(part):
    if not part:
        yield []
    for k in range(1, len(part) + 1):
        for rest in splits(part[k:]):
            yield [part[:k], *rest]


def test_segmentation_against_all_splits():
    rng = random.Random(4)
    cost = {w: 1 + rng.random() * 6 for w in ("a", "ab", "abc", "bca", "cab", "b", "aaaa", "cc", "abcab")}
    price = lambda ws: sum(cost.get(w, 8.0 + math.log(10) * len(w)) for w in ws)
    for _ in range(60):
        part = "".join(rng.choice("abcx") for _ in range(rng.randrange(1, 11)))
        got = U.segment(part, cost, 8.0)
        assert "".join(got) == part and abs(price(got) - min(price(s) for s in splits(part))) < 1e-9


def test_names_and_words_of_any_length(spark):
    """No length hides a name or a word from the model."""
    word = "pneumonoultramicroscopicsilicovolcanoconiosis"
    name = word + "shop" + "q" * 90 + "free" + word
    texts = [(w,) for w in [word] * 4 + ["shop"] * 5 + ["free"] * 5]
    parts = spark.createDataFrame([(name,), (word,)], "part string")
    words = U.word_counts(spark.createDataFrame(texts, "html string"), "html")
    got = {r.part: r.tokens for r in U.segmented(parts, words).collect()}
    assert got[word] == [word] and got[name] == [word, "shop", "q" * 90, "free", word]


def test_hot_names(spark):
    """A third of all urls share a host; joins by broadcast and by exchange agree with the counts."""
    pages = spark.createDataFrame([(i, f"http://hot.com/{'de' if i % 6 else 'fr'}/p{i}" if i % 3 == 0 else f"http://h{i}.net/x{i}", "p") for i in range(3000)], "page_id long, url string, html string")
    rows = U.url_filter(pages).collect()
    assert len(rows) == 3000 and len({r.page_id for r in rows}) == 3000
    assert {r.rule for r in rows if r.page_id % 3 == 0} == {"com/de/", "com/fr/"}


def test_segmentation_is_the_cheapest():
    cost = {"cheap": 3.0, "pills": 3.0, "che": 6.0, "ap": 6.0, "free": 2.0, "bets": 2.0}
    assert U.segment("cheappills", cost, 10.0) == ["cheap", "pills"]
    assert U.segment("freebets", cost, 10.0) == ["free", "bets"]
    assert U.segment("", cost, 10.0) == []
    assert "".join(U.segment("xyzfreeq", cost, 10.0)) == "xyzfreeq"


def test_repeats_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", None), (1, "http://a.org/x", None), (None, None, "")], "page_id long, url string, html string")
    assert U.url_filter(pages).count() == 3
    assert U.url_filter(pages.limit(0)).count() == 0


def test_query_is_multinomial(spark, tmp_path):
    """Whole words as tokens, so that the model can be written down on its own."""
    from pixelquill.llm.queries import QUERIES

    urls = ["http://b.com/de/spam/spam/spam", "http://c.com/de/spam/x", "http://d.com/fr/news/news", "http://e.org/news/spam/page/page/page", "http://f.net/spam/spam/news", "http://g.net/news/news/news/spam", "http://h.net/12/345"]
    names = sorted({w for u in urls for w in re.findall("[a-z]+", u.split("://")[1])})
    spark.createDataFrame([(i, u, " ".join(names)) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op7_url_filter"](spark, str(tmp_path)).collect()}
    bags = []
    for u in urls:
        host, path = parse(u)
        bags.append([f"{place}:" + (f"#{len(t)}" if t.isdigit() else t) for place, text in (("h", host), ("p", path)) for t in re.findall("[a-z0-9]+", text)])
    seen = {v: [t for i, b in enumerate(bags) if rule(got[i].host, got[i].path)[1] == v for t in b] for v in ("block", "allow")}
    n = {v: sum(rule(got[i].host, got[i].path)[1] == v for i in range(len(urls))) for v in seen}
    vocabulary = set(seen["block"]) | set(seen["allow"])
    for i, b in enumerate(bags):
        p = {v: math.log(n[v] + 1) + sum(math.log((seen[v].count(t) + 1) / (len(seen[v]) + len(vocabulary))) for t in b if t in vocabulary) for v in seen}
        assert abs(p["block"] - p["allow"] - got[i].log_odds) < 1e-6, urls[i]
        assert got[i].rule is not None or got[i].verdict == ("block" if p["block"] > p["allow"] else "allow")
