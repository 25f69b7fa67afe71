"""URL filters: rules, and naive Bayes over segmented host and path tokens.

Concatenated names in hosts and paths are split into words by a unigram Viterbi
search.  Its word counts come from all pages' texts: distinct name parts are cut
into substrings, which are joined with the counted words, so neither the names nor
the vocabulary is ever held in one place; the search itself runs per name.

A url that a rule fits trains the multinomial naive Bayes model with the rule's
verdict; token counts are gathered by a grouped aggregate, and urls are scored by
joining their tokens with those counts.  Every occurrence of a token counts, as
(occurrences + 1) / (tokens of the class + vocabulary); the vocabulary is that of the
trained urls, and other tokens do not count.  The rule's verdict stands; other urls
get the model's.  Names and tokens that very many urls share ("com", "www") are
joined by a broadcast of the few hot ones.

Cases: a null url, or one without "://", has an empty host and path, no tokens and
the verdict of the classes' shares; names and words may have any length; a url
without letters or digits has no tokens; repeated
pages are judged each; an empty table gives no rows; without trained rows every
verdict is "allow".
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import join_by_key, kept

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words up to this length are looked up by every substring of a name, longer ones by their first SHORT characters.
SHORT = 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules, a host with its subdomains and a path's beginning each.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER_CASE)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first "://": the host up to / ? # in lower case, the path up to ? #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null where none does."""
    best = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best if best is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def name_parts(host: Column, path: Column) -> Column:
    """(place, part) of each run of letters and digits of host and path."""
    cut = "(?:[a-z0-9]|[^\\x00-\\x7F])+"
    tag = lambda place, c: F.transform(F.regexp_extract_all(c, F.lit(f"({cut})"), F.lit(1)), lambda p: F.struct(F.lit(place).alias("place"), p.alias("part")))
    return F.concat(tag("h", host), tag("p", lower_ascii(path)))


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts: runs of letters and digits, lower case, without markup's tags."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?s)<[^>]*>", " ")
    words = F.explode(F.split(lower_ascii(plain), r"(?:(?![a-z0-9])[\x00-\x7F])+")).alias("word")
    return texts.select(words).where(F.length("word") > 0).groupBy("word").agg(F.count("*").alias("n"))


def segment(part: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split into known words; unknown pieces pay for every character."""
    n, per = len(part), math.log(10)
    sizes = sorted({len(w) for w in cost}, reverse=True)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    origin = 0  # where an unknown piece begins at best: its price is best[origin] + unknown + per * (end - origin)
    for end in range(1, n + 1):
        best[end], back[end] = best[origin] + unknown + per * (end - origin), origin
        for size in sizes:
            if size <= end and (price := cost.get(part[end - size : end])) is not None and best[end - size] + price < best[end] - 1e-12:
                best[end], back[end] = best[end - size] + price, end - size
        if best[end] - per * end < best[origin] - per * origin - 1e-12:
            origin = end
    out, end = [], n
    while end:
        out.append(part[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(part, tokens) for distinct parts."""
    total = words.agg(F.sum("n").alias("total")).collect()[0]["total"] or 0
    place = F.explode(F.sequence(F.lit(1), F.length("part"))).alias("at")
    pieces = parts.select("part", place).select("part", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(SHORT), F.length("part") - F.col("at") + 1))).alias("len"))
    short = pieces.select("part", F.substr("part", "at", "len").alias("word")).distinct().join(words, "word")
    heads = pieces.where(F.col("len") == SHORT).select("part", "at", F.substr("part", "at", "len").alias("head"))
    long = heads.join(words.where(F.length("word") > SHORT).select(F.substring("word", 1, SHORT).alias("head"), "word", "n"), "head")
    long = long.where(F.substr("part", "at", F.length("word")) == F.col("word")).select("part", "word", "n").distinct()
    found = short.select("part", "word", "n").unionAll(long).groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # words inside one name
    unknown = math.log(total + 1.0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).to_pylist()
            tokens = [segment(p, {k["word"]: unknown - math.log(k["n"]) for k in (ks or [])}, unknown) for p, ks in zip(batch.column(0).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], ["part", "tokens"])

    return parts.join(found, "part", "left").mapInArrow(split, "part string, tokens array<string>")


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES) -> DataFrame:
    """Per page: id, host, path, rule, verdict and the model's log odds of "block"."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = kept(rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)))
    shares = {r["verdict"]: r["count"] for r in rows.where("fit IS NOT NULL").groupBy(F.col("fit.verdict").alias("verdict")).count().collect()}
    block, allow = shares.get("block", 0), shares.get("allow", 0)

    tagged = rows.select("row", "fit", F.explode(name_parts(F.col("host"), F.col("path"))).alias("p")).select("row", F.col("fit.verdict").alias("verdict"), F.col("p.place").alias("place"), F.col("p.part").alias("part"))
    tagged = kept(tagged)
    parts = kept(tagged.select("part").distinct())
    tokens = kept(segmented(parts, kept(word_counts(pages, text_col))))
    # Tokens of a host and of a path count apart; digits stand for their length.
    named = lambda t: F.concat(F.col("place"), F.lit(":"), F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t))
    each = join_by_key(tagged, tokens, "part").select("row", "verdict", "place", F.explode("tokens").alias("t")).select("row", "verdict", named(F.col("t")).alias("token"))
    each = kept(each.groupBy("row", "verdict", "token").agg(F.count("*").alias("n")))
    of = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(F.lit(0)))
    counted = kept(each.where("verdict IS NOT NULL").groupBy("token").agg(of("block").alias("b"), of("allow").alias("a")))
    whole = counted.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).collect()[0]
    all_block, all_allow = (whole["b"] or 0) + whole["v"], (whole["a"] or 0) + whole["v"]
    odds = F.log((F.col("b") + 1) / F.lit(all_block)) - F.log((F.col("a") + 1) / F.lit(all_allow))
    scored = join_by_key(each, counted.select("token", odds.alias("odds")), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("odds")).alias("odds"))
    prior = math.log((block + 1) / (allow + 1))
    total = F.lit(prior) + F.coalesce("odds", F.lit(0.0))
    model = F.when(total > 0, F.lit("block")).otherwise(F.lit("allow")) if block and allow else F.lit("allow" if allow or not block else "block")
    out = rows.join(scored, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), model).alias("verdict"), F.round(total, 9).alias("log_odds"))
