"""Quality rules with adaptive thresholds.

Fixed cutoffs that suit one language or site fail on another.  Here each
measure's cutoff comes from its own distribution, read from a quantile sketch per language
and source: a histogram whose buckets keep the leading DIGITS bits of the measure in
units of 2^-20, so a bucket is at most 1/128 as wide as its values.  Sketches merge by adding
counts (partial aggregation, so a hot source never meets in one task), have no
chance in them and do not depend on how rows are dealt out: verdicts are the same in every
run.  The high cutoff is the fence FENCE interquartile ranges beyond the upper quartile, but
never nearer than the quantile NEAR and never farther than FAR: so a long tail fails
from NEAR on, an even distribution from FAR on, and where all values are the same none fails
(quantiles count as their bucket's far edge).  No cutoff has a fixed value in it.

Cases: a null or empty text has no words, fails the base rule and is not kept.
Null or absent languages and sources form groups of their own.  Repeated rows are judged
each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import kept
from ._text import LINE, SPACED, Words, covered, mix, ngrams, per_text, pieces, span_hashes, texts_of

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3

STATS = "id {id}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"

_symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_lead = (np.arange(256) & 0xC0) != 0x80

#: Measure -> (expression, which sides count).
MEASURES = {
    "symbol_ratio": ("n_symbols / n_words", "high"),
    "dup_line_ratio": ("n_dup_lines / greatest(n_lines, 1)", "high"),
    "repeat_ratio": ("n_repeat_words / n_words", "high"),
    "word_length": ("word_chars / n_words", "both"),
}
#: Width of the fence beyond a quartile, in interquartile ranges.
FENCE = 4
#: Thousandths of the ranks that a high cutoff stays between; a low one is their mirror image.
NEAR, FAR = 970, 995
#: Units of a measure, and leading bits that tell buckets apart.
UNITS, DIGITS = 1 << 20, 8


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    code, _ = pd.factorize(keys)
    return np.bincount(code)[code] > 1


def measure(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    """The counts of each text of a small batch."""
    data, off = texts_of(batch.column(batch.schema.get_field_index(text)))
    words = Words(data, off, SPACED)
    at_text = lambda flags: per_text(flags.astype(np.int8), off)
    lines = Words(data, off, LINE)
    in_words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.inside, out=in_words[1:])
    full = in_words[lines.end] > in_words[lines.start]
    with np.errstate(over="ignore"):
        line_key = (span_hashes(data, lines.start, lines.end) ^ mix(lines.text.astype(np.uint64)))[full]
    seen = pd.Series(line_key).duplicated().to_numpy() if len(line_key) else np.zeros(0, bool)
    full_first = np.searchsorted(np.flatnonzero(full), lines.first)
    gram, at = ngrams(words.hashes(), words.first, WINDOW)
    with np.errstate(over="ignore"):
        twice = repeats(gram ^ mix(words.text[at].astype(np.uint64)))
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": at_text(words.inside & _lead[data]),
        "n_symbols": at_text(_symbol[data]),
        "n_dup_lines": per_text(seen.astype(np.int8), full_first),
        "n_lines": np.diff(full_first).astype(np.int64),
        "n_repeat_words": per_text(covered(at[twice], WINDOW, len(words)).astype(np.int8), words.first),
    }


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            out = {"id": piece.column(0), "lang": piece.column(1), "source": piece.column(2)}
            out |= {k: pa.array(v, pa.int64()) for k, v in measure(piece, "text").items()}
            yield pa.RecordBatch.from_pydict(out)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of counts per row of docs, the id named `id`."""
    kind = dict(docs.dtypes)[id_col]
    have = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), have(lang_col).alias("lang"), have(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_stats, STATS.format(id=kind))


def in_units(measure_sql: str) -> Column:
    return F.floor(F.expr(measure_sql) * UNITS).cast("long")


def sketch(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, low, high, n): the buckets of each group's measures, with their edges in units."""
    listed = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), in_units(e).alias("v")) for m, (e, _) in MEASURES.items())))
    rows = stats.where(F.col("n_words") > 0).select("lang", "source", listed.alias("m")).select("lang", "source", "m.*")
    placed = rows.withColumn("s", F.greatest(F.length(F.bin("v")) - DIGITS, F.lit(0))).withColumn("low", F.expr("shiftleft(shiftright(v, s), s)"))
    return placed.groupBy("lang", "source", "measure", "low", (F.col("low") + F.expr("shiftleft(1L, s)") - 1).alias("high")).agg(F.count("*").alias("n"))


def thresholds(stats: DataFrame) -> DataFrame:
    """Per language and source, the low and high cutoff of each measure, in units."""
    w = Window.partitionBy("lang", "source", "measure")  # the buckets of a group, a few thousand at most
    ranked = sketch(stats).withColumn("upto", F.sum("n").over(w.orderBy("low"))).withColumn("total", F.sum("n").over(w))

    def at(edge: str, thousandths: int) -> Column:
        """The edge of the bucket that holds a rank."""
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * thousandths / 1000), F.col(edge)))

    room = FENCE * (at("high", 750) - at("low", 250))
    most = F.least(F.greatest(at("high", 750) + room, at("high", NEAR)), at("high", FAR))
    least = F.greatest(F.least(at("low", 250) - room, at("low", 1000 - NEAR)), at("low", 1000 - FAR))
    cut = ranked.groupBy("lang", "source", "measure").agg(most.alias("most"), least.alias("least"))
    own = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return cut.groupBy("lang", "source").agg(*(own(m, c) for m in MEASURES for c in ("least", "most")))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every row's counts with base_failed, failed_rules and kept."""
    stats = kept(document_stats(docs, id_col, text_col, lang_col, source_col))
    limits = thresholds(stats).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    beyond = lambda m, e, side: (in_units(e) > F.col(f"{m}_most")) | ((in_units(e) < F.col(f"{m}_least")) if side == "both" else F.lit(False))
    outside = [F.when(beyond(m, e, side), F.lit(m)) for m, (e, side) in MEASURES.items()]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.when(F.col("n_words") > 0, F.array_compact(F.array(*outside))).otherwise(F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed_rules")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
