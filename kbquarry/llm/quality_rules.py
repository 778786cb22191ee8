"""Quality rules of documents and of their hosts (DataFrame functions only).

Base figures of a text come from projections, without a shuffle.  Rule failures are then summed by domain, each
domain's rate is drawn towards the pooled rate by a beta prior fitted to the spread of the domains (method of moments),
and a domain is rejected if the lower bound of its posterior rate is over ``reject_over``.  Verdicts join back.

Defined cases: null and empty texts have no words and fail; a null domain is never rejected; repeated rows count as
often as they occur; an empty table gives an empty table; texts of any length are taken whole, in n log n; ties can't
occur.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_words
from .url_filter import beta_prior

#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def base_figures(docs: DataFrame, domain: str = "source") -> DataFrame:
    """doc_id, domain and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    line = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), F.xxhash64(x)))
    step = docs.select(
        "doc_id",
        F.col(domain).alias("domain"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.filter(line, lambda x: x.isNotNull()).alias("lines"),
        F.transform(text_words(text), lambda w: F.xxhash64(w)).alias("words"),
    )
    base = ("doc_id", "domain", "word_chars", "n_symbols")
    keys = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(WINDOW)]))
    step = step.select(*base, (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("words").alias("n_words"), F.when(F.size("words") >= WINDOW, keys).alias("keys"))
    # only texts in which two windows are equal have them sorted, with their places
    repeats = F.size(F.array_distinct("keys")) < F.size("keys")
    pairs = F.array_sort(F.transform("keys", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(*base, "n_dup_lines", "n_words", F.when(repeats, pairs).alias("pairs"))
    equal = lambda x, k: F.coalesce(F.get("pairs", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("pairs", k + 1)["h"] == x["h"], F.lit(False))
    step = step.select(*base, "n_dup_lines", "n_words", F.array_sort(F.transform(F.filter("pairs", equal), lambda p: p["i"])).alias("places"))
    cover = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    step = step.withColumn("n_repeat_words", F.coalesce(_total(cover), F.lit(0)))
    return step.select("doc_id", "domain", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def quality(docs: DataFrame, domain: str = "source", reject_over: float = 0.5, z: float = 1.645) -> DataFrame:
    """base_figures() plus base_failed, domain_rate (posterior mean) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    base = save(base_figures(docs, domain).withColumn("base_failed", failed), "quality-base")
    domains = base.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("k"))
    p, s = beta_prior(domains)
    mean = (F.col("k") + s * p) / (F.col("n") + s)
    rates = domains.select("domain", mean.alias("domain_rate"), (mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + s + 1))).alias("lower"))
    out = base.join(rates, "domain", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("lower"), F.lit(0.0)) <= reject_over)).drop("lower")
