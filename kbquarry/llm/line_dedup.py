"""Removes lines that many distinct sites share (DataFrame functions only).

Each line hash gets a HyperLogLog sketch of its sites; sketches merge by aggregation, map side first.  Estimates far
from the threshold decide; lines near it get exact distinct counts.  Lines on ``min_sites`` sites or more are
candidates.  They are counted again with copies of one document as one site (the smallest of those with the line), since a
copied document's lines are no boilerplate: exact copies by the hash of the text; near copies, sought among the texts at least
a quarter of whose characters lie in candidates, by bottom-k sketches of word shingles (both hold five eighths of the ``SKETCH``
smallest hashes of either; a text is compared with the first text of each bucket that it falls into, so the work is
linear).  What is shared may be a long footer, so two texts are copies only if what each has besides candidate lines is a
twentieth of its words at most, or if half of its word triples are in the other text: edited lines are, pages' own words
aren't.  Lines that still have ``min_sites`` sites are
boilerplate and go from every document that keeps a line of its own; a document of nothing but boilerplate is left whole.

Defined cases: a null text stays null; lines without a word are kept and never counted; a null site is a site of its own;
repeated rows and repeated lines count once per site; an empty table gives an empty table; lines of any length are
hashed whole (128 bits); rows are known by a hash of id and text, so that null ids are cleaned too; ties can't occur.
Further columns are kept, but for n_lines and n_removed, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from .common import ascii_lower, save, text_words

#: log2 of a sketch's registers, and the band around the threshold in which exact counts decide: six deviations.
LG_K, BAND = 10, 0.2
#: Shingle hashes that a text is known by, how many of them are bucket keys, words of a shingle.
SKETCH, KEYS, SHINGLE = 64, 3, 5
#: Texts of whose characters candidates hold at least one in so many are looked at as copies.
SHARE = 4
SPACES = " \t\n\x0b\x0c\r"


def _folded(line: Column) -> Column:
    """ascii_lower(), for lines of ASCII alone by the faster lower()"""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(ascii_lower(line))


def line_keys(text: Column) -> Column:
    """Of each line n, its length, and k, 128 bits of it without outer white space, A-Z folded; k is null for lines without a
    word.  Every line is trimmed and folded once: in steps, since a lambda evaluates what it names as often as it names
    it."""
    bare = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(x).alias("n"), F.btrim(x, F.lit(SPACES)).alias("x")))
    low = F.transform(bare, lambda s: F.struct(s["n"].alias("n"), _folded(s["x"]).alias("x")))
    key = lambda x: F.when(F.length(x) > 0, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    return F.transform(low, lambda s: F.struct(s["n"].alias("n"), key(s["x"]).alias("k")))


def boilerplate(rows: DataFrame, min_sites: int) -> DataFrame:
    """(a, b) of the lines on at least ``min_sites`` distinct sites, from ``rows`` (site, a, b)."""
    sketches = rows.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    known = save(sketches.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - max(2, BAND * min_sites)), "line-spread")
    near = known.where(F.col("sites") <= min_sites + max(2, BAND * min_sites)).select("a", "b")
    exact = rows.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("sites"))
    far = known.where(F.col("sites") > min_sites + max(2, BAND * min_sites))
    return save(far.select("a", "b").unionByName(exact.where(F.col("sites") >= min_sites).select("a", "b")), "boilerplate")


def text_sketches(texts: DataFrame) -> DataFrame:
    """t, m (the text's MD5), sketch (the smallest distinct shingle hashes, rising) of ``texts`` (t, text), once for each t.
    Hashes are eight hexadecimal digits of MD5, which other engines know too."""
    words = texts.select("t", F.md5("text").alias("m"), text_words(ascii_lower(F.col("text"))).alias("w"))
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - SHINGLE + 1, F.lit(1)))
    shingles = F.transform(at, lambda i: F.substring(F.md5(F.array_join(F.slice("w", i, SHINGLE), " ")), 1, 8))
    sketch = F.slice(F.sort_array(F.array_distinct(shingles)), 1, SKETCH).alias("sketch")
    # asked above the aggregation: below it, the filter would sink to the scan and split every text of the table
    return words.select("t", "m", sketch, (F.size("w") > 0).alias("any")).dropDuplicates(["t"]).where("any").drop("any")


def _triples(words: Column) -> Column:
    """Hashes of the distinct word triples"""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(words, i, 3))))


def _similar(texts: DataFrame) -> DataFrame:
    """(a, b) of texts (t, text) with like sketches; b is in a bucket whose first text is a."""
    keyed = save(text_sketches(texts).select("t", "m", "sketch", F.explode(F.slice("sketch", 1, KEYS)).alias("key")), "copy-keys")
    first = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("m", "t", "sketch")).alias("one")).where("n > 1")
    pairs = keyed.join(first.select("key", F.col("one.t").alias("a"), F.col("one.sketch").alias("other")), "key").where("t <> a")
    pairs = pairs.select("a", "t", F.array_intersect("sketch", "other").alias("both"), F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH).alias("least"))
    return save(pairs.where(8 * F.size(F.array_intersect("least", "both")) >= 5 * F.size("least")).select("a", F.col("t").alias("b")).distinct(), "like-texts")


def copies(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(node, component) of the texts (t, text) that have a near copy among them; ``places`` (t, bad): their candidate lines."""
    pairs = _similar(texts)
    needed = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    known = texts.join(needed, "t", "left_semi").dropDuplicates(["t"]).join(places, "t").withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "bad")
    rest = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    known = known.select("t", text_words(ascii_lower(F.col("text"))).alias("w"), text_words(ascii_lower(rest)).alias("r"))
    known = save(known.select("t", _triples(F.col("w")).alias("all"), _triples(F.col("r")).alias("own"), (20 * F.size("r") <= F.size("w")).alias("few")), "copy-words")
    for side in "ab":
        pairs = pairs.join(known.select(F.col("t").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("all", "own", "few")]), side)
    held = lambda x, y: F.col(f"few_{x}") | (2 * F.size(F.array_intersect(f"own_{x}", f"all_{y}")) >= F.size(f"own_{x}"))
    return connected_components(pairs.where(held("a", "b") & held("b", "a")).select("a", "b"))


def independent(docs: DataFrame, shared: DataFrame, min_sites: int) -> DataFrame:
    """(a, b) of the candidate lines ``shared`` (r1, r2, t, total, size, site, a, b) on ``min_sites`` sites or more, copies as
    one."""
    share = shared.groupBy("r1", "r2", "i", "t", "total").agg(F.first("size").alias("size"))  # a repeated row counts once
    share = share.groupBy("r1", "r2", "t", "total").agg(F.sum(F.col("size") + 1).alias("size"))
    wanted = save(share.where(SHARE * F.col("size") >= F.col("total")).select("t").distinct(), "mostly-shared")
    places = shared.join(wanted, "t", "left_semi").groupBy("t").agg(F.collect_set("i").alias("bad"))  # places in one text
    found = copies(docs.select(F.xxhash64("text").alias("t"), "text").join(wanted, "t", "left_semi"), places)
    homes = shared.groupBy("a", "b", "t").agg(F.min("site").alias("site"))
    homes = homes.join(found.withColumnRenamed("node", "t"), "t", "left").groupBy("a", "b", F.coalesce("component", "t").alias("copy")).agg(F.min("site").alias("site"))
    counts = homes.select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("sites"))
    return save(counts.where(F.col("sites") >= min_sites).select("a", "b"), "independent")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """``docs`` with its text cleaned, plus n_lines and n_removed (long; null text: 0)."""
    where = F.coalesce(F.col(site).cast("string"), F.lit("\x01")).alias("site")
    row = [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2")]  # never null
    # texts are hashed below the explode, else each line would hash its whole text; explode's own filter would split them again
    rows = docs.select(*row, F.xxhash64("text").alias("t"), F.length("text").alias("total"), where, line_keys(F.col("text")).alias("lines"))
    rows = rows.select("r1", "r2", "t", "total", "site", F.posexplode_outer("lines").alias("i", "x")).where(F.col("x.k").isNotNull())
    rows = save(rows.select("r1", "r2", "t", "total", "site", "x.k.a", "x.k.b", "i", F.col("x.n").alias("size")), "line-keys")  # texts are split and hashed once for all that follows
    shared = save(rows.join(boilerplate(rows, min_sites), ["a", "b"], "left_semi"), "shared-lines")
    found = independent(docs, shared, min_sites)
    own = shared.join(found, ["a", "b"], "left_semi").groupBy("r1", "r2").agg(F.collect_set("i").alias("bad"))  # places in one text
    # the input's columns travel in a struct, where their names can't clash with those used here
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), *row)
    step = keyed.join(own, ["r1", "r2"], "left").withColumn("lines", F.split("doc.text", "\n", -1)).withColumn("left", F.when(F.col("bad").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "bad")))
    step = step.withColumn("stay", F.transform("left", lambda i: F.get("lines", i)))
    takes = F.coalesce(F.exists("stay", lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0), F.lit(False))
    text = F.when(takes, F.array_join("stay", "\n")).otherwise(F.col("doc.text")).alias("text")
    return step.select(
        *[text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("doc.text").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(takes, F.size("bad")).otherwise(0).cast("long").alias("n_removed"),
    )
